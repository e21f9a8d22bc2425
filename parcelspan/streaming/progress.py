"""Progress of streaming queries as rows: what was read and how far behind a broker source is."""

from __future__ import annotations

import json
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

LAG = (
    "consumer_group string, topic string, kafka_partition int, committed_offset bigint, end_offset bigint,"
    " lag bigint, measured_at string"
)


def progress_rows(spark: SparkSession, target: str) -> DataFrame:
    """What every batch of an ingest has read, from the log it writes itself: no batch is forgotten."""
    return spark.read.parquet(f"{target}/ingest_batches")


def lag_rows(progress: dict, group: str, low: dict | None = None) -> list[tuple]:
    """One row per topic and partition of a broker source's progress: end minus committed, never below 0.

    A partition without a commit, or with one that the broker has dropped, counts from `low`, the first
    offset still there (by topic and partition; 0 where it isn't known)."""
    rows = []
    for source in progress["sources"]:
        end, latest = _offsets(source.get("endOffset")), _offsets(source.get("latestOffset"))
        for topic, partitions in latest.items():
            for partition, last in partitions.items():
                committed = end.get(topic, {}).get(partition)
                first = ((low or {}).get(topic) or {}).get(partition, 0)
                behind = max(last - max(committed if committed is not None else first, first), 0)
                rows.append((group, topic, int(partition), committed, last, behind, progress["timestamp"]))
    return rows


def _offsets(value) -> dict:
    return json.loads(value) if isinstance(value, str) else (value or {})


class QuietListener(StreamingQueryListener):
    """A listener of which only the parts that matter are written out."""

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class LagListener(QuietListener):
    """Appends the lag of every batch to a table. The rows are as many as the topic has partitions."""

    def __init__(self, spark: SparkSession, group: str, path: str, low: dict | None = None):
        self.spark, self.group, self.path, self.low = spark, group, path, low

    def onQueryProgress(self, event) -> None:
        rows = lag_rows(json.loads(event.progress.json), self.group, self.low)
        if rows:
            self.spark.createDataFrame(rows, LAG).coalesce(1).write.mode("append").parquet(self.path)


COUNTERS = (
    "table_name string, messages bigint, inserted bigint, duplicates bigint, newest string, run_id string, batch_id bigint"
)


class IngestListener(QuietListener):
    """Appends what the batches of one ingest have read and written: per table the messages, the rows inserted, the repeats, and the newest
    event among the messages. The figures of reading are observed in the stream, before repeats are dropped; those of writing come
    from the batches. Figures are kept back for up to `every` seconds and written at the end; a restarted query goes on with the batch that
    comes next, and only a driver lost between a batch's end and this write takes figures with it."""

    def __init__(self, spark: SparkSession, name: str, target: str, tables: list[str], written: dict, every: float = 10.0):
        self.spark, self.name, self.path, self.tables, self.written = spark, name, f"{target}/ingest_counters", tables, written
        self.every, self.waiting, self.last = every, [], time.monotonic()
        self.run_id, self.ended = None, threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run_id = event.id

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name != self.name or "read" not in progress.observedMetrics:
            return
        done = self.written.pop(progress.batchId, None)
        if done is None:  # nothing was new to the source
            return
        read = progress.observedMetrics["read"]
        for table in self.tables:
            late, inserted = done[table]
            messages = read[table] + late
            if messages:
                self.waiting.append((table, messages, inserted, messages - inserted, read[f"{table}_newest"], str(progress.id), progress.batchId))
        if time.monotonic() - self.last >= self.every:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        if self.run_id is not None and event.id == self.run_id:
            self.ended.set()

    def flush(self) -> None:
        rows, self.waiting, self.last = self.waiting, [], time.monotonic()
        if rows:
            self.spark.createDataFrame(rows, COUNTERS).coalesce(1).write.mode("append").parquet(self.path)

    def close(self, patience: float = 60.0) -> None:
        """Write what is left, after the query's last event has come in."""
        if self.run_id is not None:
            self.ended.wait(patience)
        self.spark.streams.removeListener(self)
        self.flush()
