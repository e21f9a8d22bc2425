"""Topics into bronze tables: one micro-batch is classified once and written as rows and dead letters.

The read is at least once; the write is idempotent by natural key, so a replayed message changes
nothing, whatever its age. No watermark drops late rows.

Which keys are known is the stream's state: one short text a key, in RocksDB, looked up by the keys of the batch. So a batch costs
what its messages cost, however much is held, and no table is read. Of the messages of one key in one batch, the first of
its topic's partition stays. A new query on tables that hold rows already takes their keys into its state with its first batch, once.
A query with a checkpoint goes on from its state; one query writes a target at a time.

The registry of sources is asked again in every batch. Rows whose source was not yet known when the query started have no part in the state;
they are compared with the tables, and their keys are kept aside and compared with later rows. Sources are never taken off the registry.

A batch writes only folders that carry its query and batch number, so a batch run again after a failure
replaces what it had written. Its files hold their day in a column and not in their path: a batch of many days makes no more files than its
size asks for, and readers of a day skip the others' files by their statistics.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parcelspan.operators.contracts import (
    CONTRACTS, Contract, check_sources, classify, dead_letters_of, refuse_unstorable, rows_of,
)
from parcelspan.operators.keyed import absent_rows, first_per_key
from parcelspan.sinks.tables import evenly, replace_folder, table_exists
from parcelspan.streaming.progress import COUNTERS, IngestListener

DEAD_KEY = ("topic", "kafka_partition", "kafka_offset")


class Ingest:
    """A running ingest: the query, and the listener that counts what it has read."""

    def __init__(self, query: StreamingQuery, listener: IngestListener):
        self.query, self.listener, self.id = query, listener, query.id

    def awaitTermination(self) -> None:  # noqa: N802  (as the query's own)
        """Wait for the end of the query and for its last figures to be written."""
        try:
            self.query.awaitTermination()
        finally:
            self.listener.close()

    def stop(self) -> None:
        self.query.stop()
        self.listener.close()


def start_ingest(
    envelopes: DataFrame,
    registry: Callable[[SparkSession], DataFrame],
    target: str,
    checkpoint: str,
    contracts: Sequence[Contract] = CONTRACTS,
    every: str | None = None,
) -> Ingest:
    """Start writing a stream of envelopes under `target`. `registry` is called for every batch, so a
    source registered meanwhile is known without a restart. Without `every` the query takes all that
    is there, in bounded batches, and ends: the way to catch up after downtime."""
    spark = envelopes.sparkSession
    name, written = f"ingest-{uuid.uuid4().hex}", {}
    seed = f"{checkpoint}/held-keys"
    if not table_exists(spark, f"{checkpoint}/offsets"):
        replace_folder(held_keys(spark, target, contracts), seed)

    known = registry(spark).select(F.col("source_id").alias("_source")).distinct().withColumn("_registered", F.lit(True))
    typed = refuse_unstorable(classify(envelopes, None, contracts), contracts)
    source = F.coalesce(*[F.col(c.table)["source"] for c in contracts])
    asked = typed.withColumn("_source", F.when(F.col("reason").isNull(), source)).join(known, "_source", "left").drop("_source")
    keyed = asked.withColumn("_registered", F.coalesce("_registered", F.lit(False))).withColumn("_key", message_key(contracts))
    counted = keyed.observe("read", *read_figures(contracts)).withColumn("_held", F.lit(False))
    held = spark.readStream.schema("_key string").parquet(seed).withColumn("_held", F.lit(True))
    fresh = counted.unionByName(held, allowMissingColumns=True).dropDuplicates(["_key"])

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        run_id = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        new = batch.where(~F.col("_held")).drop("_held")
        if batch_id == 0:
            # The held keys came in with this batch; either of two equal keys may have stayed.
            new = absent_rows(new, session.read.schema("_key string").parquet(seed), ["_key"])
        judged = check_sources(new, registry(session), contracts).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            written[batch_id] = _write(judged, target, run_id, batch_id, contracts, compared=False)
        finally:
            judged.unpersist()

    listener = IngestListener(spark, name, target, [c.table for c in contracts], written)
    spark.streams.addListener(listener)
    writer = fresh.writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    try:
        return Ingest(writer.start(), listener)
    except BaseException:
        listener.close()
        raise


def message_key(contracts: Sequence[Contract]) -> Column:
    """The text that tells messages apart: topic and natural key of a row of a known source, the place in the topic of any other."""
    key = F.to_json(F.array(F.lit("place"), "topic", F.col("partition").cast("string"), F.col("offset").cast("string")))
    for c in contracts:
        mine = F.col("reason").isNull() & F.col("_registered") & (F.col("topic") == c.topic)
        key = F.when(mine, _natural_key(c, [F.col(c.table)[k] for k in c.key])).otherwise(key)
    return key


def _natural_key(contract: Contract, values: Sequence[Column]) -> Column:
    return F.to_json(F.array(F.lit("row"), F.lit(contract.topic), *[v.cast("string") for v in values]))


def held_keys(spark: SparkSession, target: str, contracts: Sequence[Contract]) -> DataFrame:
    """The keys of all rows and dead letters under `target`."""
    keys = spark.createDataFrame([], "_key string")
    for c in contracts:
        if table_exists(spark, f"{target}/{c.table}"):
            rows = spark.read.parquet(f"{target}/{c.table}")
            keys = keys.unionByName(rows.select(_natural_key(c, [F.col(k) for k in c.key]).alias("_key")))
    if table_exists(spark, f"{target}/dead_letters"):
        place = F.to_json(F.array(F.lit("place"), "topic", F.col("kafka_partition").cast("string"), F.col("kafka_offset").cast("string")))
        keys = keys.unionByName(spark.read.parquet(f"{target}/dead_letters").select(place.alias("_key")))
    return keys


def read_figures(contracts: Sequence[Contract]) -> list[Column]:
    """What a batch has read, before repeats are dropped: all messages, and the rows of each table with the newest event."""
    figures = [F.count(F.lit(1)).alias("all")]
    for c in contracts:
        mine = F.col("reason").isNull() & F.col("_registered") & (F.col("topic") == c.topic)
        figures += [F.count_if(mine).alias(c.table), F.max(F.when(mine, F.col(c.table)["event_time"])).cast("string").alias(f"{c.table}_newest")]
    return figures


def write_batch(
    batch: DataFrame, sources: DataFrame, target: str, run_id: str, batch_id: int, contracts: Sequence[Contract] = CONTRACTS
) -> None:
    """Write one batch of envelopes without a stream: its keys are compared with the tables. Rows and dead letters are both keyed,
    so a half-written batch is repaired by running it again."""
    spark = batch.sparkSession
    judged = refuse_unstorable(classify(batch, sources, contracts), contracts).withColumn("_registered", F.lit(True))
    judged = judged.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        done = _write(judged, target, run_id, batch_id, contracts, compared=True)
        rows = [
            (c.table, done[c.table][0], done[c.table][1], done[c.table][0] - done[c.table][1], None, run_id, batch_id)
            for c in contracts if done[c.table][0]
        ]
        if rows:
            spark.createDataFrame(rows, COUNTERS).coalesce(1).write.mode("append").parquet(f"{target}/ingest_counters")
    finally:
        judged.unpersist()


def _write(
    judged: DataFrame, target: str, run_id: str, batch_id: int, contracts: Sequence[Contract], compared: bool
) -> dict[str, tuple[int, int]]:
    """Write the judged messages of a batch: tables, dead letters, one line of the log. Per table the messages that had to be compared
    with it and the rows written. One row is gathered, whatever the batch holds. The log's line comes last."""
    good = F.col("reason").isNull()
    figures = [F.count(F.lit(1)).alias("_all"), F.count_if(~good).alias("_dead")]
    for c in contracts:
        mine = good & (F.col("topic") == c.topic)
        figures += [F.count_if(mine).alias(c.table), F.count_if(mine & ~F.col("_registered")).alias(f"{c.table}_late")]
    found = judged.agg(*figures).first()
    fed = [c for c in contracts if found[c.table]]
    late = {c.table: found[c.table] if compared else found[f"{c.table}_late"] for c in contracts}
    with ThreadPoolExecutor(len(fed) + 2) as together:  # jobs of one cached batch, each into a folder of its own
        dead = together.submit(_write_dead, judged, target, run_id, batch_id, compared) if found["_dead"] else None
        rows = {c.table: together.submit(_write_rows, judged, c, target, run_id, batch_id, compared, bool(late[c.table])) for c in fed}
        written = {table: job.result() for table, job in rows.items()}
        if dead:
            dead.result()
    _write_log(judged.sparkSession, target, run_id, batch_id, found["_all"], found["_dead"])
    return {c.table: (late[c.table], written.get(c.table, 0)) for c in contracts}


def _write_rows(
    judged: DataFrame, contract: Contract, target: str, run_id: str, batch_id: int, compared: bool, late: bool
) -> int:
    """Write the rows of one table and return how many there are. Rows the state has seen to be new are written as they are, unless
    keys of late sources are kept aside."""
    spark, path, aside = judged.sparkSession, f"{target}/{contract.table}", f"{target}/late_keys/{contract.table}"
    rows = rows_of(judged.where("_registered"), contract)
    if late and not compared:
        rows = rows_of(judged, contract)
    if late or table_exists(spark, aside):
        rows = first_per_key(rows, contract.key, ["partition", "offset"])
        held = spark.read.parquet(path).where(~_own(run_id, batch_id)) if late and table_exists(spark, path) else None
        if held is None and table_exists(spark, aside):
            held = spark.read.parquet(aside).where(~_own(run_id, batch_id))
        if held is not None:
            if "event_time" in contract.key:
                held = _same_days(held, rows)
            rows = absent_rows(rows, held, contract.key)
    if late and not compared:
        keys = rows_of(judged.where(~F.col("_registered")), contract).select(*contract.key, "event_time").distinct()
        keys = keys.withColumn("event_date", F.col("event_time").cast("date"))
        replace_folder(keys, f"{aside}/run_id={run_id}/batch_id={batch_id}")
    placed = rows.select(
        *contract.columns, F.current_timestamp().alias("ingested_at"), F.col("event_time").cast("date").alias("event_date")
    )
    own = f"{path}/run_id={run_id}/batch_id={batch_id}"
    replace_folder(evenly(placed), own)
    return spark.read.schema("event_time timestamp").parquet(own).count()  # from the files' footers


def _write_dead(judged: DataFrame, target: str, run_id: str, batch_id: int, compared: bool) -> None:
    spark, path = judged.sparkSession, f"{target}/dead_letters"
    dead = dead_letters_of(judged)
    if compared:
        dead = first_per_key(dead, DEAD_KEY, ["reason"])
        if table_exists(spark, path):
            # A batch covers a stretch of offsets; files of other stretches are skipped by their statistics.
            place = F.col("kafka_offset")
            low, high = dead.agg(F.min(place), F.max(place)).first()
            held = spark.read.parquet(path).where(~_own(run_id, batch_id)).where(place.between(low, high))
            dead = absent_rows(dead, held, DEAD_KEY)
    replace_folder(dead.withColumn("ingested_at", F.current_timestamp()), f"{path}/run_id={run_id}/batch_id={batch_id}")


def _own(run_id: str, batch_id: int) -> Column:
    return (F.col("run_id") == run_id) & (F.col("batch_id") == batch_id)


def _same_days(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """The held rows from the first to the last of the batch's days: files of other days are skipped by their statistics."""
    low, high = fresh.agg(F.min("event_time").cast("date"), F.max("event_time").cast("date")).first()
    return held.where(F.col("event_date").between(F.lit(low), F.lit(high)))


def _write_log(spark: SparkSession, target: str, run_id: str, batch_id: int, messages: int, dead: int) -> None:
    """One row for each batch: unlike the progress Spark remembers, all of them are kept."""
    row = spark.range(0, 1, 1, 1).select(
        F.lit(messages).cast("bigint").alias("n_rows"), F.lit(dead).cast("bigint").alias("n_dead"), F.current_timestamp().alias("measured_at")
    )
    replace_folder(row, f"{target}/ingest_batches/run_id={run_id}/batch_id={batch_id}")
