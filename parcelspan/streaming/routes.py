"""The KPI as running aggregates over the streams: no state of its own beyond one row per route."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parcelspan.operators.keyed import latest_per_key
from parcelspan.sinks.tables import replace_partitions


def start_updates(aggregate: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep every change of a streaming aggregate: each batch writes its changed rows to a folder of its
    own, and writing a batch again replaces that folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        replace_partitions(batch.withColumn("batch_id", F.lit(batch_id)), path, ["batch_id"], balance=False)

    writer = aggregate.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def current(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The latest state of every key."""
    return latest_per_key(updates, keys, ["batch_id"]).drop("batch_id")


def daily_tally(scans: DataFrame) -> DataFrame:
    """Final scans per day so far. The state is two counts a day, so no watermark is needed and scans of any age are
    counted: a late one restates its day."""
    final = scans.where(F.col("status").isin("delivered", "failed"))
    return final.groupBy(F.col("event_time").cast("date").cast("string").alias("day")).agg(
        F.count_if(F.col("status") == "delivered").alias("delivered"), F.count_if(F.col("status") == "failed").alias("failed")
    )


def wave_windows(scans: DataFrame, routes: DataFrame) -> DataFrame:
    """Final scans per day's window and wave so far. Scans meet their route's wave in the stream; windows stay open for scans of any age,
    and a late one states its window again."""
    final = scans.where(F.col("status").isin("delivered", "failed")).join(routes.select("route_id", "wave"), "route_id")
    counted = final.groupBy(F.window(F.col("event_time").cast("timestamp"), "1 day").alias("w"), "wave").agg(
        F.count_if(F.col("status") == "delivered").alias("delivered"), F.count_if(F.col("status") == "failed").alias("failed")
    )
    return counted.select(F.col("w.start").cast("date").cast("string").alias("day"), "wave", "delivered", "failed")
