"""Topics as DataFrames: the broker's source when its connector is there, files of envelopes otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspan.operators.contracts import ENVELOPE

TOPICS = ("gps.pings", "vehicle.telemetry", "delivery.events")


def subscribe(spark: SparkSession, servers: str, batch_rows: int, topics: tuple[str, ...] = TOPICS) -> DataFrame:
    """A stream of envelopes of all topics in one query. A new query starts at the oldest retained
    message; a query with a checkpoint goes on where it stopped."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", batch_rows)
        .load()
    )
    return envelope(raw)


def envelope_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The same stream read from Parquet files of envelopes, as an archive of a topic holds them."""
    reader = spark.readStream.schema(ENVELOPE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return envelope(reader.parquet(path))


def envelope(raw: DataFrame) -> DataFrame:
    return raw.select(
        "topic", F.col("partition").cast("int"), F.col("offset").cast("bigint"), "key", "value",
        F.col("timestamp").cast("timestamp"),
    )


def publish(messages: DataFrame, servers: str, checkpoint: str):
    """Send (topic, key, value) rows to the broker, keyed so that a vehicle stays in order."""
    return (
        messages.select("topic", "key", "value")
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.compression.type", "lz4")
        .option("kafka.enable.idempotence", "true")
        .option("checkpointLocation", checkpoint)
    )
