"""Line feeds: `#`-delimited traffic lines in two layouts, with the original line kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspan.functions.calendar import utc_time


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "raw_line")


def traffic_lines(lines: DataFrame) -> DataFrame:
    """Typed states of a feed. Lines of four fields are street sections (id, local time, state, forecast);
    lines of eight are itineraries (id, available, local time, current and forecast seconds, three codes)."""
    part = F.split("raw_line", "#")
    section = F.size(part) == 4
    stamp = F.when(section, F.get(part, 1)).otherwise(F.get(part, 2))
    local = F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    return lines.select(
        F.when(section, "trams").otherwise("itineraris").alias("feed"),
        F.get(part, 0).try_cast("int").alias("feed_item_id"),
        utc_time(local).alias("event_time"),
        F.when(section, F.get(part, 2).try_cast("int")).alias("state"),
        F.when(section, F.get(part, 3).try_cast("int")).alias("state_forecast"),
        F.when(~section, F.get(part, 3).try_cast("int")).alias("travel_time_s"),
        F.when(~section, F.get(part, 4).try_cast("int")).alias("travel_time_forecast_s"),
        "raw_line",
    )


def section_points(spark: SparkSession, path: str) -> DataFrame:
    """Geometry of street sections, a CSV with a row for each point: section_id, point_seq, lon, lat. Lines that are none are left out."""
    raw = spark.read.csv(path, schema="section_id string, point_seq string, lon string, lat string", header=True)
    typed = raw.select(
        F.col("section_id").try_cast("int").alias("section_id"), F.col("point_seq").try_cast("bigint").alias("point_seq"),
        F.col("lon").try_cast("double").alias("lon"), F.col("lat").try_cast("double").alias("lat"),
    )
    return typed.where("section_id IS NOT NULL AND point_seq IS NOT NULL")
