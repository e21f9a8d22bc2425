"""Stop sessions as readings come in, late ones too.

A running aggregate keeps the readings of a vehicle and hour, and states the runs of an hour again whenever a reading of it
arrives, however late. Runs that go on over the end of an hour are joined when the statements are read: a few rows an hour and
vehicle, not its readings. The state grows with the hours that are kept open; `keep` closes those older than that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspan.operators.ordered import MAX_KEY_ROWS, Wanted, annotate
from parcelspan.session import kept


def hourly_runs(readings: DataFrame, keys: Sequence[str], time: str, flag: Column, keep: str | None = None) -> DataFrame:
    """Per key and hour: the time of its first reading, whether its last one has the flag, and the runs of readings with the flag.

    Of a run: its first and last reading, its number of readings, the reading after it (null at the end of the hour), and whether
    it begins with the hour's first reading. Readings without a time are left out. A reading that is given twice counts twice.
    """
    at = F.col(time).cast("timestamp")
    rows = readings.select(*keys, at.alias("_at"), F.coalesce(flag, F.lit(False)).alias("_on")).where("_at IS NOT NULL")
    if keep:
        rows = rows.withWatermark("_at", keep)
    held = rows.groupBy(*keys, F.window("_at", "1 hour").alias("_hour")).agg(F.array_sort(F.collect_list(F.struct("_at", "_on"))).alias("_all"))
    on = lambda i: F.coalesce(F.get("_all", i)["_on"], F.lit(False))
    places = F.sequence(F.lit(0), F.size("_all") - 1)
    begins = F.filter(places, lambda i: on(i) & ~on(i - 1))
    ends = F.filter(places, lambda i: on(i) & ~on(i + 1))
    runs = F.zip_with(
        begins,
        ends,
        lambda a, b: F.struct(
            F.get("_all", a)["_at"].alias("opened_at"), F.get("_all", b)["_at"].alias("last_at"), F.get("_all", b + 1)["_at"].alias("next_at"),
            (b - a + 1).cast("bigint").alias("readings"), (a == 0).alias("first"),
        ),
    )
    return held.select(
        *keys, F.col("_hour.start").alias("hour"), F.get("_all", F.lit(0))["_at"].alias("first_at"),
        F.element_at("_all", -1)["_on"].alias("open"), runs.alias("runs"),
    )


def joined_runs(hours: DataFrame, keys: Sequence[str], max_rows: int = MAX_KEY_ROWS) -> DataFrame:
    """Start, end and readings of every run from the latest statements of the hours. A run ends at the reading after it, or at its own
    last one when nothing follows. Ordered work reads its rows twice, so they are written first."""
    keys, hours = list(keys), kept(hours, "hours")
    beside = Wanted(previous={"_was": F.col("open")}, following={"_then": F.col("first_at")})
    runs = annotate(hours, keys, ["hour"], beside, max_rows).select(*keys, "_was", "_then", F.explode("runs").alias("r"))
    runs = runs.select(*keys, "r.*", "_then", (~(F.col("r.first") & F.coalesce(F.col("_was"), F.lit(False)))).cast("int").alias("_new"))
    numbered = annotate(kept(runs, "hourly_runs"), keys, ["opened_at"], Wanted(running_sum={"_run": F.col("_new")}), max_rows)
    return numbered.groupBy(*keys, "_run").agg(
        F.min("opened_at").alias("opened_at"), F.max(F.coalesce("next_at", "_then", "last_at")).alias("closed_at"), F.sum("readings").alias("readings")
    ).drop("_run")
