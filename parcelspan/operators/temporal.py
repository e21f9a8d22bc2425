"""As-of joins, interval membership and track resampling along time, without range joins.

Both sides are put on one time line per key and read with a last-known value or a running sum: one
shuffle, linear in the rows, and safe for large keys (see `ordered`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspan.operators.ordered import MAX_KEY_ROWS, Wanted, annotate


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    max_rows: int = MAX_KEY_ROWS,
) -> DataFrame:
    """Every left row with the values of the latest right row at or before it, NULL when there is none.
    Right rows are unique per key and time."""
    boxed = F.struct(*[F.col(v) for v in values])
    box_type = right.select(boxed.alias("b")).schema["b"].dataType
    row = F.struct(*left.columns)
    row_type = left.select(row.alias("r")).schema["r"].dataType
    line = (
        right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), boxed.alias("_right"))
        .withColumn("_left", F.lit(None).cast(row_type))
        .unionByName(
            left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), row.alias("_left")).withColumn(
                "_right", F.lit(None).cast(box_type)
            )
        )
    )
    seen = annotate(
        line, keys, ["_t", "_side"], Wanted(last_known={"_seen": F.col("_right")}), max_rows
    )
    return seen.where("_side = 1").select("_left.*", *[F.col("_seen")[v].alias(v) for v in values])


def inside_intervals(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    time: str,
    start: str,
    end: str,
    into: str = "inside",
    max_rows: int = MAX_KEY_ROWS,
) -> DataFrame:
    """Whether each point lies in at least one half-open interval [start, end) of its key: a running
    count of intervals open at the moment. Intervals may overlap."""
    row = F.struct(*points.columns)
    row_type = points.select(row.alias("r")).schema["r"].dataType
    valid = intervals.where(F.col(start) < F.col(end))
    edges = valid.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col(start).alias("_t"), F.lit(1).alias("_open")),
                F.struct(F.col(end).alias("_t"), F.lit(-1).alias("_open")),
            )
        ).alias("e"),
    ).select(*keys, "e._t", "e._open", F.lit(0).alias("_side"), F.lit(None).cast(row_type).alias("_row"))
    line = edges.unionByName(
        points.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_open"), F.lit(1).alias("_side"), row.alias("_row"))
    )
    counted = annotate(
        line, keys, ["_t", "_side"], Wanted(running_sum={"_depth": F.col("_open")}), max_rows
    )
    return counted.where("_side = 1").select("_row.*", (F.col("_depth") > 0).alias(into))


def resample_track(
    ticks: DataFrame,
    track: DataFrame,
    keys: Sequence[str],
    time: str,
    values: Sequence[str],
    max_rows: int = MAX_KEY_ROWS,
) -> DataFrame:
    """Straight-line values of a track of keyframes at each tick. Before the first and after the last
    keyframe the end value holds. `time` is numeric on both sides and the keyframes are unique."""
    ahead = annotate(
        track.select(*keys, time, *values),
        keys,
        [time],
        Wanted(following={"_t1": F.col(time), **{f"_{v}1": F.col(v) for v in values}}),
        max_rows,
    ).withColumn("_t0", F.col(time))
    first = track.groupBy(*keys).agg(*[F.min_by(v, time).alias(f"_{v}_first") for v in values])
    seen = asof_join(ticks, ahead, keys, time, time, ["_t0", "_t1", *values, *[f"_{v}1" for v in values]], max_rows)
    share = (F.col(time) - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    out = seen.join(first, list(keys))
    return out.select(
        *ticks.columns,
        *[
            F.when(F.col("_t0").isNull(), F.col(f"_{v}_first"))
            .when(F.col("_t1").isNull(), F.col(v))
            .otherwise(F.col(v) + (F.col(f"_{v}1") - F.col(v)) * share)
            .alias(v)
            for v in values
        ],
    )


def step_profile(minute: Column, profile: Sequence[tuple[int, float]]) -> Column:
    """The value of the last profile entry that starts at or before the minute: a CASE over a fixed,
    short profile, latest entry first."""
    value: Column | None = None
    for start, factor in sorted(profile, reverse=True):
        step = minute >= start
        value = F.when(step, F.lit(float(factor))) if value is None else value.when(step, F.lit(float(factor)))
    return value


def profile_asof(df: DataFrame, profile: DataFrame, minute: str, start: str, value: str) -> DataFrame:
    """The same for a profile kept in a table: minutes of a day are only 1,440, so the profile is
    spread over them once and looked up with an equi-join."""
    from pyspark.sql import Window

    ends = F.lead(start, 1, 1440).over(Window.partitionBy(F.lit(1)).orderBy(start))
    spread = profile.select(start, value, ends.alias("_end")).select(
        F.explode(F.sequence(F.col(start), F.col("_end") - 1)).alias(minute), value
    )
    return df.join(spread, minute, "left")


def sessions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, flag: Column, max_rows: int = MAX_KEY_ROWS
) -> DataFrame:
    """Runs of consecutive rows where the flag holds: start, end of each run and its row count. The run
    ends at the first row after it, or at its own last row when nothing follows."""
    spec = Wanted(
        previous={"_was": flag}, following={"_next_time": F.col(time)}
    )
    marked = annotate(df.withColumn("_on", flag), keys, order, spec, max_rows)
    begun = marked.withColumn("_start", (F.col("_on") & ~F.coalesce(F.col("_was"), F.lit(False))).cast("int"))
    numbered = annotate(
        begun, keys, order, Wanted(running_sum={"_session": F.col("_start")}), max_rows
    )
    return (
        numbered.where("_on")
        .groupBy(*keys, "_session")
        .agg(
            F.min(time).alias("opened_at"),
            F.max(F.coalesce("_next_time", time)).alias("closed_at"),
            F.count(F.lit(1)).alias("readings"),
        )
    )
