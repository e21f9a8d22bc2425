"""Ordered work inside a key: previous and next row, last known value, running sum, row number.

A window holds a whole key in one task. That is fine while every key is small, so the size of the
largest key is measured first. When a key is too large, its rows are cut into chunks along the
order; each chunk is summarised (map-side combined), the summaries are chained per key, and the
rows meet their chunk's carry in an equi-join on (key, chunk). The cuts of a key are rows of its own, drawn by a hash of
their place in the order: they follow its rows wherever these lie, whatever the order is made of. The rows
are the same either way; sums of floats may differ in their last digits, being added in another order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_KEY_ROWS = 4_000_000
DRAWN, STRIDE = 64, 16  # rows drawn from `max_rows` of a key, and how many of them lie between two cuts


@dataclass(frozen=True)
class Wanted:
    """The columns to add, each by name."""

    previous: Mapping[str, Column] = field(default_factory=dict)
    following: Mapping[str, Column] = field(default_factory=dict)
    last_known: Mapping[str, Column] = field(default_factory=dict)
    running_sum: Mapping[str, Column] = field(default_factory=dict)
    row_number: str | None = None


def largest_key(df: DataFrame, keys: Sequence[str]) -> int:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def with_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int) -> DataFrame:
    """Add `_chunk`, which grows along the order of a key: about `max_rows * STRIDE / DRAWN` rows share one."""
    place = F.struct(*[F.col(c) for c in order])
    drawn = df.where(F.pmod(F.xxhash64(*keys, *order), F.lit(max(1, max_rows // DRAWN))) == 0)
    some = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list(place)).alias("_drawn")).where(F.size("_drawn") >= STRIDE)
    cuts = F.transform(F.sequence(F.lit(STRIDE), F.size("_drawn"), F.lit(STRIDE)), lambda i: F.get("_drawn", i - 1))
    some = some.select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)], cuts.alias("_cuts"))
    same = [F.col(k).eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate(keys)]
    chunk = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= place)), F.lit(0))
    return df.join(some, same, "left").select(*df.columns, F.greatest(chunk, F.lit(0)).alias("_chunk"))


def annotate(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    wanted: Wanted,
    max_rows: int = MAX_KEY_ROWS,
) -> DataFrame:
    """Add the wanted columns. `order` must be total inside a key."""
    keys = list(keys)
    if largest_key(df, keys) <= max_rows:
        return _in_whole_keys(df, keys, order, wanted)
    return _in_chunks(df, keys, order, max_rows, wanted)


def _in_whole_keys(df: DataFrame, keys: list[str], order: Sequence[str], wanted: Wanted) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {name: F.lag(c).over(w) for name, c in wanted.previous.items()}
    new |= {name: F.lead(c).over(w) for name, c in wanted.following.items()}
    new |= {name: F.last(c, ignorenulls=True).over(upto) for name, c in wanted.last_known.items()}
    new |= {name: F.sum(c).over(upto) for name, c in wanted.running_sum.items()}
    if wanted.row_number:
        new[wanted.row_number] = F.row_number().over(w).cast("bigint")
    return df.select("*", *[c.alias(name) for name, c in new.items()])


def _in_chunks(
    df: DataFrame, keys: list[str], order: Sequence[str], max_rows: int, wanted: Wanted
) -> DataFrame:
    rows = with_chunks(df, keys, order, max_rows)
    by_order = F.struct(*order)

    def boxed(columns: Mapping[str, Column]) -> Column:
        return F.struct(*[c.alias(name) for name, c in columns.items()])

    totals = [F.count(F.lit(1)).alias("_n")]
    if wanted.previous:
        totals.append(F.max_by(boxed(wanted.previous), by_order).alias("_end"))
    if wanted.following:
        totals.append(F.min_by(boxed(wanted.following), by_order).alias("_begin"))
    totals += [F.max_by(c, F.when(c.isNotNull(), by_order)).alias(f"_last_{n}") for n, c in wanted.last_known.items()]
    totals += [F.sum(c).alias(f"_sum_{n}") for n, c in wanted.running_sum.items()]
    summary = rows.groupBy(*keys, "_chunk").agg(*totals)

    along = Window.partitionBy(*keys).orderBy("_chunk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carry = []
    if wanted.row_number:
        carry.append(F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c_n"))
    if wanted.previous:
        carry.append(F.lag("_end").over(along).alias("_c_end"))
    if wanted.following:
        carry.append(F.lead("_begin").over(along).alias("_c_begin"))
    carry += [F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_c_last_{n}") for n in wanted.last_known]
    carry += [F.sum(f"_sum_{n}").over(before).alias(f"_c_sum_{n}") for n in wanted.running_sum]
    on = [*keys, "_chunk"]
    carried = summary.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(on)], *carry)

    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(on)]
    joined = rows.join(carried, same, "left")

    w = Window.partitionBy(*on).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.row_number().over(w)
    new: dict[str, Column] = {}
    # The first row of a chunk takes what the chunk before left, the last what the next one starts with.
    for name, c in wanted.previous.items():
        new[name] = F.when(at == 1, F.col("_c_end")[name]).otherwise(F.lag(c).over(w))
    for name, c in wanted.following.items():
        new[name] = F.when(F.lead(F.lit(1)).over(w).isNull(), F.col("_c_begin")[name]).otherwise(F.lead(c).over(w))
    for name, c in wanted.last_known.items():
        new[name] = F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"_c_last_{name}"))
    for name, c in wanted.running_sum.items():
        here, past = F.sum(c).over(upto), F.col(f"_c_sum_{name}")
        new[name] = F.when(here.isNull(), past).when(past.isNull(), here).otherwise(here + past)
    if wanted.row_number:
        new[wanted.row_number] = at.cast("bigint") + F.col("_c_n")
    return joined.select(*df.columns, *[c.alias(name) for name, c in new.items()])
