"""One row per key, and set comparisons: aggregations with map-side combine, so no key is gathered whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspan.functions.ids import canonical_row, md5_number


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return chosen.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row with the greatest order of every key."""
    return _one_per_key(df, keys, order, F.max_by)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row with the least order of every key; later repeats of a key are dropped."""
    return _one_per_key(df, keys, order, F.min_by)


def absent_rows(candidates: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The candidates whose key the target does not hold."""
    return candidates.join(target.select(*keys), list(keys), "left_anti")


def left_join_known(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """A left join by `key` in which rows without a key, which match nothing, are not brought together in one task: they go round the join."""
    known = df.where(F.col(key).isNotNull()).join(other, key, "left")
    return known.unionByName(df.where(F.col(key).isNull()), allowMissingColumns=True)


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, with the surplus of the left side (negative: of the right)."""
    columns = left.columns
    both = left.withColumn("_c", F.lit(1)).unionByName(right.select(*columns).withColumn("_c", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("_c").alias("surplus")).where("surplus <> 0")


def content_digest(df: DataFrame, *by: str) -> DataFrame:
    """Row count and an order-free sum of row digests, per group or of the whole table. Two tables with
    the same rows, in any order and partitioning, have the same digest."""
    value = md5_number(canonical_row(df.columns)).cast("decimal(38,0)")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(value).cast("string").alias("digest")
    )


def upper_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Least, upper-middle and greatest value per key: element n//2 of the sorted values. The values
    are counted first, so only distinct values are ordered."""
    from pyspark.sql import Window

    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy(*keys)
    placed = counted.select(
        *keys, value, F.sum("_n").over(along).alias("_upto"), F.sum("_n").over(total).alias("_all")
    )
    middle = F.when(F.col("_upto") > F.floor(F.col("_all") / 2), F.col(value))
    return placed.groupBy(*keys).agg(
        F.min(value).alias("shortest"), F.min(middle).alias("middle"), F.max(value).alias("longest"),
        F.max("_all").alias("n"),
    )
