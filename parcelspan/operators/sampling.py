"""Reproducible samples: a row's draw depends only on its key and the seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelspan.functions.ids import uniform

SALTS = 64


def bernoulli(df: DataFrame, key: Sequence[str], share: float, seed: int, into: str) -> DataFrame:
    """Mark each row with the given probability."""
    return df.withColumn(into, uniform(*key, seed=seed) < share)


def top_k_by_draw(df: DataFrame, groups: Sequence[str], key: Sequence[str], k: int, seed: int) -> DataFrame:
    """k rows of every group, the ones with the least draw: a larger k keeps the rows of a smaller one.

    Each group is first cut to k rows inside every one of its salted parts, so that no task ranks a
    whole group; then the survivors are ranked.
    """
    drawn = df.withColumn("_u", uniform(*key, seed=seed))
    if not groups:
        return drawn.orderBy("_u", *key).limit(k).drop("_u")
    salted = drawn.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)))
    part = Window.partitionBy(*groups, "_salt").orderBy("_u", *key)
    near = salted.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= k)
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(*groups).orderBy("_u", *key)))
    return ranked.where(F.col("_rank") <= k).drop("_u", "_salt", "_rank")
