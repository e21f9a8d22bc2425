"""Data-quality expectations: a rule is a predicate on rows; a report is one aggregation per table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expectation:
    """`holds` is true, false or NULL for a row; NULL (nothing to judge) passes."""

    rule: str
    holds: Column
    severity: str = "error"


def check_table(table: str, df: DataFrame, key: str, rules: Sequence[Expectation]) -> DataFrame:
    """One row per rule: rows judged, rows that fail, and the least key that fails. One pass over the table."""
    totals = [F.count(F.lit(1)).alias("checked")]
    for i, e in enumerate(rules):
        failed = ~F.coalesce(e.holds, F.lit(True))
        totals += [
            F.count_if(failed).alias(f"failed_{i}"),
            F.min(F.when(failed, F.col(key).cast("string"))).alias(f"sample_{i}"),
        ]
    figures = df.agg(*totals)
    rows = F.array(
        *[
            F.struct(
                F.lit(table).alias("table_name"),
                F.lit(e.rule).alias("rule"),
                F.lit(e.severity).alias("severity"),
                F.col("checked"),
                F.col(f"failed_{i}").alias("failed_rows"),
                F.col(f"sample_{i}").alias("sample_key"),
            )
            for i, e in enumerate(rules)
        ]
    )
    return figures.select(F.explode(rows).alias("r")).select("r.*")


def orphans(table: str, rule: str, df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """The relationship rule: values of a column that the parent table does not hold."""
    named = df.where(F.col(column).isNotNull())
    known = parent.select(F.col(parent_column).alias(column)).distinct()
    lost = named.join(known, column, "left_anti")
    return lost.agg(
        F.lit(table).alias("table_name"),
        F.lit(rule).alias("rule"),
        F.lit("error").alias("severity"),
        F.count(F.lit(1)).alias("failed_rows"),
        F.min(F.col(column).cast("string")).alias("sample_key"),
    )
