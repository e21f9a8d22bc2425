"""Writing tables: stamped, partitioned, replaced by partition, skipped when unchanged, archived."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspan.operators.keyed import content_digest
from parcelspan.session import run_folder


class GuardError(RuntimeError):
    """The write would destroy something that builds on what it replaces."""


def stamped(df: DataFrame, source: str, ingested_at: Column | None = None) -> DataFrame:
    """Rows with where they come from and when they were written, the same for a whole write."""
    return df.withColumn("source", F.lit(source)).withColumn(
        "ingested_at", F.current_timestamp() if ingested_at is None else ingested_at
    )


def evenly(df: DataFrame, *by: str) -> DataFrame:
    """Rows brought together by partition value, if any, for writing; a value with many rows is split over tasks."""
    return df.hint("rebalance", *[F.col(c) for c in by])


def replace_partitions(df: DataFrame, path: str, by: Sequence[str], balance: bool = True) -> None:
    """Replace the partitions the rows belong to and no others: doing it again changes nothing."""
    ready = evenly(df, *by) if balance else df
    (
        ready.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*by)
        .parquet(path)
    )


def replace_folder(df: DataFrame, path: str) -> None:
    """Replace one folder whole: doing it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd").parquet(path)


def replace_days(df: DataFrame, path: str, by: str, values: Sequence[str]) -> None:
    """Replace the named partitions whole: those that get no rows are cleared. Rows of other partitions are refused,
    values are compared as text."""
    spark = df.sparkSession
    if df.where(~F.col(by).cast("string").isin(*values) | F.col(by).isNull()).limit(1).count():
        raise GuardError(f"rows outside the partitions {by} that are replaced")
    filled = {str(r[0]) for r in df.select(F.col(by).cast("string")).distinct().collect()}  # at most the named values
    replace_partitions(df, path, [by])
    for value in values:
        if value not in filled:
            _delete(spark, f"{path}/{by}={value}")


def guarded_replace(plans: DataFrame, path: str, by: Sequence[str], version: str = "plan_version", source: str | None = None) -> None:
    """Replace the baseline of the plans' partitions, unless a later version builds on it there. With `source`, only
    baseline rows that came from it are replaced and others stay."""
    spark = plans.sparkSession
    ready = plans
    if table_exists(spark, path):
        held = spark.read.parquet(path).join(plans.select(*by).distinct(), list(by), "left_semi")
        if held.where(F.col(version) > 0).limit(1).count():
            raise GuardError("later plan versions build on the baseline; it is not replaced")
        if source is not None:
            ready = plans.unionByName(held.where(~F.col("source").eqNullSafe(F.lit(source))).select(*plans.columns))
            ready = _settled(ready)
    replace_partitions(ready, path, by)


def _settled(df: DataFrame) -> DataFrame:
    """The rows in a table of their own, so that what they were read from can be overwritten."""
    path = run_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def table_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def manifest(df: DataFrame, source: str, owner: str, schema_version: int) -> DataFrame:
    """One row that describes a table: where it comes from, who owns it, and the digest of its content
    without the time it was written."""
    content = df.drop("ingested_at")
    return content_digest(content).select(
        F.lit(source).alias("source"), F.lit(owner).alias("owner"), F.lit(schema_version).alias("schema_version"),
        "n_rows", "digest",
    )


def write_if_changed(df: DataFrame, path: str, source: str, owner: str, schema_version: int) -> bool:
    """Write the table and its manifest unless the manifest there says the content is the same."""
    spark = df.sparkSession
    described = manifest(df, source, owner, schema_version)
    now = described.first()
    if table_exists(spark, f"{path}/manifest"):
        if spark.read.parquet(f"{path}/manifest").first() == now:
            return False
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows")
    spark.createDataFrame([now], described.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return True


def metadata_report(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Per table written under these paths: its rows, those without a source or a time of writing, and whether a manifest names its
    owner and schema version. A table without such a column or manifest lacks them in all its rows; nothing has to be there but the rows."""
    report: DataFrame | None = None
    for name, path in paths.items():
        rows = spark.read.parquet(f"{path}/rows")
        lacking = {c: F.count_if(F.col(c).isNull()) if c in rows.columns else F.count(F.lit(1)) for c in ("source", "ingested_at")}
        described = F.lit(False)
        if table_exists(spark, f"{path}/manifest"):
            said = spark.read.parquet(f"{path}/manifest").select("owner", "schema_version").first()  # a manifest is one row
            described = F.lit(said is not None and None not in said)
        part = rows.agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), *[n.alias(f"without_{c}") for c, n in lacking.items()],
            described.alias("described"),
        )
        report = part if report is None else report.unionByName(part)
    return report


def archive_before(df: DataFrame, day: str, cutoff: str, archive: str, table: str | None = None) -> int:
    """Copy the days before the cut-off to the archive, compare both sides day by day, and only then drop them from `table`,
    where the rows are partitioned by day. Days archived earlier aren't touched or counted, so it can run again and again. Returns
    the number of rows archived."""
    spark = df.sparkSession
    old = df.where(F.col(day) < F.lit(cutoff).cast("date"))
    replace_partitions(old, archive, [day])
    counted = old.groupBy(F.col(day).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    copied = spark.read.parquet(archive) if table_exists(spark, archive) else old.limit(0)
    kept = copied.groupBy(F.col(day).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("kept"))
    days = counted.join(kept, "day", "left").collect()  # one row a day
    wrong = [r["day"] for r in days if r["n"] != r["kept"]]
    if wrong:
        raise GuardError(f"{len(wrong)} days have other counts in the archive: nothing is dropped")
    if table is not None:
        for r in days:
            _delete(spark, f"{table}/{day}={r['day']}")
    return sum(r["n"] for r in days)
