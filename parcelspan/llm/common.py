"""What the operators of this folder share: words, tables cut off from their lineage, hashing."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspan.session import run_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words are what lies between these; other white space belongs to words.
GAP = r"[\x20\x09-\x0D]+"

# Batches that go to Python hold whole texts: a few megabytes each instead of 10,000 rows.
ARROW_ROWS = "1000"
# Parts a shuffle of large groups is cut into: as many as Spark writes without holding and sorting them.
FINE_PARTS = 200
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each application, so that they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        made = shutil.make_archive(f"{tempfile.mkdtemp()}/parcelspan", "zip", root, "parcelspan")
        context.addPyFile(made)
        _SHIPPED.add(context.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table of the given folder, with the columns that are needed."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """These names, with as many underscores before them as it takes for no column of the table to have one of them."""
    taken = {c.lower() for c in df.columns}
    while any(n in taken for n in names):
        names = tuple(f"_{n}" for n in names)
    return list(names)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text; none for null, empty or blank ones."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def written(spark: SparkSession, df: DataFrame, name: str, *partitions: str, folder: str | None = None, file_rows: int | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: later steps, and tasks run again after an
    executor is lost, start from the files. `folder` is for tables that are dropped again. `file_rows` bounds the rows of a file, for rows of
    megabytes: writers and readers hold a hundred rows of a file and more at once, however large they are."""
    path, writer = folder or run_folder(spark, name), df.write.option("compression", "zstd")
    if file_rows:
        writer = writer.option("maxRecordsPerFile", file_rows)
    writer.partitionBy(*partitions).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *folders: str) -> None:
    """Delete tables of this run that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def exchanges_dropped(spark: SparkSession) -> Iterator[None]:
    """Tables written in here leave no shuffle files behind: Spark drops them when a table is complete, not when the driver's memory is
    cleaned. For writes of several rounds, each of which begins with the files of the one before."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def finely_cut(spark: SparkSession) -> Iterator[None]:
    """Shuffles of tables written in here are cut into many parts first, so that large groups seldom share one; Spark puts small parts
    together again. A number that is set already stays."""
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    if before is None:
        spark.conf.set(name, str(max(FINE_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
