"""Session settings every job of the package relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings; none of them sizes the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key is split even when that costs one more shuffle for the aggregation after it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A JSON object that repeats a key keeps the last value, as most JSON readers do.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Running aggregates keep their state on disk, so it may outgrow the memory of an executor.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # A batch commits what it changed, not files of the whole store, and keys are put without asking first whether they are new.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # Writing a partition again replaces that partition and no other.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

# Settings a session can only be built with.
BUILD_SETTINGS = {
    # Building a plan is several times quicker without a call site kept for every expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build_session(name: str, **extra: str) -> SparkSession:
    """A session with all settings; `extra` holds further ones, such as master and memory."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **BUILD_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Bounds of a reducing task: what it reads, and how finely a shuffle is cut before small parts are put together again. A task's memory then
# follows these and not the size of the tables.
TASK_BYTES, FIRST_PARTS = 16 << 20, 1_000


def bound_tasks(spark: SparkSession) -> SparkSession:
    """Let Spark put no more than `TASK_BYTES` of a shuffle into one task, where keys allow it. Smaller sizes and numbers of parts that
    are set already stay."""
    size, parts = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size))) > TASK_BYTES:
        spark.conf.set(size, str(TASK_BYTES))
    if spark.conf.get(parts, None) is None:
        spark.conf.set(parts, str(max(FIRST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session somebody else built."""
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: spark.checkpoint.dir, or a local one in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def run_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run, under the shared folder."""
    return f"{shared_folder(spark)}/parcelspan/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The table written into a folder of this run and read back, for tables that several jobs read."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows kept in the plan itself. Spark knows how small it is, which it does not for
    a table made from Python rows, and so never sends the other side of a join instead."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    kinds = [part.strip().split(" ")[1] for part in schema.split(",")]
    values = [
        F.struct(*[F.lit(v).cast(k).alias(n) for v, n, k in zip(row, names, kinds, strict=True)]) for row in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*values)))
