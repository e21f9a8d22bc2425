"""From raw documents to packed sequences: stages that each read what the stage before has written.

1. toxicity: documents predicted toxic go. The classifier learns from the labels of the folder, on the documents it is given.
2. line_dedup: lines that recur in later documents go; a document of which nothing is left goes with them.
3. near_dedup: of every component of near-duplicates the document with the smallest id stays.
4. decontamination: documents that hold a benchmark item go, re-parameterised ones too.
5. packing: what is left becomes pieces of sequences of 1,024 tokens.

All stages but the last return the columns of documents. Each can be called alone, on any table with these columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelspan.llm import decontaminate, lines, minhash, packing, toxicity
from parcelspan.llm.common import ship, table, written
from parcelspan.llm.queries import vocabulary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return lines.dedup_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.drop_near_duplicates(docs, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]
# No SQL: the classifier, signatures and packing can't be said in it; tests/llm checks each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents", "*")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
