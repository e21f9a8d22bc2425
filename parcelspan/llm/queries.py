"""The queries of this folder by name, and the SQL that some of them are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelspan.llm import alignment, collocations, covertree, decontaminate, katz, language, lines, minhash, packing, pii, records, toxicity, warc
from parcelspan.llm.common import ship, table


def vocabulary(name: str, kind: str = "json") -> str:
    """The place of a public tokenizer's file; it is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.{kind}")


_BUILT: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": lambda spark, folder: pii.pii_digest(table(spark, folder, "documents", "doc_id", "text")),
    "op2_line_dedup": lambda spark, folder: lines.line_digest(table(spark, folder, "documents", "doc_id", "text")),
    "op3_decontamination": lambda spark, folder: decontaminate.contaminated(
        table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text")
    ),
    "op6_top_k": lambda spark, folder: covertree.top_k(table(spark, folder, "embeddings", "vec_id", "embedding")),
    "op7_toxicity": lambda spark, folder: toxicity.toxicity_scores(
        table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "labels", "doc_id", "toxic")
    ),
    "op4_katz": lambda spark, folder: katz.scores(table(spark, folder, "documents", "doc_id", "text")),
    "op5_packing": lambda spark, folder: packing.pack(
        table(spark, folder, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k")
    ),
    "op8_near_duplicates": lambda spark, folder: minhash.near_duplicates(
        table(spark, folder, "documents", "doc_id", "text")
    ),
    "op9_warc": lambda spark, folder: warc.round_trip(table(spark, folder, "pages", "page_id", "url", "html")),
    "op10_records": lambda spark, folder: records.round_trip(
        table(spark, folder, "documents", "doc_id", "text"), vocabulary("word_bpe_49k")
    ),
    "op11_alignment": lambda spark, folder: alignment.align(
        table(spark, folder, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k"), vocabulary("piece_bpe_32k", "model")
    ),
    "op12_collocations": lambda spark, folder: collocations.phrases(table(spark, folder, "documents", "text", "lang")),
    "op13_language": lambda spark, folder: language.identify(table(spark, folder, "documents", "doc_id", "text", "lang")),
}


def shipped(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return build(spark, folder)

    return run


QUERIES = {name: shipped(build) for name, build in _BUILT.items()}
SQL: dict[str, str] = {
    "op2_line_dedup": lines.SQL,
    "op6_top_k": covertree.SQL,
    "op8_near_duplicates": minhash.SQL,
    "op12_collocations": collocations.SQL,
}
