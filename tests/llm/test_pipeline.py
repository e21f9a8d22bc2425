"""The pipeline: every stage against its operator's plain version, on what the stage before has kept."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from test_decontaminate import brute as brute_leaks
from test_lines import brute as brute_lines
from test_lines import whole
from test_minhash import brute as brute_near
from test_tokens_records_packing import check_packing

from parcelspan.llm import toxicity


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).cache()
        before, after = docs.collect(), out.collect()
        rows = [(r.doc_id, r.text) for r in before]
        if name != "packing":
            assert out.columns == columns
            kept[name] = {r.doc_id: r.text for r in after}
            got = kept[name]
        if name == "toxicity":
            predicted = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, labels).collect()}
            assert set(got) == {d for d, p in predicted.items() if not p}
        elif name == "line_dedup":
            assert got == {d: c for d, t, c in brute_lines(rows) if whole(t, c)}
        elif name == "near_dedup":
            assert set(got) == {c for _, _, c in brute_near(rows, 80)}
        elif name == "decontamination":
            assert set(got) == {d for d, _ in rows} - {d for d, *_ in brute_leaks(rows, items)}
            assert len(got) < len(rows)
        else:
            assert public_tokenizers.path("byte_bpe_50k.json")
            check_packing(rows, after, "byte_bpe_50k")
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_columns_named_like_those_of_the_stages(spark):
    folder = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["_gone", "_gone_id", "_id", "_NODE", "_leak", "_tox_words", "_tox_score", "_clean", "_dropped", "_lines", "_class", "_words", "_text", "node"]
    docs = given.select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in names]).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, plain = stage(spark, docs, folder).cache(), stage(spark, given, folder)
        assert out.columns == docs.columns
        assert out.where(" OR ".join(f"`{n}` <> concat('{n}', doc_id)" for n in names)).count() == 0
        key = lambda r: repr(tuple(r))
        assert sorted(map(key, out.select(*given.columns).collect())) == sorted(map(key, plain.collect())), name
        docs, given = out, out.select(*given.columns)
    assert corpus_pipeline.packing_stage(spark, docs, folder).count() > 0


def test_odd_rows(spark):
    folder = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], given.schema)
    for docs in (odd, given.limit(0)):
        rows = docs.count()
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
        assert docs.count() == rows
