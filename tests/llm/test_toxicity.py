"""The classifier: its features against plain loops, its scores against a plain sum, held-out accuracy."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from parcelspan.llm import toxicity as tox


def test_features_equal_plain_loops():
    docs = [[5, -7, 9], [], [1], [3, 3, 3, 3]]
    flat = np.array([x for d in docs for x in d], dtype=np.int64)
    index, owner = tox.features(flat, np.array([len(d) for d in docs]))
    m = (1 << 64) - 1
    a, b = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

    def number(x: int) -> int:
        x ^= x >> 29
        return ((x * b) & m) >> (64 - tox.BITS)

    want = []
    for i, d in enumerate(docs):
        want += [(i, number((x & m) * a & m)) for x in d]
        for gap, salt in ((1, 0x165667B19E3779F9), (2, 0x27D4EB2F165667C5)):
            want += [(i, number((((d[k] & m) * a & m) ^ ((d[k + gap] & m) + salt & m)) * b & m)) for k in range(len(d) - gap)]
    assert sorted(zip(owner.tolist(), index.tolist(), strict=True)) == sorted(want)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "you moron", "x"), (1, "you moron", "x"), (2, None, "x"), (3, "", "x"), (None, "fine words", "x"), (4, "w " * 60_000, "x")],
        "doc_id bigint, text string, words string",
    )
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id bigint, toxic int")
    got = tox.toxicity_scores(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    kept = tox.drop_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 6
    assert tox.toxicity_scores(docs.limit(0), labels).count() == 0


def test_fit_equals_plain_loops_and_learns_one_row_a_document(spark):
    texts = {i: " ".join(f"w{(i * 7 + k) % 11}" for k in range(i % 5 + 1)) for i in range(40)}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(3, texts[3])] * 300, "doc_id bigint, text string").cache()
    labels = spark.createDataFrame([(i, i % 3 // 2) for i in texts] + [(3, 0)] * 50, "doc_id bigint, toxic int")
    got = dict(zip(*[x.tolist() for x in tox.fit(docs, labels)], strict=True))
    hashed = docs.dropDuplicates(["doc_id"]).select("doc_id", F.xxhash64(F.lit(7), "doc_id").alias("place"), tox.word_hashes(F.col("text")).alias("w"))
    rows = []
    for r in sorted(hashed.collect(), key=lambda r: r.place):
        index, _ = tox.features(np.array(r.w, dtype=np.int64), np.array([len(r.w)]))
        rows.append((r.doc_id % 3 // 2, sorted(set(index.tolist()))))
    share = (sum(y for y, _ in rows) + 0.1) / (len(rows) + 1)
    z, n, bias, bias_n = {}, {}, math.log(share / (1 - share)), 0.0

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= tox.L1 else (math.copysign(tox.L1, zi) - zi) / ((tox.BETA + math.sqrt(ni)) / tox.ALPHA + tox.L2)

    for _ in range(tox.EPOCHS):
        for y, index in rows:
            w = {i: weight(i) for i in index}
            g = 1 / (1 + math.exp(-max(-35, min(35, bias + sum(w.values()))))) - y
            for i in index:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / tox.ALPHA * w[i]
                n[i] = old + g * g
            bias_n += g * g
            bias -= tox.ALPHA * g / (tox.BETA + math.sqrt(bias_n))
    want = {i: weight(i) for i in z if weight(i)} | {-1: bias}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-6, abs_tol=1e-9) for i in want)


def test_held_out_accuracy_and_determinism(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = tox.toxicity_scores(docs, labels).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert held[held.toxic == 0].predicted.mean() < 0.01 and held[held.toxic == 1].predicted.mean() > 0.75
    # The same weights whatever the partitioning, and scores equal to a plain sum of weights.
    one, two = tox.fit(docs, labels.where(~tox.held_out())), tox.fit(docs.repartition(7), labels.where(~tox.held_out()))
    assert (one[0] == two[0]).all() and np.allclose(one[1], two[1])
    weights = dict(zip(one[0].tolist(), one[1].tolist(), strict=True))
    some = docs.where("doc_id < 40").select("doc_id", tox.word_hashes(F.col("text")).alias("w")).collect()
    scores = dict(zip(got.doc_id, got.score, strict=True))
    for r in some:
        if r.doc_id in scores:
            index, _ = tox.features(np.array(r.w, dtype=np.int64), np.array([len(r.w)]))
            total = weights[-1] + sum(weights.get(i, 0.0) for i in set(index.tolist()))
            assert math.isclose(scores[r.doc_id], 1 / (1 + math.exp(-max(-35, min(35, total)))), rel_tol=1e-6)
