"""Language profiles: held-out accuracy, vectors against plain loops, and every odd row."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from parcelspan.llm import language
from parcelspan.llm.common import ship, table


def vector(letter):
    return np.random.default_rng([language.SEED, ord(letter)]).integers(0, 2, language.SIZE, dtype=np.int8).astype(np.int64) * 2 - 1


def plain_profile(text):
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    low = " " + " ".join(low.split()) + " "
    total = np.zeros(language.SIZE)
    for (a, b, c), n in Counter(zip(low, low[1:], low[2:])).items():
        total += n * np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return total


def plain(rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    profiles = {}
    for doc_id, text, lang in rows:
        if not held(doc_id) and lang is not None and any(c.isalpha() for c in text or ""):
            profiles[lang] = profiles.get(lang, 0) + plain_profile(text)
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    names = sorted(profiles)
    mean = np.mean([unit(profiles[n]) for n in names], axis=0) if len(names) > 1 else 0
    out = {}
    for doc_id, text, _ in rows:
        if not names or not any(c.isalpha() for c in text or ""):
            out[doc_id] = ("und", 0.0)
        else:
            own = unit(unit(plain_profile(text)) - mean)
            cosines = [float(own @ unit(unit(profiles[n]) - mean)) for n in names]
            out[doc_id] = (names[int(np.argmax(cosines))], (1 + max(cosines)) / 2)
    return out


def test_held_out_documents_get_their_language(spark, folder):
    ship(spark)
    documents = table(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text", "lang")
    got = language.identify(documents).join(documents, "doc_id").where("held_out")
    right, all_ = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert all_ > 200 and right >= 0.98


def test_profiles_and_cosines(spark):
    ship(spark)
    texts = {"a": "the cat sat on the mat", "b": "der hund und die katze", "c": "le chat et le chien, l'été"}
    rows = [(k, f"{texts[lang]} {texts[lang][k % 9:]} {k}", lang) for k, lang in enumerate("abc" * 12)]
    rows += [(100, None, "a"), (101, "", "b"), (102, "123 !!", "c"), (103, "z", None), (104, "Straße İstanbul", None), (None, "the cat", "b")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "text AS place", "lang AS source", "1 AS sum")
    got = {r["doc_id"]: r for r in language.identify(documents.repartition(3)).collect()}
    want = plain(rows)
    assert {d: r["lang_pred"] for d, r in got.items()} == {d: n for d, (n, _) in want.items()}
    assert max(abs(got[d]["score"] - s) for d, (_, s) in want.items()) < 1e-4
    assert all(got[d]["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2) for d in got)


def test_nothing_learned_one_language_and_empty_tables(spark):
    ship(spark)
    schema = "doc_id bigint, text string, lang string"
    assert language.identify(spark.createDataFrame([], schema)).count() == 0
    unknown = language.identify(spark.createDataFrame([(1, "some text", None)], schema)).first()
    assert (unknown["lang_pred"], unknown["score"]) == ("und", 0.0)
    rows = [(k, "some text here", "x") for k in range(8)] * 2
    got = language.identify(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 16 and {r["lang_pred"] for r in got} == {"x"} and all(r["score"] > 0.99 for r in got)


def test_a_table_that_fills_up_is_bundled_exactly():
    grams, counts = language.trigrams("one two three, one two")
    whole = language.bundle(grams, counts)
    halves = language.bundle(grams[:5], counts[:5]) + language.bundle(grams[5:], counts[5:])
    assert (whole == halves).all() and (whole == plain_profile("one two three, one two")).all()
