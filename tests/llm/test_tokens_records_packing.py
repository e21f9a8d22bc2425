"""Token ids against the tokenizer itself; records and packing against plain versions and round trips."""

import itertools
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parcelspan.llm import packing, records
from parcelspan.llm.tokens import Encoder

PATHS = {n: public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k")}
PLAIN = {n: Tokenizer.from_file(p) for n, p in PATHS.items()}
ODD = [
    None, "", " ", "\n", "a  b\t\n c ", " lead", "trail  ", "x y  z\u0085", "don't I'll 's 't", "\x1c\x1d a", "A<|endoftext|> b",
    "Éa é ́x ﬁ Σας ΣΑΣ İ", "a" * 300 + " " + "b " * 2000, "日本語 한국 𝔘𝔫", "1234 5,6.7 !!??...", "\r\n\r\n  \n x\r",
]


def plain_ids(name: str, text: str | None) -> list[int]:
    return PLAIN[name].encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("name", PATHS)
def test_ids_equal_the_tokenizer(name):
    encoder = Encoder(PATHS[name])
    for _ in range(2):  # the second time from the table of words
        for text, ids in zip(ODD, encoder.documents(iter(ODD)), strict=True):
            assert ids.tolist() == plain_ids(name, text), text


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8") | st.sampled_from(" \n\t '.éΣ\x1c"), max_size=60))
def test_ids_of_any_text(text):
    for name, path in PATHS.items():
        assert Encoder.of(path).encode(text).tolist() == plain_ids(name, text)[:-1]


def test_frames():
    payload = records.pack(-5, np.array([1, 65535], dtype="<u2"))
    data = records.frame(payload) + records.frame(records.pack(None, np.array([], dtype="<u4")))
    first, at = records.unframe(memoryview(data), 0)
    second, end = records.unframe(memoryview(data), at)
    assert end == len(data) and records.unpack(second)[0] is None
    assert records.unpack(first)[0] == -5 and records.unpack(first)[1].tolist() == [1, 65535]
    broken = bytearray(data)
    broken[14] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        records.unframe(memoryview(broken), 0)


def odd_documents(spark):
    rows = [(i * 7 % 16, t, "x") for i, t in enumerate(ODD)] + [(None, "no id", "x"), (3, "again", "x"), (3, "again", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string")


def test_records_round_trip(spark, folder):
    for docs in (odd_documents(spark), spark.read.parquet(f"{folder}/documents.parquet").repartition(5)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = records.round_trip(docs, PATHS["word_bpe_49k"]).collect()
        assert len(got) == len(rows)
        # Tied ids may come in any order of their texts, but places have no gap.
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
        crc = lambda t: zlib.crc32(np.array(plain_ids("word_bpe_49k", t), dtype="<u4").tobytes())
        key = lambda x: (x[0] is None, x)
        assert sorted([(r.doc_id, r.ids_crc32) for r in got], key=key) == sorted([(i, crc(t)) for i, t in rows], key=key)
    files = records.write(docs, PATHS["word_bpe_49k"])
    one, two = (records.read(files, seed=s).collect() for s in (1, 2))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and [r.doc_id for r in one] != [r.doc_id for r in two]
    assert records.round_trip(docs.limit(0), PATHS["word_bpe_49k"]).count() == 0


def check_packing(rows, got, name):
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    texts: dict = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for i, some in texts.items():
        mine = sorted(by_doc.pop(i), key=lambda r: (r.piece, r.start))
        if len(some) == 1:
            ids, at = plain_ids(name, some[0]), 0
            for k, r in enumerate(mine):
                assert (r.piece, r.start) == (k, at) and (r.length == 1024 or k == 0)
                assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
                at += r.length
            assert at == len(ids)
    assert not by_doc
    place = lambda r: (r.sequence_id, r.offset)
    for _, held in itertools.groupby(sorted(got, key=place), key=lambda r: r.sequence_id):
        at = 0
        for r in held:
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_packing(spark, folder):
    for docs in (odd_documents(spark), spark.read.parquet(f"{folder}/documents.parquet").repartition(3)):
        got = packing.pack(docs, PATHS["byte_bpe_50k"]).collect()
        check_packing([(r.doc_id, r.text) for r in docs.collect()], got, "byte_bpe_50k")
        bound = -(-sum(r.length for r in got) // 1024)
        assert len({r.sequence_id for r in got}) <= bound * 1.02 + 1
    some = docs.where("doc_id < 30")
    made = packing.sequences(some, PATHS["byte_bpe_50k"]).collect()
    ids = {r.doc_id: plain_ids("byte_bpe_50k", r.text) for r in some.collect()}
    assert sum(len(r.ids) for r in made) == sum(map(len, ids.values())) and max(len(r.ids) for r in made) <= 1024
    assert packing.pack(docs.limit(0), PATHS["byte_bpe_50k"]).count() == 0


def test_local_search_beats_or_equals_best_fit():
    rng = random.Random(5)
    won = 0
    for _ in range(40):
        sizes = [rng.choice([rng.randint(1, 60), rng.randint(20, 40)]) for _ in range(rng.randint(1, 60))]
        plain, better = (max(packing.pack_sizes(sizes, 100, swaps=s)[0]) + 1 for s in (False, True))
        assert -(-sum(sizes) // 100) <= better <= plain
        won += better < plain
        place, offset = packing.pack_sizes(sizes, 100)
        for b in set(place):
            held = sorted((o, s) for p, o, s in zip(place, offset, sizes, strict=True) if p == b)
            assert [o for o, _ in held] == [sum(s for _, s in held[:k]) for k in range(len(held))]
            assert sum(s for _, s in held) <= 100
    assert won > 0


def test_search_ends_only_at_a_local_optimum():
    sizes = [400] * 3000 + [300] * 1000 + [224] * 1000
    assert max(packing.pack_sizes(sizes)[0]) + 1 <= 1750
    rng = random.Random(8)
    for _ in range(30):
        sizes = [rng.randint(1, rng.choice([20, 60, 90])) for _ in range(rng.randint(2, 40))]
        place, _ = packing.pack_sizes(sizes, 100)
        bins = [[s for p, s in zip(place, sizes, strict=True) if p == b] for b in set(place)]
        if len(bins) == -(-sum(sizes) // 100):
            continue
        for into, giver in itertools.permutations(bins, 2):
            if sum(giver) > sum(into):
                continue
            for out, given in ((0, 1), (1, 1), (2, 1), (1, 2)):
                for o in itertools.combinations(into, out):
                    for g in itertools.combinations(giver, given):
                        assert not sum(into) < sum(into) - sum(o) + sum(g) <= 100, (into, giver, o, g)


def test_cut():
    assert packing.cut(1) == [(0, 1)] and packing.cut(1024) == [(0, 1024)]
    assert packing.cut(1025) == [(0, 1), (1, 1024)] and packing.cut(2100) == [(0, 52), (52, 1024), (1076, 1024)]
    assert os.path.exists(PATHS["byte_bpe_50k"])
