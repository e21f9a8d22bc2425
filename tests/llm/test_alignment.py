"""Alignment against both tokenizers over whole texts and a plain intersection of their ends."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest
import public_tokenizers

from parcelspan.llm import alignment
from parcelspan.llm.common import ship, table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    " ", "  ", "\n", "\t", "\r", "\xa0", " ", "\x1c", "\x85", "a", "b", "the", "ing", "é", "Ω", "ß", "²", "1", "23", ".", ",", ";", "!", "'s",
    "'", "’", "▁", "日本", "😀", "🏽", "\x00", "<s>", "<|endoftext|>", "</s>", "<0x0A>", "é", "ﬁ", "_", "(", ")", "{\r", "[", "​", "İ", "　",
]


def plain(pair, text):
    """Ids by both of the whole text, and the groups; None where bytes differ."""
    if not text:
        return None
    a, b = pair.a.tokenizer.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    data_a, data_b = [pair.bytes_a[i] for i in a], [pair.bytes_b[i] for i in b]
    if b"".join(data_a) != (" " + text).encode() or b"".join(data_b) != (" " + text).encode():
        return None
    ends_a, ends_b = list(accumulate(map(len, data_a))), list(accumulate(map(len, data_b)))
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        i0, j0 = i, j
        i, j = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append((a[i0:i], b[j0:j]))
    return a, b, groups


def plain_table(pair, documents):
    aligned = [(d, plain(pair, t)) for d, t in documents]
    links = [Counter((i, j) for a, b in r[2] for i in a for j in b) if r else Counter() for _, r in aligned]
    held = Counter(pair_ for l in links for pair_ in l)
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for (doc_id, r), l in zip(aligned, links, strict=True):
        if r is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in r[2])
        out.append((
            doc_id, len(r[0]), len(r[1]), len(r[2]), sum(l.values()), sum(n for p, n in l.items() if held[p] == best[p[0]]),
            sum(n * held[p] for p, n in l.items()), hashlib.sha256(shown.encode()).hexdigest(),
        ))
    return Counter(out)


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair.of(A, B)


def test_division_finds_every_common_end():
    draw = random.Random(3)
    for _ in range(500):
        size = draw.randint(1, 40)
        ends = [sorted({*draw.sample(range(1, size + 1), draw.randint(1, size)), size}) for _ in range(2)]
        groups = alignment.divide(*ends)
        assert [ends[0][g[1] - 1] for g in groups] == sorted(set(ends[0]) & set(ends[1]))
        assert [g[0] for g in groups] == [0, *(g[1] for g in groups[:-1])] and groups[-1][1] == len(ends[0])
    assert alignment.divide([], []) == []


def test_parts_give_what_whole_texts_give(pair):
    draw, chunk = random.Random(5), alignment.Chunk(pair)
    texts = ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 14))) for _ in range(3000)] + ["x" * 3000, "日本" * 900, "ab " * 5000]
    for text in texts:
        r, got = plain(pair, text), chunk.add(text)
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in r[2]) if r else ""
        want = (len(r[0]), len(r[1]), len(r[2]), sum(len(a) * len(b) for a, b in r[2])) if r else (0, 0, 0, 0)
        assert got[:4] == want and got[4] == (hashlib.sha256(shown.encode()).hexdigest() if r else ""), repr(text)


def test_counts_of_all_documents(spark, folder, pair):
    ship(spark)
    documents = table(spark, folder, "documents", "doc_id", "text")
    got = Counter(tuple(r) for r in alignment.align(documents.repartition(5), A, B).collect())
    assert got == plain_table(pair, [tuple(r) for r in documents.collect()])


def test_nulls_repeats_clashing_columns_and_empty_tables(spark, pair):
    ship(spark)
    rows = [(1, None, 1), (2, "", 2), (None, "one two", 3), (4, "one two", 4), (4, "one two", 4), (5, "▁", 5), (6, " ", 6), (7, "<|endoftext|> <s>", 7)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, chunk int").selectExpr("*", "chunk AS kind", "text AS links", "chunk AS at")
    got = Counter(tuple(r) for r in alignment.align(documents, A, B).collect())
    assert got == plain_table(pair, [r[:2] for r in rows])
    assert alignment.align(documents.limit(0), A, B).count() == 0
    many = spark.createDataFrame([(k, f"word{k % 7} of {k % 11}") for k in range(300)], "doc_id bigint, text string")
    got = Counter(tuple(r) for r in alignment.align(many, A, B, chunk_bytes=200).collect())
    assert got == plain_table(pair, [tuple(r) for r in many.collect()])
