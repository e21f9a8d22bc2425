"""The backoff model against dictionaries, and its sums over the whole vocabulary."""

import math
import os
import random
import re
import tempfile
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from parcelspan.llm import katz

END, BOS = "</s>", "<s>"


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


class Plain:
    def __init__(self, rows, order):
        self.order = order
        self.count = [Counter() for _ in range(order + 1)]  # n-grams as tuples, begun by BOS
        for doc, text in rows:
            if doc is None or zlib.crc32(str(doc).encode()) % 7 != 2:
                t = [BOS] * (order - 1) + tokens(text)
                self.count[0][()] += 1
                for i in range(order - 1, len(t)):
                    for n in range(1, order + 1):
                        self.count[n][tuple(t[i - n + 1 : i + 1])] += 1
        self.docs = self.count[0][()]
        self.total = sum(self.count[1].values())
        self.d = {}
        for n in range(1, order + 1):
            kinds = Counter(self.count[n].values())
            self.d[n] = katz.discounts([kinds[r] for r in range(1, katz.GREATEST + 2)])
        self.after = [defaultdict(list) for _ in range(order + 1)]
        for n in range(2, order + 1):
            for g in self.count[n]:
                self.after[n][g[:-1]].append(g[-1])

    def discounted(self, n, c):
        return self.d[n][min(c, katz.GREATEST + 1)] * c

    def p(self, h, w):
        n = len(h) + 1
        if n == 1:
            c = self.count[1][(w,)]
            if c:
                return self.discounted(1, c) / (self.total + katz.RESERVE)
            return 1 - sum(self.discounted(1, x) for x in self.count[1].values()) / (self.total + katz.RESERVE)
        # A context that is all BOS was counted once a document.
        context = self.docs if set(h) == {BOS} else self.count[n - 1][h]
        c = self.count[n][(*h, w)]
        if c:
            return self.discounted(n, c) / (context + katz.RESERVE)
        if not context:
            return self.p(h[1:], w)
        return self.alpha(h) * self.p(h[1:], w)

    def alpha(self, h):
        n, seen = len(h) + 1, self.after[len(h) + 1][h]
        context = self.docs if set(h) == {BOS} else self.count[n - 1][h]
        given = sum(self.discounted(n, self.count[n][(*h, w)]) for w in seen) / (context + katz.RESERVE)
        return (1 - given) / (1 - sum(self.p(h[1:], w) for w in seen))

    def score(self, text):
        t = [BOS] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(tuple(t[i - self.order + 1 : i]), t[i])) for i in range(self.order - 1, len(t)))


def corpus(seed, docs=120):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(vocabulary[: rng.choice([3, 10, 40])]) for _ in range(rng.randint(0, 30)))) for i in range(docs)]
    return rows + [(500, None), (501, ""), (None, "w1 w2"), (3, rows[3][1]), (502, "Never seen BEFORE"), (503, "w1 " * 20_000)]


@pytest.mark.parametrize(("order", "chunk"), [(1, 10**6), (2, 50), (3, 200), (2, 10**6)])
def test_equals_dictionaries(spark, order, chunk, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK", chunk)
    rows = corpus(order)
    plain = Plain(rows, order)
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, score double").repartition(5)
    got = katz.scores(df, order).collect()
    assert len(got) == len(rows)
    vocabulary = len(plain.count[1])
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(t)
    for r in got:
        t = tokens(texts[r.doc_id][0])
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.train_tokens) == (len(t), plain.total) and r.n_known == sum((w,) in plain.count[1] for w in t)
        base = sum(math.log10((plain.count[1][(w,)] + 1) / (plain.total + vocabulary + 1)) for w in t)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isclose(r.score, plain.score(texts[r.doc_id][0]), rel_tol=1e-8), (r, order)


def test_contexts_sum_to_one():
    plain = Plain(corpus(7), 3)
    words = [w for (w,) in plain.count[1]] + ["<unknown>"]
    for h in [(BOS, BOS), (BOS, "w1"), ("w1", "w2"), ("w0", "w1"), ("x", "w3"), ("x", "y")]:
        assert math.isclose(sum(plain.p(h, w) for w in words), 1, rel_tol=1e-9), h


def test_discounts():
    assert list(katz.discounts([0] * 6)) == [1] * 7
    d = katz.discounts([100, 40, 20, 12, 8, 5])
    assert all(0 < x <= 1 for x in d[1:6]) and d[6] == 1


def test_given_documents(spark, folder):
    got = katz.scores(spark.read.parquet(f"{folder}/documents.parquet")).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and got.score.sum() > got.base_score.sum()
    assert katz.scores(spark.read.parquet(f"{folder}/documents.parquet").limit(0)).count() == 0


def test_registered_query_is_a_trigram_model(spark, tmp_path):
    from parcelspan.llm.queries import QUERIES

    rows = corpus(11)
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain, texts = Plain(rows, 3), defaultdict(list)
    for d, t in rows:
        texts[d].append(t)
    for r in QUERIES["op4_katz"](spark, str(tmp_path)).collect():
        assert math.isclose(r.score, plain.score(texts[r.doc_id][0]), rel_tol=1e-8), r


def test_rounds_leave_no_shuffle_files(spark, monkeypatch):
    """What the rounds of counting send is dropped as soon as their answers are written."""
    dirs = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f: os.path.getsize(os.path.join(p, f)) for d in dirs for p, _, fs in os.walk(d) for f in fs if "shuffle" in f}
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(500))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path := f"{tempfile.mkdtemp()}/documents")
    before, left, plain = files(), [], katz.discounts

    def watched(seen):
        time.sleep(1)
        left.append(sum(size for f, size in files().items() if f not in before))
        return plain(seen)

    monkeypatch.setattr(katz, "discounts", watched)
    katz.scores(spark.read.parquet(path))
    assert left and max(left) < 0.1 * sum(len(t) for _, t in rows), left


def test_what_one_chunk_has_is_not_sent():
    """Bigrams with a word that no other chunk has are counted where they are, documents that are held out included."""
    chunk = katz.Chunk(
        {
            "chunk": 0, "doc_ids": [0, 1], "held": [False, True], "lengths": np.array([4, 2]),
            "tokens": katz.planes(np.array([0, 1, 2, 3, 1, 3], np.int32)), "vocabulary": katz.planes(np.array([5, 10, 10, 10], np.uint64)),
        }
    )
    chunk.grams(1)
    word = {int(k): i for i, k in enumerate(chunk.distinct)}
    at = [word[int(k)] for k in np.array([5, 15, 25, 35], np.uint64) * katz._K1]
    replies = np.full(4, 9 * 4 + 1)
    replies[at[1]] = 0  # the second word is nobody else's
    answer = chunk.answer(replies)
    assert [answer[i] for i in at] == [37, 4 + 2 + 1, 37, 37]
    chunk.grams(2)
    # In order of place: <s> a, a b, b c, c </s>, <s> b, b </s>.
    assert chunk.local[chunk.inverse].tolist() == [False, True, True, False, True, True]
    answer = chunk.answer(np.full(2, 41))
    assert answer[chunk.inverse].tolist() == [41, 6, 6, 41, 3, 3]


@pytest.mark.parametrize("values", [[], [0], [0] * 300, [1, 2**63 + 5, 7], list(range(5000))])
def test_planes(values):
    for kind in (np.uint64, np.int64) if max(values, default=0) < 2**63 else (np.uint64,):
        assert katz.unplanes(katz.planes(np.array(values, kind)), kind).tolist() == values


def test_chunks_sort_only_their_vocabulary_for_words(monkeypatch):
    """Distinct n-grams and their numbers as np.unique gives them; for words, tokens are not sorted again."""
    draw = np.random.default_rng(4)
    vocabulary, tokens = np.unique(draw.integers(0, 300, 5_000), return_inverse=True)
    row = {"chunk": 0, "doc_ids": [0, 1], "held": [False, True], "lengths": np.array([3_000, 2_000]), "tokens": katz.planes(tokens.astype(np.int32)),
           "vocabulary": katz.planes(np.diff(vocabulary.astype(np.uint64) * np.uint64(7), prepend=np.uint64(0)))}
    chunk, sizes, sort = katz.Chunk(row), [], np.argsort
    monkeypatch.setattr(katz.np, "argsort", lambda values, *a, **k: sizes.append(len(values)) or sort(values, *a, **k))
    for n in (1, 2, 3):
        chunk.grams(n)
        distinct, inverse = np.unique(chunk.keys * katz._K1, return_inverse=True)
        assert (chunk.distinct == distinct).all() and (chunk.inverse == inverse).all()
        assert (chunk.inverse[chunk.first] == np.arange(len(distinct))).all()
        chunk.answer(np.full(int((~chunk.local).sum()), 5))
    assert sizes and sizes[0] == len(vocabulary)


def test_memory_does_not_follow_the_chunks_of_a_task(spark, monkeypatch):
    """A task with many chunks writes files of few of them, and what it evaluates as plain rows: nothing that Spark reads or writes at once
    holds all of them."""
    import pyarrow.parquet as pq

    from parcelspan.session import run_folder

    shared = os.path.dirname(run_folder(spark, "any"))
    before = set(os.listdir(shared)) if os.path.exists(shared) else set()
    files, written = {}, katz.written

    def watched(session, df, name, *a, **k):
        out = written(session, df, name, *a, **k)
        files[name] = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in out.inputFiles()]
        return out

    monkeypatch.setattr(katz, "written", watched)
    # Two texts of this length don't fit into a chunk.
    rows = [(i, f"w{i} w w{i % 3} " * 200_000) for i in range(9)] + corpus(9)
    assert katz.scores(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).count() == len(rows)
    held = [f.num_rows for f in files["chunks"]]
    assert max(held) <= 8 < 9 <= sum(held)
    for f in files["scored"]:
        for group in map(f.row_group, range(f.num_row_groups)):
            assert {group.column(i).num_values for i in range(f.num_columns)} == {group.num_rows}
    # Chunks and answers are gone when documents and contexts are joined.
    assert sorted(name.split("-")[0] for name in set(os.listdir(shared)) - before) == ["scored"]


def test_rows_leave_in_batches(monkeypatch):
    monkeypatch.setattr(katz, "BATCH", 4)
    batches = list(katz.rows_of(row=np.arange(10), doc_id=[None, *range(9)], held_out=np.arange(10) > 5))
    assert [b.num_rows for b in batches] == [4, 4, 2]
    rows = [r for b in batches for r in b.to_pylist()]
    assert [(r["row"], r["doc_id"], r["held_out"]) for r in rows] == [(i, i - 1 if i else None, i > 5) for i in range(10)]
    assert all(r[c] is None for r in rows for c in ("n_tokens", "key", "given", "times"))
    assert not list(katz.rows_of(key=np.array([], np.int64), given=np.array([]), lower=np.array([])))
