"""Near-duplicates against exact sets of all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from parcelspan.llm import minhash as mh


def shingle_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows, percent):
    """(doc_id, n_shingles, component_id) for every row, by all pairs that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    holders = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].add(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    seen = set()
    for some in holders.values():
        for i in some:
            for j in some:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    common = len(sets[i] & sets[j])
                    if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                        parent[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)].append(doc)
    return sorted(
        ((doc, len(sets[i]), min(least[root(i)], default=None) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=repr
    )


def groups_of_copies(seed):
    """Texts with exact copies, near copies around the threshold, chains of near copies, a passage many share, odd rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = []
    for _ in range(25):
        base = words(rng.choice([3, 5, 8, 40, 120]))
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).title() if rng.random() < 0.3 else " \n".join(copy))
    chain = words(200)
    for _ in range(40):
        chain = list(chain)
        chain[rng.randrange(200)] = rng.choice(vocabulary)
        texts.append(" ".join(chain))
    passage = words(40)
    texts += [" ".join(words(30) + passage + words(30)) for _ in range(150)]
    texts += [None, "", " \t\n", "a", "A", "a b c d", "a b c d", "É b", "é b", "x " * 30_000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(rows[0][0], rows[0][1])] * 3 + [(None, rows[1][1]), (None, "only here without an id")]


@pytest.mark.parametrize("pairs", [256, 0])
def test_groups_equal_brute_force(spark, pairs, monkeypatch):
    monkeypatch.setattr(mh, "PAIRS", pairs)
    rows = groups_of_copies(pairs)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, node string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in mh.near_duplicates(df).collect()), key=repr)
    assert got == brute(rows, 85)
    kept = [r.doc_id for r in mh.drop_near_duplicates(df).collect()]
    want = {(c, n) for d, n, c in brute(rows, 85)}
    empty = [d for d, t in rows if not shingle_set(t)]
    assert sorted(d for d in kept if d is not None and d not in empty) == sorted({c for c, n in want if n and c is not None})


def test_given_documents_and_empty_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in mh.near_duplicates(df).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in df.collect()], 85)
    assert mh.near_duplicates(df.limit(0)).count() == 0
    dropped = mh.drop_near_duplicates(df)
    assert dropped.columns == df.columns and dropped.count() == len({c for _, _, c in got})


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1200)] + [(500, 7)]
    random.Random(3).shuffle(edges)
    labels = dict(map(tuple, mh.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert {labels[i] for i in [*range(301), 500]} == {0} and {labels[i] for i in range(1000, 1200)} == {1000}


def test_shingles_and_signature():
    h = np.arange(1, 9, dtype=np.int64)
    assert len(mh.shingles(h)) == 4 and len(mh.shingles(h[:3])) == 1 and len(mh.shingles(h[:0])) == 0
    assert len(mh.shingles(np.ones(50, dtype=np.int64))) == 1
    some = mh.shingles(np.arange(20_000, dtype=np.int64))
    assert (mh.signature(some) == np.minimum(mh.signature(some[:5000]), mh.signature(some[5000:]))).all()
