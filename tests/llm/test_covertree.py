"""Exact search against all products."""

import math

import numpy as np
import pytest

from parcelspan.llm import covertree as ct


def brute(rows, k=5, every=50):
    fine = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.append((i, np.array([math.floor(256 * float(x)) for x in v], dtype=object)))
    out, done = set(), set()
    for i, q in sorted(fine, key=lambda r: (len(r[1]), r[1].tolist())):
        if i % every == 0 and i not in done:
            done.add(i)
            scores = sorted((-int(sum(q * v)), j) for j, v in fine if j != i and len(v) == len(q))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])}
    return out


def rows_of(seed, n=1500, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    points = (centres[rng.integers(0, 6, n)] + 0.2 * rng.normal(size=(n, dim))).astype(np.float32)
    points[: n // 3] = points[0]  # a very common vector
    return [(int(i), [float(x) for x in p]) for i, p in zip(rng.permutation(n), points, strict=True)]


@pytest.mark.parametrize("block", [64, 10_000])
def test_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(ct, "BLOCK", block)
    monkeypatch.setattr(ct, "QUERIES", 7 if block == 64 else 1024)
    odd = [(2000, None), (2050, [1.0, None] * 4), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (None, [0.0] * 8),
           (3000, [0.5, 1.5]), (3001, [2.0, -1.0]), (3050, [0.5, 1.5]), (3100, []), (3150, [])]
    rows = rows_of(block) + odd
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<float>, cell int").repartition(5)
    got = {tuple(r) for r in ct.top_k(df).collect()}
    assert got == brute(rows)


def test_given_vectors_and_empty_table(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = {tuple(r) for r in ct.top_k(df).collect()}
    assert got == brute([(r.vec_id, r.embedding) for r in df.collect()])
    assert ct.top_k(df.limit(0)).count() == 0


def test_trees_cover_and_prune():
    rng = np.random.default_rng(0)
    rows = np.floor(256 * np.repeat(rng.normal(size=(40, 16)) * 20, 100, axis=0) + rng.normal(size=(4000, 16)))
    tree, leaves, nodes = ct.build(rows), [], []
    stack = [tree]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack += node.children
        assert np.sqrt(((rows[node.points] - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        if not node.children:
            leaves.append(node.points)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(4000)) and len(leaves) > 10
    queries, ids = rows[::50], np.arange(4000)
    best = ct.Best(ids[::50], np.full(80, -np.inf), 5)
    made = ct.search(queries, ct.build(queries, 4), rows, ids, tree, best)
    products = queries @ rows.T
    products[np.arange(80), ids[::50]] = -np.inf
    for i in range(80):
        want = sorted(zip(-products[i], ids, strict=True))[:5]
        assert [(-s, int(j)) for s, j in want] == [(float(s), int(j)) for s, j in zip(best.scores[i], best.found[i], strict=True)]
    assert made < products.size / 2
    wide = np.array([[2.0**27, 2.0**27 + 1]])
    best = ct.Best(np.array([-1]), np.array([-np.inf]), 1)
    ct.search(wide, ct.build(wide), wide, np.array([5]), ct.build(wide), best)
    assert int(best.scores[0][0]) == 2**54 + (2**27 + 1) ** 2


def test_components_of_any_size(spark):
    """Finite vectors take part whatever their size; cancelling products stay exact, and what fits no long is an error."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 10.0 ** rng.integers(-3, 6)]) for i in range(400)]
    rows += [(450, [2.0**21, 1.0, -(2.0**21), 0.5]), (2, [2.0**21, 3.0, 2.0**21, 0.25]), (500, [2.0**40, 2.0**-8, 0.0])]
    rows += [(3, [0.0, 2.0**40, 7.0]), (4, [2.0**-8, 2.0**40, 7.0]), (5, [-(2.0**-8), 2.0**41, 1.0]), (6, [2.0**-7, 0.0, 0.0])]
    rows += [(550, [1.0, 2.0, 3.0, 4.0]), (550, [1.0, 2.0, 3.0, 3.5]), (550, [7.0, 7.0]), (551, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = brute(rows)
    assert {q for q, *_ in want} >= {450, 500, 550} and max(abs(s) for *_, s in want) > 1 << 53
    assert {tuple(r) for r in ct.top_k(df.repartition(3)).collect()} == want
    with pytest.raises(Exception, match="does not fit a long"):
        ct.top_k(spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id bigint, embedding array<double>")).collect()
