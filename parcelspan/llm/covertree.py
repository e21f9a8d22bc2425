"""Exact top-k by inner product with cover trees over both queries and vectors.

Components x become floor(256 x). Vectors are dealt out to cells around pivots (from a bounded sample; they only decide who
lies where, every vector is indexed), large cells to several blocks of about `BLOCK` rows by row number, so copies of one
vector are spread too. Queries are blocks of at most `QUERIES` rows around the same pivots, written as a table. A task builds the
cover tree of its block, streams the blocks of queries past it and searches each with a tree of its own:

    a pair of nodes can't hold a product above  cq.cp + |cq| rp + |cp| rq + rq rp

(centres c, covering radii r), so it is left out if that is below the worst kth score of its queries; pairs of blocks
are left out by the same bound before a block of queries is read at all. The first round searches one block of each query's own
cell and gives the kth scores to start with; the second searches all blocks and returns only what reaches them.
The bound is widened by more than its rounding error and ties are searched, so results are exact.

A tree halves nothing blindly: a node's points are covered by children of radius r / `SHRINK` as long as there are few such
children; otherwise it is a leaf, whose points are multiplied as one matrix. Identical vectors are a leaf of radius 0.

Scaled components are whole numbers kept as doubles, which hold them exactly whatever their size. Products are made in doubles where they fit
exactly, in longs where those do, and else in integers of any size; one among the best of a block that fits no long is an error, as is a
component whose 256-fold is no double.

Vectors that are null or hold null or non-finite components take no part, nor do rows with a null id. Vectors of different length never
meet. A query's own row is any row with its vec_id; repeated candidate rows each count. Rows that repeat a query's id are one query, by the
shortest vector and the smallest of those. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspan.llm.common import written
from parcelspan.session import run_folder

K, EVERY = 5, 50
BLOCK, QUERIES, LEAF, SHRINK = 16_384, 1_024, 256, 1.4
SAMPLE, PIVOTS = 4_096, 128  # rows of the sample and pivots at most
BLOCKS = "cell int, block bigint, dim int, ids array<bigint>, vectors array<double>, kth array<double>, centre array<double>, radius double, worst double"
FOUND = "query_id bigint, vec_id bigint, score bigint"


class Node:
    """Points of a cover tree's node (numbers of rows), its centre and the radius that covers them."""

    def __init__(self, points: np.ndarray, rows: np.ndarray, centre: np.ndarray):
        self.points, self.centre = points, centre
        self.radius = float(np.sqrt(((rows[points] - centre) ** 2).sum(axis=1).max()))
        self.norm = float(np.sqrt(centre @ centre))
        self.children: list[Node] = []


def build(rows: np.ndarray, leaf: int = LEAF) -> Node:
    """A cover tree over the rows; every point is in exactly one leaf."""
    root = Node(np.arange(len(rows)), rows, rows.mean(axis=0))
    open_ = [root]
    while open_:
        node = open_.pop()
        n = len(node.points)
        if n <= leaf or node.radius == 0:
            continue
        mine, most = rows[node.points], max(2, n // (leaf // 4))
        reach = (node.radius / SHRINK) ** 2
        # Farthest first: each new centre is farther than the reach from all before it.
        near = np.full(n, np.inf)
        owner, centres = np.zeros(n, dtype=np.int64), 0
        at = int(((mine - node.centre) ** 2).sum(axis=1).argmax())
        while near[at] > reach and centres <= most:
            apart = ((mine - mine[at]) ** 2).sum(axis=1)
            closer = apart < near
            owner[closer], near[closer] = centres, apart[closer]
            centres += 1
            at = int(near.argmax())
        if centres <= most:
            for i in range(centres):
                points = node.points[owner == i]
                node.children.append(Node(points, rows, rows[points].mean(axis=0)))
            open_ += node.children
    return root


def bound(q: Node, p: Node) -> float:
    most = q.centre @ p.centre + q.norm * p.radius + p.norm * q.radius + q.radius * p.radius
    # More than the rounding of a sum whose terms may cancel.
    return most + 1e-6 + 1e-9 * (q.norm + q.radius) * (p.norm + p.radius)


def below(score: int | float) -> float:
    """A double that is not above the score."""
    return float(score) if abs(score) < 1 << 53 else float(np.nextafter(float(score), -np.inf))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products, exact."""
    most = max(np.abs(queries).max(initial=0), 1) * max(np.abs(rows).max(initial=0), 1) * max(queries.shape[1], 1)
    if most < 1 << 53:
        return queries @ rows.T
    if most < 1 << 62:
        return queries.astype(np.int64) @ rows.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return whole(queries) @ whole(rows).T


class Best:
    """The k best of each query so far; scores below `kth` of the start are not kept."""

    def __init__(self, ids: np.ndarray, kth: np.ndarray, k: int):
        self.ids, self.k, self.kth = ids, k, kth.copy()
        self.scores = [np.empty(0, dtype=np.int64)] * len(ids)
        self.found = [np.empty(0, dtype=np.int64)] * len(ids)

    def add(self, queries: np.ndarray, ids: np.ndarray, products: np.ndarray) -> None:
        hits = products >= self.kth[queries][:, None]
        for row in np.flatnonzero(hits.any(axis=1)):
            query = queries[row]
            some = np.flatnonzero(hits[row])
            some = some[ids[some] != self.ids[query]]
            new = products[row, some]
            scores = np.concatenate([self.scores[query], new if new.dtype == object else new.astype(np.int64)])
            found = np.concatenate([self.found[query], ids[some]])
            if scores.dtype == object:
                best = np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], found[i]))[: self.k], dtype=np.int64)
            else:
                best = np.lexsort((found, -scores))[: self.k]
            self.scores[query], self.found[query] = scores[best], found[best]
            if len(best) == self.k:
                self.kth[query] = max(self.kth[query], below(int(scores[best[-1]])))


def search(queries: np.ndarray, top: Node, rows: np.ndarray, ids: np.ndarray, tree: Node, best: Best) -> int:
    """Go down both trees together, the most promising pairs first; returns the number of products made."""
    made, stack = 0, [(bound(top, tree), top, tree)]
    while stack:
        most, q, p = stack.pop()
        if most < best.kth[q.points].min():
            continue
        if not q.children and not p.children:
            best.add(q.points, ids[p.points], products(queries[q.points], rows[p.points]))
            made += len(q.points) * len(p.points)
            continue
        split_q = q.children and (not p.children or q.radius > p.radius)
        pairs = [(c, p) for c in q.children] if split_q else [(q, c) for c in p.children]
        stack += sorted(((bound(a, b), a, b) for a, b in pairs), key=lambda x: x[0])
    return made


def matrix(table: pa.Table | pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    column = table.column(table.schema.get_field_index(name))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and the scaled vector, of rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def whole(x: Column) -> Column:
        y = x * 256
        return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)  # larger ones are whole

    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")
    ).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return rows.where(F.coalesce(fine, F.lit(False))).select(
        "vec_id", F.size("embedding").alias("dim"), F.transform("embedding", whole).alias("vector")
    )


def pivots_of(rows: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Pivots for each length of vectors, by farthest-first choice in a sample of bounded size."""
    share = min(1.0, SAMPLE / max(1, count))
    drawn = rows.where(F.abs(F.xxhash64(F.lit(11), "vec_id") % 1_000_000) <= int(share * 1_000_000))
    sample: dict[int, list] = {}
    for r in drawn.select("dim", "vector").limit(2 * SAMPLE).collect():
        sample.setdefault(r.dim, []).append(r.vector)
    out = {}
    for dim, some in sample.items():
        points = np.unique(np.array(some, dtype=np.float64).reshape(len(some), dim), axis=0)
        chosen, near = [points.mean(axis=0)], ((points - points.mean(axis=0)) ** 2).sum(axis=1)
        for _ in range(min(PIVOTS, len(points), -(-count // (BLOCK // 4))) - 1):
            chosen.append(points[near.argmax()])
            near = np.minimum(near, ((points - chosen[-1]) ** 2).sum(axis=1))
        # Cells around the means of what lies nearest to each are tighter.
        owner = (-2 * points @ np.stack(chosen).T + (np.stack(chosen) ** 2).sum(axis=1)).argmin(axis=1)
        out[dim] = np.stack([points[owner == i].mean(axis=0) if (owner == i).any() else c for i, c in enumerate(chosen)])
    return out


def in_cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros(batch.num_rows, dtype=np.int32)
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                if dim in pivots:
                    at = np.flatnonzero(dims == dim)
                    points, p = matrix(batch.take(pa.array(at)), "vector", dim), pivots[dim]
                    if np.isinf(points).any():
                        raise ValueError("a component's 256-fold is no double")
                    cells[at] = (-2 * points @ p.T + (p**2).sum(axis=1)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], ["vec_id", "dim", "vector", "cell"])

    return rows.mapInArrow(run, "vec_id bigint, dim int, vector array<double>, cell int")


def blocked(rows: DataFrame, size: int) -> DataFrame:
    """Add `block`: cells of more than `size` rows are dealt out by row number."""
    counts = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / size).alias("_parts"))
    # At most `PIVOTS` rows for each length of vectors.
    numbered = rows.withColumn("_row", F.monotonically_increasing_id()).join(counts, ["dim", "cell"])
    return numbered.withColumn("block", F.pmod(F.xxhash64("_row"), "_parts")).drop("_row", "_parts")


def query_blocks(queries: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        dim, cell, block = (table[c][0].as_py() for c in ("dim", "cell", "block"))
        rows = matrix(table, "vector", dim)
        node = Node(np.arange(len(rows)), rows, rows.mean(axis=0))
        kth = [-np.inf if x is None else below(x) for x in table["kth"].to_pylist()]
        values = cell, block, dim, table["vec_id"].to_pylist(), rows.reshape(-1), kth, node.centre, node.radius, min(kth)
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64())
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

    return queries.groupBy("dim", "cell", "block").applyInArrow(run, BLOCKS)


def searched(folder: str, k: int, own_cell: bool):
    """What a block of vectors has for the blocks of queries in a folder: for those of its own cell, or for all."""

    def run(table: pa.Table) -> pa.Table:
        dim, cell = (table[c][0].as_py() for c in ("dim", "cell"))
        rows, ids = matrix(table, "vector", dim), table["vec_id"].to_numpy()
        tree = build(rows)
        fs, root = FileSystem.from_uri(folder)
        source = ds.dataset(root, filesystem=fs, format="parquet", exclude_invalid_files=True)
        alike = ds.field("dim") == dim
        known = source.to_table(columns=["cell", "block", "centre", "radius", "worst"], filter=alike).to_pylist()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in known:
            if own_cell and b["cell"] != cell:
                continue
            top = Node(np.array([0]), np.array([b["centre"]]), np.array(b["centre"]))
            top.radius = b["radius"]
            if bound(top, tree) < b["worst"]:
                continue
            same = alike & (ds.field("cell") == b["cell"]) & (ds.field("block") == b["block"])
            for part in source.to_table(columns=["ids", "vectors", "kth"], filter=same).to_pylist():
                queries = np.array(part["vectors"], dtype=np.float64).reshape(len(part["ids"]), dim)
                best = Best(np.array(part["ids"], dtype=np.int64), np.array(part["kth"]), k)
                search(queries, build(queries, LEAF // 4), rows, ids, tree, best)
                sizes = [len(s) for s in best.scores]
                out.append((np.repeat(best.ids, sizes), np.concatenate(best.found), np.concatenate(best.scores)))
        columns = [np.concatenate([o[i] for o in out]) if out else np.empty(0, dtype=np.int64) for i in range(3)]
        if columns[2].dtype == object and any(abs(score) >= 1 << 63 for score in columns[2]):
            raise OverflowError("a score among the best of a block does not fit a long")
        columns = [c.astype(np.int64) for c in columns]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """For every vector whose id is divisible by `every`: its k best among all others, ties to the smaller id."""
    spark = vectors.sparkSession
    rows = written(spark, scaled(vectors), "scaled")
    pivots = pivots_of(rows, rows.count())
    cells = written(spark, in_cells(rows, pivots), "cells")
    blocks = written(spark, blocked(cells, BLOCK), "blocks")
    asked = cells.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "vector", "cell")).alias("q"))
    asked = asked.select("vec_id", "q.dim", "q.vector", "q.cell")

    def query_table(kth: DataFrame | None) -> str:
        known = asked.withColumn("kth", F.lit(None).cast("bigint")) if kth is None else asked.join(kth, "vec_id", "left")
        folder = run_folder(spark, "queries")
        query_blocks(blocked(known, QUERIES)).write.option("compression", "zstd").parquet(folder)
        return folder

    of_blocks = lambda some, folder, own: some.groupBy("dim", "cell", "block").applyInArrow(searched(folder, k, own), FOUND)
    first = ranked(of_blocks(blocks.where("block = 0"), query_table(None), True), k).where(F.col("rank") == k)
    start = written(spark, first.select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth")), "kth")
    found = written(spark, of_blocks(blocks, query_table(start), False), "found")
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")


# The same where products fit a double exactly and ids are not repeated.
SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""
