"""Near-duplicates: an LSH forest proposes pairs, full shingle sets confirm them, components are whole.

Texts with the same words are one class from the start, so copies never meet in pairs. A class has a signature of
64 minima over its five-word shingles, read in 16 orders (rotations by four). In each order, classes with a common prefix
form a region; the orders are the trees of the forest, and no tree is ever gathered: regions are keys of a grouping.

1. Every class is compared with the representative of the deepest region it shares with another class, over all
   trees, and with the smallest representative of its shallowest regions: at most two pairs a class. Components are found.
2. In every tree, a class outside the largest component of its regions is compared with that component's representative
   in the deepest region where they differ. Components again. So dense groups are joined without pairs among their members, and
   the depth adapts to each region.
3. What is left are regions that still hold several components. Where the classes outside the largest one make at most `PAIRS`
   pairs with the region's members, all of them are compared. Crowded regions (documents that share a passage, say) go
   another exact way: sets that are similar enough share one of their rarest shingles, as many as they may differ by and one more,
   so only classes that meet in such a shingle and not in a component are compared, all of them.
4. Components, with the new links.

No pair inside a component is ever needed, so nothing grows with the square of a group. At four equal minima of a
tree and similarity 0.85, a link is missed by all 16 trees in 7 of a million cases; similarities above that, and every
further member of the same group, lower it more.

Words are runs of anything but ASCII white space, A-Z in lower case. A document of fewer than five words has one
shingle, the whole of it. Null, empty and blank texts have none and are linked with nothing. Repeated rows are one class;
rows with a null doc_id take part in links but never name a component unless it has no other row. Classes and shingles are
known by 64-bit hashes. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspan.llm.common import free_names, lower_ascii, words, written

WIDTH, PERMS, TREES = 5, 64, 16
DEPTHS = (4, 8, 16)
PERCENT = 85
PAIRS = 256
CHUNK = 1 << 13
_RNG = np.random.default_rng(20240601)
_MUL = _RNG.integers(1, 1 << 63, PERMS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, PERMS, dtype=np.uint64)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def hashed(text: Column) -> list[Column]:
    """The class of a text and the hashes of its words."""
    found = words(lower_ascii(text))
    return [F.xxhash64(F.array_join(found, " ")).alias("node"), F.transform(found, lambda w: F.xxhash64(w)).alias("hashes")]


def shingles(hashes: np.ndarray) -> np.ndarray:
    """The distinct shingles of a document, ascending."""
    h = hashes.view(np.uint64)
    if not len(h):
        return h
    width = min(WIDTH, len(h))
    mixed = np.full(len(h) - width + 1, np.uint64(width))
    for i in range(width):
        mixed = (mixed ^ h[i : len(h) - width + 1 + i]) * _K1
        mixed ^= mixed >> np.uint64(29)
    mixed *= _K2
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def signature(some: np.ndarray) -> np.ndarray:
    low = np.full(PERMS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(some), CHUNK):
        low = np.minimum(low, (some[at : at + CHUNK, None] * _MUL + _ADD).min(axis=0))
    return low


def prefixes(signatures: np.ndarray) -> np.ndarray:
    """Keys of the regions of each signature: for every depth, one for every tree."""
    order = (np.arange(TREES)[:, None] * (PERMS // TREES) + np.arange(max(DEPTHS))) % PERMS
    out, key = [], np.zeros((len(signatures), TREES), dtype=np.uint64)
    for d in range(max(DEPTHS)):
        key = (key ^ signatures[:, order[:, d]]) * _K1
        key ^= key >> np.uint64(31)
        if d + 1 in DEPTHS:
            out.append(key.copy())
    return np.concatenate(out, axis=1).view(np.int64)


def lists(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield flat[a:b]


def list_array(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sets = [shingles(h) for h in lists(batch, "hashes")]
            keys = prefixes(np.stack([signature(s) for s in sets]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 list_array(keys.reshape(-1), np.full(len(sets), keys.shape[1]))],
                ["doc_id", "node", "n", "keys"],
            )


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sets = [shingles(h) for h in lists(batch, "hashes")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), list_array(np.concatenate(sets).view(np.int64), np.array([len(s) for s in sets]))],
                ["node", "shingles"],
            )


def shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose region (tree and key) holds more than one class, with the region's first class."""
    regions = rows.groupBy("tree", key).agg(F.min("node").alias("_low"), F.max("node").alias("_high"))
    return rows.join(regions.where("_low < _high").drop("_high"), ["tree", key])


def links(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("_sa", "_sb"))
    return both.where(100 * common >= percent * (F.size("_sa") + F.size("_sb") - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of an edge. Labels spread to neighbours and then
    jump to the label of the label, so the rounds grow with the logarithm of the longest path."""
    spark = edges.sparkSession
    both = written(spark, edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(
        spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels"
    )
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        spread = labels.join(near, "node").select("node", "label", F.least("label", "_near").alias("_new"))
        jump = labels.select(F.col("node").alias("_new"), F.col("label").alias("_jump"))
        moved = written(
            spark, spread.join(jump, "_new").select("node", F.least("_new", "_jump").alias("label"), F.col("label").alias("_old")), "labels"
        )
        labels = moved.select("node", "label")
        if moved.where("label < _old").isEmpty():
            return labels


def sized(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs of columns a, b, na, nb whose set sizes allow the similarity, each once, the smaller node first."""
    fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("a") != F.col("b"))
    return pairs.where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def nearest(members: DataFrame) -> DataFrame:
    """At most two pairs for each class: with its deepest neighbour, and with its smallest."""
    found = members
    for i, _ in enumerate(DEPTHS[1:], 1):
        regions = members.groupBy("tree", f"k{i}").agg(
            F.min(F.struct("node", "n")).alias(f"low{i}"), F.max("node").alias("_high")
        )
        regions = regions.where(F.col(f"low{i}.node") < F.col("_high")).drop("_high")
        found = found.join(regions, ["tree", f"k{i}"], "left")
    deep = F.coalesce(*[
        F.when(F.col(f"low{i}").isNotNull(), F.struct(F.lit(-i).alias("depth"), F.col(f"low{i}").alias("to")))
        for i in range(len(DEPTHS) - 1, 0, -1)
    ], F.struct(F.lit(0).alias("depth"), F.col("low0").alias("to")))
    best = found.groupBy("node").agg(F.first("n").alias("n"), F.min(deep).alias("deep"), F.min("low0").alias("low"))
    to = F.explode(F.array("deep.to", "low")).alias("to")
    return best.select(F.col("node").alias("a"), F.col("n").alias("na"), to).select(
        "a", "na", F.col("to.node").alias("b"), F.col("to.n").alias("nb")
    )


def region_mains(named: DataFrame, key: list[str]) -> DataFrame:
    """Regions (by key) that hold several components: the largest, its first class, and the pairs others would make."""
    held = named.groupBy(*key, "comp").agg(F.count("*").alias("rows"), F.min(F.struct("node", "n")).alias("low"))
    region = held.groupBy(*key).agg(
        F.max_by(F.struct("comp", "low"), F.struct("rows", "comp")).alias("main"), F.count("*").alias("comps"),
        ((F.sum("rows") - F.max("rows")) * F.sum("rows")).alias("pairs"),
    )
    return region.where("comps > 1").select(*key, "main.comp", "main.low", "pairs").withColumnRenamed("comp", "main")


def with_components(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label", "low0")


def to_mains(named: DataFrame) -> DataFrame:
    """At most one pair for each class and tree: with the largest component of its deepest region where that isn't its own."""
    found = None
    for i in range(len(DEPTHS)):
        mains = region_mains(named, ["tree", f"k{i}"])
        some = named.join(mains, ["tree", f"k{i}"]).where("comp <> main").select("node", "n", "tree", F.lit(i).alias("depth"), "low")
        found = some if found is None else found.union(some)
    best = found.groupBy("node", "tree").agg(F.first("n").alias("na"), F.max_by("low", "depth").alias("low"))
    return best.select(F.col("node").alias("a"), "na", F.col("low.node").alias("b"), F.col("low.n").alias("nb")).distinct()


def across(named: DataFrame, mains: DataFrame, key: list[str], percent: int) -> DataFrame:
    """Classes outside the largest component of a region, with all its members of other components. `ahead` is how many
    shingles a class can still have in common with one it meets here (all of them, unless some are known to come before);
    pairs that can't be similar enough with that are left out: for whole sets this is the bound on their sizes."""
    here = named.join(mains.select(*key, "main"), key)
    side = lambda x: [F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("comp").alias(f"c{x}"), F.col("ahead").alias(f"h{x}")]
    others, every = here.where("comp <> main").select(*key, *side("a")), here.select(*key, *side("b"))
    fits = (100 + percent) * F.least("ha", "hb") >= percent * (F.col("na") + F.col("nb"))
    return others.join(every, key).where(fits & (F.col("ca") != F.col("cb"))).select("a", "na", "b", "nb")


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """node, shingle, ahead: the rarest shingles of each set, as many as a similar enough set can't lack all of, and how many
    of the set are at least as common. Shingles of a single set take places but are left out: nothing meets there."""
    rows = sets.select("node", F.explode("shingles").alias("shingle"))
    common = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    shared_ = rows.join(common, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("rare"))
    size = F.size("shingles")
    places = size - F.ceil(size * percent / 100).cast("int") + 1 - (size - F.size("rare"))
    kept = sets.join(shared_, "node").where(places > 0).select(
        "node", F.size("rare").alias("_rare"), F.posexplode(F.slice("rare", F.lit(1), F.greatest(places, F.lit(0)))).alias("_at", "_one")
    )
    return kept.select("node", F.col("_one.shingle").alias("shingle"), (F.col("_rare") - F.col("_at")).cast("bigint").alias("ahead"))


def left_over(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that share a region but not a component; in crowded regions those that share a rare shingle."""
    spark = members.sparkSession
    key = ["tree", "k0"]
    named = written(spark, with_components(members, labels), "named")
    mains = written(spark, region_mains(named, key), "mains")
    calm = across(named.withColumn("ahead", F.col("n")), mains.where(F.col("pairs") <= PAIRS), key, percent)
    crowd = named.join(mains.where(F.col("pairs") > PAIRS).select(*key), key).select("node", "n", "comp").distinct()
    crowd = written(spark, crowd, "crowd")
    rare = rarest(sets.join(crowd.select("node"), "node", "leftsemi"), percent)
    meeting = written(spark, rare.join(crowd, "node"), "meeting")
    return calm.union(across(meeting, region_mains(meeting, ["shingle"]), ["shingle"], percent))


def find(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, node (its class), n_shingles and component_id."""
    spark = documents.sparkSession
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signs = source.select("doc_id", *hashed(F.col("text"))).where(F.size("hashes") > 0)
    docs = written(spark, signs.mapInArrow(signed, "doc_id bigint, node bigint, n bigint, keys array<bigint>"), "signatures")

    # A region is a tree's number and the key of a prefix; one row for each class and tree.
    by_depth = [F.slice("keys", 1 + i * TREES, TREES).alias(f"k{i}") for i in range(len(DEPTHS))]
    classes = docs.select("node", "n", "keys").dropDuplicates(["node"])
    trees = classes.select("node", "n", F.posexplode(F.arrays_zip(*by_depth)).alias("tree", "k"))
    trees = trees.select("node", "n", "tree", "k.*")
    regions = trees.groupBy("tree", "k0").agg(F.min(F.struct("node", "n")).alias("low0"), F.max("node").alias("_high"))
    regions = regions.where(F.col("low0.node") < F.col("_high")).drop("_high")
    members = written(spark, trees.join(regions, ["tree", "k0"]), "members")

    # The full sets of all classes that share a region: one text of each, found by its class.
    wanted = members.select("node").distinct()
    texts = source.select(hashed(F.col("text"))[0], "text").groupBy("node").agg(F.first("text").alias("text"))
    texts = texts.join(wanted, "node", "leftsemi").select("node", hashed(F.col("text"))[1])
    sets = written(spark, texts.mapInArrow(sets_of, "node bigint, shingles array<bigint>"), "sets")

    first = written(spark, links(sized(nearest(members), percent), sets, percent), "links")
    labels = components(first)
    for pairs in (lambda: to_mains(with_components(members, labels)), lambda: left_over(members, labels, sets, percent)):
        more = links(sized(pairs(), percent), sets, percent)
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))

    reps = docs.groupBy("node").agg(F.min("doc_id").alias("rep"))
    whole = reps.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = whole.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = written(spark, whole.select("node", "label").join(lowest, "label").drop("label"), "components")
    linked = docs.select("doc_id", "node", F.col("n").alias("n_shingles")).join(named, "node")
    none = source.where(F.size(words(F.col("text"))) == 0).select(
        "doc_id", F.lit(None).cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    return linked.select("doc_id", "node", "n_shingles", "component_id").union(none)


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: the size of its set, the smallest doc_id of its component, and whether that is its own."""
    found = find(documents, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns. Documents without words
    all stay; of rows that repeat the kept document, one stays."""
    found = find(documents, percent)
    kept = found.where("node IS NOT NULL").select(F.col("component_id").alias("doc_id"), "node", F.col("doc_id").alias("_own"))
    id_, node, count, class_ = free_names(documents, "_id", "_node", "_words", "_class")
    kept = kept.where(F.col("_own").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias(id_), F.col("node").alias(node)).distinct()
    rows = documents.withColumns({count: F.size(words(F.col("text"))), class_: hashed(F.col("text"))[0]})
    empty = rows.where(F.col(count) == 0).select(*documents.columns)
    some = rows.where(F.col(count) > 0).join(
        kept, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(class_) == F.col(node)), "leftsemi"
    )
    return some.dropDuplicates(["doc_id", class_]).select(*documents.columns).union(empty)


# The same for links from 85 of 100; ids are not repeated.
SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON p.x = nx.doc_id JOIN n ny ON p.y = ny.doc_id WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON c.doc_id = n.doc_id"""
