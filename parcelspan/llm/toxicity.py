"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, A-Z in lower case. A document's features are its distinct words, pairs
of neighbouring words and pairs of words with one between them, hashed to `BITS` bits; each counts once.
Per-coordinate learning rates and the L1 penalty leave a short list of weights, which is what is broadcast:
its size is bounded by 2**BITS whatever the corpus.

Fitting reads a sample of labelled rows of bounded size (`train_rows`, chosen by the hash of the id, so it is
the same in every run), in one task: the method is sequential. Scoring reads every document, one pass, no
shuffle.

Null and empty texts have no features and get the score of the bias alone. Rows whose label or id is null teach
nothing; of several labels of an id each is a row of its own. Without any training row the bias stands for a share of
0.1, so nothing is rejected. A repeated document is scored each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspan.llm.common import free_names, lower_ascii

BITS = 20
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 6.0, 0.0, 3
SLICE = 500  # documents whose features are made at once


def word_hashes(text: Column) -> Column:
    found = F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(found, lambda w: w != ""), lambda w: F.xxhash64(w))


def features(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of some documents and the document each belongs to; a feature may repeat."""
    h = hashes.view(np.uint64)
    doc = np.repeat(np.arange(len(counts)), counts)
    first, second = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    parts, owners = [h * first], [doc]
    for gap, salt in ((1, 0x165667B19E3779F9), (2, 0x27D4EB2F165667C5)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            pair = ((h[:-gap] * first) ^ (h[gap:] + np.uint64(salt))) * second
            parts.append(pair[same])
            owners.append(doc[gap:][same])
    mixed = np.concatenate(parts)
    mixed ^= mixed >> np.uint64(29)
    mixed *= second
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owners)


def slices(batch: pa.RecordBatch, name: str = "_tox_words") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    lists = batch.column(batch.schema.get_field_index(name))
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    for at in range(0, len(lists), SLICE):
        to = min(at + SLICE, len(lists))
        yield at, to, flat[offsets[at] : offsets[to]], np.diff(offsets[at : to + 1])


def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights left by FTRL over all rows of the sample; index -1 is the bias."""
    rows: list[tuple[int, float, np.ndarray]] = []
    for batch in batches:
        order, label = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("place", "toxic"))
        for at, to, flat, counts in slices(batch):
            index, owner = features(flat, counts)
            keys = np.unique(owner << BITS | index)
            cut = np.searchsorted(keys, np.arange(to - at + 1) << BITS)
            mask = (1 << BITS) - 1
            rows += [
                (int(order[at + i]), float(label[at + i]), (keys[cut[i] : cut[i + 1]] & mask).astype(np.int32))
                for i in range(to - at)
            ]
    rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    share = (sum(r[1] for r in rows) + 0.1) / (len(rows) + 1)
    bias, bias_n = float(np.log(share / (1 - share))), 0.0

    def weight(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zi) * L1 - zi
        return np.where(np.abs(zi) <= L1, 0.0, shrunk / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for _, label, index in rows:
            zi, ni = z[index], n[index]
            w = weight(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - label
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[index] = ni + g * g
            bias_n += g * g
            bias -= ALPHA * g / (BETA + np.sqrt(bias_n))
    w = weight(z, n)
    kept = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(kept, -1), pa.int64()), pa.array(np.append(w[kept], bias), pa.float64())], ["index", "weight"]
    )


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Weights learnt from labelled documents: the feature numbers, ascending, and their weights."""
    usable = labels.select("doc_id", F.col("toxic").cast("double").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    usable = usable.groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    share = min(1.0, train_rows / max(1, usable.count()))
    drawn = usable.withColumn("place", F.xxhash64(F.lit(7), "doc_id")).where(
        F.abs(F.col("place") % 1_000_000) < int(share * 1_000_000)
    )
    # The drawn labels are about `train_rows` rows of three numbers, so they can be sent to all tasks.
    # Of rows that repeat a doc_id one is learnt, so the fitting task gets no more rows than labels.
    sample = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    sample = sample.groupBy("doc_id", "place", "toxic").agg(F.min("text").alias("text"))
    sample = sample.select("place", "toxic", word_hashes(F.col("text")).alias("_tox_words")).repartition(1)
    model = sample.mapInArrow(train, "index bigint, weight double").collect()
    if not model:  # no partition at all
        model = next(train(iter(()))).to_pylist()
        return np.array([r["index"] for r in model]), np.array([r["weight"] for r in model])
    model.sort(key=lambda r: r["index"])
    return np.array([r["index"] for r in model]), np.array([r["weight"] for r in model])


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], name: str = "toxic_score") -> DataFrame:
    """Add a column, the probability of the label 1, to every document."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    (listed,) = free_names(documents, "_tox_words")
    kept = [c for c in documents.columns if c != name]
    out = documents.select(*kept).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weights = sent.value
        dense = np.zeros(1 << BITS, dtype=np.float64)
        dense[index[index >= 0]] = weights[index >= 0]
        bias = float(weights[index == -1][0])
        for batch in batches:
            total = np.full(batch.num_rows, bias)
            for at, to, flat, counts in slices(batch, listed):
                number, owner = features(flat, counts)
                hit = dense[number] != 0
                keys = np.unique(owner[hit] << BITS | number[hit])
                total[at:to] += np.bincount(keys >> BITS, dense[keys & ((1 << BITS) - 1)], minlength=to - at)
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p)], [*kept, name])

    return documents.select(*kept, word_hashes(F.col("text")).alias(listed)).mapInArrow(run, out)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fourth of the documents whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: whether it is held out, its score and the prediction at `THRESHOLD`."""
    model = fit(documents, labels.where(~held_out()))
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic, with all their columns."""
    model = fit(documents, labels.where(~held_out()))
    (name,) = free_names(documents, "_tox_score")
    return score(documents, model, name).where(F.col(name) < THRESHOLD).select(*documents.columns)
