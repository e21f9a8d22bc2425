"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram binds its three letters: their vectors,
permuted by their place (rotated by 2, 1 and 0), are multiplied. A profile bundles trigrams: the sum of their vectors, each as often as the
trigram occurs. A document gets the language whose profile has the greatest cosine with its own, after the mean of all profiles,
each of unit length, is taken off both, as it says nothing about any of them; ties go to the smaller language value. With a single
language nothing is taken off.

Letters are lower-cased; everything that is no letter separates words, and a separator counts as a letter of its own, one at each end of a
word. Profiles are sums of whole numbers below 2^53, so they do not depend on how rows are dealt out. The tasks count
trigrams and bundle them whenever their table is full; what they return is a vector a language. The profiles, one a language
and `LANGUAGES` at most (more is an error: such a column does not hold languages), are sent to all tasks.

A null text and one without a letter are `und` with a score of 0, and so is every text where no language could be learned. The score is
(1 + cosine) / 2. Documents without a doc_id are never held out. Repeated rows count as often as they are there; columns other than doc_id, text
and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, SEED = 1024, 7  # components of a vector, and what the letters are drawn with
GAP = 32  # the separator's code
GRAMS = 1 << 18  # trigrams a language's table holds in a task before they are bundled
TOGETHER = 1 << 17  # letters of the documents whose vectors are made at once
LANGUAGES = 4096
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Letters:
    """Vectors of the letters met so far, rotated for each place of a trigram; one table a worker."""

    def __init__(self) -> None:
        self.rows: dict[int, int] = {}
        self.vectors = np.zeros((3, 0, SIZE), dtype=np.int8)

    def at(self, codes: np.ndarray) -> np.ndarray:
        """Row numbers of letters, which get their vectors when first met."""
        distinct, where = np.unique(codes, return_inverse=True)
        new = [c for c in distinct.tolist() if c not in self.rows]
        if new:
            drawn = np.stack([np.random.default_rng([SEED, c]).integers(0, 2, SIZE, dtype=np.int8) * 2 - 1 for c in new])
            turned = np.stack([np.roll(drawn, 2 - place, axis=1) for place in range(3)]).astype(np.int8)
            self.vectors = np.concatenate([self.vectors, turned], axis=1)
            for c in new:
                self.rows[c] = len(self.rows)
        return np.array([self.rows[c] for c in distinct.tolist()], dtype=np.int64)[where]

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of trigrams."""
        first, second, third = (self.at(grams >> shift & 0x1FFFFF) for shift in (42, 21, 0))
        return self.vectors[0][first] * self.vectors[1][second] * self.vectors[2][third]


LETTERS = Letters()
_IS_LETTER: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    if not _IS_LETTER:
        _IS_LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _IS_LETTER[0]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a text, each as three code points of 21 bits, and how often they occur; none without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    letter = is_letter()[codes]
    codes = np.concatenate([[GAP], np.where(letter, codes, GAP), [GAP]])
    gap = codes == GAP
    codes = codes[~(gap & np.concatenate([[False], gap[:-1]]))]  # one separator for a run of them
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)


def bundle(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of trigram vectors, exact."""
    total = np.zeros(SIZE)
    for at in range(0, len(grams), 1 << 14):
        total += counts[at : at + (1 << 14)].astype(np.float64) @ LETTERS.bound(grams[at : at + (1 << 14)]).astype(np.float64)
    return total


def learned(documents: DataFrame) -> dict[str, np.ndarray]:
    """The profile of every language, from rows of text and lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list] = {}
        bundled: dict[str, np.ndarray] = {}

        def merged(pieces: list) -> tuple[np.ndarray, np.ndarray]:
            grams, where = np.unique(np.concatenate([g for g, _ in pieces]), return_inverse=True)
            return grams, np.bincount(where, weights=np.concatenate([c for _, c in pieces]).astype(np.float64))

        def settle(lang: str) -> None:
            bundled[lang] = bundled.get(lang, 0) + bundle(*merged(waiting.pop(lang)))

        held: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                grams, counts = trigrams(text.as_py() or "")
                if not len(grams):
                    continue
                lang = lang.as_py()
                waiting.setdefault(lang, []).append((grams, counts))
                held[lang] = held.get(lang, 0) + len(grams)
                if held[lang] > GRAMS:
                    waiting[lang] = [merged(waiting[lang])]
                    held[lang] = len(waiting[lang][0][0])
                    if 2 * held[lang] > GRAMS:
                        settle(lang)
                        held[lang] = 0
            if sum(held.values()) > 8 * GRAMS:  # many languages in one task
                for lang in list(waiting):
                    settle(lang)
                held.clear()
        for lang in list(waiting):
            settle(lang)
        for lang, vector in bundled.items():
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * SIZE), "place": pa.array(range(SIZE), pa.int32()), "sum": pa.array(vector.astype(np.int64)),
            })

    parts = documents.select("text", "lang").mapInArrow(run, "lang string, place int, sum bigint")
    sums = parts.groupBy("lang", "place").agg(F.sum("sum").alias("sum"))
    profiles = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "sum"))).alias("cells"))
    rows = profiles.select("lang", F.col("cells.sum").alias("vector")).limit(LANGUAGES + 1).collect()
    if len(rows) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of lang: they are no languages")
    return {r["lang"]: np.array(r["vector"], dtype=np.float64) for r in rows}


def unit(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return vectors / np.where(lengths == 0, 1, lengths)


def identify(documents: DataFrame) -> DataFrame:
    """The predicted language of every document, learned from those that are not held out."""
    spark = documents.sparkSession
    known = documents.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    profiles = learned(known.select("text", F.col("lang").cast("string").alias("lang")))
    names = sorted(profiles)
    matrix = unit(np.stack([profiles[n] for n in names])) if names else np.zeros((0, SIZE))
    mean = matrix.mean(axis=0) if len(names) > 1 else np.zeros(SIZE)
    sent = spark.sparkContext.broadcast((names, mean, unit(matrix - mean).T.astype(np.float32)))

    def scored(texts: list) -> Iterator[tuple[str, float]]:
        names, mean, profiles = sent.value
        grams = [g for g, _ in texts]
        distinct, where = np.unique(np.concatenate(grams), return_inverse=True)
        counts = np.zeros((len(texts), len(distinct)), dtype=np.float32)
        rows = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
        counts[rows, where] = np.concatenate([c for _, c in texts])
        vectors = np.zeros((len(texts), SIZE), dtype=np.float32)
        for at in range(0, len(distinct), 1 << 13):
            vectors += counts[:, at : at + (1 << 13)] @ LETTERS.bound(distinct[at : at + (1 << 13)]).astype(np.float32)
        cosines = unit(unit(vectors) - mean.astype(np.float32)) @ profiles
        for grams, row, at in zip(grams, cosines, cosines.argmax(axis=1) if names else [0] * len(texts), strict=True):
            yield (names[at], min(1.0, max(0.0, (1 + float(row[at])) / 2))) if len(grams) and names else (UNKNOWN, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, waiting, size = [], [], 0
            for text in batch.column(1):
                waiting.append(trigrams(text.as_py() or ""))
                size += len(waiting[-1][0])
                if size > TOGETHER or len(waiting) == 64:
                    found.extend(scored(waiting))
                    waiting, size = [], 0
            if waiting:
                found.extend(scored(waiting))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = source.mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
