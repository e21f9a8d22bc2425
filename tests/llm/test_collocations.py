"""Phrases against plain dictionaries, and the automata alone."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from parcelspan.llm.collocations import Automaton, Dealt, folded, phrases, short_grams, unfolded, united
from parcelspan.llm.common import ship, table
from parcelspan.llm.katz import planes


def plain(rows, least, most, share, top):
    counts, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            held = counts.setdefault(lang, Counter())
            held.update(tuple(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, held in counts.items():
        candidates = {p: a for p, a in held.items() if len(p) > 1 and a >= least}
        gone = {
            p[i : i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
            if 100 * a >= share * candidates[p[i : i + k]]
        }
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (held[p[:k]] * held[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), held[p[:k]], held[p[k:]]))
        out += [(lang, at, p.decode(), -a, l, r, n[lang], -s) for at, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def found(documents, *given):
    return sorted(tuple(r) for r in phrases(documents, *given).collect())


def test_phrases_of_all_documents(spark, folder):
    ship(spark)
    documents = table(spark, folder, "documents", "text", "lang")
    rows = [tuple(r) for r in documents.collect()]
    assert found(documents.repartition(4), 2, 5, 50, 300, 3000, 700) == plain(rows, 2, 5, 50, 300)
    assert found(documents, 5, 5, 100, 2000) == plain(rows, 5, 5, 100, 2000)


def test_ties_overlaps_odd_words_and_a_hot_word(spark):
    ship(spark)
    draw = random.Random(1)
    words = ["a", "a", "a", "A", "É", "é", "x\x1fy", "ß", "\xa0", "tab\there", "it's"]
    rows = [("".join(draw.choice(words) + draw.choice([" ", " ", "  ", ". ", "\n", "\x0b"]) for _ in range(60)), draw.choice(["q", None, "und", "a b"])) for _ in range(40)]
    rows += [(None, "q"), ("", None), ("...", "q"), ("only", "z"), ("a " * 500, "q")]
    documents = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "text AS range", "lang AS words", "1 AS f")
    for least, most, share in ((3, 5, 100), (2, 3, 40), (1, 5, 100)):
        assert found(documents.repartition(3), least, most, share, 50, 400, 60) == plain(rows, least, most, share, 50)


def test_empty_tables(spark):
    ship(spark)
    assert found(spark.createDataFrame([], "text string, lang string")) == []
    assert found(spark.createDataFrame([("one two", "q")], "text string, lang string")) == []


def test_automata_keep_counts_and_share_states():
    draw = random.Random(2)
    grams = [tuple(draw.randint(0, 5) for _ in range(draw.randint(1, 4))) for _ in range(400)]
    rows = np.zeros((400, 4), dtype=np.int64)
    for row, gram in zip(rows, grams, strict=True):
        row[: len(gram)] = gram
    lengths, weights = np.array([len(g) for g in grams]), np.arange(1, 401)
    want = Counter()
    for gram, weight in zip(grams, weights.tolist(), strict=True):
        want[gram] += weight
    built = Automaton.load(Automaton.build(rows, lengths, weights).dump())
    labels, sizes, kept = built.paths()
    assert {tuple(g[:n]): w for g, n, w in zip(labels.tolist(), sizes.tolist(), kept.tolist(), strict=True)} == dict(want)
    assert built.compose(rows, lengths).tolist() == [want[g] for g in grams]
    assert built.compose(np.array([[9, 0, 0, 0]]), np.array([1])).tolist() == [0]
    same = Automaton.build(np.array([[k, 7] for k in range(9)]), np.full(9, 2), np.ones(9, dtype=np.int64))
    assert len(same.levels[1][1]) == 1  # nine first words lead to one state


def test_what_is_too_rare_is_left_out_of_automata():
    grams = np.array([[1, 2, 3], [1, 2, 4], [1, 5, 0], [6, 7, 0], [6, 8, 9], [6, 8, 9]])
    lengths, weights = np.array([3, 3, 2, 2, 3, 3]), np.array([5, 1, 9, 2, 2, 2])
    labels, sizes, kept = Automaton.build(grams, lengths, weights, 4).paths()
    held = {tuple(g[:n]): w for g, n, w in zip(labels.tolist(), sizes.tolist(), kept.tolist(), strict=True)}
    assert held == {(1, 2, 3): 5, (1, 5): 9, (6, 8, 9): 4}
    assert len(Automaton.build(grams, lengths, weights, 10).paths()[0]) == 0


def test_words_are_folded_and_unfolded():
    for words in ([], [b""], [b"a\tq", b"", "\u00e9\n\t".encode()], [b"%d" % k for k in range(3000)]):
        given = pa.array([b"before", *words, b"after"], pa.binary()).slice(1, len(words))
        assert unfolded(folded(given)).to_pylist() == words


class Given:
    """Stands for a table and gives back the function that would run on it."""

    def select(self, *columns):
        return self

    groupBy = select

    def mapInArrow(self, run, schema):
        return run

    applyInArrow = mapInArrow


def test_memory_of_a_range():
    """A worker that unites a range holds few bytes for each of its n-grams and words."""
    draw, parts, want = np.random.default_rng(3), [], Counter()
    for chunk in range(10):
        words = [b"%d-%d\tq" % (chunk, k) for k in range(9_000)] + [b"w%d\tq" % k for k in range(1_000)]
        tokens = draw.integers(1, len(words) + 1, 20_000).astype("<u4")
        want.update((words[a - 1], words[b - 1]) for a, b in zip(tokens, tokens[1:], strict=False))
        want.update((words[a - 1],) for a in tokens)
        batch = pa.RecordBatch.from_pydict({
            "chunk": pa.array([chunk], pa.int64()), "words": pa.array([folded(pa.array(words, pa.binary()))], pa.binary()),
            "tokens": pa.array([planes(tokens)], pa.binary()),
        })
        parts += short_grams(Dealt(1), Given())(iter([batch]))
    group = pa.Table.from_batches(parts)
    tracemalloc.start()
    found = united(Given(), 4, True)(group).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    grams = {tuple(w.encode() + b"\tq" for w in r["words"]): r["f"] for r in found if r["kind"] == "gram"}
    assert grams == {g: n for g, n in want.items() if n >= 4}
    assert peak < 120 * len(want), peak / len(want)
