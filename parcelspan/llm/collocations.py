"""Phrases whose words occur together more often than their parts would by chance, per language.

Counts of n-grams are weighted acyclic automata. A shard is a chunk of documents: its n-grams, in the order of their words, are built
into automata whose paths are n-grams and whose arcs carry counts; states are registered as soon as their last arc is known, from the deepest
on, and equal ones are kept once. A shard's automata are dealt out by prefix range (the first word's, in the order of a checksum of the
words) and the n-grams of a range by a hash of their other words, so that a frequent first word is many groups. The automata of one
range are united, weights of equal paths added. Words stand for themselves and their language: `word TAB lang`.

Two rounds find every n-gram with at least `least` occurrences. The first counts words and pairs of neighbours; each shard is told which
of its pairs are frequent. The second counts longer n-grams of which all neighbours are frequent pairs, for no other can reach
`least`. Shards hold tokens as numbers and are written once.

A candidate's parts are looked up by composition: the candidates of a range are walked, from each cut on, through the automaton of the counts
of all parts that the range asks for. All arithmetic is in whole numbers of any size.

Null texts are empty, a null lang is `und`; repeated rows count each time, and columns other than text and lang are not read. A document
longer than a shard is a shard of its own.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelspan.llm.common import finely_cut, written
from parcelspan.llm.katz import planes, unplanes

SHARD_TOKENS, SHARD_WORDS = 3_000_000, 600_000  # a shard ends when it reaches either
RANGE_TOKENS, SPLIT = 1_000_000, 8  # tokens of the corpus for each range, and the parts a first word's n-grams are dealt into
UNKNOWN = "und"
# Pieces end at these; inside the workers a full stop stands for all of them.
ENDS = bytes(b"."[0] if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
SHARD = "chunk bigint, words binary, tokens binary, langs array<string>, totals array<bigint>"
PART = "range int, chunk bigint, words binary, numbers binary, automaton binary"
FOUND = "kind string, range int, lang string, words array<string>, f bigint, chunk bigint, pairs binary"


class Automaton:
    """A weighted acyclic automaton over numbered labels, level by level.

    At each depth, `starts` says where the arcs of each state begin; an arc has a label, the weight of the path that ends with it (0:
    no n-gram ends there) and the state of the next depth it leads to. State 0 of every depth but the first has no arcs.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def build(cls, grams: np.ndarray, lengths: np.ndarray, weights: np.ndarray, least: int = 0) -> Automaton:
        """From n-grams (rows of labels, of which the first `lengths` count); weights of equal ones are added. Arcs that lead to no weight
        of `least` are left out before states are compared."""
        tries, states = [], np.zeros(len(grams), dtype=np.int64)
        rows = np.arange(len(grams))
        for depth in range(grams.shape[1]):
            rows = rows[lengths[rows] > depth]
            if not len(rows):
                break
            arcs, where = np.unique(states[rows] << 32 | grams[rows, depth], return_inverse=True)
            states[rows] = where
            ends = lengths[rows] == depth + 1
            weight = np.zeros(len(arcs), dtype=np.int64)
            np.add.at(weight, where[ends], weights[rows[ends]].astype(np.int64))
            tries.append((arcs >> 32, arcs & 0xFFFFFFFF, weight))
        levels, targets = [], None
        for depth in range(len(tries) - 1, -1, -1):
            parents, labels, weight = tries.pop()
            if least:
                often = weight >= least if targets is None else (weight >= least) | (targets > 0)
                parents, labels, weight, targets = parents[often], labels[often], weight[often], None if targets is None else targets[often]
            arcs = np.stack([labels, weight, np.zeros_like(labels) if targets is None else targets], axis=1)
            firsts = np.flatnonzero(np.diff(parents, prepend=-1))
            stops = np.append(firsts[1:], len(arcs))[: len(firsts)]
            if depth == 0:
                kept = [slice(0, len(arcs))]
            else:
                data, size, register, kept = arcs.tobytes(), 8 * arcs.shape[1], {}, []
                targets = np.zeros(len(tries[-1][0]), dtype=np.int64)
                for parent, first, stop in zip(parents[firsts].tolist(), firsts.tolist(), stops.tolist(), strict=True):
                    key = data[size * first : size * stop]
                    state = register.get(key)
                    if state is None:
                        kept.append(slice(first, stop))
                        state = register[key] = len(kept)
                    targets[parent] = state
            arcs_kept = np.concatenate([arcs[s] for s in kept]) if depth and kept else arcs
            sizes = [s.stop - s.start for s in kept]
            starts = np.cumsum([0, *([] if depth == 0 else [0]), *sizes])
            levels.append((starts, arcs_kept[:, 0], arcs_kept[:, 1], arcs_kept[:, 2]))
        return cls(levels[::-1])

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All n-grams with a weight: labels, lengths and weights."""
        depths = len(self.levels)
        found, ahead, states = [], np.zeros((1, 0), dtype=np.int64), np.zeros(1, dtype=np.int64)
        for depth, (starts, labels, weights, targets) in enumerate(self.levels):
            counts = starts[states + 1] - starts[states]
            places = np.arange(counts.sum()) + np.repeat(starts[states] - (np.cumsum(counts) - counts), counts)
            ahead = np.concatenate([np.repeat(ahead, counts, axis=0), labels[places, None]], axis=1)
            states, weight = targets[places], weights[places]
            ends = weight > 0
            grams = np.zeros((int(ends.sum()), depths), dtype=np.int64)
            grams[:, : depth + 1] = ahead[ends]
            found.append((grams, np.full(len(grams), depth + 1), weight[ends]))
        if not found:
            return np.zeros((0, 1), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate(part) for part in zip(*found, strict=True))

    def compose(self, grams: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The weight of each n-gram, 0 where there is no such path: all are walked together, a label at a time."""
        out, states = np.zeros(len(grams), dtype=np.int64), np.zeros(len(grams), dtype=np.int64)
        rows = np.arange(len(grams))
        for depth, (starts, labels, weights, targets) in enumerate(self.levels):
            rows = rows[lengths[rows] > depth]
            keys = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) << 32 | labels
            wanted = states[rows] << 32 | grams[rows, depth]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            met = keys[at] == wanted if len(keys) else np.zeros(len(rows), dtype=bool)
            rows, at = rows[met], at[met]
            states[rows] = targets[at]
            ends = lengths[rows] == depth + 1
            out[rows[ends]] = weights[at[ends]]
        return out

    def dump(self) -> bytes:
        """Depths, then for each the numbers of states and arcs and the four columns; starts and labels as differences."""
        head, body = [len(self.levels)], []
        for starts, labels, weights, targets in self.levels:
            head += [len(starts), len(labels)]
            body += [np.diff(starts, prepend=0), np.diff(labels, prepend=0), weights, targets]
        data = np.concatenate([np.array(head), *body]).astype("<i8")
        return np.array([data.nbytes], "<i8").tobytes() + pa.Codec("zstd").compress(data.view(np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True)

    @classmethod
    def load(cls, data: bytes) -> Automaton:
        size = int(np.frombuffer(data[:8], "<i8")[0])
        raw = np.frombuffer(pa.Codec("zstd").decompress(data[8:], size, asbytes=True), np.uint8)
        values = np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel()
        depths, at, levels = int(values[0]), 1 + 2 * int(values[0]), []
        for depth in range(depths):
            states, arcs = values[1 + 2 * depth : 3 + 2 * depth].tolist()
            columns = [values[at : at + states], *[values[at + states + k * arcs : at + states + (k + 1) * arcs] for k in range(3)]]
            levels.append((np.cumsum(columns[0]), np.cumsum(columns[1]), columns[2], columns[3]))
            at += states + 3 * arcs
        return cls(levels)


def folded(words: pa.Array) -> bytes:
    """Words as one compressed value; a list of them takes Spark many times the room. Back with `unfolded`."""
    stops = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
    data = words.buffers()[2]
    held = bytes(data[stops[0] : stops[-1]]) if data else b""
    raw = np.diff(stops).astype("<i4").tobytes() + held
    return np.array([len(words), len(raw)], "<i8").tobytes() + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unfolded(data: bytes) -> pa.Array:
    count, size = np.frombuffer(data, "<i8", 2).tolist()
    raw = pa.Codec("zstd").decompress(data[16:], size)
    stops = np.cumsum(np.frombuffer(raw, "<i4", count), dtype=np.int32)
    stops = np.concatenate([np.zeros(1, np.int32), stops])
    return pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(stops), raw.slice(4 * count)])


class Words(dict):
    """Numbers of a shard's words of one language; the separator is 0."""

    def __init__(self, lang: str, words: list[bytes]):
        super().__init__({b".": 0})
        self.tail, self.words = b"\t" + lang.encode(), words

    def __missing__(self, word: bytes) -> int:
        self.words.append(word + self.tail)
        self[word] = len(self.words)
        return len(self.words)


def shards(documents: DataFrame, most: int = SHARD_TOKENS) -> DataFrame:
    """The documents' words as numbers, a row for each shard, written: with its words, and the tokens of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        words, tokens, known, totals = [], array("I", [0]), {}, {}

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([number], pa.int64()), "words": pa.array([folded(pa.array(words, pa.binary()))], pa.binary()),
                "tokens": pa.array([planes(np.frombuffer(tokens, np.uint32))], pa.binary()), "langs": pa.array([list(totals)], pa.list_(pa.string())),
                "totals": pa.array([list(totals.values())], pa.list_(pa.int64())),
            })

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                text, lang = text.as_py(), lang.as_py()
                if not text:
                    continue
                lang = UNKNOWN if lang is None else lang
                found = text.encode().lower().translate(ENDS).replace(b".", b" . ").split()
                if lang not in known:
                    known[lang], totals[lang] = Words(lang, words), 0
                tokens.extend(map(known[lang].__getitem__, found))
                tokens.append(0)
                totals[lang] += len(found) - found.count(b".")
                if len(tokens) >= most or len(words) >= SHARD_WORDS:
                    yield row()
                    number, words, tokens, known, totals = number + 1, [], array("I", [0]), {}, {}
        if words:
            yield row()

    return written(documents.sparkSession, documents.select("text", F.col("lang").cast("string")).mapInArrow(run, SHARD), "shards")


class Dealt:
    """The ranges of n-grams: how many there are, and how they are split."""

    def __init__(self, tokens: int, each: int = RANGE_TOKENS):
        wanted = max(1, tokens // each)
        self.split = min(SPLIT, wanted)
        self.firsts = -(-wanted // self.split)

    def of(self, checks: np.ndarray, grams: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The range of each n-gram, from the checksums of the words by number."""
        rest = np.zeros(len(grams), dtype=np.int64)
        for place in range(1, grams.shape[1]):
            rest += np.where(lengths > place, (place + 1) * checks[grams[:, place]], 0)
        rest %= self.split
        first = checks[grams[:, 0]]
        first *= self.firsts
        first >>= 32
        return (first * self.split + rest).astype(np.int32)


def parts_of(
    dealt: Dealt, chunk: int, words: pa.Array, grams: np.ndarray, lengths: np.ndarray, weights: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """A shard's automata, one for each range it has n-grams in. `grams` holds the shard's numbers, which begin at 1."""
    checks = np.zeros(len(words) + 1, dtype=np.int64)
    for at in range(0, len(words), 1 << 16):  # words stay in Arrow: as Python's objects they are many times as large
        some = words.slice(at, 1 << 16)
        checks[at + 1 : at + 1 + len(some)] = [zlib.crc32(w) for w in some.to_pylist()]
    ranges = dealt.of(checks, grams, lengths)
    order = np.argsort(ranges, kind="stable")
    begins = np.flatnonzero(np.diff(ranges[order], prepend=-1))
    for begin, stop in zip(begins, [*begins[1:], len(order)], strict=True):
        rows = order[begin:stop]
        some, size = grams[rows].astype(np.int64), lengths[rows].astype(np.int64)
        inside = np.arange(grams.shape[1]) < size[:, None]
        numbers = np.unique(some[inside])
        numbers = numbers[np.lexsort((numbers, checks[numbers]))]  # the words' order: by checksum
        label = np.zeros(int(numbers.max()) + 1, dtype=np.int64)
        label[numbers] = np.arange(len(numbers))
        built = Automaton.build(np.where(inside, label[np.where(inside, some, numbers[0])], 0), size, weights[rows].astype(np.int64))
        told = [int(ranges[rows[0]])], [chunk], [folded(words.take(pa.array(numbers - 1)))], [numbers.astype("<u4").tobytes()], [built.dump()]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(told, PART_TYPE, strict=True)], schema=PART_TYPE)


PART_TYPE = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("numbers", pa.binary()), ("automaton", pa.binary())])
FOUND_TYPE = pa.schema([
    ("kind", pa.string()), ("range", pa.int32()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("f", pa.int64()),
    ("chunk", pa.int64()), ("pairs", pa.binary()),
])


def counted_pairs(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of neighbours with no separator between them, as numbers of 64 bits, and how often each occurs."""
    pairs = tokens[:-1].astype(np.int64)
    pairs <<= 32
    pairs |= tokens[1:]
    pairs = pairs[(tokens[:-1] > 0) & (tokens[1:] > 0)]
    pairs.sort()
    firsts = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[firsts], np.diff(firsts, append=len(pairs))


def short_grams(dealt: Dealt, table: DataFrame) -> DataFrame:
    """Automata of the shards' words and pairs of neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, data in zip(*batch.columns, strict=True):
                tokens = unplanes(data.as_py(), np.uint32)
                singles, n_single = np.unique(tokens[tokens > 0], return_counts=True)
                pairs, n_pair = counted_pairs(tokens)
                grams = np.zeros((len(singles) + len(pairs), 2), dtype=np.uint32)
                grams[: len(singles), 0] = singles
                grams[len(singles) :, 0], grams[len(singles) :, 1] = pairs >> 32, pairs & 0xFFFFFFFF
                lengths = np.repeat(np.array([1, 2], dtype=np.int8), [len(singles), len(pairs)])
                weights = np.concatenate([n_single, n_pair]).astype(np.uint32)
                del tokens, singles, n_single, pairs, n_pair
                yield from parts_of(dealt, chunk.as_py(), unfolded(words.as_py()), grams, lengths, weights)

    return table.select("chunk", "words", "tokens").mapInArrow(run, PART)


def long_grams(dealt: Dealt, table: DataFrame, kept: DataFrame, most: int) -> DataFrame:
    """Automata of the shards' n-grams of three words and more all of whose neighbours are frequent pairs."""

    def run(shard: pa.Table, told: pa.Table) -> pa.Table:
        parts: list[pa.RecordBatch] = []
        if shard.num_rows and told.num_rows:
            pairs = np.sort(np.concatenate([np.frombuffer(p, "<i8") for p in told.column("pairs").to_pylist()]))
            tokens = unplanes(shard.column("tokens")[0].as_py(), np.uint32)
            near, states = np.zeros(max(0, len(tokens) - 1), dtype=bool), []
            for at in range(0, len(near), 1 << 18):  # a stretch at a time
                both = tokens[:-1][at : at + (1 << 18)].astype(np.int64) << 32 | tokens[1:][at : at + (1 << 18)]
                met = pairs[np.minimum(np.searchsorted(pairs, both), len(pairs) - 1)] == both
                near[at : at + (1 << 18)] = met
                states.append(both[met])
            starts, states = np.flatnonzero(near), np.concatenate(states) if states else np.zeros(0, dtype=np.int64)
            grams, lengths, weights = [], [], []
            # States of the automaton along the text: a longer n-gram's is that of the n-gram before its last word, and that word.
            for size in range(3, most + 1):
                inside = starts + size - 2 < len(near)
                starts, states = starts[inside], states[inside]
                goes = near[starts + size - 2]
                starts, states = starts[goes], states[goes]
                if not len(starts):
                    break
                earlier = np.unique(states, return_inverse=True)[1]
                _, first, states, count = np.unique(
                    earlier << 32 | tokens[starts + size - 1], return_index=True, return_inverse=True, return_counts=True
                )
                rows = np.zeros((len(first), most), dtype=np.uint32)
                rows[:, :size] = tokens[starts[first][:, None] + np.arange(size)]
                grams.append(rows)
                lengths.append(np.full(len(first), size, dtype=np.int8))
                weights.append(count.astype(np.uint32))
            del near, starts, states
            if grams:
                words = unfolded(shard.column("words")[0].as_py())
                parts = list(parts_of(dealt, shard.column("chunk")[0].as_py(), words, *map(np.concatenate, (grams, lengths, weights))))
        return pa.Table.from_batches(parts, schema=PART_TYPE)

    of_shard = table.select("chunk", "words", "tokens").groupBy("chunk")
    return of_shard.cogroup(kept.select("chunk", "pairs").toDF("of", "pairs").groupBy("of")).applyInArrow(run, PART)


def united(parts: DataFrame, least: int, tell: bool) -> DataFrame:
    """The n-grams of each range with at least `least` occurrences in all shards; with `tell`, also which of its pairs each shard
    should keep."""

    def run(group: pa.Table) -> pa.Table:
        # Words stay in Arrow, and labels take 32 bits: a range is the largest thing a worker holds.
        words = [unfolded(w.as_py()) for w in group.column("words")]
        encoded = pa.concat_arrays(words).dictionary_encode()
        common, labels = encoded.dictionary, np.split(encoded.indices.to_numpy().astype(np.uint32), np.cumsum([len(w) for w in words])[:-1])
        pieces = []
        for label, data in zip(labels, group.column("automaton"), strict=True):
            grams, lengths, weights = Automaton.load(data.as_py()).paths()
            grams = np.where(np.arange(grams.shape[1]) < lengths[:, None], label[grams], np.uint32(0))
            pieces.append((grams, lengths.astype(np.int8), weights.astype(np.uint32)))
        stops = np.cumsum([len(n) for _, n, _ in pieces])
        every = np.zeros((stops[-1], max(g.shape[1] for g, _, _ in pieces)), dtype=np.uint32)
        for stop, (grams, _, _) in zip(stops, pieces, strict=True):
            every[stop - len(grams) : stop, : grams.shape[1]] = grams
        lengths, weights = (np.concatenate([p[i] for p in pieces]) for i in (1, 2))
        del words, pieces, encoded, grams
        owns = list(zip(np.split(every, stops[:-1]), np.split(lengths, stops[:-1]), strict=True))
        grams, lengths, weights = Automaton.build(every, lengths, weights, least).paths()
        often = weights >= least
        grams, lengths, weights = grams[often], lengths[often], weights[often]
        names = {w: common[w].as_py().split(b"\t", 1) for w in np.unique(grams).tolist()}
        at = group.column("range")[0].as_py()
        rows = [
            {"kind": "gram", "range": at, "lang": names[g[0]][1].decode(), "words": [names[w][0].decode() for w in g[:n]], "f": f}
            for g, n, f in zip(grams.tolist(), lengths.tolist(), weights.tolist(), strict=True)
        ]
        pairs = np.sort(grams[lengths == 2][:, 0] << 32 | grams[lengths == 2][:, 1]) if tell and grams.shape[1] > 1 else []
        if len(pairs):
            for chunk, numbers, label, (own, sizes) in zip(group.column("chunk"), group.column("numbers"), labels, owns, strict=True):
                own = own[sizes == 2].astype(np.int64)
                keys = own[:, 0] << 32 | own[:, 1]
                keys = keys[pairs[np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)] == keys]
                if len(keys):
                    order = np.argsort(label)
                    label, number = label[order].astype(np.int64), np.frombuffer(numbers.as_buffer(), "<u4")[order].astype(np.int64)
                    kept = number[np.searchsorted(label, keys >> 32)] << 32 | number[np.searchsorted(label, keys & 0xFFFFFFFF)]
                    rows.append({"kind": "pairs", "chunk": chunk.as_py(), "pairs": kept.astype("<i8").tobytes()})
        return pa.Table.from_pylist(rows, schema=FOUND_TYPE)

    return parts.groupBy("range").applyInArrow(run, FOUND)


def frequent(
    documents: DataFrame, least: int, most: int, shard_tokens: int = SHARD_TOKENS, range_tokens: int = RANGE_TOKENS
) -> tuple[DataFrame, DataFrame, Dealt]:
    """Every n-gram of up to `most` words with at least `least` occurrences (range, lang, words, f), the words of each language
    (lang, n), and how n-grams are dealt out."""
    spark, table = documents.sparkSession, shards(documents, shard_tokens)
    each = table.select(F.explode(F.arrays_zip("langs", "totals")).alias("t"))
    totals = each.groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.totals").alias("n"))
    dealt = Dealt(totals.agg(F.sum("n")).first()[0] or 0, range_tokens)
    with finely_cut(spark):
        short = written(spark, united(short_grams(dealt, table), least, True), "short-grams", "kind")
        longer = long_grams(dealt, table, short.where("kind = 'pairs'"), most)
        longer = written(spark, united(longer, least, False), "long-grams", "kind")
    columns = ["range", "lang", "words", "f"]
    return short.where("kind = 'gram'").select(columns).unionByName(longer.where("kind = 'gram'").select(columns)), totals, dealt


def maximal(grams: DataFrame, share: int) -> DataFrame:
    """Candidates without those that lie inside a longer one with at least `share` hundredths of their occurrences. No longer n-gram
    occurs more often than one a word longer, so those are enough."""
    size = F.size("words")
    inner = F.explode(F.array(F.slice("words", 1, size - 1), F.slice("words", 2, size - 1)))
    around = grams.where(size > 2).select("lang", inner.alias("words"), "f").groupBy("lang", "words").agg(F.max("f").alias("_longer"))
    candidates = grams.where(size > 1).join(around, ["lang", "words"], "left")
    return candidates.where(F.col("_longer").isNull() | (100 * F.col("_longer") < share * F.col("f"))).drop("_longer")


SCORED = "range int, lang string, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"


def scored(candidates: DataFrame, grams: DataFrame, totals: DataFrame) -> DataFrame:
    """Every candidate at its lowest-scoring cut: the parts a range asks for are brought to it once, made one automaton, and composed with
    the candidates' parts."""
    parts = F.flatten(F.transform(
        F.sequence(F.lit(1), F.size("words") - 1),
        lambda k: F.array(F.slice("words", F.lit(1), k), F.slice("words", k + 1, F.size("words") - k)),
    ))
    asked = candidates.select("range", "lang", F.explode(parts).alias("words")).distinct()
    told = asked.join(grams.select("lang", "words", "f"), ["lang", "words"]).select("range", "lang", "words", "f").toDF("at", "lang", "words", "f")

    def run(wanted: pa.Table, told: pa.Table) -> pa.Table:
        label: dict[tuple[str, str], int] = {}

        def numbered(langs: list, lists: list, width: int) -> tuple[np.ndarray, np.ndarray]:
            rows = np.zeros((len(lists), width), dtype=np.int64)
            for at, (lang, words) in enumerate(zip(langs, lists, strict=True)):
                rows[at, : len(words)] = [label.setdefault((lang, w), len(label)) for w in words]
            return rows, np.array([len(w) for w in lists], dtype=np.int64)

        lists, langs = wanted.column("words").to_pylist(), wanted.column("lang").to_pylist()
        width = max(map(len, lists), default=1)
        rows, lengths = numbered(langs, lists, width)
        counts = Automaton.build(*numbered(told.column("lang").to_pylist(), told.column("words").to_pylist(), width), told.column("f").to_numpy())
        best: list = [None] * len(lists)
        a, n = wanted.column("f").to_pylist(), wanted.column("n").to_pylist()
        for cut in range(1, width):
            at = np.flatnonzero(lengths > cut)
            tails = np.concatenate([rows[at, cut:], np.zeros((len(at), cut), dtype=np.int64)], axis=1)
            left, right = counts.compose(rows[at], np.full(len(at), cut)), counts.compose(tails, lengths[at] - cut)
            for k, l, r in zip(at.tolist(), left.tolist(), right.tolist(), strict=True):
                score = 1000 * a[k] * n[k] // (l * r)
                if best[k] is None or score < best[k][0]:
                    best[k] = (score, l, r)
        return pa.table({
            "range": wanted.column("range"), "lang": wanted.column("lang"), "phrase": pa.array([" ".join(w) for w in lists], pa.string()),
            "a": wanted.column("f"), "l": pa.array([b[1] for b in best], pa.int64()), "r": pa.array([b[2] for b in best], pa.int64()),
            "n": wanted.column("n"), "score": pa.array([b[0] for b in best], pa.int64()),
        })

    given = candidates.join(totals, "lang").select("range", "lang", "words", "f", "n")
    return given.groupBy("range").cogroup(told.groupBy("at")).applyInArrow(run, SCORED)


def phrases(
    documents: DataFrame, least: int = 100, most: int = 5, share: int = 100, top: int = 2000,
    shard_tokens: int = SHARD_TOKENS, range_tokens: int = RANGE_TOKENS,
) -> DataFrame:
    """The first `top` phrases of each language by score, occurrences and phrase: lang, rank, phrase, a, l, r, n, score."""
    grams, totals, dealt = frequent(documents, least, most, shard_tokens, range_tokens)
    found = scored(maximal(grams, share), grams, totals)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language is ranked in parts first: as many as make parts and what they leave about equal.
    part = F.pmod("range", F.lit(max(1, int((dealt.firsts * dealt.split) ** 0.5))))
    first = found.withColumn("_part", part).withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
    last = first.where(F.col("_at") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return last.where(F.col("rank") <= top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


# The same for `least` 100, five words, `share` 100 and 2,000 phrases.
SQL = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY 1),
e AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM e JOIN (SELECT unnest(range(1, 6)) AS k) ks ON i + k - 1 <= len(ws) GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s FROM g WHERE k > 1),
inner_ AS (SELECT lang, unnest([array_to_string(s[1:k - 1], ' '), array_to_string(s[2:k], ' ')]) AS phrase, a FROM c WHERE k > 2),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN longer o ON c.lang = o.lang AND c.phrase = o.phrase WHERE o.most IS NULL OR o.most < c.a),
cuts AS (SELECT lang, phrase, a, j, array_to_string(s[1:j], ' ') AS lp, array_to_string(s[j + 1:k], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM kept) x),
scored AS (SELECT u.lang, u.phrase, u.a, u.j, l.f AS l, r.f AS r, n.n, CAST((1000::HUGEINT * u.a * n.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
 FROM cuts u JOIN g l ON u.lang = l.lang AND u.lp = l.phrase JOIN g r ON u.lang = r.lang AND u.rp = r.phrase JOIN n ON u.lang = n.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best QUALIFY rank <= 2000"""
