"""Alignment of two tokenizers over the same bytes, and how often their ids meet.

A text is encoded by both, with a space in front of it. The intervals between byte offsets at which tokens of both end are the
groups. They are found by division: of an interval, a common end near its middle is located by bisecting, and both
halves are divided on; an interval without one is a group. Two token occurrences of one group are linked; an id pair's count is the
number of documents that hold it linked.

Both tokenizers used here end a token before every space, tab and line break that follows something else, and before a full stop or comma
after a letter or digit, which is looked up in their vocabularies first. A text falls into parts there, which is the division's upper
half; a worker encodes and divides each distinct part once for each chunk of documents. Texts of other tokenizers are one part.

The documents of a task are cut into chunks of bounded size. A chunk's distinct pairs, each numbered and with its documents, are exchanged
once; each document keeps the numbers of its own and how many links each has. The counts come back to the chunk they were asked by.

A null or empty text, and one whose tokens don't give its bytes back under both tokenizers, has no tokens: zeros and an empty digest. Special
strings in texts are plain text. A repeated row is a document each time; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspan.llm.common import written
from parcelspan.llm.tokens import Encoder, byte_letters, with_space

CHUNK_BYTES, CHUNK_PARTS = 64 << 20, 500_000  # a chunk ends when its texts or its distinct parts reach these
PIECE_SPACE = "▁"
# White space besides space, tab, line feed and carriage return: where a run of it begins or ends depends on the tokenizer.
OTHER_SPACE = re.compile(r"[^\S \n\t\r]")
COARSE = r"[ \n\t]*[^ \n\t]+|[ \n\t]+"
LETTER, STOPS = "A-Za-zÀ-ÖØ-öø-ÿ0-9", ".,;:!?)"
AFTER_TEXT = re.compile(r"(?<=\S)(?=[ \n\t])")
SIMPLE = re.compile(r" ?[^\s\x1c-\x1f]+")
Group = tuple[int, int, int, int]
# Ids by both of one or more parts, where this part's begin and end in each, and its groups.
Aligned = tuple[list[int], list[int], int, int, int, int, list[Group]]


def divide(ends_a: list[int], ends_b: list[int], whole: Group | None = None) -> list[Group]:
    """Groups of two token sequences over the same bytes, from the ends of their tokens: (first, after last) of each side, in order.
    `whole` is the interval to divide; it begins and ends at a common end."""
    groups, open_ = [], [whole or (0, len(ends_a), 0, len(ends_b))]
    while open_:
        interval = low, high, low_b, high_b = open_.pop()
        if high - low <= 1 or high_b - low_b <= 1:
            if high > low and high_b > low_b:
                groups.append(interval)
            continue
        middle, last = (low + high - 1) // 2, high - 1
        for step in range(2 * (high - low)):
            # Outwards from the middle: itself, one below, one above, ...
            at = middle - (step + 1) // 2 if step % 2 else middle + step // 2
            if low <= at < last:
                there = bisect_left(ends_b, ends_a[at], low_b, high_b)
                if ends_b[there] == ends_a[at]:
                    open_.append((at + 1, high, there + 1, high_b))
                    open_.append((low, at + 1, low_b, there + 1))
                    break
        else:
            groups.append(interval)
    return groups


class Pair:
    """Both tokenizers: parts of texts, ids of parts and the bytes of ids. One per worker process."""

    made: dict[tuple[str, str], Pair] = {}

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, self.b = Encoder(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.tokenizer.encode_special_tokens = True
        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        size = self.a.tokenizer.get_vocab_size(True)
        entries = [self.a.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(byte_of[c] for c in e) if all(c in byte_of for c in e) else e.encode() for e in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(PIECE_SPACE, " ").encode() for i, p in enumerate(pieces)
        ]
        # No piece may run over a cut, nor may the line break join anything: it stands in front of parts, see `ids_b`.
        joined = any(re.search(rf"[^{PIECE_SPACE}][{PIECE_SPACE}\t]|\n", p) for p in pieces)
        stops = "".join(s for s in STOPS if not any(re.search(f"[{LETTER}]{re.escape(s)}", p) for p in pieces))
        fine = rf"[ \n\t]*[^ \n\t{stops}]*[{LETTER}](?=[{stops}])|" if stops else ""
        splits = self.a.cut is not None and self.a.cut[0] is with_space
        self.pattern = re.compile(fine + COARSE) if splits and not joined else None
        line_a, line_b = self.a.tokenizer.encode("\n", add_special_tokens=False).ids, self.b.encode("\n")[1:]
        self.line_a, self.line_b = (line_a[0], line_b[0]) if self.pattern and len(line_a) == len(line_b) == 1 else (None, None)

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Pair:
        if (path_a, path_b) not in cls.made:
            cls.made[path_a, path_b] = cls(path_a, path_b)
        return cls.made[path_a, path_b]

    def parts(self, text: str) -> list[str]:
        """A text with its space in front, cut where tokens of both end for certain."""
        if self.pattern is None:
            return [text]
        if OTHER_SPACE.search(text):
            return AFTER_TEXT.split(text)
        return self.pattern.findall(text)

    def ids_b(self, part: str) -> list[int]:
        if self.pattern is None:
            return self.b.encode(part[1:])  # adds the space itself
        return self.b.encode("\n" + part)[2:]  # its own space and the line break stand before the part

    def one(self, part: str) -> Aligned | None:
        """Ids of a part by both and its groups; None if the bytes aren't the part's."""
        a, b, data = list(array(self.a.code, self.a.part(part))), self.ids_b(part), part.encode()
        data_a, data_b = list(map(self.bytes_a.__getitem__, a)), list(map(self.bytes_b.__getitem__, b))
        if b"".join(data_a) != data or b"".join(data_b) != data:
            return None
        return a, b, 0, len(a), 0, len(b), divide(list(accumulate(map(len, data_a))), list(accumulate(map(len, data_b))))

    def many(self, parts: list[str]) -> Iterator[Aligned | None]:
        """The same for parts of at most one space in front and no other white space, in one call of each tokenizer:
        they are set in lines, and no token of either joins a line break to what stands beside it there."""
        text = "\n".join(parts) + "\n"
        data = text.encode()
        a, b = self.a.tokenizer.encode(text, add_special_tokens=False).ids, self.b.encode("\n" + text)[2:]
        data_a, data_b = list(map(self.bytes_a.__getitem__, a)), list(map(self.bytes_b.__getitem__, b))
        if b"".join(data_a) != data or b"".join(data_b) != data or a.count(self.line_a) != len(parts) or b.count(self.line_b) != len(parts):
            yield from map(self.one, parts)
            return
        ends_a, ends_b = list(accumulate(map(len, data_a))), list(accumulate(map(len, data_b)))
        low = low_b = 0
        for _ in parts:
            high, high_b = a.index(self.line_a, low), b.index(self.line_b, low_b)
            yield a, b, low, high, low_b, high_b, divide(ends_a, ends_b, (low, high, low_b, high_b))
            low, low_b = high + 1, high_b + 1

    def aligned(self, parts: list[str]) -> Iterator[tuple[str, Aligned | None]]:
        lines = [p for p in parts if self.line_a is not None and SIMPLE.fullmatch(p)]
        if lines:
            yield from zip(lines, self.many(lines), strict=True)
        simple = set(lines)
        for part in parts:
            if part not in simple:
                yield part, self.one(part)


class Chunk:
    """What the documents of a chunk share: parts by number, their groups as text, and the pairs of each part."""

    def __init__(self, pair: Pair):
        self.pair, self.numbers, self.texts = pair, {}, []
        self.figures = array("q")  # four numbers a part: n_a, n_b, groups, links; -1 where the bytes differ
        self.begins, self.pairs, self.times = array("q", [0]), array("I"), array("q")
        self.pair_numbers: dict[int, int] = {}
        self.documents = np.zeros(1024, dtype=np.int64)
        self.size = 0

    def full(self, most: int) -> bool:
        return self.size >= most or len(self.texts) >= CHUNK_PARTS

    def learn(self, parts: list[str]) -> None:
        """Number parts that are new, with their figures and pairs."""
        pair_numbers, pairs, times = self.pair_numbers, self.pairs, self.times
        for part, found in self.pair.aligned(parts):
            links: dict[int, int] = {}
            if found is None:
                self.texts.append("")
                self.figures.extend((-1, -1, -1, -1))
            else:
                a, b, low, high, low_b, high_b, groups = found
                texts, total = [], 0
                for a0, a1, b0, b1 in groups:
                    if a1 - a0 == 1 and b1 - b0 == 1:
                        left, right = a[a0], b[b0]
                        texts.append(f"{left}|{right}")
                        link = left << 32 | right
                        links[link] = links.get(link, 0) + 1
                        total += 1
                        continue
                    some_a, some_b, n = a[a0:a1], b[b0:b1], (a1 - a0) * (b1 - b0)
                    texts.append(",".join(map(str, some_a)) + "|" + ",".join(map(str, some_b)))
                    total += n
                    if n > 64:  # long groups repeat few ids: each pair of ids once, with its links
                        some_a, some_b = Counter(some_a), Counter(some_b)
                        for left, k in some_a.items():
                            for right, m in some_b.items():
                                links[left << 32 | right] = links.get(left << 32 | right, 0) + k * m
                    else:
                        for left in some_a:
                            for right in some_b:
                                links[left << 32 | right] = links.get(left << 32 | right, 0) + 1
                self.texts.append(";".join(texts))
                self.figures.extend((high - low, high_b - low_b, len(groups), total))
            for link, n in links.items():
                at = pair_numbers.get(link)
                if at is None:
                    at = pair_numbers[link] = len(pair_numbers)
                pairs.append(at)
                times.append(n)
            self.begins.append(len(pairs))
            self.numbers[part] = len(self.texts) - 1

    def add(self, text: str | None) -> tuple[int, int, int, int, str, bytes]:
        """Four counts of a document, the digest of its groups, and its pairs' numbers with their links."""
        nothing = (0, 0, 0, 0, "", b"")
        if not text:
            return nothing
        self.size += len(text)
        cut = self.pair.parts(" " + text)
        new = [p for p in dict.fromkeys(cut) if p not in self.numbers]
        if new:
            self.learn(new)
        numbers = list(map(self.numbers.__getitem__, cut))
        parts, times = np.unique(np.array(numbers, dtype=np.int64), return_counts=True)
        figures = np.frombuffer(self.figures, dtype=np.int64).reshape(-1, 4)[parts]
        if (figures < 0).any():
            return nothing
        begins = np.frombuffer(self.begins, dtype=np.int64)
        lengths = begins[parts + 1] - begins[parts]
        ahead = np.cumsum(lengths) - lengths
        places = np.arange(lengths.sum()) + np.repeat(begins[parts] - ahead, lengths)
        links = np.frombuffer(self.times, dtype=np.int64)[places] * np.repeat(times, lengths)
        numbered = np.frombuffer(self.pairs, dtype=np.uint32)[places]
        order = np.argsort(numbered, kind="stable")
        pairs, first = np.unique(numbered[order], return_index=True)
        links = np.add.reduceat(links[order], first)
        while len(self.documents) < len(self.pair_numbers):
            self.documents = np.concatenate([self.documents, np.zeros_like(self.documents)])
        self.documents[pairs] += 1
        digest = hashlib.sha256(";".join(map(self.texts.__getitem__, numbers)).encode()).hexdigest()
        figures = (figures * times[:, None]).sum(axis=0).tolist()
        return (*figures, digest, np.stack([np.diff(pairs.astype(np.int64), prepend=0), links]).astype("<i8").tobytes())

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """The chunk's pairs by number, and the documents that hold each."""
        return np.fromiter(self.pair_numbers, np.int64, len(self.pair_numbers)), self.documents[: len(self.pair_numbers)]


DOCUMENT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary"
ROWS = f"kind string, chunk bigint, {DOCUMENT}, a int, b int, at int, docs bigint"
SHOWN = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def chunked(documents: DataFrame, path_a: str, path_b: str, most: int) -> DataFrame:
    """A row for each document and for each distinct pair of a chunk, written."""
    schema = pa.schema(
        [("kind", pa.string()), ("chunk", pa.int64()), ("doc_id", pa.int64()), *[(n, pa.int64()) for n in SHOWN[1:5]],
         ("groups_sha256", pa.string()), ("links", pa.binary()), ("a", pa.int32()), ("b", pa.int32()), ("at", pa.int32()), ("docs", pa.int64())]
    )

    def filled(kind: str, chunk: int, n: int, columns: dict) -> pa.RecordBatch:
        columns = {"kind": pa.array([kind] * n), "chunk": pa.array([chunk] * n, pa.int64()), **columns}
        arrays = [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def pairs_of(chunk: Chunk, number: int) -> Iterator[pa.RecordBatch]:
        asked, docs = chunk.asked()
        for at in range(0, len(asked), 50_000):
            some = asked[at : at + 50_000]
            yield filled("pair", number, len(some), {
                "a": pa.array((some >> 32).astype(np.int32)), "b": pa.array((some & 0xFFFFFFFF).astype(np.int32)),
                "at": pa.array(np.arange(at, at + len(some), dtype=np.int32)), "docs": pa.array(docs[at : at + 50_000]),
            })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair = Pair.of(path_a, path_b)
        chunk, number = Chunk(pair), TaskContext.get().partitionId() << 32
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                rows, stop = [], start
                while stop < batch.num_rows and not chunk.full(most):
                    rows.append(chunk.add(batch.column(1)[stop].as_py()))
                    stop += 1
                if rows:
                    columns = {n: pa.array(c, schema.field(n).type) for n, c in zip(schema.names[3:9], zip(*rows, strict=True), strict=True)}
                    yield filled("doc", number, len(rows), {"doc_id": batch.column(0).slice(start, len(rows)), **columns})
                if chunk.full(most):
                    yield from pairs_of(chunk, number)
                    chunk, number = Chunk(pair), number + 1
                start = stop
        yield from pairs_of(chunk, number)

    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return written(documents.sparkSession, source.mapInArrow(run, ROWS), "aligned", "kind")


def pair_counts(rows: DataFrame) -> DataFrame:
    """Of every linked id pair the number of documents that hold it, and whether it is the highest of its A id: a, b, n_docs, best."""
    counts = rows.where("kind = 'pair'").groupBy("a", "b").agg(F.sum("docs").alias("n_docs"))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("_most"))
    return counts.join(most, "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("_most")).alias("best"))


def align(documents: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Counts of tokens, groups and links of each document, its links to the ids that meet most often, the sum of its links' counts, and
    the digest of its groups. `path_a` is a file of the tokenizers library, `path_b` one of sentencepiece."""
    rows = chunked(documents, path_a, path_b, chunk_bytes)
    pairs = rows.where("kind = 'pair'").select("chunk", "at", "a", "b")
    answers = pairs.join(pair_counts(rows), ["a", "b"]).select("chunk", "at", "n_docs", "best").toDF("of", "at", "n_docs", "best")

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        size = told.num_rows
        count, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        at = told.column("at").to_numpy()
        count[at], best[at] = told.column("n_docs").to_numpy(), told.column("best").to_numpy()
        n_best, total = [], []
        for links in docs.column("links").to_pylist():
            steps, n = np.frombuffer(links, dtype="<i8").reshape(2, -1)
            numbers = np.cumsum(steps)
            n_best.append(int((best[numbers] * n).sum()))
            total.append(int((count[numbers] * n).sum()))
        out = {n: docs.column(n) for n in SHOWN if n not in ("n_best", "count_sum")}
        out |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        return pa.table({n: out[n] for n in SHOWN})

    of_docs = rows.where("kind = 'doc'").drop("kind", "a", "b", "at", "docs")
    schema = ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'bigint'}" for n in SHOWN)
    return of_docs.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(run, schema)
