"""Packing documents into sequences of a fixed number of tokens: best fit, then swaps between underfull bins.

A document's ids (with an end id) are cut only when there are more than fit into one sequence: into full pieces, the
first taking what is left over. Full pieces are sequences of their own and are never shuffled. The others, at most one
a document, are dealt out evenly to shards of about `SHARD` pieces; each shard is packed alone by best fit
decreasing and then improved by local search:

    while a bin is not full, look for an exchange with an emptier bin that fills it further: a piece moved over, one
    for one, two for one or one for two. Every exchange raises the sum of squared fills, so the search ends; bins that
    become empty are dropped.

All lengths of the bin meet all lengths on offer, and the exchange that fills it most is taken; the search ends only where
no such exchange is left, or when the shard has no more bins than its tokens need. So what is lost to dealing out shards is
less than a bin a shard, and beyond that what this local search can't find.

Null texts count as empty and are packed as their end id alone. Repeated documents are packed each time. No text is
dropped, cut short or reordered inside. Columns other than doc_id and text are not carried.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspan.llm.common import written
from parcelspan.llm.tokens import Encoder

CAPACITY = 1024
SHARD = 20_000
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document: all full but perhaps the first."""
    first = (total - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, total, capacity))]


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document, with a checksum of their ids and, if asked for, the ids."""
    schema = PIECE + ", ids array<bigint>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            rows: list[list] = [[] for _ in range(5 + with_ids)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.documents(t.as_py() for t in batch.column(1)), strict=True):
                wide = ids.astype("<u4")
                for number, (start, length) in enumerate(cut(len(wide), capacity)):
                    some = wide[start : start + length]
                    values = (doc_id, number, start, length, zlib.crc32(some.tobytes()), some.tolist())
                    for column, value in zip(rows, values, strict=False):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=False)], names[: len(rows)])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


class Bins:
    """Bins of one shard: their pieces by number, and how empty a bin with a piece, or two pieces, of each length can be."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.fill: list[int] = []
        self.held: list[list[int]] = []
        self.version: list[int] = []  # counts the changes of a bin, so that old entries of `offers` are known
        # For each length of one piece, and then of two pieces of one bin: (fill, bin, its version, the pieces), emptiest first.
        self.offers: list[list[list[tuple]]] = [[[] for _ in range(capacity + 1)] for _ in range(2)]
        self.least = np.full((2, capacity + 1), capacity + 1)  # the fill of the first of them
        self.seen: dict[tuple[int, ...], int] = {}  # contents that found no exchange, and the number of exchanges then
        self.changes = 0

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin with room for it."""
        spare: list[list[int]] = [[] for _ in range(self.capacity + 1)]  # bins by the room they have
        rooms = 0  # bit r is set if a bin has room r
        for number in sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i], i)):
            size = self.sizes[number]
            fits = rooms >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                at = spare[room].pop()
                if not spare[room]:
                    rooms ^= 1 << room
            else:
                room, at = self.capacity, len(self.fill)
                self.fill.append(0)
                self.held.append([])
                self.version.append(0)
            self.fill[at] += size
            self.held[at].append(number)
            if not spare[room - size]:
                rooms |= 1 << (room - size)
            spare[room - size].append(at)

    def distinct(self, bin_: int) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
        """One piece of each length in a bin, and two pieces of each sum of lengths."""
        ones: dict[int, int] = {}
        twos: dict[int, tuple[int, int]] = {}
        more: list[int] = []
        for number in self.held[bin_]:
            size = self.sizes[number]
            if size not in ones:
                ones[size] = number
                more.append(number)
            elif 2 * size not in twos:
                twos[2 * size] = ones[size], number
        for i, a in enumerate(more):
            for b in more[i + 1 :]:
                twos.setdefault(self.sizes[a] + self.sizes[b], (a, b))
        return ones, twos

    def refresh(self, kind: int, size: int) -> None:
        offers = self.offers[kind][size]
        while offers and offers[0][2] != self.version[offers[0][1]]:
            heapq.heappop(offers)
        self.least[kind, size] = offers[0][0] if offers else self.capacity + 1

    def withdraw(self, bin_: int) -> None:
        self.version[bin_] += 1
        for kind, sums in enumerate(self.distinct(bin_)):
            for size in sums:
                if self.least[kind, size] == self.fill[bin_]:
                    self.refresh(kind, size)

    def offer(self, bin_: int) -> None:
        fill = self.fill[bin_]
        if 0 < fill < self.capacity:
            ones, twos = self.distinct(bin_)
            for kind, sums in enumerate(({s: (n,) for s, n in ones.items()}, twos)):
                for size, numbers in sums.items():
                    heapq.heappush(self.offers[kind][size], (fill, bin_, self.version[bin_], numbers))
                    if fill < self.least[kind, size]:
                        self.least[kind, size] = fill

    def improve(self, into: int) -> bool:
        """The exchange with a bin no fuller that fills this one most: a piece moved over, one for one, two for one or one for two."""
        key = tuple(sorted(self.sizes[n] for n in self.held[into]))
        if self.seen.get(key) == self.changes:  # a bin of the same lengths has just found none
            return False
        fill, room = self.fill[into], self.capacity - self.fill[into]
        self.withdraw(into)
        ones, twos = self.distinct(into)
        sums = np.arange(self.capacity + 1)
        longest = np.maximum.accumulate(np.where(self.least <= fill, sums, -1), axis=1)  # the longest on offer up to each length
        leaving: list[tuple[int, ...]] = [(), *((n,) for n in ones.values()), *twos.values()]
        gone = np.array([0, *ones, *twos])
        come = longest[:, np.minimum(gone + room, self.capacity)]
        come[1, 1 + len(ones) :] = -1  # two for two is no exchange of this search
        gain = come - gone
        kind, at = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[kind, at] <= 0:
            self.seen[key] = self.changes
            self.offer(into)
            return False
        _, giver, _, given = self.offers[kind][come[kind, at]][0]
        self.withdraw(giver)
        for bin_, out, in_ in ((into, leaving[at], given), (giver, given, leaving[at])):
            self.held[bin_] = [n for n in self.held[bin_] if n not in out] + list(in_)
            self.fill[bin_] = sum(self.sizes[n] for n in self.held[bin_])
            self.offer(bin_)
        self.changes += 1
        return True

    def search(self) -> None:
        """Exchanges until there are none, or no more bins than the tokens need."""
        need = -(-sum(self.sizes) // self.capacity)
        used = len(self.fill)
        open_ = [b for b in range(used) if self.fill[b] < self.capacity]
        for b in open_:
            self.offer(b)
        changed = True
        while changed and used > need:
            changed = False
            # The fullest first: what they take comes from the emptiest in the end.
            for b in sorted(open_, key=lambda b: (-self.fill[b], b)):
                while 0 < self.fill[b] < self.capacity and self.improve(b):
                    changed = True
            open_ = [b for b in open_ if 0 < self.fill[b] < self.capacity]
            used = sum(f > 0 for f in self.fill)


def pack_sizes(sizes: list[int], capacity: int = CAPACITY, swaps: bool = True) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece; bins are numbered without gaps."""
    bins = Bins(sizes, capacity)
    bins.best_fit()
    if swaps:
        bins.search()
    place, offset = [0] * len(sizes), [0] * len(sizes)
    for number, held in enumerate(h for h in bins.held if h):
        at = 0
        for piece in held:
            place[piece], offset[piece] = number, at
            at += sizes[piece]
    return place, offset


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """All pieces with `sequence_id` and `offset`: their place in the sequences."""
    spark = documents.sparkSession
    made = written(spark, pieces(documents, tokenizer, capacity, with_ids), "pieces")
    full = made.where(F.col("length") == capacity)
    rest = made.where(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // SHARD))
    # Dealt out by row number, not by content: copies of one document go to all shards.
    dealt = rest.withColumn("shard", (F.monotonically_increasing_id() % shards).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        place, offset = pack_sizes(table["length"].to_pylist(), capacity)
        shard = table["shard"][0].as_py()
        ids = np.array(place, dtype=np.int64) + (shard << 32)
        table = table.drop_columns(["shard"])
        return table.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset, pa.int64()))

    out = PIECE + ", ids array<bigint>" * with_ids + ", sequence_id bigint, offset bigint"
    packed = dealt.groupBy("shard").applyInArrow(run, out)
    alone = full.withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")}
    )
    return alone.unionByName(packed)


def sequences(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves: sequence_id, the documents in it in order, and their ids in a row."""
    placed = pack(documents, tokenizer, capacity, with_ids=True)
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(rows.alias("rows")).select(
        "sequence_id", F.col("rows.doc_id").alias("doc_ids"), F.flatten("rows.ids").alias("ids")
    )
