"""Scoring texts with a Katz backoff model: Good-Turing discounts, backoff weights that normalise exactly.

    P(w | h) = d(c) c / (C + RESERVE)        if h w was counted c times, C being the times of h
             = alpha(h) P(w | h')            if only h was counted; h' is h without its first word
             = P(w | h')                     if h was never counted

d(c) is the Good-Turing discount of the order for c <= `GREATEST` and 1 above; where counts of counts don't allow it, a smaller
bound is taken. RESERVE keeps a little for unseen words in contexts without a small count. alpha(h) is what the first
line leaves of 1, over what P(. | h') leaves of the words not seen after h, so every context sums to 1. Unknown words are
one class of their own, with what the words leave.

How it is computed. Documents are cut into chunks that fit into a task and written once, as numbers of a chunk's own
vocabulary. In a round for every order each chunk sends its distinct n-grams (64-bit hashes) with their counts to buckets of the hash
range; a bucket adds up and answers each chunk. So counts move once per chunk and n-gram, however often it occurs: frequent words
weigh nothing, and the work of a bucket depends on the number of buckets, which follows the corpus. An n-gram that no other chunk has
is answered so, and then no other chunk has the longer ones that begin or end with it: the chunk counts these itself and sends
nothing. The answers are tables partitioned by group of chunks and chunk, and a round's exchanges are dropped when they are
written. Each chunk's task reads its own and evaluates its tokens from the lowest order up. What
is still open then are backoff weights: sums over the distinct n-grams of a context, each counted by the one chunk that its
bucket named, and met by the documents in an equi-join on the context. Chunks and answers are deleted before that.

A chunk is one row of megabytes, so files hold few of them, and what is evaluated leaves as plain rows in small batches: Spark holds
hundreds of rows of a file at once, and memory must not follow the number of chunks that a task happens to get.

All documents are counted whole (those of the training part) and scored whole. Null texts are empty: one end token. Null
ids count as training documents. Repeated documents are counted and scored each time. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspan.llm.common import dropped, exchanges_dropped, lower_ascii, words, written
from parcelspan.session import run_folder

ORDER, GREATEST, RESERVE = 3, 5, 0.1
CHUNK = 1_000_000  # tokens; a document is never cut
BUCKET = 1_000_000  # tokens a bucket, on average
FILE_CHUNKS, BATCH = 8, 20_000  # chunks a file, rows a batch of what is evaluated
END, BOS = 0x5EED0E4D, 0x5EED0B05
GROUP_BITS, PLACE_BITS = 20, 21
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

CHUNKS = "chunk bigint, doc_ids array<bigint>, held array<boolean>, lengths array<int>, tokens binary, vocabulary binary"
REQUEST = "bucket int, chunk bigint, keys binary, counts binary, stats array<bigint>"
REPLY = "bucket int, chunk bigint, totals binary, stats array<bigint>"
# Rows of documents have the first columns, those of contexts `key`, `given` and `lower`, those of misses `row`, `key` and `times`.
SCORED = (
    "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, part double, "
    "key bigint, given double, lower double, times int"
)
_KINDS = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes before all second ones, each compressed by itself: high bytes are mostly zeros, which take
    no room, and low bytes of hashes stay as they are."""
    codec, lengths, parts = pa.Codec("zstd", compression_level=1), [], []
    for plane in np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T:
        part = plane.tobytes() if plane.any() else b""
        small = codec.compress(part, asbytes=True) if part else part
        parts.append(small if len(small) < len(part) else part)
        lengths.append(len(parts[-1]))
    return np.array([len(values), *lengths], np.int32).tobytes() + b"".join(parts)


def unplanes(data: bytes, dtype: type) -> np.ndarray:
    codec, size = pa.Codec("zstd"), np.dtype(dtype).itemsize
    count, *lengths = np.frombuffer(data, np.int32, size + 1).tolist()
    out, at = np.zeros((size, count), np.uint8), 4 * (size + 1)
    for plane, length in zip(out, lengths, strict=True):
        if length:
            part = data[at : at + length]
            plane[:] = np.frombuffer(part if length == count else codec.decompress(part, count, asbytes=True), np.uint8)
            at += length
    return out.T.copy().view(dtype).reshape(-1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, held_rows = TaskContext.get().partitionId() << GROUP_BITS, []

    def flush() -> pa.RecordBatch:
        nonlocal number, held_rows
        lengths = np.array([len(h) + 1 for _, _, h in held_rows], dtype=np.int32)
        flat = np.concatenate([part for _, _, h in held_rows for part in (h, [END])]).astype(np.int64)
        vocabulary, inverse = np.unique(flat.view(np.uint64), return_inverse=True)
        steps, tokens = planes(np.diff(vocabulary, prepend=np.uint64(0))), planes(inverse.astype(np.int32))
        row = [number], [[d for d, _, _ in held_rows]], [[t for _, t, _ in held_rows]], [lengths], [tokens], [steps]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        number, held_rows = number + 1, []
        names = ["chunk", "doc_ids", "held", "lengths", "tokens", "vocabulary"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

    size = 0
    for batch in batches:
        flat, offsets = batch.column(2).values.to_numpy(), batch.column(2).offsets.to_numpy()
        ids, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for k in range(batch.num_rows):
            hashes = flat[offsets[k] : offsets[k + 1]]
            if held_rows and (size + len(hashes) >= CHUNK or len(held_rows) == (1 << PLACE_BITS) - 1):
                yield flush()
                size = 0
            held_rows.append((ids[k], held[k], hashes.copy()))
            size += len(hashes) + 1
    if held_rows:
        yield flush()


class Chunk:
    """A chunk's tokens, and its distinct n-grams of each order in the order of their keys."""

    def __init__(self, row: dict):
        self.chunk, self.doc_ids, self.held = row["chunk"], row["doc_ids"], np.array(row["held"])
        self.lengths = np.array(row["lengths"], dtype=np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.held_at = self.held[self.doc]
        self.vocabulary, self.tokens = np.cumsum(unplanes(row["vocabulary"], np.uint64), dtype=np.uint64), unplanes(row["tokens"], np.int32)
        self.ends = self.vocabulary[self.tokens]
        self.keys = self.ends
        self.alone = np.zeros(len(self.ends), dtype=bool)

    def before(self, values: np.ndarray, at_start) -> np.ndarray:
        """The value of the token before each, another at the start of documents."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = at_start
        return out

    def longer(self) -> np.ndarray:
        """From keys of n-grams to keys of n-grams one word longer; returns the keys of their contexts."""
        contexts = self.before(self.keys, np.uint64(BOS))
        mixed = ((contexts ^ (contexts >> np.uint64(31))) * _K1 + self.ends) * _K2
        self.keys = mixed ^ (mixed >> np.uint64(29))
        return contexts

    def number(self, n: int) -> None:
        """Number the distinct n-grams in the order of their keys, spread so that they fill their range evenly, as buckets need them; `first`
        is one place of each. Words are numbered already, so of them only the vocabulary is sorted."""
        spread = (self.vocabulary if n == 1 else self.keys) * _K1
        order = np.argsort(spread)
        sorted_ = spread[order]
        begins = np.ones(len(sorted_), dtype=bool)
        begins[1:] = sorted_[1:] != sorted_[:-1]
        numbers = np.empty(len(sorted_), dtype=np.int64)
        numbers[order] = np.cumsum(begins) - 1
        self.distinct, self.inverse = sorted_[begins], numbers[self.tokens] if n == 1 else numbers
        self.first = np.empty(len(self.distinct), dtype=np.int64)
        self.first[self.inverse] = np.arange(len(self.inverse))

    def grams(self, n: int) -> np.ndarray | None:
        """Go on to the next order: its distinct n-grams, what this chunk counts of them, and which no other chunk can have, because
        none has the one they begin or the one they end with. Returns the keys of their contexts."""
        contexts = self.longer() if n > 1 else None
        self.number(n)
        self.train = np.bincount(self.inverse[~self.held_at], minlength=len(self.distinct))
        self.own_held = np.bincount(self.inverse[self.held_at], minlength=len(self.distinct)) > 0
        self.local = (self.alone | self.before(self.alone, False))[self.first]
        return contexts

    def answer(self, replies: np.ndarray) -> np.ndarray:
        """Of each distinct n-gram: 4 times the total, plus 2 if this chunk is to speak for it, plus 1 if documents that are held out have it."""
        answer = np.zeros(len(self.distinct), dtype=np.int64)
        answer[~self.local] = replies
        alone = answer == 0
        self.alone = alone[self.inverse]
        return np.where(alone, self.train * 4 + 2 + self.own_held, answer)


def chunks_of(batch: pa.RecordBatch) -> Iterator[Chunk]:
    for k in range(batch.num_rows):
        row = {}
        for i, field in enumerate(batch.schema):
            value = batch.column(i)[k]
            row[field.name] = value.values.to_numpy(zero_copy_only=False) if field.name == "lengths" else value.as_py()
        yield Chunk(row)


def tally(total: np.ndarray) -> list[int]:
    """Of n-grams with these totals: how many were counted, their occurrences, and how many were counted 1 to `GREATEST` + 1 times."""
    kinds = np.bincount(np.minimum(total, GREATEST + 2), minlength=GREATEST + 3)
    return [int((total > 0).sum()), int(total.sum()), *kinds[1 : GREATEST + 2].tolist()]


def replies_to(chunk: int, folder: str) -> np.ndarray:
    """What the buckets of an order answered to a chunk, in the order of the keys it sent."""
    fs, root = FileSystem.from_uri(folder)
    path = f"{root}/group={chunk >> GROUP_BITS}/chunk={chunk}"
    if fs.get_file_info(path).type == FileType.NotFound:  # the chunk sent none
        return np.array([], dtype=np.int64)
    mine = ds.dataset(path, filesystem=fs, format="parquet").to_table(columns=["bucket", "totals"])
    return np.concatenate([np.array([], dtype=np.int64), *(unplanes(b.as_py(), np.int64) for b in mine.sort_by("bucket")["totals"])])


def requests(n: int, bits: int, folders: list[str]):
    """folders: the answers of the orders below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks_of(batch):
                for k, folder in enumerate(folders, 1):
                    c.grams(k)
                    c.answer(replies_to(c.chunk, folder))
                c.grams(n)
                sent = ~c.local
                keys, counts = c.distinct[sent], (c.train * 2 + c.own_held)[sent].astype(np.uint32)
                cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
                # What is not sent counts too; any bucket may add that up.
                rows: list[tuple] = [(((c.chunk >> GROUP_BITS) + c.chunk) % (1 << bits), c.chunk, None, None, tally(c.train[c.local]))]
                for b in np.flatnonzero(np.diff(cuts)):
                    some = keys[cuts[b] : cuts[b + 1]]
                    steps = np.diff(some, prepend=np.uint64(int(b) << (64 - bits)))
                    rows.append((int(b), c.chunk, planes(steps), planes(counts[cuts[b] : cuts[b + 1]]), None))
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                columns = [pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "keys", "counts", "stats"])

    return run


def totals(bits: int):
    def run(table: pa.Table) -> pa.Table:
        """The counts of all chunks for the n-grams of a bucket: for each chunk 4 times the total, plus 2 if the chunk is to
        speak for the n-gram, plus 1 if documents that are held out have it; 0 if no other chunk has it."""
        bucket = table["bucket"][0].as_py()
        stats = np.array([tally(np.array([], dtype=np.int64)), *(s for s in table["stats"].to_pylist() if s)]).sum(axis=0)
        rows: list[tuple] = []
        table = table.filter(pc.is_valid(table["keys"])).sort_by("chunk")
        if table.num_rows:
            top = np.uint64(bucket << (64 - bits))
            keys = [np.cumsum(unplanes(k.as_py(), np.uint64), dtype=np.uint64) + top for k in table["keys"]]
            counts = np.concatenate([unplanes(k.as_py(), np.uint32) for k in table["counts"]])
            sizes = np.cumsum([len(k) for k in keys])[:-1]
            _, first, inverse, chunks = np.unique(np.concatenate(keys), return_index=True, return_inverse=True, return_counts=True)
            total = np.bincount(inverse, counts >> 1).astype(np.int64)
            held = np.bincount(inverse, counts & 1) > 0
            reply = total[inverse] * 4 + held[inverse]
            reply[first] += 2
            reply[first[chunks == 1]] = 0
            stats = stats + tally(total)
            rows = [(bucket, c.as_py(), planes(r), None) for c, r in zip(table["chunk"], np.split(reply, sizes), strict=True)]
        rows.append((bucket, -1, None, stats.tolist()))
        types = (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        arrays = [pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.Table.from_arrays(arrays, ["bucket", "chunk", "totals", "stats"])

    return run


def discounts(seen: list[int]) -> np.ndarray:
    """d(0) to d(GREATEST + 1), the last standing for all larger counts; seen[r - 1] n-grams were counted r times."""
    out = np.ones(GREATEST + 2)
    for k in range(GREATEST, 0, -1):
        if all(seen[: k + 1]):
            part = (k + 1) * seen[k] / seen[0]
            d = [((r + 1) * seen[r] / (r * seen[r - 1]) - part) / (1 - part) if part < 1 else 0.0 for r in range(1, k + 1)]
            if all(0 < x <= 1 for x in d):
                out[1 : k + 1] = d
                break
    return out


def scored(folders: list[str], model: dict[int, tuple]):
    """model: for each order (distinct n-grams, their occurrences, discounts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks_of(batch):
                yield from evaluate(c, folders, model)

    return run


def rows_of(**columns: Sequence | np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of `SCORED`, a batch at a time; columns that are not given are null."""
    names, kinds = zip(*((n, _KINDS[kind]) for n, kind in (column.split() for column in SCORED.split(", "))), strict=True)
    size = len(next(iter(columns.values())))
    for at in range(0, size, BATCH):
        some = min(BATCH, size - at)
        arrays = [pa.array(columns[n][at : at + some], k) if n in columns else pa.nulls(some, k) for n, k in zip(names, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names)


def evaluate(c: Chunk, folders: list[str], model: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    distinct, occurrences, d, left = model[1]
    c.grams(1)
    reply = c.answer(replies_to(c.chunk, folders[0]))[c.inverse]
    count, held = reply >> 2, (reply & 1) > 0
    known = count > 0
    docs = len(c.lengths)
    rows = (c.chunk << PLACE_BITS) + np.arange(docs)
    base = np.bincount(c.doc, np.log10((count + 1) / (occurrences + distinct + 1)), minlength=docs)
    n_known = np.bincount(c.doc, known, minlength=docs).astype(np.int64)

    small = np.minimum(count, GREATEST + 1)
    with np.errstate(divide="ignore"):
        probability = np.where(known, d[small] * count / (occurrences + RESERVE), left / (occurrences + RESERVE))
        log = np.log10(probability)
    trained = int(model[0][1])  # documents, which is how often texts begin
    for n in range(2, len(folders) + 1):
        context_count, context_held = c.before(count, trained), c.before(held, True)
        lower = probability
        # Contexts go by their numbers in the order below, one more for texts that begin.
        place, places = c.before(c.inverse, len(c.distinct)), len(c.distinct) + 1
        contexts = c.grams(n)
        answer = c.answer(replies_to(c.chunk, folders[n - 1]))
        reply = answer[c.inverse]
        count, held = reply >> 2, (reply & 1) > 0
        d = model[n][2]
        seen, small = count > 0, np.minimum(count, GREATEST + 1)
        probability = np.where(seen, d[small] * count / (context_count + RESERVE), 0.0)
        with np.errstate(divide="ignore"):
            log = np.where(seen, np.log10(probability), log)
        missed = ~seen & (context_count > 0)
        log[missed] -= np.log10(context_count[missed] + RESERVE)
        # One row for each document and context; the order is part of the context's key.
        tag = np.zeros(places, dtype=np.int64)
        tag[place] = (contexts ^ (np.uint64(n) * _K2)).view(np.int64)
        if missed.any():
            pair, times = np.unique(c.doc[missed] << 32 | place[missed], return_counts=True)
            yield from rows_of(row=rows[pair >> 32], key=tag[pair & 0xFFFFFFFF], times=times)
        # The n-grams this chunk speaks for, of contexts that documents which are held out have.
        own = c.first[(answer & 2) > 0]
        own = own[seen[own] & context_held[own]]
        if len(own):
            at = place[own]
            there = np.flatnonzero(np.bincount(at, minlength=places))
            given = np.bincount(at, count[own] * (1 - d[small[own]]), minlength=places)
            yield from rows_of(key=tag[there], given=given[there], lower=np.bincount(at, lower[own], minlength=places)[there])
    part = np.bincount(c.doc, log, minlength=docs)
    yield from rows_of(row=rows, doc_id=c.doc_ids, held_out=c.held, n_tokens=c.lengths, n_known=n_known, base_score=base, part=part)


def scores(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = documents.sparkSession
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    hashes = F.transform(words(lower_ascii(F.col("text"))), lambda w: F.xxhash64(w)).alias("hashes")
    cut = source.select("doc_id", held_out(F.col("doc_id")).alias("held"), hashes)
    cuts = run_folder(spark, "chunks")
    chunks = written(spark, cut.mapInArrow(chunked, CHUNKS), "chunks", folder=cuts, file_rows=FILE_CHUNKS)
    size = chunks.select(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    bits = max(6, int(np.ceil(np.log2(max(1, size) / BUCKET))))

    model: dict[int, tuple] = {}
    folders: list[str] = []
    sums = [F.sum(F.col("stats")[i]) for i in range(GREATEST + 3)]
    for n in range(1, order + 1):
        counted = chunks.mapInArrow(requests(n, bits, list(folders)), REQUEST).groupBy("bucket").applyInArrow(totals(bits), REPLY)
        folders.append(run_folder(spark, f"ngrams{n}"))
        grouped = counted.withColumn("group", F.shiftright("chunk", GROUP_BITS)).repartition("group")
        with exchanges_dropped(spark):
            grouped.write.option("compression", "zstd").partitionBy("group", "chunk").parquet(folders[-1])
        replies = spark.read.schema(f"{REPLY}, group bigint").parquet(folders[-1])
        distinct, occurrences, *seen = [x or 0 for x in replies.where("group = -1").agg(*sums).first()]
        d = discounts(seen)
        model[n] = (distinct, occurrences, d, RESERVE + sum(r * (1 - d[r]) * seen[r - 1] for r in range(1, GREATEST + 1)))
    trained = chunks.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    model[0] = (0, trained)

    made = written(spark, chunks.mapInArrow(scored(folders, model), SCORED), "scored")
    dropped(spark, cuts, *folders)
    docs = made.where("n_tokens IS NOT NULL").select("row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "part")
    sums_of = made.where("given IS NOT NULL").groupBy("key").agg(F.sum("given").alias("given"), F.sum("lower").alias("lower"))
    weight = F.log10((F.col("given") + RESERVE) / (1 - F.col("lower")))
    open_ = made.where("times IS NOT NULL").select("row", "key", "times").join(sums_of.select("key", weight.alias("weight")), "key")
    later = open_.groupBy("row").agg(F.sum(F.col("times") * F.col("weight")).alias("later"))
    return docs.join(later, "row", "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model[1][1])).cast("bigint").alias("train_tokens"),
        "base_score", (F.col("part") + F.coalesce("later", F.lit(0.0))).alias("score"),
    )
