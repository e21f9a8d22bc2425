"""Token ids as length-delimited binary records, with an offset index beside each file.

A record is its payload's length (8 bytes), a masked checksum of those, the payload, and a masked checksum of
the payload; all numbers are little-endian. The checksum is CRC-32, rotated by 15 bits with a constant added, so
that a checksum of data that holds checksums stays sound. A payload is the document's id (8 bytes, preceded by
one byte that is 0 for a null id), the bytes per id (1) and the ids. The index has 16 bytes a record: its offset in
the file, and the number of ids in the records before it in the file. So any record can be read alone, in any
order, and its place among all ids is known.

Documents are dealt out by ranges of doc_id (ties by text, nulls first) and each task writes a file of its own
in the shared folder. Its name is in the rows the task returns: a task run again writes another file and the
rows of the one that counts name that. One row per file is gathered to find where each file starts.

Null texts count as empty: such a document is the end id alone. A repeated document is a record each time.
Columns other than doc_id and text are not stored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelspan.llm.common import written
from parcelspan.llm.tokens import Encoder
from parcelspan.session import run_folder

BLOCK = 1024  # records that a reading task takes at once
MASK = 0xA282EAD8
BUFFER = 1 << 22
INDEX = np.dtype([("at", "<u8"), ("ids", "<u8")])
FILE = "part int, file string, index string, records bigint, ids bigint"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the record at a place and the place of the next; a wrong checksum is an error."""
    (length,), (check,) = struct.unpack_from("<Q", data, at), struct.unpack_from("<I", data, at + 8)
    if masked(bytes(data[at : at + 8])) != check:
        raise ValueError(f"length checksum differs at {at}")
    payload = data[at + 12 : at + 12 + length]
    if len(payload) != length or masked(payload) != struct.unpack_from("<I", data, at + 12 + length)[0]:
        raise ValueError(f"checksum differs at {at}")
    return payload, at + 16 + length


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    return struct.pack("<?qB", doc_id is not None, doc_id or 0, ids.dtype.itemsize) + ids.tobytes()


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    known, doc_id, width = struct.unpack_from("<?qB", payload, 0)
    return (doc_id if known else None), np.frombuffer(payload[10:], dtype=f"<u{width}")


def write(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents in ascending doc_id order; a row per file, with the ids before it in `start`."""
    spark = documents.sparkSession
    folder = run_folder(spark, "records")
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # By range of the id and of a hash of the text: rows that repeat one id are dealt out too.
    dealt = source.withColumn("_tie", F.xxhash64("text"))
    dealt = dealt.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, root = FileSystem.from_uri(folder)
        encoder, name = Encoder.of(tokenizer), f"{part:06d}-{uuid.uuid4().hex}"
        places, total, at, out = [], 0, 0, None
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for k, ids in enumerate(encoder.documents(t.as_py() for t in texts)):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}.rec", buffer_size=BUFFER)
                record = frame(pack(doc_ids[k].as_py(), ids))
                out.write(record)
                places.append((at, total))
                at, total = at + len(record), total + len(ids)
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.idx") as index:
                index.write(np.array(places, dtype=INDEX).tobytes())
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "file": [f"{name}.rec"], "index": [f"{name}.idx"],
                 "records": pa.array([len(places)], pa.int64()), "ids": pa.array([total], pa.int64())}
            )

    files = written(spark, dealt.select("doc_id", "text").mapInArrow(run, FILE), "record-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.select(
        F.lit(folder).alias("folder"), "*", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start")
    )


def read(files: DataFrame, seed: int | None = None) -> DataFrame:
    """All records of the files: doc_id, start (ids of all records before it in doc_id order) and ids.

    With a seed, blocks of records come in an order that depends on the seed, and so do the records of a block.
    """
    spark: SparkSession = files.sparkSession
    steps = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("records") - 1, F.lit(BLOCK).cast("bigint")))
    blocks = files.where("records > 0").select("folder", "file", "index", "start", "records", steps.alias("first"))
    if seed is None:
        blocks = blocks.repartition(spark.sparkContext.defaultParallelism * 2, "file", "first")
    else:
        blocks = blocks.withColumn("_order", F.xxhash64(F.lit(seed), "file", "first"))
        blocks = blocks.repartitionByRange("_order").sortWithinPartitions("_order").drop("_order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, root = FileSystem.from_uri(row["folder"])
                last = min(row["first"] + BLOCK, row["records"])
                with fs.open_input_file(f"{root}/{row['index']}") as file:
                    more = min(last + 1, row["records"]) - row["first"]
                    index = np.frombuffer(file.read_at(more * INDEX.itemsize, row["first"] * INDEX.itemsize), dtype=INDEX)
                with fs.open_input_file(f"{root}/{row['file']}") as file:
                    low = int(index["at"][0])
                    high = int(index["at"][last - row["first"]]) if last < row["records"] else file.size()
                    data = memoryview(file.read_at(high - low, low))
                at, found = 0, []
                for place in range(last - row["first"]):
                    payload, at = unframe(data, at)
                    doc_id, ids = unpack(payload)
                    found.append((doc_id, row["start"] + int(index["ids"][place]), ids))
                if seed is not None:
                    np.random.default_rng([seed, row["start"] + row["first"]]).shuffle(found)
                sizes = np.cumsum([0, *(len(f[2]) for f in found)])
                lists = pa.ListArray.from_arrays(
                    pa.array(sizes, pa.int32()), pa.array(np.concatenate([f[2] for f in found]).astype(np.int64))
                )
                numbers = [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*numbers, lists], ["doc_id", "start", "ids"])

    return blocks.mapInArrow(run, "doc_id bigint, start bigint, ids array<bigint>")


def checksums(records: DataFrame) -> DataFrame:
    """Number of ids and CRC-32 of the ids as unsigned 32-bit numbers, instead of the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            flat, offsets = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            data = flat.tobytes()
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            rest = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "ids"]
            names = [f.name for f in batch.schema if f.name != "ids"]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], [*names, "n_tokens", "ids_crc32"]
            )

    rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema if f.name != "ids")
    return records.mapInArrow(run, f"{rest}, n_tokens bigint, ids_crc32 bigint")


def round_trip(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Write the records, read them back and sum them up."""
    return checksums(read(write(documents, tokenizer)))
