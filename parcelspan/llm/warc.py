"""Web archives: one gzip member per record on the way out, a splittable reader on the way in.

Writing. A page is a `response` record with its HTTP message, or a `revisit` that names the record with the same
payload. Which of equal payloads is kept is settled by one aggregation on the digest (combined before the shuffle)
and an equi-join that Spark may split where one payload is very common. Each task writes files of its own in the
shared folder; the rows it returns name them, so a task that runs again leaves a file nobody reads.

Reading. Files are cut into byte ranges and each range is a row of its own. A task looks in its range for the gzip
magic, tries each candidate by decoding its beginning and takes it for a record only if a WARC header comes out that
names the same archive (`WARC-Warcinfo-ID`) as the start of the file: so a compressed archive inside a page is not
mistaken for records. From there it follows member after member and owns those that start inside its range, however far
they reach. Lengths and digests are compared on the way.

Null html counts as empty. A page row that is repeated is a record each time; all rows that have the largest page_id
of a payload are responses. Rows with a null page_id are written too, and revisit if another row has an id. A null url has no
target field. Other columns are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspan.llm.common import written
from parcelspan.session import run_folder

MAGIC = b"\x1f\x8b\x08"
SPLIT, CHUNK, HEAD = 32 << 20, 1 << 16, 1 << 14  # bytes of a range, of a step of decoding, and of a header's first look
FILE_BYTES = 512 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def member(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as a gzip member of its own; fields without a value are left out."""
    head = [f"WARC/1.1\r\nWARC-Type: {kind}"]
    head += [f"{k}: {re.sub('[\r\n]', lambda m: f'%{ord(m[0]):02X}', str(v))}" for k, v in fields if v is not None]
    text = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text + block + b"\r\n\r\n") + packer.flush()


def page_record(info: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = refers_to is not None
    fields = [
        ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Warcinfo-ID", info), ("WARC-Date", DATE), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-ID", page_id),
        ("WARC-Profile", PROFILE if again else None), ("WARC-Refers-To", record_id(refers_to, digest) if again else None),
        ("X-Refers-To-Page-ID", refers_to),
    ]
    return member("revisit" if again else "response", fields, http if again else http + payload)


def targets(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, and the page each row revisits (null for a response)."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("_sha", F.sha1("payload"))
    long_ = F.octet_length("payload") >= min_bytes
    groups = rows.where(long_).groupBy("_sha").agg(F.max("page_id").alias("_kept"), F.count("*").alias("_rows"))
    groups = groups.where("_rows > 1 AND _kept IS NOT NULL").drop("_rows")
    other = ~F.col("page_id").eqNullSafe(F.col("_kept")) & long_
    return rows.join(groups, "_sha", "left").select(
        "page_id", "url", "payload", F.when(other, F.col("_kept")).alias("refers_to")
    )


def write(pages: DataFrame, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives; a row per file: its path, its length and the records of pages in it."""
    spark = pages.sparkSession
    folder = run_folder(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        out, name, size, pages_in, done = None, "", 0, 0, []

        def close() -> None:
            out.close()
            done.append((f"{folder}/{name}", size, pages_in))

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name, info, size = f"{uuid.uuid4().hex}.warc.gz", f"<urn:uuid:{uuid.uuid4()}>", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None, buffer_size=CHUNK)
                    about = [("WARC-Record-ID", info), ("WARC-Warcinfo-ID", info), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")]
                    first = member("warcinfo", about, b"format: WARC File Format 1.1\r\n")
                    out.write(first)
                    size, pages_in = len(first), 0
                data = page_record(info, page_id, url, payload, refers_to)
                out.write(data)
                size, pages_in = size + len(data), pages_in + 1
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict(
            {
                "path": pa.array([d[0] for d in done], pa.string()), "length": pa.array([d[1] for d in done], pa.int64()),
                "records": pa.array([d[2] for d in done], pa.int64()),
            }
        )

    return written(spark, targets(pages, min_bytes).mapInArrow(run, "path string, length bigint, records bigint"), "warc-files")


class Range:
    """The bytes of a file from a place on; more are read as they are needed."""

    def __init__(self, file, start: int, end: int):
        self.file, self.start, self.size = file, start, file.size()
        self.data = bytearray(file.read_at(min(end, self.size) - start, start))

    def upto(self, at: int) -> bool:
        """Have the byte at this place (from the range's start), if the file has it."""
        while at >= len(self.data) and self.start + len(self.data) < self.size:
            self.data += self.file.read_at(min(16 * CHUNK, self.size - self.start - len(self.data)), self.start + len(self.data))
        return at < len(self.data)

    def decode(self, at: int, most: int | None = None) -> tuple[bytes, int]:
        """The content of the member at this place (the beginning only, if `most` is given) and where it ends."""
        reader, parts, got = zlib.decompressobj(31), [], 0
        while not reader.eof and self.upto(at):
            step = bytes(self.data[at : at + CHUNK])
            part = reader.decompress(step, most - got) if most else reader.decompress(step)
            parts.append(part)
            got += len(part)
            at += len(step) - len(reader.unused_data)
            if most and got >= most:
                break
        if not most and not reader.eof:
            raise ValueError("a member has no end")
        return b"".join(parts), at


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:] if ": " in line)


def is_record(data: Range, at: int, info: str | None) -> bool:
    """Whether a record of this archive starts here. Headers have no greatest length: what begins as one is decoded on until it ends."""
    most = HEAD
    while True:
        try:
            begun = data.decode(at, most)[0]
        except zlib.error:
            return False
        head, end, _ = begun.partition(b"\r\n\r\n")
        if end or not begun.startswith(b"WARC/1.") or len(begun) < most:
            return bool(end) and head.startswith(b"WARC/1.") and info in (None, fields_of(head).get("WARC-Warcinfo-ID"))
        most *= 4


def members(file, start: int, end: int, info: str | None) -> Iterator[bytes]:
    """The records that start in [start, end)."""
    data = Range(file, start, end)
    at = -1
    while (at := data.data.find(MAGIC, at + 1) if data.upto(at + 3) else -1) >= 0 and start + at < end:
        if is_record(data, at, info):
            break
    else:
        # A magic that reaches over the end starts inside too.
        tail = end - start - 2
        at = -1
        for place in (tail, tail + 1):
            if place >= 0 and data.upto(place + 2) and data.data[place : place + 3] == MAGIC and is_record(data, place, info):
                at = place
                break
        if at < 0:
            return
    while start + at < end and data.upto(at):
        content, at = data.decode(at)
        yield content


def parsed(content: bytes, with_payload: bool) -> tuple | None:
    """The columns of a page's record; None for records of other kinds."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = fields_of(head)
    kind = fields.get("WARC-Type")
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(fields_of(http)["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its length or digest")
    page, target = (fields.get(k) for k in ("X-Page-ID", "X-Refers-To-Page-ID"))
    row = (page and int(page), fields.get("WARC-Target-URI"), size, digest, kind, target and int(target))
    return (*row, payload if kind == "response" else None) if with_payload else row


def read(files: DataFrame, split: int = SPLIT, with_payload: bool = True) -> DataFrame:
    """Records of all files (path, length), each found by the task whose range it starts in."""
    spark = files.sparkSession
    steps = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split).cast("bigint")))
    ranges = files.where("length > 0").select("path", steps.alias("start"), "length")
    ranges = ranges.repartition(spark.sparkContext.defaultParallelism * 2, "path", "start")
    schema = RECORD + ", payload binary" * with_payload
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=False)], names)

        for batch in batches:
            for row in batch.to_pylist():
                fs, path = FileSystem.from_uri(row["path"])
                rows, held = [], 0
                with fs.open_input_file(path) as file:
                    top = Range(file, 0, min(HEAD, row["length"]))
                    first = fields_of(top.decode(0, HEAD)[0].partition(b"\r\n\r\n")[0])
                    info = first.get("WARC-Warcinfo-ID") or (first.get("WARC-Record-ID") if first.get("WARC-Type") == "warcinfo" else None)
                    for content in members(file, row["start"], min(row["start"] + split, row["length"]), info):
                        if (found := parsed(content, with_payload)) is not None:
                            rows.append(found)
                            held += len(content)
                        if held > 1 << 24 or len(rows) >= 5_000:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    return ranges.mapInArrow(run, schema)


def complete(files: DataFrame, records: DataFrame) -> DataFrame:
    """The records, after their number has been compared with what the writer counted; a difference is an error."""
    kept = written(records.sparkSession, records, "warc-records")
    wrote, found = files.agg(F.sum("records")).first()[0] or 0, kept.count()
    if wrote != found:
        raise ValueError(f"{wrote} records were written and {found} read")
    return kept


def round_trip(pages: DataFrame, file_bytes: int = FILE_BYTES, split: int = SPLIT) -> DataFrame:
    """Write the pages, read the archives back."""
    files = write(pages, file_bytes=file_bytes)
    return complete(files, read(files, split, with_payload=False).drop("url"))
