"""Archives: round trips at several split sizes, an archive inside a page, and the contract by brute force."""

import base64
import hashlib
import os

import pytest
from pyarrow.fs import LocalFileSystem

from parcelspan.llm import warc


def expected(rows, least=0):
    best: dict = {}
    for page, html in rows:
        data = (html or "").encode()
        if len(data) >= least and page is not None:
            best[data] = max(best.get(data, page), page)
    count: dict = {}
    for _, html in rows:
        count[(html or "").encode()] = count.get((html or "").encode(), 0) + 1
    out = []
    for page, html in rows:
        data = (html or "").encode()
        kept = best.get(data) if count[data] > 1 and len(data) >= least else None
        again = kept is not None and kept != page
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if again else "response", kept if again else None))
    return sorted(out, key=repr)


def odd_pages(spark):
    noise = base64.b85encode(os.urandom(200_000)).decode()
    inner = warc.member("warcinfo", [("WARC-Warcinfo-ID", "<x>")], b"y") * 3
    rows = [(1, "u1", "same"), (2, "u2\r\nX: y", "same"), (3, None, None), (4, "é", ""), (5, "u", noise), (6, "u", "same"), (6, "u", "same"),
            (None, "n", "same"), (None, "n", "only"), (7, "u", "WARC/1.1\r\n\r\n"), (8, "u", inner.decode("latin-1"))]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, payload string")


def test_round_trip(spark, folder):
    for pages in (odd_pages(spark), spark.read.parquet(f"{folder}/pages.parquet").repartition(3)):
        rows = [(r.page_id, r.html) for r in pages.collect()]
        for least, split in ((0, 1 << 25), (5, 1000), (0, 37)):
            files = warc.write(pages, least, file_bytes=150_000)
            got = warc.read(files, split).collect() if split > 100 else warc.read(files.orderBy("length").limit(1), split).collect()
            if split > 100:
                mine = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
                assert sorted(mine, key=repr) == expected(rows, least)
                texts = {(p, (h or "").encode()) for p, h in rows}
                assert all((r.page_id, bytes(r.payload)) in texts for r in got if r.record_type == "response")
    assert warc.round_trip(pages).columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_every_split_owns_each_record_once(tmp_path):
    info = "<urn:uuid:a>"
    inner = warc.member("response", [("WARC-Warcinfo-ID", "<other>")], b"inner")
    import zlib

    def stored(data: bytes) -> bytes:
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        return packer.compress(data) + packer.flush()

    records = [warc.member("warcinfo", [("WARC-Warcinfo-ID", info)], b"")]
    records += [warc.page_record(info, i, "u", b"p" * i, None) for i in range(6)]
    # An archive stored as it is inside a record: candidates in the middle of a member.
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Warcinfo-ID: {info}\r\nContent-Length: {len(inner) * 4}\r\n\r\n".encode()
    records += [stored(head + inner * 4 + b"\r\n\r\n"), warc.page_record(info, 9, "u", b"last", 3)]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(records))
    with LocalFileSystem().open_input_file(str(path)) as file:
        size = file.size()
        for split in (1, 2, 3, 7, 50, 113, 400, size):
            found = [c for s in range(0, size, split) for c in warc.members(file, s, min(s + split, size), info)]
            assert len(found) == len(records), split
    assert [warc.parsed(c, True) for c in found][-1][:1] == (9,)
    broken = found[3].replace(b"pp", b"pq")
    with pytest.raises(ValueError, match="differs"):
        warc.parsed(broken, True)


def test_headers_longer_than_any_step_are_records_of_any_range(spark):
    import random

    draw = random.Random(4)
    long_ = lambda: "data:" + "".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(90_000))
    rows = [(i, long_() if i % 3 == 0 else f"u{i}", f"page {i % 20}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    want = expected([(r[0], r[2]) for r in rows])
    for split in (1 << 25, 20_000, 5_000):
        got = warc.round_trip(pages, split=split).collect()
        assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == want
    files = warc.write(pages)
    with pytest.raises(ValueError, match="60 records were written and 59 read"):
        warc.complete(files, warc.read(files, with_payload=False).where("page_id <> 7"))
