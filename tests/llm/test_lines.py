"""Line dedup against a plain version, and the given tables against SQL."""

import re

from compare import connection, difference

from parcelspan.llm import lines


def keys(line):
    t = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub(r"(?<!\S)[^\s0-9]*[0-9]\S*", "<*>", line, flags=re.A)) if x]
    if len(t) < lines.LEAST:
        return []
    out, tail = [("all", *t)], len(t) - lines.LEADING
    if len(t) >= lines.GENERAL:
        for i in range(lines.FIELDS):
            a, b = (lines.LEADING + tail * k // lines.FIELDS for k in (i, i + 1))
            out.append((i, len(t), *t[:a], None, *t[b:]))
    return out


def brute(rows):
    first = {}
    for doc, text in rows:
        if doc is not None and text is not None:
            for line in text.split("\n"):
                for k in keys(line):
                    first[k] = min(first.get(k, doc), doc)
    out = []
    gone = {
        (doc, i) for doc, text in rows if doc is not None and text is not None
        for i, line in enumerate(text.split("\n")) if any(first[k] < doc for k in keys(line))
    }
    for doc, text in rows:
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (doc, i) not in gone)
        out.append((doc, text, kept))
    return out


def whole(text, kept):
    """Whether a document stays: nothing of it went, or a tenth of its words and one at least are left."""
    count = lambda t: len([x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x])
    return kept == text or 0 < count(text) <= lines.REMNANT * count(kept)


PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (1, f"own words of the first document here\n{PASSAGE}\nshort line"),
    (2, f"{PASSAGE}\nshort line\nsome other words that nobody else has"),
    (3, PASSAGE.replace("nine", "NINE")), (4, PASSAGE.replace("nine", "x").replace("twelve", "y") + "\n"),
    (5, "ticket 1234 was closed by agent 77 on monday at 12:30\nx"), (6, "ticket 99 was closed by agent 1 on monday at 9:15\n\n y z"),
    (7, None), (8, ""), (9, "a b c d e\na b c d e\na b c d e"), (10, "a b  c\td e\r\nA b c d e"), (None, PASSAGE), (None, None),
    (13, f"{PASSAGE}\n{PASSAGE}\nhi there"), (14, f"{PASSAGE}\n{PASSAGE}\nwell"), (3, "again " + PASSAGE), (11, "w " * 40_000), (12, "w " * 40_000 + "\nlast"),
]


def test_against_plain_version(spark):
    df = spark.createDataFrame([(d, t, [1]) for d, t in ROWS], "doc_id bigint, text string, keys array<int>")
    got = lines.without_dropped(df).collect()
    mine = sorted([(r.doc_id, r.text, r._clean) for r in got], key=repr)
    assert mine == sorted(brute(ROWS), key=repr)
    kept = lines.dedup_lines(df)
    assert kept.columns == df.columns
    want = [(d, c) for d, t, c in brute(ROWS) if whole(t, c)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert PASSAGE in texts[1] and PASSAGE not in texts[2] and 6 in texts and "ticket" not in texts[6] and not {12, 13, 14} & set(texts)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert lines.line_digest(none).count() == 0 and lines.dedup_lines(none).count() == 0


def test_sql(spark):
    folder = "/root/testdata/sf0.01"
    df = lines.line_digest(spark.read.parquet(f"{folder}/documents.parquet"))
    assert difference(df, connection(folder), lines.SQL) is None
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
