"""Line dedup by a log-template tree: lines that recur across documents, up to a variable field, are dropped.

A line is parsed to a fixed depth: its number of tokens, its first `LEADING` tokens, and what follows in `FIELDS` equal
parts. Tokens with a digit are variable from the start. A leaf's templates are the whole line and, for lines of
`GENERAL` tokens or more, the line with any one of its parts left open; two lines have a template in common if they
differ in one part at most. So the tree needs no walk: a template is a key, and finding those that recur is one
aggregation, combined before the shuffle.

A line is dropped if an earlier document (by doc_id) has a line with a template in common; the first document keeps
it, and lines repeated inside one document stay. Lines of fewer than `LEAST` tokens are never dropped. Nothing is capped or
sampled: every line of every document takes part.

Documents that keep fewer than one in `REMNANT` of their words are dropped by `dedup_lines`: they were copies, and what short lines are
left of them resembles nothing any more. Those that had no words, null texts
among them, stay as they are, and so do documents without a dropped line, to the character. Rows that share a
doc_id are one document. Rows with a null doc_id neither lose lines nor make others lose any. Other columns are carried
along; their names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspan.llm.common import free_names, words, written

LEAST, GENERAL = 5, 8
LEADING, FIELDS = 2, 5
REMNANT = 10
VARIABLE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
SPACE = r"[\x20\x09-\x0D]+"


def line_keys(documents: DataFrame) -> DataFrame:
    """doc_id, line (from 0) and the keys of its templates, for every line that may be dropped."""
    masked = F.when(F.col("text").rlike("[0-9]"), F.regexp_replace("text", VARIABLE, "<*>")).otherwise(F.col("text"))
    parsed = F.transform(F.split(masked, "\n"), lambda line: F.array_remove(F.split(line, SPACE), ""))
    lines = documents.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(parsed).alias("line", "tokens"))
    count = F.size("tokens")
    tail = count - LEADING

    def field(i: int) -> Column:
        start, end = F.floor(tail * i / FIELDS).cast("int"), F.floor(tail * (i + 1) / FIELDS).cast("int")
        return F.xxhash64(F.slice("tokens", start + LEADING + 1, end - start))

    # Each part is hashed once; templates are hashes of those.
    leading = F.xxhash64(F.slice("tokens", 1, LEADING))
    parts = F.when(count >= GENERAL, F.array(leading, *[field(i) for i in range(FIELDS)])).alias("parts")
    lines = lines.where(count >= LEAST).select("doc_id", "line", count.alias("count"), F.xxhash64("tokens").alias("whole"), parts)
    part = [F.get("parts", F.lit(i)) for i in range(FIELDS + 1)]
    open_ = [F.xxhash64("count", F.lit(i), *part[: i + 1], *part[i + 2 :]) for i in range(FIELDS)]
    return lines.select("doc_id", "line", F.when(F.col("count") >= GENERAL, F.array("whole", *open_)).otherwise(F.array("whole")).alias("keys"))


def dropped_lines(documents: DataFrame) -> DataFrame:
    """Per document that loses lines: doc_id and `dropped`, their numbers."""
    lines = written(documents.sparkSession, line_keys(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")), "lines")
    rows = lines.select("doc_id", "line", F.explode("keys").alias("key"))
    first = rows.groupBy("key").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"))
    late = rows.join(first.where("_first < _last").drop("_last"), "key").where("doc_id > _first")
    return late.groupBy("doc_id").agg(F.collect_set("line").alias("dropped"))


def without_dropped(documents: DataFrame, clean: str = "_clean", n_lines: str = "_lines", n_dropped: str = "_dropped") -> DataFrame:
    """All documents with the text that is left, the number of lines and of dropped ones, in columns of these names."""
    gone_id, gone = free_names(documents, "_gone_id", "_gone")
    found = dropped_lines(documents).select(F.col("doc_id").alias(gone_id), F.col("dropped").alias(gone))
    rows = documents.join(found, F.col("doc_id") == F.col(gone_id), "left").drop(gone_id)
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains(gone, i))
    return rows.withColumns(
        {
            clean: F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
            n_lines: F.size(lines).cast("bigint"),
            n_dropped: F.coalesce(F.size(gone), F.lit(0)).cast("bigint"),
        }
    ).drop(gone)


def dedup_lines(documents: DataFrame) -> DataFrame:
    """Documents without the lines that recur, with all their columns; documents that lose all words, or all but one in `REMNANT`, are
    left out."""
    clean, n_lines, n_dropped = free_names(documents, "_clean", "_lines", "_dropped")
    left, had = F.size(words(F.col(clean))), F.size(words(F.col("text")))
    cleaned = without_dropped(documents, clean, n_lines, n_dropped)
    cleaned = cleaned.where((F.col(n_dropped) == 0) | ((left > 0) & (left * REMNANT >= had)))
    return cleaned.select(*[F.col(clean).alias("text") if c == "text" else F.col(c) for c in documents.columns])


def line_digest(documents: DataFrame) -> DataFrame:
    """Per document: its lines, those dropped, and the hash of the text that is left (null: empty)."""
    return without_dropped(documents.select("doc_id", "text")).select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("_clean", F.lit("")).cast("binary"), 256).alias("clean_sha256"),
    )


SQL = rf"""
WITH lines AS (
  SELECT doc_id, line, list_filter(string_split_regex(regexp_replace(l, '(^|\s)[^\s0-9]*[0-9]\S*', '\1<*>', 'g'), '[ \t-\r]+'), lambda t: t <> '') AS t
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents)
), fields AS (
  SELECT doc_id, line, t, len(t) AS n, i,
         {LEADING} + floor((len(t) - {LEADING}) * i / {FIELDS}.0)::BIGINT AS a, {LEADING} + floor((len(t) - {LEADING}) * (i + 1) / {FIELDS}.0)::BIGINT AS b
  FROM lines, range(-1, {FIELDS}) AS r(i) WHERE len(t) >= {LEAST} AND (i = -1 OR len(t) >= {GENERAL})
), keys AS (
  SELECT doc_id, line, CASE WHEN i = -1 THEN array_to_string(t, ' ')
         ELSE concat(i, ' ', n, ' ', array_to_string(t[1:a], ' '), chr(1), array_to_string(t[b + 1:], ' ')) END AS k
  FROM fields
), firsts AS (SELECT k, min(doc_id) AS f FROM keys GROUP BY k),
gone AS (SELECT DISTINCT doc_id, line FROM keys JOIN firsts USING (k) WHERE doc_id > f),
kept AS (
  SELECT d.doc_id, d.line, d.l, g.line IS NOT NULL AS dropped
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents) d
  LEFT JOIN gone g ON d.doc_id = g.doc_id AND d.line = g.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY line) FILTER (WHERE NOT dropped), '')) AS clean_sha256
FROM kept GROUP BY doc_id
"""
