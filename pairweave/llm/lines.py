"""Line dedup by overlapping three-line windows, with DataFrame functions only.

A text is split at line feeds.  Every three consecutive lines are hashed (128
bits); a window that occurs more than once in the corpus is kept at its first
place, by (doc_id, line), null doc_id first, and all lines of its later
occurrences go: the positions covered by any of them are merged.  Texts of fewer
than three lines have no window and stay as they are.  Lines are compared as
they are, but for spaces, tabs and carriage returns at either end; windows of
blank lines only don't count.

Rows of equal doc_id share their places: a window at the same (doc_id, line) in
two such rows is first in both, so a repeated row is not a copy of itself.  Null
texts stay null and empty ones empty; a text whose lines all go becomes empty.

First places are found by a group-by that sums within tasks; later occurrences
are joined to them on the hash, the most frequent windows dealt to many parts.  Texts are shuffled once, to meet the lines to
remove.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import salted_join

WINDOW = 3


def _hash_pair(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The columns of ``docs`` with the text's later lines removed, and two counts: lines, and lines removed."""
    names = docs.columns
    fresh = lambda x: next(n for n in (x + "_" * i for i in range(99)) if n.lower() not in {c.lower() for c in names})
    doc, body, gone = fresh("k_doc"), fresh("k_text"), fresh("k_gone")
    keyed = docs.withColumns({doc: F.col(f"`{id_col}`").cast("string"), body: F.xxhash64(F.col(f"`{text_col}`"))})

    lines = F.split(F.col(f"`{text_col}`"), "\n", -1)
    trimmed = F.transform(lines, lambda x: F.trim(x, F.lit(" \t\r")))
    own = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("body"), trimmed.alias("lines")).filter(F.size("lines") >= window)
    joined = F.transform(F.sequence(F.lit(1), F.size("lines") - (window - 1)), lambda i: F.array_join(F.slice("lines", i, window), "\n"))
    each = own.select("doc", "body", F.posexplode(joined).alias("at", "w")).filter(F.length("w") > window - 1)
    hashed = each.select("doc", "body", "at", *_hash_pair(F.col("w")))

    place = F.struct(F.col("doc"), F.col("at"))
    repeated = hashed.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).filter(~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first", "n")
    later = salted_join(hashed, repeated, ["h1", "h2"], "n", F.col("doc")).filter(~place.eqNullSafe(F.col("first")))
    remove = later.groupBy("doc", "body").agg(F.collect_set("at").alias(gone)).select(F.col("doc").cast("string").alias("doc"), "body", gone)

    right = remove.withColumnsRenamed({"doc": doc + "r", "body": body + "r"})
    both = keyed.join(right, F.col(doc).eqNullSafe(F.col(doc + "r")) & (F.col(body) == F.col(body + "r")), "left").drop(doc + "r", body + "r")
    starts = F.array_sort(F.col(gone))
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (window - 1)))))
    all_lines = F.size(lines)
    kept = F.array_except(F.sequence(F.lit(0), all_lines - 1), covered)
    text = F.when(F.col(gone).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    removed = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(covered))
    out = both.withColumns({counts[0]: F.coalesce(all_lines, F.lit(0)).cast("long"), counts[1]: removed.cast("long")})
    return out.withColumn(text_col, text).drop(doc, body, gone)


SQL = r"""
WITH own AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines,
         list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))) AS trimmed
  FROM documents),
each AS (
  SELECT doc_id, i AS pos, trimmed[i + 1] || chr(10) || trimmed[i + 2] || chr(10) || trimmed[i + 3] AS w
  FROM own, unnest(range(0, len(lines) - 2)) AS u(i)),
placed AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS nth
  FROM each WHERE w <> chr(10) || chr(10)),
gone AS (
  SELECT DISTINCT doc_id, pos + k AS line FROM placed, unnest([0, 1, 2]) AS u(k) WHERE nth > 1),
kept AS (
  SELECT o.doc_id, string_agg(o.line_text, chr(10) ORDER BY o.line) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(lines) AS line_text, unnest(range(0, len(lines))) AS line FROM own) o
  ANTI JOIN gone g ON g.doc_id = o.doc_id AND g.line = o.line
  GROUP BY o.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(len(d.lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(d.lines), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed
FROM own d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
