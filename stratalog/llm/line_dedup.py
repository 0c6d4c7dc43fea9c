"""Line dedup with DataFrame functions only.

Lines are exploded, normalised and hashed (128 bits); distinct documents are counted per hash in two steps, first by
(hash, document), so that a line which a third of all documents hold is spread over all tasks; the hashes over the
threshold go back to the lines in a salted join, and each document is put together again from the stretches between its
dropped positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, salted, unused

_KEYS = ["__h1", "__h2"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row a line whose key has min_chars code points at least."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("__t"), F.posexplode(_lines(F.col("text"))).alias("__pos", "__line"))
    rows = rows.where(F.length("__line") >= min_chars).withColumn("__key", ascii_lower(F.btrim("__line", F.lit(BLANKS))))
    return rows.where(F.length("__key") >= min_chars).select("doc_id", "__t", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(11), F.col("__key")).alias("__h2"))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs(doc_id, text, ...) with n_lines and n_dropped, and `text` without the lines that repeat across documents.

    A line's key is the line without `[\\x20\\x09-\\x0D]` at its ends and with A-Z in lower case.  A key of min_chars code
    points or more that min_docs distinct doc_id or more hold stays only in the largest of them (there, each time it
    occurs).  A null or empty text is one empty line and comes back as an empty text.  All rows of a null doc_id count
    as one document, which is never the largest.  Repeated rows count as one document and each comes back; rows with
    one doc_id and different texts are one document.  Columns called n_lines or n_dropped are replaced, others kept.
    An empty table gives an empty one.
    """
    lines = _hashed(docs, min_chars)
    held = lines.select(*_KEYS, "doc_id").distinct()
    hot = held.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("__n"), F.max("doc_id").alias("__stays")).where(F.col("__n") >= min_docs).drop("__n")
    dropped = salted(lines, hot, _KEYS, F.col("doc_id"), "inner").where(~F.col("doc_id").eqNullSafe(F.col("__stays")))
    dropped = dropped.groupBy("doc_id", "__t").agg(F.array_sort(F.collect_set("__pos")).alias("__gone"))
    rows = docs.drop("n_lines", "n_dropped")
    own, doc, hashed, gone = unused(rows, 4)
    dropped = dropped.select(F.col("doc_id").alias(doc), F.col("__t").alias(hashed), F.col("__gone").alias(gone))
    rows = rows.withColumn(own, F.xxhash64("text"))
    rows = rows.join(dropped, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(hashed)), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.withColumn("n_lines", F.size(_lines(F.col("text"))).cast("long")).withColumn("n_dropped", F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))
    rows = rows.withColumn("text", F.when(F.col(gone).isNull(), text).otherwise(_without(_lines(F.col("text")), F.col(gone))))
    return rows.drop(own, doc, hashed, gone)


def _without(lines: Column, gone: Column) -> Column:
    """The lines joined, without those at the ascending positions `gone`: the stretches between them, in one pass."""
    from .common import let

    def stretches(x: Column) -> Column:
        ends = F.concat(gone, F.array(F.size(x)))
        return F.flatten(F.transform(F.concat(F.array(F.lit(-1)), gone), lambda a, i: F.slice(x, a + 2, F.get(ends, i) - a - 1)))

    return F.array_join(let(lines, stretches), "\n")


SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), hot AS (
  SELECT key, max(doc_id) AS stays FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, hot.key IS NOT NULL AND k.doc_id <> hot.stays AS gone FROM keyed k LEFT JOIN hot ON k.key = hot.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
