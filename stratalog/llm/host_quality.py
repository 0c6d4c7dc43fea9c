"""Host-level quality rules with DataFrame functions only.

Each document is measured and tested; failures are added up by domain (`source`), the domains' failure rates are shrunk
by a beta prior fitted to all domains, and a domain's verdict goes back to its documents in a salted join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, salted, written

#: A document fails as a member of its host if it fails the base rules, or more than so many symbols a word, or so large a part of its lines repeats.
MAX_SYMBOLS, MAX_DUP_LINES = 0.5, 0.5
#: A host goes if its failure rate is above this, less so many standard deviations of the posterior.
MAX_RATE, SIGMAS = 0.5, 2.0


def words_of(text: Column) -> Column:
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[\\x20\\x09-\\x0D]+")))


def _repeated(w: Column) -> Column:
    """Words of w that are covered by windows of 3 words which occur twice or more.

    Windows are compared by 64-bit hashes first; only those whose hash occurs twice are compared as strings.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def twice(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["g"] == x["g"], F.lit(False))
        return F.transform(F.filter(s, same), lambda x: x["i"])

    def covered(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        grams = lambda places: F.array_sort(F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(3), p - acc["last"])).alias("total"))
        places = F.array_sort(let(let(let(by_hash, twice), grams), twice))
        count = F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total")), step, lambda acc: acc["total"])
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(count)

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, covered))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source and the base measures of docs(doc_id, text, source): n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines (those with a word), base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), _repeated(w).alias("r"))

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    rows = docs.select("doc_id", "source", let(words_of(F.col("text")), of_words).alias("w"), of_lines.alias("l"), F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).alias("s"))
    long = {"n_words": "w.n", "word_chars": "w.c", "n_symbols": "s", "n_dup_lines": "l.d", "n_repeat_words": "w.r", "n_lines": "l.n"}
    rows = rows.select("doc_id", "source", *[F.col(c).cast("long").alias(k) for k, c in long.items()])
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def shrunk(hosts: DataFrame, failed: str = "failed", n: str = "n") -> DataFrame:
    """hosts(failed, n) with rate, deviation: mean and standard deviation of each posterior.  The beta prior has the mean
    of all rows; its weight follows from how much the rates differ beyond chance, between 1 and 1000 rows.  The prior is
    two numbers, which the driver reads."""
    one = hosts.agg(F.sum(failed).alias("k"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("g"), F.sum(F.col(failed) * F.col(failed) / F.col(n)).alias("q")).first()
    mean, weight = prior(one["k"] or 0, one["n"] or 0, one["g"], one["q"] or 0.0)
    a, b = F.col(failed) + mean * weight, F.col(n) - F.col(failed) + (1 - mean) * weight
    return hosts.withColumn("rate", a / (a + b)).withColumn("deviation", F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))


def prior(k: float, n: float, groups: int, squares: float) -> tuple[float, float]:
    """Mean and weight of the beta prior.  squares: the sum of failed * failed / n."""
    if not n or not 0 < k < n:
        return (k + 0.5) / (n + 1), 1.0
    mean = k / n
    between = (squares - k * mean) / n - mean * (1 - mean) * groups / n
    return mean, min(1000.0, max(1.0, mean * (1 - mean) / max(between, 1e-6) - 1))


def host_quality(docs: DataFrame) -> DataFrame:
    """The measures of each row of docs(doc_id, text, source), host_rate, host_deviation, and kept.

    kept: the document passes the base rules and its host isn't judged bad.  A null text has no words, a null source is
    a host of its own.  Repeated rows count each and come back each; an empty table gives an empty one; other columns
    are left out.
    """
    rows = written(measure(docs), "measures")
    bad = F.col("base_failed") | (F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words")) | (F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"))
    hosts = shrunk(rows.groupBy("source").agg(F.sum(bad.cast("long")).alias("failed"), F.count(F.lit(1)).alias("n")))
    hosts = hosts.select("source", F.col("rate").alias("host_rate"), F.col("deviation").alias("host_deviation"))
    rows = salted(rows, hosts, ["source"], F.col("doc_id"))
    good = F.col("host_rate") - SIGMAS * F.col("host_deviation") <= MAX_RATE
    return rows.withColumn("kept", ~F.col("base_failed") & good)


SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t
), g AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), twice AS (
  SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1
), r AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid
), m AS (
  SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON w.rid = r.rid
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), h AS (
  SELECT source, CAST(sum(CASE WHEN base_failed OR n_symbols > 0.5 * n_words OR n_dup_lines > 0.5 * n_lines THEN 1 ELSE 0 END) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n
  FROM b GROUP BY source
), o AS (SELECT sum(k) AS k, sum(n) AS n, count(*) AS g, sum(k * k / n) AS q FROM h),
p AS (
  SELECT CASE WHEN 0 < k AND k < n THEN k / n ELSE (k + 0.5) / (n + 1) END AS mean,
         CASE WHEN 0 < k AND k < n THEN least(1000.0, greatest(1.0, k / n * (1 - k / n) / greatest((q - k * k / n) / n - k / n * (1 - k / n) * g / n, 1e-6) - 1)) ELSE 1.0 END AS weight FROM o
), s AS (SELECT source, k + mean * weight AS a, n - k + (1 - mean) * weight AS b FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND s.a / (s.a + s.b) - 2.0 * sqrt(s.a * s.b / ((s.a + s.b) * (s.a + s.b) * (s.a + s.b + 1))) <= 0.5 AS kept
FROM b JOIN s ON b.source IS NOT DISTINCT FROM s.source
"""
