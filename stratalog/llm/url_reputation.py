"""URL filters with DataFrame functions only: written rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are added up by host, registered domain and suffix.  Each level's rate is shrunk
towards that of the level above by a beta-binomial prior whose weight is fitted to how much the groups of the level
differ; a host is blocked if the lower posterior bound of its bad rate is above the limit.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, salted, written
from .host_quality import prior

#: (verdict, rule); a rule is a host and a path, which begins at the first slash.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A host is blocked if its bad rate is above MAX_RATE by SIGMAS posterior standard deviations.
MAX_RATE, SIGMAS = 0.5, 1.0
#: The suffixes under which domains are registered: names, `*.name` for all below one, `!name` for what is excepted from that.
PUBLIC_SUFFIXES = tuple(x for x in (Path(__file__).parent / "public_suffixes.txt").read_text(encoding="utf-8").split("\n") if x and x[0] != "#")
_IP = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$"
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def named(hosts: DataFrame, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> DataFrame:
    """hosts(host, ...), a row a host, with its registered domain and suffix.

    The suffix is the longest of `suffixes` that the host ends with, else its last label; the domain has one label more.
    A host that is a suffix is its own domain, an IP address too, with an empty suffix.  A port is left out.  The table of
    suffixes is part of this package, about 10,000 rows, and is broadcast.
    """
    kinds = [(x.lstrip("!").removeprefix("*."), -1 if x[0] == "!" else int(x[0] == "*")) for x in suffixes]
    rules = hosts.sparkSession.createDataFrame(kinds, "__rule string, __more int")
    name = F.regexp_replace("host", ":[0-9]*$", "")
    most = max(x.count(".") for x in suffixes) + 1
    rows = hosts.withColumn("__name", name).withColumn("__labels", F.split("__name", "\\."))
    ends = F.explode(F.sequence(F.lit(1), F.least(F.size("__labels"), F.lit(most))))
    ends = rows.select("host", "__labels", ends.alias("__k")).withColumn("__rule", F.array_join(F.slice("__labels", -F.col("__k"), F.col("__k")), "."))
    found = ends.join(F.broadcast(rules), "__rule").where(F.col("__k") + F.col("__more") <= F.size("__labels"))
    found = found.groupBy("host").agg(F.max(F.when(F.col("__more") < 0, F.col("__k") - 1)).alias("__except"), F.max(F.col("__k") + F.col("__more")).alias("__most"))
    found = found.select(F.col("host").alias("__host"), F.coalesce("__except", "__most").alias("__n"))
    rows = rows.join(found, F.col("host") == F.col("__host"), "left").withColumn("__n", F.coalesce("__n", F.lit(1)))
    ip = F.col("__name").rlike(_IP)
    part = lambda n: F.array_join(F.slice("__labels", -F.least(n, F.size("__labels")), n), ".")
    rows = rows.withColumn("domain", F.when(ip, F.col("__name")).otherwise(part(F.col("__n") + 1))).withColumn("suffix", F.when(ip, "").otherwise(part(F.col("__n"))))
    return rows.drop("__name", "__labels", "__n", "__host")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does.  Of rules of one length the first listed wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        at, _, below = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + below))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def reputation(outcomes: DataFrame) -> DataFrame:
    """host, rate, deviation from outcomes(host, bad 0/1): the posterior of each host that has an outcome.

    The priors are two numbers a level, which the driver reads from three one-row aggregates.
    """
    hosts = outcomes.groupBy("host").agg(F.sum(F.col("bad").cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))
    hosts = written(named(hosts), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))

    def fitted(level: DataFrame) -> tuple[float, float]:
        one = level.agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("q")).first()
        return prior(one["k"] or 0, one["n"] or 0, one["g"], one["q"] or 0.0)

    (mean, weight), (_, of_domain), (_, of_host) = fitted(suffixes), fitted(domains), fitted(hosts)
    suffixes = suffixes.select("suffix", ((F.col("k") + mean * weight) / (F.col("n") + weight)).alias("__s"))
    domains = salted(domains, suffixes, ["suffix"], F.col("domain"))
    domains = domains.select("domain", ((F.col("k") + F.col("__s") * of_domain) / (F.col("n") + of_domain)).alias("__d"))
    hosts = salted(hosts, domains, ["domain"], F.col("host"))
    a, b = F.col("k") + F.col("__d") * of_host, F.col("n") - F.col("k") + (1 - F.col("__d")) * of_host
    return hosts.select("host", (a / (a + b)).alias("rate"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("deviation"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, rate of each row of pages(page_id, url); outcomes(page_id, bad 0/1).

    A null url, or one without `://`, has an empty host and path.  A page without a rule is blocked if its host's lower
    posterior bound is above the limit, else allowed; a host without outcomes is allowed, and its rate is null.  Null
    outcomes are left out; several outcomes of one page_id count each.  Repeated rows come back each; other columns
    are left out; empty tables are fine.
    """
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    labels = outcomes.where(F.col("bad").isNotNull()).select(F.col("page_id").alias("__page"), "bad")
    known = reputation(labels.join(rows.select("page_id", "host"), F.col("__page") == F.col("page_id")).select("host", "bad"))
    rows = salted(rows, known, ["host"], F.col("page_id"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    bad = F.coalesce(F.col("rate") - SIGMAS * F.col("deviation") > MAX_RATE, F.lit(False))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "rate")


def _level(name: str, rows: str) -> str:
    return f"""{name}_o AS (SELECT sum(k) AS k, sum(n) AS n, count(*) AS g, sum(k * k / n) AS q FROM {rows}),
{name}_p AS (
  SELECT CASE WHEN 0 < k AND k < n THEN k / n ELSE (k + 0.5) / (n + 1) END AS mean,
         CASE WHEN 0 < k AND k < n THEN least(1000.0, greatest(1.0, k / n * (1 - k / n) / greatest((q - k * k / n) / n - k / n * (1 - k / n) * g / n, 1e-6) - 1)) ELSE 1.0 END AS weight FROM {name}_o)"""


SQL = rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), rules(verdict, rule) AS (VALUES {", ".join(f"('{v}', '{r}')" for v, r in RULES)}
), fit AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN rules ON (host = split_part(rule, '/', 1) OR host LIKE '%.' || split_part(rule, '/', 1))
    AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY ALL
), raw AS (
  SELECT host, CAST(sum(CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n
  FROM p JOIN labels l ON l.doc_id = p.page_id GROUP BY host
), listed AS (SELECT unnest(string_split('{" ".join(PUBLIC_SUFFIXES)}', ' ')) AS raw
), psl AS (SELECT regexp_replace(raw, '^(!|\*\.)', '') AS name, CASE WHEN raw LIKE '!%' THEN -1 WHEN raw LIKE '*.%' THEN 1 ELSE 0 END AS more FROM listed
), named AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name FROM raw
), parts AS (SELECT *, string_split(name, '.') AS part FROM named
), ends AS (SELECT host, part, unnest(range(1, len(part) + 1)) AS k FROM parts
), cut AS (
  SELECT host, coalesce(max(CASE WHEN more < 0 THEN k - 1 END), max(k + more)) AS n
  FROM ends JOIN psl ON psl.name = array_to_string(list_slice(part, len(part) - k + 1, len(part)), '.') AND k + more <= len(part) GROUP BY host
), h AS (
  SELECT p.host, k, p.n, CASE WHEN regexp_matches(name, '{_IP}') THEN name ELSE array_to_string(list_slice(part, greatest(1, len(part) - coalesce(c.n, 1)), len(part)), '.') END AS domain,
         CASE WHEN regexp_matches(name, '{_IP}') THEN '' ELSE array_to_string(list_slice(part, len(part) - coalesce(c.n, 1) + 1, len(part)), '.') END AS suffix
  FROM parts p LEFT JOIN cut c ON c.host = p.host
), d AS (SELECT domain, suffix, sum(k) AS k, sum(n) AS n FROM h GROUP BY ALL), s AS (SELECT suffix, sum(k) AS k, sum(n) AS n FROM h GROUP BY suffix),
{_level("s", "s")},
{_level("d", "d")},
{_level("h", "h")},
sr AS (SELECT suffix, (k + mean * weight) / (n + weight) AS r FROM s, s_p),
dr AS (SELECT domain, (k + sr.r * weight) / (n + weight) AS r FROM d JOIN sr USING (suffix), d_p),
ab AS (SELECT host, k + dr.r * weight AS a, n - k + (1 - dr.r) * weight AS b FROM h JOIN dr USING (domain), h_p)
SELECT p.page_id, p.host, p.path, fit.rule,
       coalesce(fit.verdict, CASE WHEN a / (a + b) - sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit ON fit.page_id = p.page_id LEFT JOIN ab ON ab.host = p.host
"""
