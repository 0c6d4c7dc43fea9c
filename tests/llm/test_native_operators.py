"""Line dedup, URL reputation and host quality against brute force, and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stratalog.llm import host_quality, line_dedup, url_reputation

BLANKS = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# Line dedup


def deduped(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    key = lambda x: lower(x.strip(BLANKS))
    for d, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(d)
    hot = {k: max(h) for k, h in holders.items() if len(k) >= min_chars and len(h) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if hot.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup_as_brute_force(spark):
    rng = random.Random(4)
    lines = [f"line number {i} " + "äbc def " * rng.randrange(2, 6) for i in range(12)]
    rows = [(d, "\n".join(rng.choice((x, x.upper(), f" \t{x}\r", "short", "")) for x in rng.choices(lines, k=rng.randrange(1, 9)))) for d in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (3, rows[3][1]), (63, (lines[0] + "\n") * 3), (64, "z" * 200_000 + "\n" + lines[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.line_dedup(docs).collect())
    assert found == deduped(rows)
    assert sum(r[2] for r in found) > 20


def test_line_dedup_keeps_other_columns(spark):
    line = "a line of more than forty characters, which five documents have"
    docs = spark.createDataFrame([(i, line, "t", "d", "g", 5) for i in range(6)], "doc_id long, text string, __t string, __doc string, __gone string, n_lines int")
    rows = line_dedup.line_dedup(docs)
    assert set(rows.columns) == {*docs.columns, "n_dropped"}
    assert {(r["__t"], r["__doc"], r["__gone"], r["n_lines"]) for r in rows.collect()} == {("t", "d", "g", 1)}
    assert [r["doc_id"] for r in rows.where("n_dropped = 0").collect()] == [5]
    assert line_dedup.line_dedup(docs.limit(0)).collect() == []


# URL reputation


@pytest.mark.parametrize(
    ("host", "domain", "suffix"),
    [
        ("www.x.gov.au", "x.gov.au", "gov.au"),
        ("10.0.0.1", "10.0.0.1", ""),
        ("10.0.0.1:8080", "10.0.0.1", ""),
        ("a.github.io", "a.github.io", "github.io"),
        ("github.io", "github.io", "github.io"),
        ("x.co.kr", "x.co.kr", "co.kr"),
        ("b.www.ck", "www.ck", "ck"),
        ("a.b.foo.ck", "b.foo.ck", "foo.ck"),
        ("www.example.com:443", "example.com", "com"),
        ("localhost", "localhost", "localhost"),
        ("a.b.unlisted", "b.unlisted", "unlisted"),
        ("", "", ""),
    ],
)
def test_registered_domains(spark, host, domain, suffix):
    row = url_reputation.named(spark.createDataFrame([(host,)], "host string")).first()
    assert (row["domain"], row["suffix"]) == (domain, suffix)


def verdicts(pages, outcomes):
    """By hand: suffix, domain and host shrink in turn."""
    host = {}
    for p, u in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host[p] = (lower(m[1]), m[2]) if m else ("", "")
    k, n = Counter(), Counter()
    for p, bad in outcomes:
        if bad is not None and p in host:
            k[host[p][0]] += bad
            n[host[p][0]] += 1
    cut = lambda h, i: ".".join(h.split(".")[-i:])  # noqa: E731  hosts of this test have suffixes of one label
    up = {}
    for i in (1, 2):
        up[i] = (Counter(), Counter())
        for h in n:
            up[i][0][cut(h, i)] += k[h]
            up[i][1][cut(h, i)] += n[h]
    fit = lambda a, b: host_quality.prior(sum(a[x] for x in b), sum(b.values()), len(b), sum(a[x] ** 2 / b[x] for x in b))
    (mean, w1), (_, w2), (_, w3) = fit(*up[1]), fit(*up[2]), fit(k, n)
    out = {}
    for p, (h, path) in host.items():
        fits = [(len(r), r, v) for v, r in url_reputation.RULES if (h == r.split("/", 1)[0] or h.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        if fits:
            out[p] = (max(fits)[1], max(fits)[2])
            continue
        bad = False
        if n[h]:
            s = (up[1][0][cut(h, 1)] + mean * w1) / (up[1][1][cut(h, 1)] + w1)
            d = (up[2][0][cut(h, 2)] + s * w2) / (up[2][1][cut(h, 2)] + w2)
            a, b = k[h] + d * w3, n[h] - k[h] + (1 - d) * w3
            bad = a / (a + b) - (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5 > 0.5
        out[p] = (None, "block" if bad else "allow")
    return out


def test_url_filter_as_brute_force(spark):
    rng = random.Random(9)
    hosts = [f"{a}.{b}.{c}" for a in ("www", "cdn") for b in ("good", "bad", "mixed", "example") for c in ("com", "net", "org")]
    pages = [(i, f"HTTPS://{rng.choice(hosts).upper() if i % 7 == 0 else rng.choice(hosts)}/{rng.choice(('en/1', 'es/x', 'fr/', 'de/q?x', ''))}") for i in range(600)]
    pages += [(600, None), (601, "no scheme"), (602, "x://"), (603, "ftp://example.org/en/12#f"), (604, "a://b.org?x")]
    outcomes = [(i, int(rng.random() < (0.95 if "bad" in u.lower() else 0.1))) for i, u in pages[:500]] + [(1, None), (2, 1), (99_999, 1)]
    rows = url_reputation.url_filter(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int"))
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in rows.collect()}
    assert found == verdicts(pages, outcomes)
    assert {"block", "allow"} == {v for r, v in found.values() if r is None}


def test_url_filter_on_empty_tables_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "x")] * 3 + [(None, None, "y")], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad int")
    assert url_reputation.url_filter(pages, none).count() == 4
    assert url_reputation.url_filter(pages.limit(0), none).collect() == []


# Host quality


def measured(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + k for w in windows.values() if len(w) > 1 for i in w for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def test_host_quality_as_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        source = rng.choice(("good", "bad", "mixed", "good", None))
        size = {"bad": 20, "good": rng.choice((60, 120, 200))}.get(source, rng.choice((0, 2, 3, 4, 30, 60, 120)))
        few = rng.choice((3, 500, 500))
        words = [rng.choice(("ä", "b", "cc", "e", "d|")) + str(rng.randrange(few)) for _ in range(size)]
        rows.append((i, rng.choice((" ", "\n", "\t")).join(words), source))
    rows += [(400, None, "good"), (401, "", "lone"), (402, " \n\t", None), (402, " \n\t", None), (403, "x y z " * 30_000, "good")]
    want, failed, n = {}, Counter(), Counter()
    for d, t, s in rows:
        w, c, y, dup, rep, lines = measured(t)
        base = w < 50 or 100 * rep > 50 * w
        want[d] = [w, c, y, dup, rep, base]
        failed[s] += base or y > 0.5 * w or dup > 0.5 * lines
        n[s] += 1
    mean, weight = host_quality.prior(sum(failed.values()), sum(n.values()), len(n), sum(failed[s] ** 2 / n[s] for s in n))
    for d, _, s in rows:
        a, b = failed[s] + mean * weight, n[s] - failed[s] + (1 - mean) * weight
        want[d] = (*want[d][:6], not want[d][5] and a / (a + b) - 2 * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5 <= 0.5)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, n_words string")
    found = host_quality.host_quality(docs.drop("n_words")).collect()
    assert len(found) == len(rows)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert {r["doc_id"]: tuple(r[c] for c in names) for r in found} == want
    assert host_quality.host_quality(docs).count() == len(rows)  # a column of a measure's name is left out
    assert host_quality.host_quality(docs.limit(0)).collect() == []
    assert {True, False} == {v[6] for v in want.values()}


def test_digest_of_the_contract(spark):
    docs = spark.createDataFrame([(1, "ä\nb")], "doc_id long, text string")
    row = line_dedup.line_dedup(docs).select(F.sha2("text", 256).alias("h")).first()
    assert row["h"] == hashlib.sha256("ä\nb".encode()).hexdigest()
