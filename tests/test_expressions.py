"""Spark expressions against the byte codecs."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from stratalog.functions import bloom, codec
from stratalog.functions import expressions as ex
from tests.test_codec import HASHES


def both(spark, rows, schema, *columns):
    return [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def test_hash_vectors_and_nulls(spark):
    rows = [(d, s) for d, s, _ in HASHES] + [(None, 1), (b"x", None)]
    assert both(spark, rows, "k binary, s long", ex.hash32("k", "s")) == [(h,) for *_, h in HASHES] + [(None,), (None,)]


def test_hash_of_keys_of_all_lengths(spark):
    rng = random.Random(1)
    rows = [(rng.randbytes(n), rng.randrange(2**32)) for n in range(60) for _ in range(5)]
    assert both(spark, rows, "k binary, s long", ex.hash32("k", "s")) == [(codec.hash32(k, s),) for k, s in rows]


def test_varints(spark):
    numbers = [0, 1, 127, 128, 255, 300, 2**14 - 1, 2**14, 2**31, 2**32, 2**56 - 1, 2**62, 2**63 - 1]
    code = ex.varint(F.col("n"))
    got = both(spark, [(n,) for n in numbers], "n long", code, ex.read_varint(F.concat(code, F.lit(b"\x85z")))["number"], ex.read_varint(code)["length"])
    assert got == [(codec.varint(n), n, codec.varint_length(n)) for n in numbers]
    assert both(spark, [(None,), (-1,)], "n long", code) == [(None,), (None,)]
    assert both(spark, [(b"",), (b"\x80",), (b"\xff" * 12,), (None,)], "n binary", ex.read_varint(F.col("n"))) == [(None,)] * 4


def test_fixed_numbers(spark):
    numbers = [0, 1, 255, 256, 2**32 - 1, 2**40 + 7, 2**63 - 1]
    got = both(spark, [(n,) for n in numbers], "n long", ex.fixed64(F.col("n")), ex.read_fixed64(ex.fixed64(F.col("n"))))
    assert got == [(n.to_bytes(8, "little"), n) for n in numbers]
    assert both(spark, [(n,) for n in (0, 77, 2**32 - 1)], "n long", ex.fixed32(F.col("n"))) == [(n.to_bytes(4, "little"),) for n in (0, 77, 2**32 - 1)]


def test_separators_and_successors(spark):
    rng = random.Random(2)
    pairs = [(b"request", b"require"), (b"abcde", b"abcdx"), (b"abcdx", b"abcde"), (b"abcdex", b"abcdfg"), (b"", b"a"), (b"\xff", b"\xff\xff"), (b"a\xfe", b"a\xff\x01"), (b"a\xff", b"b")]
    pairs += [tuple(rng.choice((b"", b"\xff", b"ab")) + bytes(rng.choice((0, 97, 98, 254, 255)) for _ in range(rng.randrange(5))) for _ in range(2)) for _ in range(300)]
    got = both(spark, pairs, "a binary, b binary", ex.separator(F.col("a"), F.col("b")), ex.successor(F.col("a")))
    assert got == [(codec.separator(a, b), codec.successor(a)) for a, b in pairs]
    assert both(spark, [(None, b"x"), (b"x", None)], "a binary, b binary", ex.separator(F.col("a"), F.col("b")), ex.successor(F.col("a"))) == [(None, None), (None, b"y")]
    inner = [(codec.internal_key(a, 100, 1), codec.internal_key(b, 200, 1)) for a, b in [*pairs[:60], (b"foo", b"hello"), (b"foo", b"foo"), (b"foo", b"foobar"), (b"foobar", b"foo"), (b"foo", b"bar")]]
    got = both(spark, inner, "a binary, b binary", ex.internal_separator(F.col("a"), F.col("b")), ex.internal_successor(F.col("a")))
    assert got == [(codec.internal_separator(a, b), codec.internal_successor(a)) for a, b in inner]


def test_internal_keys(spark):
    rows = [(b"test", 2, 1), (b"", 2**55 - 1, 0), (b"\xff\x00", 0, 1)]
    key = ex.internal_key(F.col("k"), F.col("s"), F.col("o"))
    got = both(spark, rows, "k binary, s long, o int", key, ex.user_key(key), ex.parse_internal_key(key)["seq"], ex.parse_internal_key(key)["op"])
    assert got == [(codec.internal_key(*r), *r) for r in rows]
    assert both(spark, [(b"short",), (b"k" + bytes([9, 0, 0, 0, 0, 0, 0, 0]),), (None,)], "k binary", ex.parse_internal_key(F.col("k"))) == [(None,)] * 3
    assert both(spark, [(b"test", 2, 1)], "k binary, s long, o int", ex.format_key(F.col("k"), F.col("s"), F.col("o"))) == [('"test",2,TypeValue',)]


def test_checksums(spark):
    blocks = [b"", b"hello world", b"foo", bytes(range(256))]
    crc = ex.block_checksum(F.col("b"), 1)
    assert both(spark, [(b,) for b in blocks], "b binary", crc, ex.unmask_crc(crc)) == [(codec.mask(c), c) for c in (zlib.crc32(b + b"\x01") for b in blocks)]


def test_names_numbers_and_bounds(spark):
    names = [("000100.log", 100, "log"), ("0.ddb", 0, "table"), ("18446744073709551615.tmp", 2**64 - 1, "temp"), ("MANIFEST-7", 7, "manifest"), ("CURRENT", 0, "current"), ("LOCK", 0, "lock"), ("LOG", 0, "info"), ("LOG.old", 0, "info")]
    bad = ["", "foo", "100", "100.", "100.lop", "MANIFEST", "MANIFEST-", "MANIFEST-3x", "CURRENTx", "LOC", "18446744073709551616.log", "-1.log"]
    got = both(spark, [(n,) for n, *_ in names] + [(n,) for n in bad], "n string", ex.file_kind(F.col("n")))
    assert [g and (int(g["number"]), g["kind"]) for (g,) in got] == [(n, k) for _, n, k in names] + [None] * len(bad)
    digits = [("123abc", 123), ("", None), ("x1", None), ("0", 0), (str(2**64 - 1), 2**64 - 1), (str(2**64), None)]
    assert [n and int(n) or (0 if n is not None else None) for (n,) in both(spark, [(t,) for t, _ in digits], "t string", ex.decimal_prefix(F.col("t")))] == [n for _, n in digits]
    items = F.array(*map(F.lit, (10, 11, 13, 13, 15)))
    got = both(spark, [(t,) for t in (9, 10, 12, 13, 15, 16)], "t int", ex.lower_bound(items, F.col("t")), ex.upper_bound(items, F.col("t")), ex.clip(F.col("t"), 10, 13))
    assert got == [(0, 0, 10), (0, 1, 10), (2, 2, 12), (2, 4, 13), (4, 5, 13), (5, 5, 13)]


def test_clock(spark):
    import time

    (now,) = spark.range(1).select(ex.now_micros()).first()
    assert abs(now / 1e6 - time.time()) < 60


def test_relational_filters_are_the_codec_s(spark):
    keys = [f"key{i}".encode() for i in range(300)]
    bits = {(r["bits"], r["position"]) for r in bloom.build(spark.createDataFrame([(0, k) for k in keys], "grp long, key binary")).collect()}
    data = codec.Bloom(10).build(keys)
    assert {p for _, p in bits} == {i for i in range((len(data) - 1) * 8) if data[i >> 3] >> (i & 7) & 1}
    assert {n for n, _ in bits} == {(len(data) - 1) * 8}


def test_filter_blocks(spark):
    held = [(0, b"foo"), (2000, b"bar"), (3100, b"box"), (9000, b"box"), (9000, b"hello")]
    inner = lambda k: codec.internal_key(k, 5, 1)
    entries = spark.createDataFrame([(p, inner(k)) for p, k in held], "place long, internal_key binary")
    asked = [(p, inner(k)) for p in (0, 2000, 3100, 4100, 9000, 20_000) for k in (b"foo", b"bar", b"box", b"hello")]
    rows = bloom.block_may_hold(bloom.filter_blocks(entries, 20), spark.createDataFrame(asked, "place long, internal_key binary"), 20)
    found = {(r["place"], bytes(r["internal_key"])[:-8]) for r in rows.where("may_hold").collect()}
    first, beyond = {(p, k) for p in (0, 2000) for k in (b"foo", b"bar")}, {(20_000, k) for k in (b"foo", b"bar", b"box", b"hello")}
    assert found == first | {(3100, b"box"), (9000, b"box"), (9000, b"hello")} | beyond
    empty = bloom.filter_blocks(entries.limit(0))
    assert all(r["may_hold"] for r in bloom.block_may_hold(empty, spark.createDataFrame(asked, "place long, internal_key binary")).collect())


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_filter_rates(spark, n):
    held = spark.range(n).select(F.lit(0).cast("long").alias("grp"), F.col("id").cast("string").cast("binary").alias("key"))
    other = spark.range(2000).select(F.lit(0).cast("long").alias("grp"), F.concat(F.lit("x"), F.col("id")).cast("binary").alias("key"))
    filters = bloom.build(held)
    assert bloom.probe(filters, held).where("not may_hold").isEmpty()
    assert bloom.probe(filters, other).where("may_hold").count() < 40
    assert bloom.probe(filters, other.withColumn("grp", F.lit(9).cast("long"))).where("not may_hold").isEmpty()  # no filter, no answer
