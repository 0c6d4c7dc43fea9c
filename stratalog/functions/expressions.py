"""Scalar functions of the store as Spark expressions, and those that need a loop as pandas functions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import codec

_U32 = 1 << 32


def pack_tag(seq: Column, op: Column) -> Column:
    return F.shiftleft(seq.cast("long"), 8).bitwiseOR(op.cast("long"))


def _turned(hex16: Column) -> Column:
    """Hex digits of 8 bytes in the opposite order."""
    return F.concat(*[F.substring(hex16, 2 * i + 1, 2) for i in reversed(range(8))])


def fixed64(n: Column) -> Column:
    """8 bytes, lowest first."""
    return F.unhex(_turned(F.lpad(F.hex(n.cast("long")), 16, "0")))


def read_fixed64(data: Column) -> Column:
    """The number in 8 bytes; numbers of 2 ** 63 and more don't fit."""
    return F.conv(_turned(F.hex(data)), 16, 10).cast("long")


def fixed32(n: Column) -> Column:
    return F.unhex(F.concat(*[F.substring(F.lpad(F.hex(n.cast("long")), 8, "0"), 2 * i + 1, 2) for i in reversed(range(4))]))


def internal_key(key: Column, seq: Column, op: Column) -> Column:
    """The key with its tag: newer versions of a key have greater tags."""
    return F.concat(key.cast("binary"), fixed64(pack_tag(seq, op)))


def user_key(data: Column) -> Column:
    return F.substring(data, F.lit(1), F.octet_length(data) - 8)


def parse_internal_key(data: Column) -> Column:
    """struct(k, seq, op), null for what is no internal key."""
    tag = read_fixed64(F.substring(data, F.octet_length(data) - 7, F.lit(8)))
    op = tag.bitwiseAND(F.lit(255))
    whole = F.struct(user_key(data).alias("k"), F.shiftright(tag, 8).alias("seq"), op.cast("int").alias("op"))
    return F.when((F.octet_length(data) >= 8) & (op <= 1), whole)


def format_key(key: Column, seq: Column, op: Column) -> Column:
    return F.format_string('"%s",%s,%s', key.cast("string"), seq.cast("string"), F.when(op == 1, "TypeValue").otherwise("TypeDeletion"))


def mask_crc(crc: Column) -> Column:
    """A checksum, turned by 15 bits and moved, so that checksums of data with checksums inside stay good."""
    turned = F.shiftright(crc, 15).bitwiseOR(F.pmod(F.shiftleft(crc, 17), F.lit(_U32)))
    return F.pmod(turned + 0xA282EAD8, F.lit(_U32))


def unmask_crc(masked: Column) -> Column:
    turned = F.pmod(masked - 0xA282EAD8, F.lit(_U32))
    return F.pmod(F.shiftright(turned, 17).bitwiseOR(F.shiftleft(turned, 15)), F.lit(_U32))


def block_checksum(block: Column, kind: int) -> Column:
    return mask_crc(F.crc32(F.concat(block, F.lit(bytes([kind])))))


def shared_prefix(a: Column, b: Column) -> Column:
    """Bytes that two binary keys have in common at their beginnings."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    x, y = F.hex(a), F.hex(b)
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(x, 2 * i - 1, F.lit(2)) != F.substring(y, 2 * i - 1, F.lit(2)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, n))


def decimal_prefix(text: Column) -> Column:
    """The number that a text begins with; null without a digit, or beyond 64 bits."""
    n = F.regexp_extract(text, "^[0-9]+", 0).try_cast("decimal(38,0)")
    return F.when(n < F.lit(str(1 << 64)).cast("decimal(38,0)"), n)


def file_kind(name: Column) -> Column:
    """struct(number, kind) of a file name of a store, null for any other name."""
    number = decimal_prefix(F.regexp_extract(name, "^(?:MANIFEST-)?([0-9]+)(?:\\.(?:log|ddb|tmp))?$", 1))
    kinds = {"^[0-9]+\\.log$": "log", "^[0-9]+\\.ddb$": "table", "^[0-9]+\\.tmp$": "temp", "^MANIFEST-[0-9]+$": "manifest"}
    kind = reduce(lambda c, k: F.when(name.rlike(k[0]), k[1]).otherwise(c), kinds.items(), F.lit(None).cast("string"))
    kind = F.when(name == "CURRENT", "current").when(name == "LOCK", "lock").when(name.isin("LOG", "LOG.old"), "info").otherwise(kind)
    number = F.when(kind.isin("current", "lock", "info"), F.lit(0)).otherwise(number)
    return F.when(kind.isNotNull() & number.isNotNull(), F.struct(number.cast("decimal(20,0)").alias("number"), kind.alias("kind")))


def clip(n: Column, lo, hi) -> Column:
    return F.least(F.greatest(n, F.lit(lo)), F.lit(hi))


def lower_bound(items: Column, target: Column) -> Column:
    """Place of the first item of a sorted array that isn't less than target."""
    return F.size(F.filter(items, lambda x: x < target))


def upper_bound(items: Column, target: Column) -> Column:
    return F.size(F.filter(items, lambda x: x <= target))


def _hex2(n: Column) -> Column:
    return F.lpad(F.hex(n.cast("long")), 2, "0")


def varint(n: Column) -> Column:
    """Seven bits a byte, lowest first, the high bit saying that more follow; null for a negative number."""
    n = n.cast("long")
    part = lambda i: F.shiftright(n, 7 * i)
    digits = [F.when((part(i) > 0) | F.lit(i == 0), _hex2(part(i).bitwiseAND(F.lit(127)) + F.when(part(i + 1) > 0, 128).otherwise(0))).otherwise("") for i in range(9)]
    return F.when(n >= 0, F.unhex(F.concat(*digits)))


def read_varint(data: Column) -> Column:
    """struct(number, length) of the varint that data begins with; null where it is cut short or beyond 63 bits."""
    h = F.hex(data)
    code = F.regexp_extract(h, "^(?:[89A-F].){0,8}[0-7].", 0)
    length = F.length(code) / 2
    byte = lambda i: F.conv(F.substring(code, 2 * i + 1, 2), 16, 10).cast("long").bitwiseAND(F.lit(127))
    number = reduce(lambda acc, i: acc + F.when(length > i, F.shiftleft(byte(i), 7 * i)).otherwise(0), range(9), F.lit(0).cast("long"))
    return F.when(code != "", F.struct(number.alias("number"), length.cast("int").alias("length")))


def _byte(data: Column, at: Column) -> Column:
    """The byte at a place from 0 on, as a number."""
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int")


def separator(start: Column, limit: Column) -> Column:
    """A short key in [start, limit); start itself where none is shorter."""
    start, limit = start.cast("binary"), limit.cast("binary")
    same = shared_prefix(start, limit)
    a, b = _byte(start, same), _byte(limit, same)
    short = F.concat(F.substring(start, F.lit(1), same), F.unhex(_hex2(a + 1)))
    return F.when((same < F.least(F.octet_length(start), F.octet_length(limit))) & (a + 1 < b), short).otherwise(F.when(limit.isNotNull(), start))


def successor(key: Column) -> Column:
    """A short key at or after key: its first byte below 255, one more, with what is before; key itself if there is none."""
    key = key.cast("binary")
    full = F.length(F.regexp_extract(F.hex(key), "^(?:FF)*", 0)) / 2
    short = F.concat(F.substring(key, F.lit(1), full.cast("int")), F.unhex(_hex2(_byte(key, full.cast("int")) + 1)))
    return F.when(full < F.octet_length(key), short).otherwise(key)


_MAX_TAG = bytes([1, *[255] * 7])


def internal_separator(start: Column, limit: Column) -> Column:
    """A short internal key between two: the separator of the user keys with the greatest tag, if it is shorter and
    greater than start's user key, else start."""
    mine = user_key(start)
    short = separator(mine, user_key(limit))
    return F.when((F.octet_length(short) < F.octet_length(mine)) & (mine < short), F.concat(short, F.lit(_MAX_TAG))).otherwise(start)


def internal_successor(key: Column) -> Column:
    mine = user_key(key)
    short = successor(mine)
    return F.when((F.octet_length(short) < F.octet_length(mine)) & (mine < short), F.concat(short, F.lit(_MAX_TAG))).otherwise(key)


def now_micros() -> Column:
    """The wall clock in microseconds."""
    return F.unix_micros(F.current_timestamp())


def hashes32(keys: list[bytes], seeds: np.ndarray) -> np.ndarray:
    """codec.hash32 of many keys at once: word i of all keys that have one, then the rests."""
    m, u32 = np.uint64(0xC6A4A793), np.uint64(0xFFFFFFFF)
    n = np.array([len(k) for k in keys], np.int64)
    width = int(n.max(initial=0)) + 4 >> 2 << 2
    data = np.frombuffer(b"".join(k.ljust(width, b"\0") for k in keys), "<u4").reshape(len(keys), -1).astype(np.uint64)
    h = seeds.astype(np.uint64) ^ (n.astype(np.uint64) * m & u32)
    for i in range(data.shape[1]):
        more = n >= 4 * i + 4
        if not more.any():
            break
        step = (h + data[:, i] & u32) * m & u32
        h = np.where(more, step ^ (step >> np.uint64(16)), h)
    rest = n % 4 > 0
    last = (h + data[np.arange(len(keys)), np.minimum(n // 4, data.shape[1] - 1)] & u32) * m & u32
    return np.where(rest, last ^ (last >> np.uint64(24)), h)


@F.pandas_udf(T.LongType())
def hash32(data: pd.Series, seed: pd.Series) -> pd.Series:
    """codec.hash32, a batch at a time; null for a null key."""
    there = data.notna() & seed.notna()
    out = pd.Series([None] * len(data), dtype="Int64")
    if there.any():
        out[there.to_numpy()] = hashes32([bytes(d) for d in data[there]], seed[there].to_numpy(np.int64)).astype(np.int64)
    return out


def bloom_positions(key: Column, bits: Column, probes: int = 6) -> Column:
    """The bits that a key sets in a filter of so many bits: its hash, and steps of the hash turned by 15 bits."""
    h = hash32(key, F.lit(codec.BLOOM_SEED))
    step = F.shiftright(h, 17).bitwiseOR(F.pmod(F.shiftleft(h, 15), F.lit(_U32)))
    return F.array(*[F.pmod(F.pmod(h + step * i, F.lit(_U32)), bits.cast("long")).cast("int") for i in range(probes)])
