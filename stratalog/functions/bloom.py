"""Bloom filters as relations: a filter is its set of bits, a probe a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codec import Bloom
from .expressions import bloom_positions, user_key

#: Bytes of data that share a filter of a file.
WINDOW_BYTES = 2048


def build(keys: DataFrame, bits_per_key: int = 10) -> DataFrame:
    """keys(grp, key) as bits(grp, bits, position): a filter for each group."""
    sizes = keys.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).select("grp", (F.ceil(F.greatest(F.col("n") * bits_per_key, F.lit(64)) / 8) * 8).cast("long").alias("bits"))
    rows = keys.join(sizes, "grp")
    return rows.select("grp", "bits", F.explode(bloom_positions(F.col("key"), F.col("bits"), Bloom(bits_per_key).probes)).alias("position")).distinct()


def probe(bits: DataFrame, keys: DataFrame, bits_per_key: int = 10) -> DataFrame:
    """keys(grp, key) with may_hold.  A group without a filter may hold anything."""
    sizes = bits.groupBy("grp").agg(F.first("bits").alias("bits"))
    rows = keys.distinct().join(sizes, "grp", "left")
    asked = rows.where(F.col("bits").isNotNull()).select("grp", "key", F.explode(F.array_distinct(bloom_positions(F.col("key"), F.col("bits"), Bloom(bits_per_key).probes))).alias("position"))
    found = asked.join(bits.select("grp", "position").withColumn("hit", F.lit(1)), ["grp", "position"], "left")
    full = found.groupBy("grp", "key").agg((F.count("hit") == F.count(F.lit(1))).alias("may_hold"))
    return rows.select("grp", "key").join(full, ["grp", "key"], "left").withColumn("may_hold", F.coalesce("may_hold", F.lit(True)))


def window_of(offset: Column) -> Column:
    """The filter that covers a block which begins at a place in its file."""
    return F.floor(offset / WINDOW_BYTES).cast("long")


def filter_blocks(entries: DataFrame, bits_per_key: int = 10) -> DataFrame:
    """A filter for each window of a file's entries(place, internal_key), place being where the entry's block begins.  A
    filter knows user keys: the versions of a key are one."""
    return build(entries.select(window_of(F.col("place")).alias("grp"), user_key(F.col("internal_key")).alias("key")).distinct(), bits_per_key)


def block_may_hold(filters: DataFrame, asked: DataFrame, bits_per_key: int = 10) -> DataFrame:
    """asked(place, internal_key) with may_hold: whether the block that begins at place may hold the key.

    A window up to the last one that has a filter but has none of its own is empty and holds nothing; a place beyond is
    unknown to the filters and may hold anything.
    """
    rows = asked.select("place", "internal_key", window_of(F.col("place")).alias("grp"), user_key(F.col("internal_key")).alias("key"))
    found = probe(filters, rows.select("grp", "key").distinct(), bits_per_key).withColumnRenamed("may_hold", "__may")
    last = filters.agg(F.coalesce(F.max("grp"), F.lit(-1)).alias("__last"))
    known = filters.select("grp").distinct().withColumn("__known", F.lit(True))
    rows = rows.join(found, ["grp", "key"]).join(known, "grp", "left").crossJoin(last)  # one row
    may = F.when(F.col("grp") > F.col("__last"), True).otherwise(F.col("__may") & F.coalesce("__known", F.lit(False)))
    return rows.select("place", "internal_key", may.alias("may_hold"))
