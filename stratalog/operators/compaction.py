"""Garbage collection of versions and the cuts of compaction output."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..log import DELETE
from . import order
from .files import interval_join
from .read import newest

#: A run's output ends before it overlaps more than this many bytes of the level after next.
GRANDPARENT_FILES = 10


def retained(log: DataFrame, bound: int, deeper: DataFrame | None = None) -> DataFrame:
    """The rows that readers at `bound` and later can still see.

    A version goes if the next newer one of its key is at or before the bound: so what stays is every row beyond the
    bound and each key's newest row up to it, a filter and one aggregate, whatever number of versions a key has.  Of the
    latter, a tombstone goes as well, unless a file of deeper(lo, hi) spans its key (deeper None: nothing is deeper).
    """
    after = log.where(F.col("seq") > bound)
    last = newest(log, bound)
    if deeper is None:
        last = last.where(F.col("op") != DELETE)
    else:
        last = last.where((F.col("op") != DELETE)).unionByName(_spanned(last.where(F.col("op") == DELETE), deeper))
    return after.unionByName(last.select(*after.columns))


def _spanned(rows: DataFrame, files: DataFrame) -> DataFrame:
    """The rows whose key lies within a file."""
    asked = rows.select(F.col("k").alias("__lo"), F.col("k").alias("__hi"))
    keys = interval_join(asked, files.select(F.col("lo").alias("__a"), F.col("hi").alias("__z")), "__lo", "__hi", "__a", "__z").select(F.col("__lo").alias("k")).distinct()
    return rows.join(keys, "k", "left_semi")


def reasons(log: DataFrame, bound: int) -> DataFrame:
    """(reason, n): rows kept, hidden by a newer version, and obsolete tombstones, where nothing is deeper."""
    last = newest(log, bound)
    kept = log.where(F.col("seq") > bound).agg(F.count(F.lit(1)).alias("n"))
    dead = last.groupBy((F.col("op") == DELETE).alias("dead")).agg(F.count(F.lit(1)).alias("n"))
    total = log.where(F.col("seq") <= bound).agg(F.count(F.lit(1)).alias("n"))
    parts = kept.select(F.lit("kept").alias("reason"), "n")
    parts = parts.unionByName(dead.select(F.when(F.col("dead"), "tombstone").otherwise("kept").alias("reason"), "n"))
    parts = parts.unionByName(total.select(F.lit("hidden").alias("reason"), "n")).unionByName(dead.select(F.lit("hidden").alias("reason"), (-F.col("n")).alias("n")))
    return parts.groupBy("reason").agg(F.sum("n").alias("n"))


def cut_by_size(rows: DataFrame, most: int) -> DataFrame:
    """rows(run, position, bytes) with `block`: a block ends with the row that brings it to `most` bytes.  A cut resets the
    sum, which no window function can do, so each run is walked by one task in order."""

    def walk(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("position")
        block, size, out = 0, 0, []
        for n in run["bytes"]:
            out.append(block)
            size += n
            if size >= most:
                block, size = block + 1, 0
        return run.assign(block=out)[["run", "position", "block"]]

    return rows.groupBy("run").applyInPandas(walk, "run long, position long, block long")


def cut_by_grandparents(keys: DataFrame, files: DataFrame, most: int) -> DataFrame:
    """keys(run, k) in key order with `output`: a new output starts before the key that would bring the overlapped bytes
    of files(hi, size) beyond `most`.

    Only the keys at which a file ends can start an output, and they are one row a file: each key learns in parallel how
    many bytes of files end before it, and one task a run walks over the keys where that number changes.  The first key's
    own file isn't counted until the run has passed it.
    """
    ends = files.groupBy("hi").agg(F.sum("size").alias("size"))
    cuts = order.bounds(keys.select(F.col("k").alias("key")))
    both = keys.select("run", F.col("k").alias("key"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("last")).distinct()
    runs = keys.select("run").distinct()
    both = both.unionByName(runs.crossJoin(ends.select(F.col("hi").alias("key"), F.col("size").cast("long").alias("size"), F.lit(1).alias("last"))))  # a run overlaps the level's files
    both = both.withColumnRenamed("run", "grp").withColumn("__cell", order.cell_of(F.col("key"), cuts))
    passed = order.running_sum(both, ["key", "last"], "size", "passed").where(F.col("last") == 0)
    steps = passed.groupBy("grp", "passed").agg(F.min("key").alias("k"))

    def walk(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("k")
        since, output, out = run["passed"].iloc[0], 0, []
        for p in run["passed"]:
            if p - since > most:
                since, output = p, output + 1
            out.append(output)
        return run.assign(output=out)[["grp", "passed", "output"]]

    outputs = steps.groupBy("grp").applyInPandas(walk, "grp long, passed long, output long")
    return passed.join(outputs, ["grp", "passed"]).select(F.col("grp").alias("run"), F.col("key").alias("k"), "output")
