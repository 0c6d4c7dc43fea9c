"""Reads of the log: what is visible at a sequence number, and where a cursor would stand.

`view` is a DataFrame with unique k.  Numbers over the whole order are found in two steps, inside cells of keys and over
the cells, so that no single task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..log import DELETE, PUT
from . import order


def newest(log: DataFrame, seq: int | None = None) -> DataFrame:
    """The newest row of each key with a sequence number up to seq, tombstones too.  One shuffle, after partial maxima."""
    rows = log if seq is None else log.where(F.col("seq") <= seq)
    others = [c for c in log.columns if c not in ("k", "seq")]
    best = rows.groupBy("k").agg(F.max(F.struct("seq", *others)).alias("r"))
    return best.select("k", *[F.col(f"r.{c}").alias(c) for c in ("seq", *others)])


def visible(log: DataFrame, seq: int | None = None) -> DataFrame:
    """(k, seq, v): the newest row of each key, if it is a value.  The bound holds before the choice, the tombstone after."""
    return newest(log, seq).where(F.col("op") == PUT).drop("op")


def deleted(log: DataFrame, seq: int | None = None) -> DataFrame:
    return newest(log, seq).where(F.col("op") == DELETE).select("k", "seq")


def get(log: DataFrame, key, seq: int | None = None) -> DataFrame:
    """The value of one key, or no row: no shuffle, the newest row by a top-1."""
    rows = log.where(F.col("k") == F.lit(key))
    if seq is not None:
        rows = rows.where(F.col("seq") <= seq)
    return rows.orderBy(F.desc("seq")).limit(1).where(F.col("op") == PUT).drop("op")


def multi_get(view: DataFrame, keys: DataFrame) -> DataFrame:
    """view's rows of keys(k); absent keys have none."""
    return view.join(keys.select("k").distinct(), "k", "left_semi")


def seek(view: DataFrame, key) -> DataFrame:
    """The first row at or after key."""
    return view.where(F.col("k") >= F.lit(key)).orderBy("k").limit(1)


def seek_before(view: DataFrame, key) -> DataFrame:
    """The last row before key."""
    return view.where(F.col("k") < F.lit(key)).orderBy(F.desc("k")).limit(1)


def first(view: DataFrame) -> DataFrame:
    return view.orderBy("k").limit(1)


def last(view: DataFrame) -> DataFrame:
    return view.orderBy(F.desc("k")).limit(1)


def page(view: DataFrame, after, n: int, reverse: bool = False) -> DataFrame:
    """The next n rows beyond `after` (None: from the end): the cursor verbs next and prev, n times."""
    key = F.col("k")
    if after is not None:
        view = view.where(key < F.lit(after) if reverse else key > F.lit(after))
    return view.orderBy(key.desc() if reverse else key).limit(n)


def scan(view: DataFrame, lo=None, hi=None) -> DataFrame:
    """The rows with lo <= k < hi."""
    if lo is not None:
        view = view.where(F.col("k") >= F.lit(lo))
    return view if hi is None else view.where(F.col("k") < F.lit(hi))


def versions(log: DataFrame, key=None) -> DataFrame:
    """Every version, newest first in each key; a tombstone has no value."""
    rows = log if key is None else log.where(F.col("k") == F.lit(key))
    return rows.withColumn("v", F.when(F.col("op") == PUT, F.col("v")))


def ranked(view: DataFrame, reverse: bool = False, by: list[str] | None = None) -> DataFrame:
    """view with `position`, from 1 on in the order of k (and of further columns `by`): inside cells of neighbouring keys,
    plus the rows of the cells before."""
    rows = order.celled(view, "k")
    by = by or []
    return order.numbered(rows, [*order.ordered(["k"], reverse), *order.ordered(by, not reverse)], reverse).drop("__cell")


def internal_order(log: DataFrame) -> DataFrame:
    """Every version with its `position`: keys ascending, in each key the newest first."""
    return ranked(versions(log), by=["seq"])


def listing(log: DataFrame) -> DataFrame:
    """(k, entries): the versions of each key, newest first, as `[ v2, DEL, v1 ]`.  A key's text is one value, so this is
    for looking at keys whose versions fit one; `versions` has them as rows."""
    entry = F.when(F.col("op") == DELETE, "DEL").otherwise(F.col("v").cast("string"))
    rows = log.groupBy("k").agg(F.array_sort(F.collect_list(F.struct((-F.col("seq")).alias("s"), entry.alias("e")))).alias("es"))
    return rows.select("k", F.concat(F.lit("[ "), F.array_join("es.e", ", "), F.lit(" ]")).alias("entries"))


def valid(view: DataFrame) -> bool:
    """Whether a cursor on the view stands on an entry."""
    return not view.isEmpty()


def neighbours(view: DataFrame) -> DataFrame:
    """view with prev_k and next_k: inside cells of keys, and at a cell's ends from the neighbouring cells' ends."""
    rows = order.celled(view, "k")
    ends = rows.groupBy("__cell").agg(F.min("k").alias("__lo"), F.max("k").alias("__hi"))
    over = Window.orderBy("__cell")  # a row a cell
    ends = ends.select(F.col("__cell").alias("__c"), F.lag("__hi").over(over).alias("__p"), F.lead("__lo").over(over).alias("__q"))
    inside = Window.partitionBy("__cell").orderBy("k")
    rows = rows.withColumn("prev_k", F.lag("k").over(inside)).withColumn("next_k", F.lead("k").over(inside)).join(ends, F.col("__cell") == F.col("__c"))
    return rows.withColumn("prev_k", F.coalesce("prev_k", "__p")).withColumn("next_k", F.coalesce("next_k", "__q")).drop("__cell", "__c", "__p", "__q")
