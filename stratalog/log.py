"""The canonical change log: one row a write, (k, seq, op, v), and the tables it is derived from.

op 1 stores v under k, op 0 deletes k; seq is unique and grows with every write.  Bounds are put on the raw columns of
the files, so that they reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUT, DELETE = 1, 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, seq: int | None = None, above: int | None = None) -> DataFrame:
    """The events as a log by user; an error deletes.  seq: newest sequence number, above: sequence numbers beyond it only."""
    rows = table(spark, sf_dir, "events")
    if seq is not None:
        rows = rows.where(F.col("event_id") <= seq - 1)
    if above is not None:
        rows = rows.where(F.col("event_id") > above - 1)
    op = F.when(F.col("event_type") == "error", DELETE).otherwise(PUT)
    return rows.select(F.col("user_id").alias("k"), (F.col("event_id") + 1).alias("seq"), op.alias("op"), F.col("value").alias("v"))


def orders(spark: SparkSession, sf_dir: str, seq: int | None = None) -> DataFrame:
    """The orders as a log by customer; status F deletes."""
    rows = table(spark, sf_dir, "orders")
    if seq is not None:
        rows = rows.where(F.col("o_orderkey") <= seq - 1)
    op = F.when(F.col("o_orderstatus") == "F", DELETE).otherwise(PUT)
    return rows.select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") + 1).alias("seq"), op.alias("op"), F.col("o_totalprice").alias("v"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of a store's files that hold the orders: level, file_no, k, seq, bytes.

    The last digit of the order picks the level.  Level 0 has a file for each 500 orders, which overlap; deeper levels
    have a file for each range of customers, which don't.
    """
    digit = F.col("o_orderkey") % 10
    level = F.when(digit == 0, 0).when(digit < 3, 1).when(digit < 6, 2).otherwise(3)
    run = F.when(digit == 0, F.floor(F.col("o_orderkey") / 500)).when(digit < 3, F.floor(F.col("o_custkey") / 200)).when(digit < 6, F.floor(F.col("o_custkey") / 100)).otherwise(F.floor(F.col("o_custkey") / 50))
    rows = table(spark, sf_dir, "orders").select(level.alias("level"), run.alias("run"), F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"))
    return rows.select("level", (F.col("level") * 1_000_000 + F.col("run")).cast("long").alias("file_no"), "k", "seq", (60_000 + F.col("seq") % 40 * 250).cast("long").alias("bytes"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File metadata of that store: level, file_no, size, lo, hi."""
    return entries(spark, sf_dir).groupBy("level", "file_no").agg(F.sum("bytes").alias("size"), F.min("k").alias("lo"), F.max("k").alias("hi"))
