"""Whole orders without a whole sort in one task.

Rows go to cells of neighbouring keys.  The cells' bounds are quantiles of a sample of the keys, so any type that has an
order will do, and cells are about equally full wherever the keys lie.  Windows run inside cells; what must pass from one
cell to the next is one row a cell.  A sample that isn't typical makes cells uneven, never a result wrong.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of the sample, which the driver holds, and cells at most.
SAMPLE, CELLS = 4096, 256


def bounds(keys: DataFrame, cells: int | None = None) -> list:
    """Ascending bounds between cells of keys(key): quantiles of the SAMPLE different keys with the least hashes."""
    if cells is None:
        cells = min(CELLS, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = keys.where(F.col("key").isNotNull()).select("key", F.xxhash64("key").alias("h")).orderBy("h").limit(SAMPLE)
    found = sorted({bytes(r["key"]) if isinstance(r["key"], bytearray) else r["key"] for r in rows.collect()})
    return sorted({found[len(found) * i // cells] for i in range(1, cells)}) if found else []


def cell_of(key: Column, cuts: list) -> Column:
    """The number of bounds at or before key: a search by halves, in generated code."""
    if not cuts:
        return F.lit(0)
    middle = len(cuts) // 2
    return F.when(key < F.lit(cuts[middle]), cell_of(key, cuts[:middle])).otherwise(cell_of(key, cuts[middle + 1 :]) + (middle + 1))


def celled(rows: DataFrame, key: str, cells: int | None = None) -> DataFrame:
    """rows with `__cell`, ascending with key."""
    return rows.withColumn("__cell", cell_of(F.col(key), bounds(rows.select(F.col(key).alias("key")), cells)))


def ordered(columns: list[str], reverse: bool) -> list[Column]:
    return [F.desc(c) if reverse else F.asc(c) for c in columns]


def numbered(rows: DataFrame, by: list[Column], reverse: bool = False) -> DataFrame:
    """rows(__cell, ...) with `position`, from 1 on in the order `by` inside cells, and of the cells."""
    counts = rows.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(*ordered(["__cell"], reverse)).rowsBetween(Window.unboundedPreceding, -1)  # a row a cell
    counts = counts.select(F.col("__cell").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__cell").orderBy(*by))
    rows = rows.withColumn("__in", inside).join(counts, F.col("__cell") == F.col("__c"))
    return rows.withColumn("position", F.col("__before") + F.col("__in")).drop("__in", "__c", "__before")


def next_mark(targets: DataFrame, marks: DataFrame, cells: int | None = None) -> DataFrame:
    """targets(t, ...) with `mark`, the least value of marks(key, mark), in the order of (key, mark), whose key is at or after t;
    null beyond the last.  A union and windows inside cells, no join of inequalities."""
    cuts = bounds(marks.select("key").unionByName(targets.select(F.col("t").alias("key"))), cells)
    mine = targets.withColumn("__key", F.col("t")).withColumn("__mark", F.lit(None).cast(marks.schema["mark"].dataType))
    theirs = marks.select(F.col("key").alias("__key"), F.col("mark").alias("__mark"))
    rows = mine.withColumn("__target", F.lit(True)).unionByName(theirs.withColumn("__target", F.lit(False)), allowMissingColumns=True).withColumn("__cell", cell_of(F.col("__key"), cuts))
    after = Window.partitionBy("__cell").orderBy("__key", F.desc("__target"), "__mark").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("__found", F.first("__mark", ignorenulls=True).over(after))
    firsts = rows.groupBy("__cell").agg(F.min(F.when(~F.col("__target"), F.struct("__key", "__mark")))["__mark"].alias("__first"))
    later = F.first("__first", ignorenulls=True).over(Window.orderBy("__cell").rowsBetween(1, Window.unboundedFollowing))  # a row a cell
    firsts = firsts.select(F.col("__cell").alias("__c"), later.alias("__later"))
    rows = rows.where("__target").join(firsts, F.col("__cell") == F.col("__c"))
    return rows.select(*targets.columns, F.coalesce("__found", "__later").alias("mark"))


def running_max(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """rows(grp, __cell, ...) with the greatest `value` of the rows before, in the order `by`, in their group."""
    inside = F.max(value).over(Window.partitionBy("grp", "__cell").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    cells = rows.groupBy("grp", "__cell").agg(F.max(value).alias("__m"))
    before = F.max("__m").over(Window.partitionBy("grp").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(F.col("grp").alias("__g"), F.col("__cell").alias("__c"), before.alias("__m"))
    out = rows.withColumn("__in", inside).join(cells, F.col("grp").eqNullSafe(F.col("__g")) & (F.col("__cell") == F.col("__c")))
    return out.withColumn(name, F.greatest("__in", "__m")).drop("__in", "__g", "__c", "__m")


def running_sum(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """rows(grp, __cell, ...) with the sum of `value` up to each row, in the order `by`, in their group."""
    inside = F.sum(value).over(Window.partitionBy("grp", "__cell").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    cells = rows.groupBy("grp", "__cell").agg(F.sum(value).alias("__m"))
    before = F.sum("__m").over(Window.partitionBy("grp").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(F.col("grp").alias("__g"), F.col("__cell").alias("__c"), F.coalesce(before, F.lit(0)).alias("__m"))
    out = rows.withColumn("__in", inside).join(cells, F.col("grp").eqNullSafe(F.col("__g")) & (F.col("__cell") == F.col("__c")))
    return out.withColumn(name, F.col("__in") + F.col("__m")).drop("__in", "__g", "__c", "__m")


def merged(sources: list[DataFrame], schema: str, spark) -> DataFrame:
    """The rows of all sources: none gives an empty table, one is passed on as it is."""
    if not sources:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, sources)
