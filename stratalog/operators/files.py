"""Queries over file metadata: files(level, file_no, size, lo, hi), with inclusive bounds of any ordered type.

Interval joins are equi-joins on cells of keys (order.py): either side goes to the cells it touches, and a pair counts in
the cell that holds the later of the two beginnings, so that no pair shows twice and none needs a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order

#: Files that start a compaction of level 0, and the byte budget of level 1.
L0_FILES, L1_BYTES = 4, 10 << 20
LEVELS = 7
#: Bytes that a seek costs as much as, and the fewest seeks that a file is allowed before it asks for a compaction.
SEEK_BYTES, LEAST_SEEKS = 16 << 10, 100
#: Files of a level that one key of the join of overlapping files holds.
BLOCK = 128


def _spread(rows: DataFrame, lo: str, hi: str, cuts: list, name: str) -> DataFrame:
    return rows.withColumn(name, F.explode(F.sequence(order.cell_of(F.col(lo), cuts), order.cell_of(F.col(hi), cuts))))


def interval_join(left: DataFrame, right: DataFrame, l_lo: str, l_hi: str, r_lo: str, r_hi: str, also: Column | None = None) -> DataFrame:
    """All pairs of rows whose intervals meet; the two sides' columns must differ.  An interval whose end is before its
    beginning meets nothing."""
    left, right = left.where(F.col(l_lo) <= F.col(l_hi)), right.where(F.col(r_lo) <= F.col(r_hi))
    cuts = order.bounds(left.select(F.col(l_lo).alias("key")).unionByName(right.select(F.col(r_lo).alias("key"))))
    a, b = _spread(left, l_lo, l_hi, cuts, "__cell"), _spread(right, r_lo, r_hi, cuts, "__cell_r")
    on = (F.col("__cell") == F.col("__cell_r")) & (F.col(l_lo) <= F.col(r_hi)) & (F.col(r_lo) <= F.col(l_hi))
    on &= F.col("__cell") == order.cell_of(F.greatest(l_lo, r_lo), cuts)
    return a.join(b, on if also is None else on & also).drop("__cell", "__cell_r")


def prefixed(files: DataFrame, prefix: str) -> DataFrame:
    return files.select(*[F.col(c).alias(f"{prefix}_{c}") for c in files.columns])


def _ends(files: DataFrame) -> DataFrame:
    """files with a row for either end: `__key`, and `__side`, 0 of lo and 2 of hi.  An interval whose end is before its
    beginning has none."""
    end = lambda c, side: F.struct(F.col(c).alias("__key"), F.lit(side).alias("__side"))
    return files.where(F.col("lo") <= F.col("hi")).select("*", F.inline(F.array(end("lo", 0), end("hi", 2))))


def overlaps(files: DataFrame) -> DataFrame:
    """Pairs a_file_no < b_file_no of files of one level that overlap.

    Files are numbered by (lo, file_no) in their level.  Those that a file meets from there on are the next ones, up to the
    last that begins at or before its end, so each pair is found once, from the earlier of the two.  A file goes to the
    blocks of BLOCK numbers that this range touches, whatever the keys: the work grows with the pairs, not with the files'
    lengths, and many files that share keys still make many blocks.
    """
    rows = order.celled(_ends(files).withColumn("grp", F.col("level")), "__key").withColumn("__begins", F.when(F.col("__side") == 0, 1).otherwise(0))
    rows = order.running_sum(rows, ["__key", "__side", "file_no"], "__begins", "__upto")
    own = ["level", "file_no", "lo", "hi"]
    rows = rows.groupBy(*own).agg(F.min("__upto").alias("__at"), F.max("__upto").alias("__last"), *[F.first(c).alias(c) for c in files.columns if c not in own])
    block = lambda c: F.floor(c / BLOCK)
    x = rows.where(F.col("__last") > F.col("__at")).withColumn("__block", F.explode(F.sequence(block(F.col("__at") + 1), block(F.col("__last")))))
    x = prefixed(x, "x").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x_level", "x___block")  # few bytes make many pairs
    y = prefixed(rows.withColumn("__block", block(F.col("__at"))), "y")
    on = (F.col("x_level") == F.col("y_level")) & (F.col("x___block") == F.col("y___block")) & (F.col("y___at") > F.col("x___at")) & (F.col("y___at") <= F.col("x___last"))
    older = F.col("x_file_no") < F.col("y_file_no")
    sides = [F.when(older, F.col(f"{p}_{c}")).otherwise(F.col(f"{q}_{c}")).alias(f"{name}_{c}") for name, p, q in (("a", "x", "y"), ("b", "y", "x")) for c in files.columns]
    return x.join(y, on & (F.col("x_file_no") != F.col("y_file_no"))).select(*sides)


def has_overlap(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges(range_id, level, lo, hi), null bounds being open, with `overlaps`: whether a file of the level meets the
    range.  Open bounds become the ends of all files."""
    ends = files.agg(F.min("lo").alias("__a"), F.max("hi").alias("__z"))
    asked = ranges.crossJoin(ends).select("range_id", F.col("level").alias("__level"), F.coalesce("lo", "__a").alias("__lo"), F.coalesce("hi", "__z").alias("__hi"))  # one row
    met = interval_join(asked, files, "__lo", "__hi", "lo", "hi", F.col("__level") == F.col("level")).select("range_id").distinct().withColumn("overlaps", F.lit(True))
    return ranges.join(met, "range_id", "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(False)))


def files_for_keys(files: DataFrame, keys: DataFrame, most: int | None = None) -> DataFrame:
    """keys(key) with the files that may hold each, and `probe`, the order in which a lookup tries them: level 0 from the
    newest file on, then the one file of each deeper level.  most: probes at most."""
    asked = keys.select(F.col("key"), F.col("key").alias("__k"))
    rows = interval_join(asked, files, "key", "__k", "lo", "hi").drop("__k")
    probe = Window.partitionBy("key").orderBy("level", F.desc("file_no"))
    rows = rows.withColumn("probe", F.row_number().over(probe))
    return rows if most is None else rows.where(F.col("probe") <= most)


def _tried(files: DataFrame, asked: DataFrame, nodes: Column) -> DataFrame:
    """asked, all columns being keys, with `__n`, how many files(level, file_no, __node) are at one of its nodes, and `__first`,
    the first of them that a lookup tries."""
    first = F.struct("level", (-F.col("file_no")).alias("__late"))
    held = files.groupBy("__node").agg(F.count(F.lit(1)).alias("__n"), F.min(first).alias("__first"))
    return asked.withColumn("__node", F.explode(nodes)).join(held, "__node").groupBy(*asked.columns).agg(F.sum("__n").alias("__n"), F.min("__first").alias("__first"))


def charged(files: DataFrame, lookups: DataFrame) -> DataFrame:
    """files with `allowed_seeks` and `charges`: a lookup(key) that has to try two files charges the first of them.  A file
    whose charges reach its allowance asks for a compaction.

    Keys between two neighbouring ends of files are in the same files: the ends cut the keys into numbered stretches, and a
    file is a range of them.  Each range is the union of a few nodes, a node (height, n) being the 2^height stretches from
    n * 2^height on, and a stretch is below one node of each height: so files and keys meet in the nodes, a number of
    times that grows with the logarithm of the number of files, however many files hold a key.
    """
    times = lookups.where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("__times"))
    none = lambda c: F.lit(None).cast(files.schema[c].dataType).alias(c)
    ends = _ends(files).select("level", "file_no", "__key", "__side", F.lit(0).cast("long").alias("__times"), F.lit(1).alias("__end"))
    rows = ends.unionByName(times.select(none("level"), none("file_no"), F.col("key").alias("__key"), F.lit(1).alias("__side"), "__times", F.lit(0).alias("__end")))
    rows = order.running_sum(order.celled(rows.withColumn("grp", F.lit(1)), "__key"), ["__key", "__side"], "__end", "__upto")
    spans = rows.where(F.col("__end") == 1).groupBy("level", "file_no").agg(F.min("__upto").alias("__from"), F.max("__upto").alias("__to"))  # stretches from __from on, before __to
    heights = lambda c: F.sequence(F.lit(0), F.length(F.bin(c)) - 1)
    spans = spans.withColumn("__height", F.explode(heights("__to")))
    spans = spans.withColumn("__l", F.expr("shiftright(__from + shiftleft(1L, __height) - 1, __height)")).withColumn("__r", F.expr("shiftright(__to, __height)")).where(F.col("__l") < F.col("__r"))
    left, right = F.when(F.col("__l") % 2 == 1, F.col("__l")), F.when(F.col("__r") % 2 == 1, F.col("__r") - 1)
    node = lambda n: F.struct(F.col("__height").alias("height"), n.alias("n"))
    spans = spans.select("level", "file_no", F.explode(F.array_compact(F.array(F.when(left.isNotNull(), node(left)), F.when(right.isNotNull(), node(right))))).alias("__node"))
    asked = rows.where((F.col("__end") == 0) & (F.col("__upto") > 0)).groupBy(F.col("__upto").alias("__stretch")).agg(F.sum("__times").alias("__times"))
    above = F.transform(heights("__stretch"), lambda h: F.struct(h.alias("height"), F.call_function("shiftright", F.col("__stretch"), h).alias("n")))
    two = _tried(spans, asked, above).where(F.col("__n") > 1)
    charges = two.groupBy(F.col("__first.level").alias("level"), (-F.col("__first.__late")).alias("file_no")).agg(F.sum("__times").alias("charges"))
    allowed = F.greatest(F.floor(F.col("size") / SEEK_BYTES), F.lit(LEAST_SEEKS))
    return files.join(charges, ["level", "file_no"], "left").withColumn("charges", F.coalesce("charges", F.lit(0))).withColumn("allowed_seeks", allowed)


def find_file(files: DataFrame, targets: DataFrame) -> DataFrame:
    """targets(t) with the first file of a sorted level whose hi is at or after t; none if there is none."""
    found = order.next_mark(targets, files.select(F.col("hi").alias("key"), F.col("file_no").alias("mark")))
    return found.where(F.col("mark").isNotNull()).withColumnRenamed("mark", "file_no")


def next_level_overlap(files: DataFrame) -> DataFrame:
    """Bytes of the next level that each file overlaps."""
    pairs = interval_join(prefixed(files, "a"), prefixed(files, "b"), "a_lo", "a_hi", "b_lo", "b_hi", F.col("b_level") == F.col("a_level") + 1)
    return pairs.groupBy("a_level", "a_file_no").agg(F.sum("b_size").alias("overlap_bytes"))


def most_overlap(files: DataFrame) -> DataFrame:
    """One row `overlap_bytes`: the most of the next level that a file of level 1 and deeper overlaps."""
    rows = next_level_overlap(files.where(F.col("level") >= 1))
    return rows.agg(F.coalesce(F.max("overlap_bytes"), F.lit(0)).cast("long").alias("overlap_bytes"))


def islands(files: DataFrame) -> DataFrame:
    """Files with `island`: in each level, the sets of files that grow together to a fixed point."""
    by = ["lo", "file_no"]
    rows = order.celled(files.withColumn("grp", F.col("level")), "lo")
    rows = order.running_max(rows, by, "hi", "__reach")
    rows = rows.withColumn("__new", F.when(F.col("__reach").isNull() | (F.col("lo") > F.col("__reach")), 1).otherwise(0))
    return order.running_sum(rows, by, "__new", "island").drop("grp", "__cell", "__reach", "__new")


def ranges(files: DataFrame) -> DataFrame:
    """(level, lo, hi): the keys that each level spans."""
    return files.groupBy("level").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def overlapping(files: DataFrame, level: int, lo, hi) -> DataFrame:
    """The files of a level that meet [lo, hi] (None: open).  At level 0 the range grows to a fixed point."""
    meets = lambda a, b: (F.lit(True) if hi is None else F.col(a) <= F.lit(hi)) & (F.lit(True) if lo is None else F.col(b) >= F.lit(lo))
    files = files.where(F.col("level") == level)
    if level:
        return files.where(meets("lo", "hi"))
    marked = islands(files)
    touched = marked.where(meets("lo", "hi")).select("island").distinct()
    return marked.join(touched, "island", "left_semi").drop("island")


def level_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def budget(level: Column) -> Column:
    return L1_BYTES * F.pow(F.lit(10.0), F.greatest(level - 1, F.lit(0)))


def scores(files: DataFrame) -> DataFrame:
    """Of each level but the last: how full it is; 1 and more asks for a compaction."""
    full = F.when(F.col("level") == 0, F.col("files") / F.lit(float(L0_FILES))).otherwise(F.col("bytes") / budget(F.col("level")))
    return level_totals(files).where(F.col("level") < LEVELS - 1).select("level", full.alias("score"))


def pick(files: DataFrame) -> DataFrame:
    """The level of the highest score, the first of equals."""
    best = F.max_by(F.struct("level", "score"), F.struct("score", -F.col("level"))).alias("r")
    return scores(files).agg(best).select("r.level", "r.score").where(F.col("score") >= 1)


def pick_file(files: DataFrame, pointers: DataFrame) -> DataFrame:
    """pointers(level, pointer): the first file of each level beyond its pointer, or the level's first."""
    rows = files.join(pointers, "level").withColumn("wrapped", ~(F.col("hi") > F.col("pointer")))
    return rows.groupBy("level").agg(F.min(F.struct("wrapped", "lo", "file_no")).alias("r")).select("level", F.col("r.file_no").alias("file_no"), F.col("r.wrapped").alias("wrapped"))


def block_index(entries: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """(level, file_no, block, place, bytes, hi) of entries(level, file_no, k, seq, bytes): a file's entries in the order of
    keys and versions, cut into blocks where their bytes pass a multiple of block_bytes; `place` is where the block begins
    in its file.  A file is one window, which its size bounds."""
    upto = F.sum("bytes").over(Window.partitionBy("level", "file_no").orderBy("k", F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0))
    rows = entries.withColumn("__upto", upto).withColumn("block", F.floor((F.col("__upto") - F.col("bytes")) / block_bytes))
    return rows.groupBy("level", "file_no", "block").agg(F.min(F.col("__upto") - F.col("bytes")).cast("long").alias("place"), F.sum("bytes").cast("long").alias("bytes"), F.max("k").alias("hi"))


def block_offsets(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """targets(t) with `place`, where the block begins that would hold t in one file's blocks(block, place, bytes, hi), or the
    end of the blocks beyond the last key."""
    found = order.next_mark(targets, blocks.select(F.col("hi").alias("key"), F.col("place").alias("mark")))
    end = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("__end"))
    return found.crossJoin(end).withColumn("place", F.coalesce("mark", "__end").cast("long")).drop("mark", "__end")  # one row


def approximate_sizes(files: DataFrame, blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges(range_id, start, stop) with the bytes of files before stop less those before start, 0 at least.

    A file that ends at or before a bound counts whole, one that begins beyond it not at all; of a file in between counts
    what lies before the block(level, file_no, block, place, hi) that would hold the bound.  Only files that a bound cuts
    are looked into.
    """
    points = ranges.select("range_id", F.explode(F.array(F.struct(F.lit("start").alias("side"), F.col("start").alias("t")), F.struct(F.lit("stop").alias("side"), F.col("stop").alias("t")))).alias("p")).select("range_id", "p.*")
    asked = points.select(F.col("t").alias("t"), F.col("t").alias("__t")).distinct()
    cut = interval_join(asked, files.select("level", "file_no", "lo", "hi"), "t", "__t", "lo", "hi").where(F.col("hi") > F.col("t")).drop("__t")
    inside = cut.select("t", "level", "file_no").join(blocks.select("level", "file_no", "place", F.col("hi").alias("b_hi")), ["level", "file_no"]).where(F.col("b_hi") >= F.col("t"))
    inside = inside.groupBy("t", "level", "file_no").agg(F.min("place").alias("place")).groupBy("t").agg(F.sum("place").alias("inside"))
    cuts = order.bounds(files.select(F.col("hi").alias("key")).unionByName(asked.select(F.col("t").alias("key"))))
    both = files.select(F.lit(1).alias("grp"), F.col("hi").alias("key"), F.col("size").alias("size"), F.lit(0).alias("last")).unionByName(asked.select(F.lit(1).alias("grp"), F.col("t").alias("key"), F.lit(0).cast("long").alias("size"), F.lit(1).alias("last")))
    both = order.running_sum(both.withColumn("__cell", order.cell_of(F.col("key"), cuts)), ["key", "last"], "size", "whole").where(F.col("last") == 1)
    at = both.select(F.col("key").alias("t"), "whole").join(inside, "t", "left").select("t", (F.col("whole") + F.coalesce("inside", F.lit(0))).alias("before"))
    sums = points.join(at, "t").groupBy("range_id").agg(F.sum(F.when(F.col("side") == "stop", F.col("before")).otherwise(-F.col("before"))).alias("bytes"))
    return sums.select("range_id", F.greatest(F.col("bytes"), F.lit(0)).cast("long").alias("bytes"))


def apply_edits(base: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The files of the next version: an added file stays though it is removed as well."""
    keys = ["level", "file_no"]
    return base.join(removed.select(keys), keys, "left_anti").join(added.select(keys), keys, "left_anti").unionByName(added)


def misplaced(files: DataFrame) -> DataFrame:
    """Pairs of files of one level beyond 0 that overlap: a version with any is broken."""
    return overlaps(files.where(F.col("level") >= 1))


def output_levels(files: DataFrame, ranges: DataFrame, most: int = 10 * (2 << 20)) -> DataFrame:
    """ranges(range_id, a, z) with the level for a flushed buffer of these keys: the deepest up to 2 that it reaches without
    meeting a file, nor more than `most` bytes one level further on."""
    met = interval_join(ranges.select("range_id", "a", "z"), files, "a", "z", "lo", "hi")
    totals = [F.sum(F.when(F.col("level") == n, F.col("size"))).alias(f"m{n}") for n in range(4)]
    rows = ranges.select("range_id").join(met.groupBy("range_id").agg(*totals), "range_id", "left")
    first = F.col("m0").isNull() & F.col("m1").isNull() & (F.coalesce("m2", F.lit(0)) <= most)
    second = F.col("m2").isNull() & (F.coalesce("m3", F.lit(0)) <= most)
    return rows.select("range_id", F.when(first & second, 2).when(first, 1).otherwise(0).alias("level"))
