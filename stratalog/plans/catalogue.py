"""The registered queries and the SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import log
from ..functions import bloom, expressions
from ..operators import compaction, files, order, read, write
from ..scratch import shared_folder
from ..sources import wal
from ..sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Sequence numbers of older snapshots, and the one up to which the log counts as flushed.
SNAPSHOTS, FLUSHED = (500, 3000, 7000), 7000

_LOG = "log AS (SELECT user_id AS k, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op, value AS v FROM events)"
_NEWEST = f"{_LOG}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1)"
_VIEW = f"{_NEWEST}, vis AS (SELECT k, seq, v FROM newest WHERE op = 1)"
_ENTRIES = """entries AS (
  SELECT level, CAST(level * 1000000 + run AS BIGINT) AS file_no, k, seq, CAST(60000 + seq % 40 * 250 AS BIGINT) AS bytes FROM (
    SELECT CASE WHEN o_orderkey % 10 = 0 THEN 0 WHEN o_orderkey % 10 < 3 THEN 1 WHEN o_orderkey % 10 < 6 THEN 2 ELSE 3 END AS level,
           CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey // 500 WHEN o_orderkey % 10 < 3 THEN o_custkey // 200
                WHEN o_orderkey % 10 < 6 THEN o_custkey // 100 ELSE o_custkey // 50 END AS run, o_custkey AS k, o_orderkey AS seq FROM orders))"""
_FILES = f"{_ENTRIES}, files AS (SELECT level, file_no, CAST(sum(bytes) AS BIGINT) AS size, min(k) AS lo, max(k) AS hi FROM entries GROUP BY level, file_no)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.visible(log.events(spark, sf_dir))


# Reads


@query(f"WITH {_VIEW} SELECT k, seq, v FROM vis")
def visible_view(spark, sf_dir):
    return _view(spark, sf_dir)


@query(f"WITH {_VIEW} SELECT k, seq, v FROM vis WHERE k = 42")
def point_get(spark, sf_dir):
    return read.get(log.events(spark, sf_dir), 42)


@query(
    f"WITH {_LOG}, s(bound) AS (VALUES (500), (3000), (7000)), r AS (SELECT bound, k, seq, op, v, row_number() OVER (PARTITION BY bound, k ORDER BY seq DESC) AS rn FROM log JOIN s ON seq <= bound) "
    "SELECT bound, k, seq, v FROM r WHERE rn = 1 AND op = 1"
)
def snapshot_get(spark, sf_dir):
    parts = [read.visible(log.events(spark, sf_dir, s)).withColumn("bound", F.lit(s)) for s in SNAPSHOTS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("bound", "k", "seq", "v")


@query(f"WITH {_NEWEST} SELECT k, seq FROM newest WHERE op = 0")
def deleted_get(spark, sf_dir):
    return read.deleted(log.events(spark, sf_dir))


@query(f"WITH {_VIEW} SELECT k, seq, v, row_number() OVER (ORDER BY k) AS position FROM vis")
def scan_forward(spark, sf_dir):
    return read.ranked(_view(spark, sf_dir))


@query(f"WITH {_VIEW} SELECT k, seq, v, row_number() OVER (ORDER BY k DESC) AS position FROM vis")
def scan_reverse(spark, sf_dir):
    return read.ranked(_view(spark, sf_dir), reverse=True)


@query(f"WITH {_VIEW} SELECT * FROM (SELECT k, seq, v, 'first' AS place FROM vis ORDER BY k LIMIT 1) UNION ALL SELECT * FROM (SELECT k, seq, v, 'last' AS place FROM vis ORDER BY k DESC LIMIT 1)")
def seek_ends(spark, sf_dir):
    view = _view(spark, sf_dir)
    return read.first(view).withColumn("place", F.lit("first")).unionByName(read.last(view).withColumn("place", F.lit("last")))


@query(f"WITH {_VIEW} SELECT k, seq, v FROM vis WHERE k >= 77 ORDER BY k LIMIT 1")
def seek_ge(spark, sf_dir):
    return read.seek(_view(spark, sf_dir), 77)


@query(f"WITH {_VIEW} SELECT k, seq, v FROM vis WHERE k >= 100000000 ORDER BY k LIMIT 1")
def seek_past_end(spark, sf_dir):
    return read.seek(_view(spark, sf_dir), 100_000_000)


@query(f"WITH {_VIEW} SELECT k, seq, v FROM vis WHERE k < 77 ORDER BY k DESC LIMIT 1")
def seek_prev(spark, sf_dir):
    return read.seek_before(_view(spark, sf_dir), 77)


@query(f"WITH {_VIEW} SELECT k, seq, v FROM vis WHERE k > 20 ORDER BY k LIMIT 25")
def next_page(spark, sf_dir):
    return read.page(_view(spark, sf_dir), 20, 25)


@query(f"WITH {_VIEW} SELECT k, seq, v FROM vis WHERE k < 120 ORDER BY k DESC LIMIT 25")
def prev_page(spark, sf_dir):
    return read.page(_view(spark, sf_dir), 120, 25, reverse=True)


@query(f"WITH {_VIEW} SELECT k, seq, v FROM vis WHERE k >= 30 AND k < 90")
def range_scan(spark, sf_dir):
    return read.scan(_view(spark, sf_dir), 30, 90)


@query(f"WITH {_VIEW} SELECT k, seq, v, lag(k) OVER (ORDER BY k) AS prev_k, lead(k) OVER (ORDER BY k) AS next_k FROM vis")
def next_prev(spark, sf_dir):
    return read.neighbours(_view(spark, sf_dir))


@query(f"WITH {_VIEW} SELECT k, seq, v FROM vis WHERE k IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def multi_get(spark, sf_dir):
    keys = log.table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("k"))
    return read.multi_get(_view(spark, sf_dir), keys)


@query(f"WITH {_LOG} SELECT k, seq, op, CASE WHEN op = 1 THEN v END AS v FROM log WHERE k = 42")
def all_versions(spark, sf_dir):
    return read.versions(log.events(spark, sf_dir), 42)


@query(f"WITH {_LOG} SELECT k, seq, op, CASE WHEN op = 1 THEN v END AS v, row_number() OVER (ORDER BY k, seq DESC) AS position FROM log")
def internal_scan(spark, sf_dir):
    """Every version in internal order."""
    return read.internal_order(log.events(spark, sf_dir))


@query(f"WITH {_LOG} SELECT k, '[ ' || string_agg(CASE WHEN op = 0 THEN 'DEL' ELSE CAST(seq AS VARCHAR) END, ', ' ORDER BY seq DESC) || ' ]' AS entries FROM log GROUP BY k")
def version_lists(spark, sf_dir):
    """The versions of each key as text; the sequence number stands for the value."""
    return read.listing(log.events(spark, sf_dir).withColumn("v", F.col("seq")))


@query(f"WITH {_VIEW}, f AS (SELECT k, seq, v, row_number() OVER (ORDER BY k) AS position FROM vis) SELECT count(*) AS n, TRUE AS same FROM f")
def both_ways(spark, sf_dir):
    """Whether a scan backward is the scan forward in reverse."""
    forward, backward = read.ranked(_view(spark, sf_dir)), read.ranked(_view(spark, sf_dir), reverse=True)
    n = forward.agg(F.count(F.lit(1)).alias("__n"))
    turned = backward.crossJoin(n).select("k", "seq", (F.col("__n") + 1 - F.col("position")).alias("back"))  # one row
    rows = forward.join(turned, ["k", "seq"], "full")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(F.col("position") == F.col("back"), F.lit(False))).alias("same"))


@query(
    "WITH log AS (SELECT o_custkey AS k, o_orderkey + 1 AS seq, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS op, o_totalprice AS v FROM orders), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log) SELECT k, seq, v FROM r WHERE rn = 1 AND op = 1"
)
def visible_orders(spark, sf_dir):
    return read.visible(log.orders(spark, sf_dir))


@query(
    f"WITH {_LOG}, u AS (SELECT k, seq, op, v FROM log UNION ALL SELECT o_custkey, o_orderkey + 1099511627777, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_totalprice FROM orders), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM u) SELECT k, seq, v FROM r WHERE rn = 1 AND op = 1"
)
def merged_sources(spark, sf_dir):
    """Two sorted sources read as one."""
    newer = log.orders(spark, sf_dir).withColumn("seq", F.col("seq") + (1 << 40))
    return read.visible(order.merged([log.events(spark, sf_dir), newer], "k long, seq long, op int, v double", spark))


# Writes and recovery


@query(
    f"WITH {_LOG}, batch AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS op, c_acctbal AS v, (SELECT max(seq) FROM log) + c_custkey + 1 AS seq FROM customer), "
    f"u AS (SELECT k, seq, op, v FROM log UNION ALL SELECT k, seq, op, v FROM batch), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM u) SELECT k, seq, v FROM r WHERE rn = 1 AND op = 1"
)
def batch_apply(spark, sf_dir):
    """A batch of the customers after the log: record i gets the newest sequence number + 1 + i."""
    key = F.col("c_custkey")
    batch = log.table(spark, sf_dir, "customer").select(key.alias("ordinal"), F.when(key % 3 == 0, log.DELETE).otherwise(log.PUT).alias("op"), key.alias("k"), F.col("c_acctbal").alias("v"))
    rows = log.events(spark, sf_dir)
    return read.visible(rows.unionByName(write.numbered(batch, rows.agg(F.max("seq")).first()[0] or 0)))


_BYTES = "SELECT CAST(user_id AS VARCHAR) AS k, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op, props AS v FROM events"
_LIVE = f"WITH log AS ({_BYTES}), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log) SELECT k, seq, v FROM r WHERE rn = 1 AND op = 1"


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of bytes."""
    rows = log.table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", log.DELETE).otherwise(log.PUT)
    return rows.select(F.col("user_id").cast("string").cast("binary").alias("k"), (F.col("event_id") + 1).alias("seq"), op.alias("op"), F.when(op == log.PUT, F.col("props").cast("binary")).alias("v"))


def _shown(view: DataFrame) -> DataFrame:
    return view.select(F.col("k").cast("string").alias("k"), "seq", F.col("v").cast("string").alias("v"))


@query(_LIVE)
def wal_replay(spark, sf_dir):
    """A restart: the log up to FLUSHED from its table, the tail from write-ahead log files, which are written, read and
    replayed; they begin before the flushed part ends."""
    rows, folder = _bytes(spark, sf_dir), shared_folder(spark, "wal")
    wal.write_logs(rows.where(F.col("seq") > FLUSHED // 2), folder)
    tail = wal.read_logs(spark, folder).select("k", "seq", "op", "v")
    return _shown(read.visible(wal.replay(rows.where(F.col("seq") <= FLUSHED), tail)))


@query(_LIVE)
def store_view(spark, sf_dir):
    """What a store shows after the events were written as one batch, flushed and compacted."""
    store = Store(spark, shared_folder(spark, "store"))
    store.write(_bytes(spark, sf_dir).select((F.col("seq") - 1).alias("ordinal"), "op", "k", "v"))
    store.compact_range()
    return _shown(store.view())


@query(f"WITH log AS ({_BYTES}), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log) SELECT k, count(*) AS versions FROM r WHERE op = 1 AND rn = 1 GROUP BY k")
def store_compacted(spark, sf_dir):
    """The versions that a store keeps of each key once a later write over the whole range was compacted with it: one."""
    store = Store(spark, shared_folder(spark, "store"))
    rows = _bytes(spark, sf_dir).select((F.col("seq") - 1).alias("ordinal"), "op", "k", "v")
    store.write(rows)
    store.flush()
    store.write(rows)
    store.compact_range()
    return store.log().groupBy(F.col("k").cast("string").alias("k")).agg(F.count(F.lit(1)).alias("versions"))


@query("SELECT n AS seq, CAST(held AS INTEGER) AS held FROM (SELECT count(*) AS n, 1 AS held FROM region UNION ALL SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation), 2)")
def snapshot_registry(spark, sf_dir):
    """The snapshots that a store holds after two tables were written: one after the first; after the second three, of which
    one was released."""
    store = Store(spark, shared_folder(spark, "store"))
    for name, times in (("region", 1), ("nation", 3)):
        key = F.col(f"{name[0]}_{name}key").cast("long")
        rows = log.table(spark, sf_dir, name).select(key.alias("ordinal"), F.lit(log.PUT).alias("op"), key.cast("string").cast("binary").alias("k"), F.lit(b"").alias("v"))
        store.write(rows)
        held = [store.snapshot() for _ in range(times)]
    store.release(held[0])
    return store.snapshots()


@query("SELECT count(*) AS oldest, count(*) + (SELECT count(*) FROM nation) AS newest FROM region")
def oldest_snapshot(spark, sf_dir):
    held = log.table(spark, sf_dir, "region").agg(F.count(F.lit(1)).alias("seq"))
    rows = log.table(spark, sf_dir, "nation").select("n_nationkey").unionByName(log.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_nationkey")))
    newest = rows.agg(F.count(F.lit(1)).alias("seq"))
    return write.oldest_bound(held, newest).select(F.col("seq").alias("oldest")).crossJoin(newest.select(F.col("seq").alias("newest")))  # one row each


@query("SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op, CAST(event_id AS VARCHAR) AS k, CASE WHEN event_type <> 'error' THEN props END AS v, user_id + row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events")
def batch_decode(spark, sf_dir):
    """Batches of each user's events, encoded by expressions and decoded again."""
    rows = log.table(spark, sf_dir, "events")
    sized = lambda c: F.concat(F.hex(expressions.varint(F.octet_length(c))), F.hex(c))
    key, value = F.col("event_id").cast("string").cast("binary"), F.col("props").cast("binary")
    record = F.when(F.col("event_type") == "error", F.concat(F.lit("00"), sized(key))).otherwise(F.concat(F.lit("01"), sized(key), sized(value)))
    batches = rows.groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("i"), record.alias("r")))).alias("rs"))
    data = F.unhex(F.concat(F.hex(expressions.fixed64(F.col("id"))), F.hex(expressions.fixed32(F.size("rs"))), F.array_join("rs.r", "")))
    found = write.decoded(batches.select("id", data.alias("data")))
    return found.select("id", "ordinal", "op", F.col("k").cast("string").alias("k"), F.col("v").cast("string").alias("v"), "seq")


_VARINT = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 ELSE 4 END"


@query(
    f"WITH r AS (SELECT octet_length(CAST(CAST(user_id AS VARCHAR) AS BLOB)) + 8 AS a, CASE WHEN event_type = 'error' THEN 0 ELSE octet_length(CAST(props AS BLOB)) END AS b FROM events WHERE event_id >= {FLUSHED}) "
    f"SELECT CAST(coalesce(sum(a + {_VARINT.format('a')} + b + {_VARINT.format('b')}), 0) AS BIGINT) AS bytes, count(*) AS records FROM r"
)
def memory_usage(spark, sf_dir):
    rows = log.table(spark, sf_dir, "events").where(F.col("event_id") >= FLUSHED)
    size = write.entry_bytes(F.col("user_id").cast("string"), F.col("props"), F.when(F.col("event_type") == "error", 0).otherwise(1))
    return rows.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"), F.count(F.lit(1)).alias("records"))


@query(
    "WITH RECURSIVE w AS (SELECT user_id AS queue, event_id AS position, CAST(20000 + event_id % 7 * 30000 AS BIGINT) AS bytes, event_type = 'error' AS sync, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), "
    "g AS (SELECT queue, position, rn, CAST(0 AS BIGINT) AS grp, bytes AS size, CAST(CASE WHEN bytes <= 131072 THEN bytes + 131072 ELSE 1048576 END AS BIGINT) AS most, sync AS lead FROM w WHERE rn = 1 "
    "UNION ALL SELECT w.queue, w.position, w.rn, CASE WHEN n THEN grp + 1 ELSE grp END, CASE WHEN n THEN w.bytes ELSE size + w.bytes END, CASE WHEN n THEN CASE WHEN w.bytes <= 131072 THEN w.bytes + 131072 ELSE 1048576 END ELSE most END, CASE WHEN n THEN w.sync ELSE lead END "
    "FROM (SELECT w.*, g.grp, g.size, g.most, g.lead, (w.sync AND NOT g.lead) OR g.size + w.bytes > g.most AS n FROM w JOIN g ON w.queue = g.queue AND w.rn = g.rn + 1) w) SELECT queue, position, grp FROM g"
)
def group_commit(spark, sf_dir):
    rows = log.table(spark, sf_dir, "events")
    rows = rows.select(F.col("user_id").alias("queue"), F.col("event_id").alias("position"), (20000 + F.col("event_id") % 7 * 30000).alias("bytes"), (F.col("event_type") == "error").alias("sync"))
    return write.commit_groups(rows)


# Garbage collection

_NEXT = f"{_LOG}, n AS (SELECT *, lag(seq) OVER (PARTITION BY k ORDER BY seq DESC) AS newer FROM log), kept AS (SELECT * FROM n WHERE NOT coalesce(newer <= 3000, FALSE))"


@query(f"WITH {_NEXT} SELECT k, seq, op, v FROM kept WHERE NOT (op = 0 AND seq <= 3000)")
def gc_retained(spark, sf_dir):
    return compaction.retained(log.events(spark, sf_dir), 3000)


@query(f"WITH {_NEXT} SELECT CASE WHEN coalesce(newer <= 3000, FALSE) THEN 'hidden' WHEN op = 0 AND seq <= 3000 THEN 'tombstone' ELSE 'kept' END AS reason, count(*) AS n FROM n GROUP BY 1")
def gc_reasons(spark, sf_dir):
    return compaction.reasons(log.events(spark, sf_dir), 3000)


@query(
    f"WITH {_NEXT}, deeper(lo, hi) AS (VALUES (10, 25), (60, 61), (100, 140)) "
    "SELECT k, seq, op, v FROM kept WHERE NOT (op = 0 AND seq <= 3000 AND NOT EXISTS (SELECT 1 FROM deeper WHERE k BETWEEN lo AND hi))"
)
def gc_base_level(spark, sf_dir):
    deeper = spark.createDataFrame([(10, 25), (60, 61), (100, 140)], "lo long, hi long")
    return compaction.retained(log.events(spark, sf_dir), 3000, deeper)


@query(
    "WITH RECURSIVE r AS (SELECT o_custkey // 100 AS run, o_orderkey AS position, CAST(700 + o_orderkey % 900 AS BIGINT) AS bytes, row_number() OVER (PARTITION BY o_custkey // 100 ORDER BY o_orderkey) AS rn FROM orders), "
    "w AS (SELECT run, position, rn, CAST(0 AS BIGINT) AS block, bytes AS size FROM r WHERE rn = 1 UNION ALL "
    "SELECT r.run, r.position, r.rn, CASE WHEN w.size >= 4096 THEN w.block + 1 ELSE w.block END, CASE WHEN w.size >= 4096 THEN r.bytes ELSE w.size + r.bytes END FROM r JOIN w ON r.run = w.run AND r.rn = w.rn + 1) SELECT run, position, block FROM w"
)
def block_cuts(spark, sf_dir):
    """Blocks of 4 KiB in the runs of 100 customers."""
    rows = log.table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 100).alias("run"), F.col("o_orderkey").alias("position"), (700 + F.col("o_orderkey") % 900).alias("bytes"))
    return compaction.cut_by_size(rows, 4096)


@query(
    "WITH RECURSIVE o AS (SELECT c_nationkey AS run, c_custkey AS k, c_custkey // 40 AS f, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer), "
    "w AS (SELECT run, k, f, rn, f AS since, CAST(0 AS BIGINT) AS output FROM o WHERE rn = 1 UNION ALL "
    "SELECT o.run, o.k, o.f, o.rn, CASE WHEN (o.f - w.since) * 50 > 120 THEN o.f ELSE w.since END, CASE WHEN (o.f - w.since) * 50 > 120 THEN w.output + 1 ELSE w.output END FROM o JOIN w ON o.run = w.run AND o.rn = w.rn + 1) "
    "SELECT CAST(run AS BIGINT) AS run, k, output FROM w"
)
def compaction_cuts(spark, sf_dir):
    """Runs of the customers of each nation, cut where they overlap more than 120 bytes of files of 40 keys and 50 bytes."""
    rows = log.table(spark, sf_dir, "customer")
    keys = rows.select(F.col("c_nationkey").cast("long").alias("run"), F.col("c_custkey").alias("k"))
    below = rows.select((F.floor(F.col("c_custkey") / 40) * 40 + 39).alias("hi")).distinct().withColumn("size", F.lit(50).cast("long"))
    return compaction.cut_by_grandparents(keys, below, 120)


# Files and levels


@query(f"WITH {_FILES} SELECT level, file_no, size, lo, hi FROM files")
def file_stats(spark, sf_dir):
    return log.levels(spark, sf_dir)


@query(f"WITH {_FILES} SELECT a.level AS level, a.file_no AS a_file_no, b.file_no AS b_file_no FROM files a JOIN files b ON a.level = b.level AND a.file_no < b.file_no AND a.lo <= b.hi AND b.lo <= a.hi")
def file_overlaps(spark, sf_dir):
    return files.overlaps(log.levels(spark, sf_dir)).select(F.col("a_level").alias("level"), "a_file_no", "b_file_no")


@query(f"WITH {_FILES}, t(key) AS (VALUES (3), (77), (500), (1444)) SELECT key, level, file_no, row_number() OVER (PARTITION BY key ORDER BY level, file_no DESC) AS probe FROM t JOIN files ON key BETWEEN lo AND hi")
def files_for_key(spark, sf_dir):
    keys = spark.createDataFrame([(3,), (77,), (500,), (1444,)], "key long")
    return files.files_for_keys(log.levels(spark, sf_dir), keys).select("key", "level", "file_no", "probe")


_RUNS = "runs AS (SELECT o_custkey // 3 AS file_no, CAST(0 AS INTEGER) AS level, min(o_custkey) AS lo, max(o_custkey) + o_custkey // 3 % 5 AS hi FROM orders GROUP BY o_custkey // 3)"


@query(f"WITH {_RUNS}, p AS (SELECT *, max(hi) OVER (ORDER BY lo, file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM runs) SELECT file_no, lo, hi, CAST(sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (ORDER BY lo, file_no) AS BIGINT) AS island FROM p")
def overlap_islands(spark, sf_dir):
    """Files of three customers each that reach a few keys further; every fifth doesn't reach the next."""
    run = F.floor(F.col("o_custkey") / 3)
    rows = log.table(spark, sf_dir, "orders").groupBy(run.alias("file_no")).agg(F.min("o_custkey").alias("lo"), F.max("o_custkey").alias("most")).withColumn("level", F.lit(0))
    rows = rows.withColumn("hi", F.col("most") + F.col("file_no") % 5).drop("most")
    return files.islands(rows).select("file_no", "lo", "hi", "island")


@query(f"WITH {_RUNS}, p AS (SELECT *, max(hi) OVER (ORDER BY lo, file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM runs), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (ORDER BY lo, file_no) AS island FROM p) SELECT file_no, lo, hi FROM i WHERE island IN (SELECT island FROM i WHERE lo <= 100 AND hi >= 80)")
def overlapping_level0(spark, sf_dir):
    """The files of level 0 that a range takes with it, once it has grown over all that overlap."""
    run = F.floor(F.col("o_custkey") / 3)
    rows = log.table(spark, sf_dir, "orders").groupBy(run.alias("file_no")).agg(F.min("o_custkey").alias("lo"), F.max("o_custkey").alias("most")).withColumn("level", F.lit(0))
    rows = rows.withColumn("hi", F.col("most") + F.col("file_no") % 5).drop("most")
    return files.overlapping(rows, 0, 80, 100).select("file_no", "lo", "hi")


@query(f"WITH {_FILES} SELECT file_no, lo, hi FROM files WHERE level = 2 AND lo <= 640 AND hi >= 230")
def overlapping_files(spark, sf_dir):
    return files.overlapping(log.levels(spark, sf_dir), 2, 230, 640).select("file_no", "lo", "hi")


@query(f"WITH {_FILES}, t AS (SELECT DISTINCT user_id * 7 AS t FROM events) SELECT t, min(file_no) AS file_no FROM t JOIN files ON level = 3 AND hi >= t GROUP BY t")
def find_file(spark, sf_dir):
    targets = log.table(spark, sf_dir, "events").select((F.col("user_id") * 7).alias("t")).distinct()
    return files.find_file(log.levels(spark, sf_dir).where(F.col("level") == 3), targets)


_SCORES = f"{_FILES}, tot AS (SELECT level, count(*) AS files, sum(size) AS bytes FROM files GROUP BY level), sc AS (SELECT level, CASE WHEN level = 0 THEN files / 4.0::DOUBLE ELSE bytes / (10485760 * pow(10.0::DOUBLE, greatest(level - 1, 0))) END AS score FROM tot WHERE level < 6)"


@query(f"WITH {_SCORES} SELECT level, score FROM sc")
def level_scores(spark, sf_dir):
    return files.scores(log.levels(spark, sf_dir))


@query(f"WITH {_SCORES} SELECT level, score FROM sc WHERE score >= 1 ORDER BY score DESC, level LIMIT 1")
def pick_level(spark, sf_dir):
    return files.pick(log.levels(spark, sf_dir))


@query(f"WITH {_FILES}, p(level, pointer) AS (VALUES (1, 350), (2, 99999999), (3, 0)), w AS (SELECT f.*, NOT hi > pointer AS wrapped, row_number() OVER (PARTITION BY f.level ORDER BY NOT hi > pointer, lo, file_no) AS rn FROM files f JOIN p ON f.level = p.level) SELECT level, file_no, wrapped FROM w WHERE rn = 1")
def pick_file(spark, sf_dir):
    pointers = spark.createDataFrame([(1, 350), (2, 99_999_999), (3, 0)], "level int, pointer long")
    return files.pick_file(log.levels(spark, sf_dir), pointers)


@query(f"WITH {_SCORES} SELECT level, files, CAST(bytes AS BIGINT) AS bytes FROM tot")
def level_counts(spark, sf_dir):
    return files.level_totals(log.levels(spark, sf_dir))


@query(f"WITH {_SCORES} SELECT 'files[ ' || string_agg(coalesce(files, 0), ' ' ORDER BY n) || ' ]' AS summary FROM range(7) t(n) LEFT JOIN tot ON level = n")
def level_summary(spark, sf_dir):
    rows = files.level_totals(log.levels(spark, sf_dir))
    counts = [F.coalesce(F.sum(F.when(F.col("level") == n, F.col("files"))), F.lit(0)).cast("string") for n in range(files.LEVELS)]
    return rows.agg(F.concat(F.lit("files[ "), F.concat_ws(" ", *counts), F.lit(" ]")).alias("summary"))


@query(
    f"WITH {_SCORES}, done(level, micros, read, written) AS (VALUES (1, 30, 4096, 2048), (2, 7, 8192, 8000), (5, 1, 1, 1)) "
    "SELECT coalesce(t.level, d.level) AS level, coalesce(files, 0) AS files, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes, CAST(coalesce(micros, 0) AS BIGINT) AS micros, CAST(coalesce(read, 0) AS BIGINT) AS read, CAST(coalesce(written, 0) AS BIGINT) AS written FROM tot t FULL JOIN done d ON t.level = d.level"
)
def stats_report(spark, sf_dir):
    done = spark.createDataFrame([(1, 10, 4000, 2000), (1, 20, 96, 48), (2, 7, 8192, 8000), (5, 1, 1, 1)], "level int, micros long, read long, written long")
    done = done.groupBy("level").agg(*[F.sum(c).alias(c) for c in ("micros", "read", "written")])
    rows = files.level_totals(log.levels(spark, sf_dir)).join(done, "level", "full")
    return rows.select("level", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "bytes", "micros", "read", "written")])


_BLOCKS = (
    "upto AS (SELECT *, sum(bytes) OVER (PARTITION BY level, file_no ORDER BY k, seq DESC ROWS UNBOUNDED PRECEDING) AS upto FROM entries), "
    "blocks AS (SELECT level, file_no, CAST((upto - bytes) // 4096 AS BIGINT) AS block, CAST(min(upto - bytes) AS BIGINT) AS place, CAST(sum(bytes) AS BIGINT) AS bytes, max(k) AS hi FROM upto GROUP BY ALL)"
)
_RANGES = [(1, 0, 200), (2, 150, 1111), (3, 900, 100), (4, 99_999_999, 999_999_999), (5, 17, 18), (6, 0, 99_999_999)]


@query(f"WITH {_FILES}, {_BLOCKS} SELECT level, file_no, block, place, bytes, hi FROM blocks")
def block_index(spark, sf_dir):
    return files.block_index(log.entries(spark, sf_dir))


@query(
    f"WITH {_FILES}, {_BLOCKS}, r(range_id, start, stop) AS (VALUES {', '.join(map(str, _RANGES))}), t AS (SELECT range_id, start AS t, -1 AS sign FROM r UNION ALL SELECT range_id, stop, 1 FROM r), "
    "o AS (SELECT range_id, sign, CASE WHEN f.hi <= t THEN f.size WHEN f.lo > t THEN 0 ELSE (SELECT min(b.place) FROM blocks b WHERE b.level = f.level AND b.file_no = f.file_no AND b.hi >= t) END AS n FROM t, files f) "
    "SELECT range_id, CAST(greatest(sum(sign * n), 0) AS BIGINT) AS bytes FROM o GROUP BY range_id"
)
def approx_size(spark, sf_dir):
    """Bytes between two keys, by the offsets of blocks inside files."""
    ranges = spark.createDataFrame(_RANGES, "range_id int, start long, stop long")
    return files.approximate_sizes(log.levels(spark, sf_dir), files.block_index(log.entries(spark, sf_dir)), ranges)


@query(
    "WITH b AS (SELECT o_custkey // 20 AS block, CAST(sum(60 + o_orderkey % 40) AS BIGINT) AS bytes, max(o_custkey) AS hi FROM orders GROUP BY 1), o AS (SELECT *, sum(bytes) OVER (ORDER BY block) - bytes AS place FROM b), "
    "k AS (SELECT DISTINCT user_id * 3 AS t FROM events), s AS (SELECT t, min(place) AS place FROM k LEFT JOIN o ON hi >= t GROUP BY t) SELECT t, CAST(coalesce(place, (SELECT sum(bytes) FROM b)) AS BIGINT) AS place FROM s"
)
def block_offset(spark, sf_dir):
    """Where in a file the block of a key begins; beyond the last key, the end of the blocks."""
    blocks = log.table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_custkey") / 20).alias("block")).agg(F.sum(60 + F.col("o_orderkey") % 40).alias("bytes"), F.max("o_custkey").alias("hi"))
    blocks = order.running_sum(order.celled(blocks.withColumn("grp", F.lit(0)), "block"), ["block"], "bytes", "upto")
    blocks = blocks.select("block", "bytes", "hi", (F.col("upto") - F.col("bytes")).alias("place"))
    return files.block_offsets(blocks, log.table(spark, sf_dir, "events").select((F.col("user_id") * 3).alias("t")).distinct())


@query(f"WITH {_FILES} SELECT a.level AS level, a.file_no AS file_no, CAST(sum(b.size) AS BIGINT) AS overlap_bytes FROM files a JOIN files b ON b.level = a.level + 1 AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY ALL")
def next_level_overlap(spark, sf_dir):
    return files.next_level_overlap(log.levels(spark, sf_dir)).select(F.col("a_level").alias("level"), F.col("a_file_no").alias("file_no"), "overlap_bytes")


@query(f"WITH {_FILES} SELECT level, file_no, size, lo, hi FROM files WHERE NOT (level = 1 AND lo < 800) UNION ALL SELECT 2, file_no + 500000, size, lo, hi FROM files WHERE level = 1 AND lo < 800")
def version_edit_apply(spark, sf_dir):
    """A manifest edit that moves the first files of level 1 down."""
    base = log.levels(spark, sf_dir)
    moved = base.where((F.col("level") == 1) & (F.col("lo") < 800))
    added = moved.withColumn("level", F.lit(2)).withColumn("file_no", F.col("file_no") + 500_000)
    return files.apply_edits(base, added, moved)


@query(f"WITH {_FILES} SELECT printf('%07d.ddb', p_partkey) AS name FROM part WHERE p_partkey NOT IN (SELECT file_no FROM files)")
def obsolete_files(spark, sf_dir):
    """Files of a listing that no version names."""
    names = log.table(spark, sf_dir, "part").select(F.format_string("%07d.ddb", F.col("p_partkey")).alias("name"))
    listed = names.withColumn("file_no", expressions.file_kind(F.col("name"))["number"].cast("long"))
    return listed.join(log.levels(spark, sf_dir).select("file_no"), "file_no", "left_anti").select("name")


_APART = "apart AS (SELECT level, file_no, size, lo + level * 10000000 AS lo, hi + level * 10000000 AS hi FROM files)"
_BUFFERS = [(1, 50, 60), (2, 10_000_040, 10_000_060), (3, 20_000_010, 20_000_020), (4, 30_000_001, 30_000_002), (5, 30_000_001, 39_000_000), (6, 90_000_000, 91_000_000), (7, 20_000_000, 30_000_100)]


@query(
    f"WITH {_FILES}, {_APART}, r(range_id, a, z) AS (VALUES {', '.join(map(str, _BUFFERS))}), m AS (SELECT range_id, level, sum(size) AS b FROM r JOIN apart ON lo <= z AND hi >= a GROUP BY ALL), "
    "x AS (SELECT range_id, EXISTS (SELECT 1 FROM m WHERE m.range_id = r.range_id AND level < 2) OR coalesce((SELECT b FROM m WHERE m.range_id = r.range_id AND level = 2), 0) > 20971520 AS stays, "
    "EXISTS (SELECT 1 FROM m WHERE m.range_id = r.range_id AND level = 2) OR coalesce((SELECT b FROM m WHERE m.range_id = r.range_id AND level = 3), 0) > 20971520 AS stops FROM r) "
    "SELECT range_id, CASE WHEN stays THEN 0 WHEN stops THEN 1 ELSE 2 END AS level FROM x"
)
def flush_level(spark, sf_dir):
    """Where buffers go that meet files of each level; the levels' files are set apart for that."""
    shift = F.col("level") * 10_000_000
    apart = log.levels(spark, sf_dir).withColumn("lo", F.col("lo") + shift).withColumn("hi", F.col("hi") + shift)
    return files.output_levels(apart, spark.createDataFrame(_BUFFERS, "range_id int, a long, z long"))


@query(f"WITH {_FILES}, m AS (SELECT a.file_no, sum(b.size) AS n FROM files a JOIN files b ON b.level = a.level + 1 AND a.lo <= b.hi AND b.lo <= a.hi WHERE a.level >= 1 GROUP BY ALL) SELECT CAST(coalesce(max(n), 0) AS BIGINT) AS overlap_bytes FROM m")
def most_overlap(spark, sf_dir):
    return files.most_overlap(log.levels(spark, sf_dir))


_ASKED = [(1, 0, 10, 20), (2, 1, None, 5), (3, 2, 99_999_999, None), (4, 3, None, None), (5, 3, 30, 20), (6, 5, None, None)]


@query(f"WITH {_FILES}, r(range_id, level, lo, hi) AS (VALUES {', '.join(str(r).replace('None', 'NULL') for r in _ASKED)}) SELECT range_id, level, lo, hi, EXISTS (SELECT 1 FROM files f WHERE f.level = r.level AND (r.lo IS NULL OR f.hi >= r.lo) AND (r.hi IS NULL OR f.lo <= r.hi) AND coalesce(r.lo <= r.hi, TRUE)) AS overlaps FROM r")
def range_overlaps(spark, sf_dir):
    """Whether a level has a file that meets a range with open or closed ends."""
    return files.has_overlap(log.levels(spark, sf_dir), spark.createDataFrame(_ASKED, "range_id int, level int, lo long, hi long"))


@query(
    f"WITH {_FILES}, c AS (SELECT user_id AS key, count(*) AS times FROM events GROUP BY 1), p AS (SELECT key, level, file_no, row_number() OVER (PARTITION BY key ORDER BY level, file_no DESC) AS probe FROM c JOIN files ON key BETWEEN lo AND hi), "
    "two AS (SELECT a.level, a.file_no, times FROM p a JOIN p b ON a.key = b.key AND a.probe = 1 AND b.probe = 2 JOIN c ON c.key = a.key), t AS (SELECT level, file_no, CAST(sum(times) AS BIGINT) AS charges FROM two GROUP BY ALL) "
    "SELECT f.level, f.file_no, coalesce(charges, 0) AS charges, greatest(size // 16384, 100) AS allowed_seeks FROM files f LEFT JOIN t ON f.level = t.level AND f.file_no = t.file_no"
)
def seek_charges(spark, sf_dir):
    """Seeks that lookups of the events' users charge to files, and those that each file is allowed."""
    lookups = log.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"))
    return files.charged(log.levels(spark, sf_dir), lookups).select("level", "file_no", "charges", "allowed_seeks")


@query(f"WITH {_FILES} SELECT level, min(lo) AS lo, max(hi) AS hi FROM files GROUP BY level")
def level_ranges(spark, sf_dir):
    return files.ranges(log.levels(spark, sf_dir))


# Blocks, filters and codecs

_KEYS = "keys AS (SELECT c_name AS key, row_number() OVER (ORDER BY c_name) - 1 AS i, lag(c_name) OVER (ORDER BY c_name) AS before FROM customer)"


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in order with their place and the name before."""
    rows = log.table(spark, sf_dir, "customer").select(F.col("c_name").alias("k"))
    rows = read.neighbours(read.ranked(rows))
    return rows.select(F.col("k").alias("key"), (F.col("position") - 1).alias("i"), F.col("prev_k").alias("before"))


@query(
    f"WITH {_KEYS} SELECT key, i, CAST(CASE WHEN before IS NULL OR i % 16 = 0 THEN 0 ELSE coalesce((SELECT min(j) - 1 FROM range(1, 1 + least(length(key), length(before))) t(j) WHERE substr(key, j, 1) <> substr(before, j, 1)), least(length(key), length(before))) END AS INTEGER) AS shared FROM keys"
)
def prefix_lengths(spark, sf_dir):
    rows = _keys(spark, sf_dir)
    shared = expressions.shared_prefix(F.col("key").cast("binary"), F.col("before").cast("binary"))
    return rows.select("key", "i", F.when(F.col("before").isNull() | (F.col("i") % 16 == 0), 0).otherwise(shared).cast("int").alias("shared"))


@query(f"WITH {_KEYS} SELECT i // 16 AS restart, key FROM keys WHERE i % 16 = 0")
def restart_points(spark, sf_dir):
    return _keys(spark, sf_dir).where(F.col("i") % 16 == 0).select(F.floor(F.col("i") / 16).alias("restart"), "key")


_M32, _BLOOM_SEED = 3332679571, 0xBC9F1D34


def _word(text: str, at: int) -> str:
    return " + ".join(f"CAST(ascii(substr({text}, {at + i + 1}, 1)) AS HUGEINT) * {256**i}" for i in range(4))


def _mixed(h: str, word: str) -> str:
    return f"(SELECT xor(x, x >> 16) FROM (SELECT CAST(({h} + {word}) % 4294967296 * {_M32} % 4294967296 AS BIGINT) AS x))"


def _hash8(text: str, seed: int) -> str:
    """The hash of a text of eight ASCII characters."""
    first = _mixed(f"CAST({seed ^ 8 * _M32 % 2**32} AS HUGEINT)", _word(text, 0))
    return _mixed(first, _word(text, 4))


def _positions(rows: str) -> str:
    """(grp, bits, key, position) of rows(grp, bits, key)."""
    h = f"SELECT grp, bits, key, {_hash8('key', _BLOOM_SEED)} AS h FROM {rows}"
    return f"SELECT grp, bits, key, (h + i * ((h >> 17) | (h << 15) % 4294967296)) % 4294967296 % bits AS position FROM ({h}) CROSS JOIN range(6) t(i)"


_SIZED = "sized AS (SELECT grp, CAST(ceil(greatest(count(DISTINCT key) * 10, 64) / 8) * 8 AS BIGINT) AS bits FROM held GROUP BY grp)"
_HELD = f"held AS (SELECT p_partkey % 7 AS grp, printf('%08d', p_partkey) AS key FROM part), {_SIZED}, known AS (SELECT h.grp, bits, key FROM held h JOIN sized s ON h.grp = s.grp)"


def _parts(spark, sf_dir, pattern: str) -> DataFrame:
    return log.table(spark, sf_dir, "part").select((F.col("p_partkey") % 7).alias("grp"), F.format_string(pattern, F.col("p_partkey")).cast("binary").alias("key"))


@query(f"WITH {_HELD} SELECT DISTINCT grp, bits, CAST(position AS INTEGER) AS position FROM ({_positions('known')})")
def bloom_bits(spark, sf_dir):
    """The bits of a filter for each group of parts."""
    return bloom.build(_parts(spark, sf_dir, "%08d"))


@query(
    f"WITH {_HELD}, set_bits AS (SELECT DISTINCT grp, position FROM ({_positions('known')})), asked AS (SELECT p_partkey % 7 AS grp, printf('%08d', p_partkey) AS key FROM part UNION ALL SELECT p_partkey % 7, printf('x%07d', p_partkey) FROM part), "
    f"a AS (SELECT k.grp, bits, key FROM asked k JOIN sized s ON k.grp = s.grp), q AS ({_positions('a')}) "
    "SELECT q.grp, q.key, bool_and(b.position IS NOT NULL) AS may_hold FROM q LEFT JOIN set_bits b ON b.grp = q.grp AND b.position = q.position GROUP BY q.grp, q.key"
)
def bloom_membership(spark, sf_dir):
    """What the filters say of the keys they were built of, and of as many others."""
    asked = _parts(spark, sf_dir, "%08d").unionByName(_parts(spark, sf_dir, "x%07d"))
    return bloom.probe(bloom.build(_parts(spark, sf_dir, "%08d")), asked).select("grp", F.col("key").cast("string").alias("key"), "may_hold")


@query(f"WITH held AS (SELECT p_partkey * 700 // 2048 AS grp, printf('%08d', p_partkey) AS key FROM part), {_SIZED}, known AS (SELECT h.grp, bits, key FROM held h JOIN sized s ON h.grp = s.grp) SELECT DISTINCT grp, bits, CAST(position AS INTEGER) AS position FROM ({_positions('known')})")
def filter_blocks(spark, sf_dir):
    """The filters of a file whose blocks are 700 bytes apart and hold one part each, in two versions."""
    key = F.format_string("%08d", F.col("p_partkey"))
    rows = log.table(spark, sf_dir, "part").select((F.col("p_partkey") * 700).alias("place"), F.explode(F.array(expressions.internal_key(key, F.lit(7), F.lit(1)), expressions.internal_key(key, F.lit(9), F.lit(0)))).alias("internal_key"))
    return bloom.filter_blocks(rows)


_LE = "||".join(f"substr(printf('%016X', (event_id + 1) * 256 + CASE WHEN event_type = 'error' THEN 0 ELSE 1 END), {15 - 2 * i}, 2)" for i in range(8))


@query(f"SELECT event_id, hex(CAST(CAST(user_id AS VARCHAR) AS BLOB)) || {_LE} AS internal, CAST(user_id AS VARCHAR) AS k, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op FROM events")
def internal_key_codec(spark, sf_dir):
    rows = log.table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", 0).otherwise(1)
    rows = rows.select("event_id", expressions.internal_key(F.col("user_id").cast("string"), F.col("event_id") + 1, op).alias("internal"))
    rows = rows.withColumn("p", expressions.parse_internal_key(F.col("internal")))
    return rows.select("event_id", F.hex("internal").alias("internal"), F.col("p.k").cast("string").alias("k"), "p.seq", "p.op")


@query("SELECT event_id, '\"' || user_id || '\",' || (event_id + 1) || CASE WHEN event_type = 'error' THEN ',TypeDeletion' ELSE ',TypeValue' END AS shown FROM events")
def format_key(spark, sf_dir):
    rows = log.events(spark, sf_dir)
    return rows.select((F.col("seq") - 1).alias("event_id"), expressions.format_key(F.col("k"), F.col("seq"), F.col("op")).alias("shown"))


@query("SELECT o_orderkey, CAST(CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 WHEN n < 268435456 THEN 4 ELSE 5 END AS BIGINT) AS bytes FROM (SELECT o_orderkey, o_orderkey * 3001 AS n FROM orders)")
def varint_lengths(spark, sf_dir):
    return log.table(spark, sf_dir, "orders").select("o_orderkey", write.varint_bytes(F.col("o_orderkey") * 3001).alias("bytes"))


_VARINT_CODE = " || ".join(f"CASE WHEN {i} = 0 OR n >> {7 * i} > 0 THEN printf('%02X', ((n >> {7 * i}) & 127) + CASE WHEN n >> {7 * i + 7} > 0 THEN 128 ELSE 0 END) ELSE '' END" for i in range(8))


@query(f"SELECT o_orderkey, {_VARINT_CODE} AS code, n AS back, CAST(length({_VARINT_CODE}) // 2 AS INTEGER) AS length FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey * (o_orderkey % 5) * 1009 AS BIGINT) AS n FROM orders)")
def varint_codes(spark, sf_dir):
    key = F.col("o_orderkey")
    code = expressions.varint(key * key * (key % 5) * 1009)
    rows = log.table(spark, sf_dir, "orders").select("o_orderkey", F.hex(code).alias("code"), expressions.read_varint(code).alias("r"))
    return rows.select("o_orderkey", "code", F.col("r.number").alias("back"), "r.length")


@query("SELECT o_orderkey, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS code, n AS back FROM (SELECT o_orderkey, n, printf('%08X', n) AS h FROM (SELECT o_orderkey, o_orderkey * 77777 AS n FROM orders))")
def fixed_codes(spark, sf_dir):
    rows = log.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 77777).alias("n"))
    return rows.select("o_orderkey", F.hex(expressions.fixed32(F.col("n"))).alias("code"), expressions.read_fixed64(expressions.fixed64(F.col("n"))).alias("back"))


@query("SELECT o_orderkey, (((c >> 15) | ((c << 17) % 4294967296)) + 2726488792) % 4294967296 AS masked, c AS back FROM (SELECT o_orderkey, o_orderkey * 1234567 % 4294967296 AS c FROM orders)")
def crc_mask(spark, sf_dir):
    rows = log.table(spark, sf_dir, "orders").select("o_orderkey", F.pmod(F.col("o_orderkey") * 1234567, F.lit(1 << 32)).alias("c"))
    masked = expressions.mask_crc(F.col("c"))
    return rows.select("o_orderkey", masked.alias("masked"), expressions.unmask_crc(masked).alias("back"))


@query()
def crc_masked(spark, sf_dir):
    """Block checksums of the customers' names (no CRC in the SQL to compare with; tests compare with zlib)."""
    rows = log.table(spark, sf_dir, "customer")
    return rows.select("c_custkey", expressions.block_checksum(F.col("c_name").cast("binary"), 0).alias("crc"))


_STEP = f"list_reduce(list_prepend(CAST(xor(3164544308, length(key) * {_M32} % 4294967296) AS HUGEINT), [{', '.join(_word('key', 4 * i) for i in range(4))}]), lambda h, w: xor((h + w) % 4294967296 * {_M32} % 4294967296, ((h + w) % 4294967296 * {_M32} % 4294967296) >> 16))"


@query(
    f"WITH s AS (SELECT c_custkey, key, {_STEP} AS h FROM (SELECT c_custkey, c_name AS key FROM customer)), "
    f"t AS (SELECT c_custkey, CAST((h + ascii(substr(key, 17, 1)) + ascii(substr(key, 18, 1)) * 256) % 4294967296 * {_M32} % 4294967296 AS BIGINT) AS h FROM s) SELECT c_custkey, xor(h, h >> 24) AS h FROM t"
)
def key_hash(spark, sf_dir):
    """The hash of the customers' names, four words and two bytes each."""
    return log.table(spark, sf_dir, "customer").select("c_custkey", expressions.hash32(F.col("c_name").cast("binary"), F.lit(_BLOOM_SEED)).alias("h"))


@query(
    f"WITH {_KEYS}, d AS (SELECT key, before, (SELECT min(j) FROM range(1, 1 + least(length(key), length(before))) t(j) WHERE substr(key, j, 1) <> substr(before, j, 1)) AS pos FROM keys WHERE before IS NOT NULL) "
    "SELECT key, CASE WHEN pos IS NOT NULL AND ascii(substr(before, CAST(pos AS BIGINT), 1)) + 1 < ascii(substr(key, CAST(pos AS BIGINT), 1)) THEN substr(before, 1, CAST(pos - 1 AS BIGINT)) || chr(ascii(substr(before, CAST(pos AS BIGINT), 1)) + 1) ELSE before END AS separator, chr(ascii(key) + 1) AS successor FROM d"
)
def separators(spark, sf_dir):
    """The shortest string between each name and the one before it, and a short one after it."""
    rows = _keys(spark, sf_dir).where(F.col("before").isNotNull())
    between = expressions.separator(F.col("before").cast("binary"), F.col("key").cast("binary"))
    return rows.select("key", between.cast("string").alias("separator"), expressions.successor(F.col("key").cast("binary")).cast("string").alias("successor"))


@query(
    "WITH a AS (SELECT o_custkey, list_sort(list(CAST(o_totalprice AS BIGINT))) AS items FROM orders GROUP BY 1) "
    "SELECT o_custkey, CAST(len(list_filter(items, lambda x: x < 100000)) AS INTEGER) AS lower_bound, CAST(len(list_filter(items, lambda x: x <= 100000)) AS INTEGER) AS upper_bound, least(greatest(o_custkey, 100), 900) AS clipped FROM a"
)
def bounds(spark, sf_dir):
    rows = log.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.round("o_totalprice").cast("long"))).alias("items"))
    target = F.lit(100000)
    return rows.select("o_custkey", expressions.lower_bound(F.col("items"), target).alias("lower_bound"), expressions.upper_bound(F.col("items"), target).alias("upper_bound"), expressions.clip(F.col("o_custkey"), 100, 900).alias("clipped"))


_NAMES = ["%06d.log", "%06d.ddb", "MANIFEST-%06d", "%06d.tmp", "CURRENT", "LOCK", "LOG", "LOG.old", "%06d.txt"]
_KIND_NAMES = ["log", "table", "manifest", "temp", "current", "lock", "info", "info", None]


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 < 4 THEN CAST(p_partkey AS BIGINT) * 1000 WHEN p_partkey % 9 < 8 THEN 0 END AS number, CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KIND_NAMES) if k) + " END AS kind FROM part")
def file_names(spark, sf_dir):
    """Names of all eight kinds of files, and one of none."""
    key, name = F.col("p_partkey"), F.lit(None).cast("string")
    for i, pattern in enumerate(_NAMES):
        name = F.when(key % 9 == i, F.format_string(pattern, key * 1000) if "%" in pattern else F.lit(pattern)).otherwise(name)
    rows = log.table(spark, sf_dir, "part").select("p_partkey", expressions.file_kind(name).alias("f"))
    return rows.select("p_partkey", F.col("f.number").cast("long").alias("number"), "f.kind")
