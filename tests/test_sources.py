"""Write-ahead logs and streams."""

import os

from pyspark.sql import functions as F

from stratalog.functions import codec
from stratalog.operators import read
from stratalog.sources import wal
from stratalog.sources.store import Store
from stratalog.streaming import ingest

LOG = "seq long, op int, k binary, v binary"


def plain(df):
    return sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect())


def test_logs_written_and_read(spark, tmp_path):
    rows = [(i, i % 3 and 1, b"k%d" % (i % 7), b"v" * (i * 50) if i % 3 else None) for i in range(1, 300)]
    rows += [(i, 1, b"", b"") for i in range(400, 410)]  # a gap
    folder = f"file://{tmp_path}/wal"
    made = wal.write_logs(spark.createDataFrame(rows, LOG), folder, batch_rows=20).collect()
    assert sum(r["records"] for r in made) == len(rows) and all(os.path.getsize(r["path"]) == r["bytes"] for r in made)
    assert plain(wal.read_logs(spark, folder).select("seq", "op", "k", "v")) == sorted(rows)
    assert plain(wal.read_logs(spark, folder, 300).select("seq")) == [(i,) for i in range(400, 410)]


def test_broken_logs(spark, tmp_path):
    whole = wal.encode_log([(1, [(1, b"a", b"1")]), (2, [(0, b"a", None), (1, b"b", b"x" * 40_000)])])
    (tmp_path / "1.log").write_bytes(whole)
    (tmp_path / "2.log").write_bytes(wal.encode_log([(9, [(1, b"c", b"3")]), (10, [(1, b"lost", b"")])])[:-1])
    (tmp_path / "3.log").write_bytes(codec.wal_encode([b"short", codec.encode_batch(20, [(1, b"d", b"4")])]))
    (tmp_path / "4.txt").write_bytes(b"no log")
    found = plain(wal.read_logs(spark, f"file://{tmp_path}").select("seq", "k"))
    assert found == [(1, b"a"), (2, b"a"), (3, b"b"), (9, b"c"), (20, b"d")]


def test_replay(spark):
    flushed = spark.createDataFrame([(1, 1, b"a", b"1"), (2, 1, b"b", b"2")], LOG)
    tail = spark.createDataFrame([(2, 1, b"b", b"2"), (3, 0, b"a", None), (4, 1, b"c", b"4")], LOG)
    assert plain(read.visible(wal.replay(flushed, tail)).select("k", "v")) == [(b"b", b"2"), (b"c", b"4")]
    assert wal.replay(flushed.limit(0), tail).count() == 3 and wal.replay(flushed, tail.limit(0)).count() == 2


def _writes(spark, folder, part, rows):
    spark.createDataFrame(rows, "op int, k string, v string, order_key long").coalesce(1).write.mode("append").json(f"{folder}/{part}")


def test_a_stream_into_a_store(spark, tmp_path):
    source, store = f"{tmp_path}/in", Store(spark, f"file://{tmp_path}/db")
    schema = "op int, k string, v string, order_key long"
    _writes(spark, source, "x", [(1, "a", "1", 3), (1, "a", "2", 7), (0, "b", None, 5), (1, "b", "3", 1)])
    stream = lambda: spark.readStream.schema(schema).json(f"{source}/x")
    ingest.ingest(stream(), store, f"{tmp_path}/check").awaitTermination()
    assert {bytes(r["k"]): bytes(r["v"]) for r in store.view().collect()} == {b"a": b"2"} and store.state()["last_seq"] == 4
    assert [bytes(r["k"]) for r in store.log().orderBy("seq").collect()] == [b"b", b"a", b"b", b"a"]
    _writes(spark, source, "x", [(1, "c", "4", 1)])
    ingest.ingest(stream(), store, f"{tmp_path}/check").awaitTermination()
    assert store.state()["last_seq"] == 5
    # A second stream has batch numbers of its own; the first one's, done again, changes nothing.
    _writes(spark, source, "y", [(1, "d", "5", 1)])
    ingest.ingest(spark.readStream.schema(schema).json(f"{source}/y"), store, f"{tmp_path}/other", "other").awaitTermination()
    assert store.get(b"d") == b"5"
    ingest.ingest(stream(), store, f"{tmp_path}/lost").awaitTermination()
    assert store.state()["last_seq"] == 6 and store.state()["marks"] == {"stream:writes": 1, "stream:other": 0}


def test_the_newest_row_of_a_stream(spark, tmp_path):
    source = f"{tmp_path}/in"
    rows = [(b"k%d" % (i % 5), i, int(i % 4 > 0), b"v%d" % i) for i in range(40)]
    for part in (rows[20:], rows[:20]):  # the older ones come late
        spark.createDataFrame(part, "k binary, seq long, op int, v binary").coalesce(1).write.mode("append").parquet(source)
    log = spark.readStream.schema("k binary, seq long, op int, v binary").option("maxFilesPerTrigger", 1).parquet(source)
    query = ingest.latest(log).writeStream.format("memory").queryName("newest").outputMode("update").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.table("newest").groupBy("k").agg(F.max(F.struct("seq", "op", "v")).alias("r"), F.count(F.lit(1)).alias("n")).collect()
    assert {bytes(r["k"]): (r["r"]["seq"], bytes(r["r"]["v"])) for r in found} == {b"k%d" % (i % 5): (i, b"v%d" % i) for i in range(35, 40)}
