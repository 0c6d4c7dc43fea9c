"""The store: reads, snapshots, deletions, levels, recovery, concurrent writers."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from stratalog.functions import codec
from stratalog.operators.write import WriteBatch
from stratalog.plans import picking
from stratalog.sources import store as st
from stratalog.sources.comparator import NUMERIC
from stratalog.sources.store import Conflict, NotFound, Store, StoreError


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/db"


@pytest.fixture
def db(spark, root):
    return Store(spark, root)


def get(db, key, snapshot=None):
    try:
        return db.get(key.encode(), snapshot).decode()
    except NotFound:
        return None


def put(db, **pairs):
    for k, v in pairs.items():
        db.put(k.encode(), v.encode())


def contents(db, **at):
    return "".join(f"({bytes(r['k']).decode()}->{bytes(r['v']).decode()})" for r in db.scan(**at).collect())


def make_tables(db, n, small, large):
    for _ in range(n):
        db.put(small, b"begin")
        db.put(large, b"end")
        db.flush()


# Reads and writes


def test_read_write_and_delete(db):
    put(db, foo="v1", bar="v2")
    put(db, foo="v3")
    assert (get(db, "foo"), get(db, "bar"), get(db, "baz")) == ("v3", "v2", None)
    db.delete(b"foo")
    db.delete(b"never there")
    assert get(db, "foo") is None
    db.flush()
    assert (get(db, "foo"), get(db, "bar")) == (None, "v2")


def test_empty_keys_and_values(db):
    db.put(b"", b"")
    db.put(b"k", b"v1")
    db.put(b"k", b"")
    assert db.get(b"") == b"" and db.get(b"k") == b""
    db.compact_range()
    assert db.get(b"") == b"" and db.get(b"k") == b"" and contents(db) == "(->)(k->)"


def test_a_fresh_tombstone_hides_a_flushed_value(db):
    put(db, k="v")
    db.flush()
    db.delete(b"k")
    assert get(db, "k") is None and contents(db) == ""


def test_a_hole_in_an_upper_level(db):
    put(db, a="1", m="deep", z="1")
    db.flush()
    put(db, b="2", y="2")
    db.flush()
    assert db.levels() == "0,1,1" and get(db, "m") == "deep"


def test_batches_are_atomic_and_the_last_write_wins(db):
    assert db.write(WriteBatch().put(b"a", b"1").delete(b"a").put(b"b", b"2").put(b"b", b"3")) == 4
    assert get(db, "a") is None and get(db, "b") == "3"
    assert db.write(WriteBatch()) == 4


def test_a_table_as_one_batch(spark, db):
    put(db, k5="old")
    rows = spark.range(50).select(F.col("id").alias("ordinal"), F.when(F.col("id") % 10 == 3, 0).otherwise(1).alias("op"), F.concat(F.lit("k"), F.col("id") % 20).cast("binary").alias("k"), F.col("id").cast("string").cast("binary").alias("v"))
    assert db.write(rows) == 51
    want = {f"k{i % 20}": str(i) for i in range(50)}
    for i in range(50):
        if i % 10 == 3 and want.get(f"k{i % 20}") == str(i):
            want[f"k{i % 20}"] = None
    assert {k: get(db, k) for k in want} == want
    assert db.write(rows.limit(0)) == 51
    for bad in (rows.withColumn("ordinal", F.col("ordinal") + 1), rows.withColumn("ordinal", F.floor(F.col("ordinal") / 2)), rows.withColumn("ordinal", F.col("ordinal") * 2)):
        with pytest.raises(StoreError, match="ordinals"):
            db.write(bad)
    assert db.state()["last_seq"] == 51


def test_snapshots(db):
    held = []
    for v in ("v1", "v2", "v3"):
        put(db, foo=v)
        held.append(db.snapshot())
    put(db, foo="v4")
    for flushed in (False, True):
        assert [get(db, "foo", s) for s in held] == ["v1", "v2", "v3"] and get(db, "foo") == "v4"
        if not flushed:
            db.flush()
    assert db.oldest_bound() == held[0]
    db.release(held[1])
    db.compact_range()
    db.release(held[0])
    assert [get(db, "foo", s) for s in held[2:]] == ["v3"]
    db.release(held[2])
    with pytest.raises(StoreError, match="no snapshot"):
        db.release(held[2])
    assert db.oldest_bound() == db.state()["last_seq"] and db.snapshots().collect() == []


def test_an_empty_snapshot_stays_empty(db):
    s = db.snapshot()
    put(db, a="1", b="2")
    assert contents(db, snapshot=s) == ""
    db.flush()
    assert contents(db, snapshot=s) == "" and contents(db) == "(a->1)(b->2)"


def test_scans_and_cursor_moves(spark, db):
    from stratalog.operators import read

    put(db, a="va", b="vb", c="vc")
    db.delete(b"b")
    big = b"x" * 100_000
    db.put(b"d", big)
    keys = lambda df: [bytes(r["k"]).decode() for r in df.collect()]
    for _ in range(2):
        assert keys(db.scan()) == ["a", "c", "d"] and keys(db.scan(reverse=True)) == ["d", "c", "a"]
        assert keys(db.scan(b"b", b"d")) == ["c"] and keys(db.scan(b"z")) == [] and keys(db.scan(hi=b"a")) == []
        view = db.view()
        assert keys(read.seek(view, b"ax")) == ["c"] and keys(read.seek(view, b"z")) == [] and keys(read.seek_before(view, b"c")) == ["a"]
        assert read.valid(view) and not read.valid(read.seek(view, b"z"))
        assert keys(read.page(view, b"a", 2)) == ["c", "d"] and keys(read.page(view, b"d", 5, reverse=True)) == ["c", "a"]
        db.compact_range()
    assert keys(db.multi_get(spark.createDataFrame([(b"a",), (b"b",), (b"a",)], "k binary"))) == ["a"]


def test_a_view_is_pinned(db):
    put(db, a="1")
    seen = db.view()
    put(db, a="2", b="3")
    db.delete(b"a")
    assert [bytes(r["v"]) for r in seen.collect()] == [b"1"]


# Levels


def test_deletion_markers_over_a_value(db):
    put(db, foo="v1")
    db.flush()
    assert db.num_files(2) == 1
    put(db, a="begin", z="end")
    db.flush()
    assert (db.num_files(2), db.num_files(1)) == (1, 1)
    db.delete(b"foo")
    put(db, foo="v2")
    assert db.versions(b"foo") == "[ v2, DEL, v1 ]"
    db.flush()
    assert db.versions(b"foo") == "[ v2, DEL, v1 ]"
    db.compact_level(0, None, b"z")
    assert db.versions(b"foo") == "[ v2, v1 ]"
    db.compact_level(1)
    assert db.versions(b"foo") == "[ v2 ]"


@pytest.mark.parametrize("ranges", [st.RANGES, 0])
def test_deletion_markers_alone(db, monkeypatch, ranges):
    monkeypatch.setattr(st, "RANGES", ranges)
    put(db, foo="v1")
    db.flush()
    put(db, a="begin", z="end")
    db.flush()
    db.delete(b"foo")
    db.flush()
    assert db.versions(b"foo") == "[ DEL, v1 ]"
    db.compact_level(0)
    assert db.versions(b"foo") == "[ DEL, v1 ]"  # a deeper file spans the key
    db.compact_level(1)
    assert db.versions(b"foo") == "[ ]"


def test_hidden_values_are_removed_once_no_snapshot_sees_them(db):
    make_tables(db, 3, b"a", b"z")
    big = "b" * 50_000
    put(db, foo=big, pastfoo="v")
    s = db.snapshot()
    put(db, foo="tiny", pastfoo2="v2")
    db.flush()
    assert db.num_files(0) > 0 and get(db, "foo", s) == big and 50_000 < db.approximate_size(b"", b"pastfoo") < 60_000
    db.release(s)
    assert db.versions(b"foo") == f"[ tiny, {big} ]"
    db.compact_level(0, None, b"x")
    assert db.versions(b"foo") == "[ tiny ]" and db.num_files(0) == 0 and db.num_files(1) >= 1
    db.compact_level(1, None, b"x")
    assert db.versions(b"foo") == "[ tiny ]" and db.approximate_size(b"", b"pastfoo") < 1000


def test_overlap_in_level_0(db):
    put(db, **{"100": "v100", "999": "v999"})
    db.flush()
    db.delete(b"100")
    db.delete(b"999")
    db.flush()
    assert db.levels() == "0,1,1"
    put(db, **{"300": "v300", "500": "v500"})
    db.flush()
    put(db, **{"200": "v200", "600": "v600", "900": "v900"})
    db.flush()
    assert db.levels() == "2,1,1" and db.level_summary() == "files[ 2 1 1 0 0 0 0 ]"
    db.compact_level(1)
    db.compact_level(2)
    assert db.levels() == "2"
    db.delete(b"600")
    db.flush()
    assert db.levels() == "3" and get(db, "600") is None


def test_manual_compaction(db):
    make_tables(db, 3, b"p", b"q")
    assert db.levels() == "1,1,1"
    db.compact_range(b"", b"c")
    db.compact_range(b"r", b"z")
    assert db.levels() == "1,1,1"
    db.compact_range(b"p1", b"p9")
    assert db.levels() == "0,0,1"
    make_tables(db, 3, b"c", b"e")
    assert db.levels() == "1,1,2"
    db.compact_range(b"b", b"f")
    assert db.levels() == "0,0,2"
    make_tables(db, 1, b"a", b"z")
    assert db.levels() == "0,1,2"
    db.compact_range()
    assert db.levels() == "0,0,1"


def test_outputs_are_cut_by_size(spark, root):
    db = Store(spark, root, file_bytes=1 << 20)
    for _ in range(2):
        rows = spark.range(4000).select(F.col("id").alias("ordinal"), F.lit(1).alias("op"), F.format_string("%06d", "id").cast("binary").alias("k"), F.repeat(F.lit("v"), 1000).cast("binary").alias("v"))
        db.write(rows)
        db.flush()
    db.compact_range()
    made = sorted((f for f in db.state()["files"]), key=lambda f: f["lo"])
    assert len(made) >= 3 and all(f["size"] < 3 << 20 for f in made)
    assert all(a["hi"] < b["lo"] for a, b in zip(made, made[1:], strict=False))  # files of a level don't meet
    assert db.view().count() == 4000
    stats = {r["level"]: r for r in db.stats().collect()}
    deepest = max(stats)
    assert stats[deepest]["files"] == len(made) and stats[deepest]["micros"] > 0 and stats[deepest]["read"] > stats[deepest]["written"] > 0


def test_outputs_are_cut_at_grandparents(spark, root, monkeypatch):
    monkeypatch.setattr(picking, "GRANDPARENTS", 0)
    db = Store(spark, root)
    make_tables(db, 1, b"a", b"c")
    db.put(b"d", b"begin")
    db.put(b"f", b"end")
    db.flush()
    base = db.state()["files"]
    assert picking.output_bounds([{**f, "size": 1} for f in base], 1 << 20) == [b"c".hex(), b"f".hex()]
    made = db._add_files(db.log().withColumn("v", F.lit(b"x")), 1, [b"c".hex()])
    assert [(f["lo"], f["hi"]) for f in made] == [(b"a".hex(), b"c".hex()), (b"d".hex(), b"f".hex())]


def test_automatic_and_requested_maintenance(spark, root):
    db = Store(spark, root)
    assert not db.needs_compaction() and not db.maintain()
    make_tables(db, 6, b"a", b"z")
    assert db.num_files(0) == 4 and db.needs_compaction()
    assert db.maintain() and db.num_files(0) == 0
    db.request(1, b"a", b"b")
    assert Store(spark, root).needs_compaction()  # a request is part of the store
    assert Store(spark, root).maintain() and not db.needs_compaction()
    assert db.levels() == "0,0,1" and contents(db) == "(a->begin)(z->end)"


def test_lookups_in_vain_wear_a_file_out(db, monkeypatch):
    monkeypatch.setattr(picking, "LEAST_SEEKS", 2)
    make_tables(db, 2, b"a", b"z")
    assert db.levels() == "0,1,1"
    for _ in range(2):
        assert not db.needs_compaction()
        get(db, "m")
    assert db.needs_compaction() and db.maintain()
    assert db.levels() == "0,0,1" and not db.needs_compaction()


def test_most_overlap_and_properties(db):
    make_tables(db, 2, b"a", b"z")
    below = sum(f["size"] for f in db.state()["files"] if f["level"] == 2)
    assert db.most_overlap() == below > 0
    assert db.property("num-files-at-level1") == 1 and db.property("num-files-at-level7") is None and db.property("num-files-at-level1x") is None and db.property("what") is None
    assert db.property("approximate-memory-usage") == 0 == db.memory_usage()
    put(db, big="x" * 1000)
    assert 1000 < db.property("approximate-memory-usage") < 5 << 20
    assert {r["level"] for r in db.property("stats").collect()} == {1, 2}
    assert db.name == db.root


def test_approximate_sizes(spark, db):
    rows = spark.range(80).select(F.col("id").alias("ordinal"), F.lit(1).alias("op"), F.format_string("key%06d", "id").cast("binary").alias("k"), F.repeat(F.lit("v"), 100_000).cast("binary").alias("v"))
    db.write(rows)
    assert db.approximate_size(b"", b"key000050") == 0  # the buffer doesn't count
    db.flush()
    for i in (0, 10, 79):
        assert 100_000 * i <= db.approximate_size(b"", b"key%06d" % i) <= 105_000 * i
        assert 100_000 <= db.approximate_size(b"key%06d" % i, b"key%06d.suffix" % i) <= 105_000
    assert db.approximate_size(b"", b"xyz") >= 8_000_000 and db.approximate_size(b"x", b"a") == 0


# Opening, recovery, failure


def test_open_options(spark, root):
    with pytest.raises(StoreError, match=r"does not exist \(create_if_missing is false\)"):
        Store(spark, root, create_if_missing=False)
    Store(spark, root)
    Store(spark, root, create_if_missing=False)
    with pytest.raises(StoreError, match=r"exists \(error_if_exists is true\)"):
        Store(spark, root, error_if_exists=True)
    with pytest.raises(StoreError, match="Comparator does not match"):
        Store(spark, root, comparator=NUMERIC)


def test_recovery_replays_what_was_not_flushed(spark, root):
    db = Store(spark, root)
    put(db, foo="v1", baz="v5")
    db = Store(spark, root)
    assert (get(db, "foo"), get(db, "baz")) == ("v1", "v5")
    put(db, bar="v2", foo="v3")
    db = Store(spark, root)
    assert (get(db, "foo"), get(db, "bar"), get(db, "baz")) == ("v3", "v2", "v5")
    put(db, foo="v4")
    assert get(db, "foo") == "v4" and db.state()["last_seq"] == 5


def test_reopening_between_deletes(spark, root):
    for key, value in ((b"b", b"v"), (b"b", None), (b"", b""), (b"e", None), (b"a", b"v"), (b"", None), (b"a", b"v")):
        db = Store(spark, root)
        db.put(key, value) if value is not None else db.delete(key)
    assert contents(Store(spark, root)) == "(a->v)"
    db.compact_range()
    assert contents(Store(spark, root)) == "(a->v)"


def test_checkpoints_and_old_commits(spark, root, monkeypatch):
    monkeypatch.setattr(st, "CHECKPOINT", 4)
    db = Store(spark, root)
    for i in range(11):
        db.put(b"k%d" % (i % 3), b"%d" % i)
    log = f"{root.removeprefix('file://')}/log"
    assert sorted(n for n in os.listdir(log) if n.endswith(".state")) == [f"{n:020d}.state" for n in (1, 4, 8, 12)]
    assert contents(db) == contents(Store(spark, root)) == "(k0->9)(k1->10)(k2->8)"
    assert [bytes(r["v"]) for r in db.view(version=3).orderBy("k").collect()] == [b"0", b"1"]  # an earlier version
    db.flush()
    assert db.vacuum(-60) == 0 and contents(Store(spark, root)) == "(k0->9)(k1->10)(k2->8)"
    with pytest.raises(StoreError, match="is gone"):
        Store(spark, root).state(2)


def test_missing_and_broken_commits(spark, root):
    db = Store(spark, root)
    put(db, a="1", b="2", c="3")
    log = f"{root.removeprefix('file://')}/log"
    path = f"{log}/{3:020d}"
    data = open(path, "rb").read()
    with open(path, "wb") as f:
        f.write(data[:-1] + bytes([data[-1] ^ 1]))
    for name in os.listdir(log):  # the file system's own checksums would notice first
        if name.endswith(".crc"):
            os.remove(f"{log}/{name}")
    with pytest.raises(StoreError, match="its batch is broken"):
        Store(spark, root)
    assert contents(Store(spark, root, paranoid=False)) == "(a->1)(c->3)"
    os.remove(path)
    with pytest.raises(StoreError, match="commit 3 is missing"):
        Store(spark, root)


def test_numeric_comparator(spark, root):
    db = Store(spark, root, comparator=NUMERIC)
    put(db, **{"[10]": "ten", "[0x14]": "twenty"})
    for _ in range(2):
        assert (get(db, "[10]"), get(db, "[0xa]"), get(db, "[20]"), get(db, "[0x14]"), get(db, "[15]"), get(db, "[0xf]")) == ("ten", "ten", "twenty", "twenty", None, None)
        db.compact_range(b"[0]", b"[9999]")
    for run in range(2):
        for i in range(40):
            db.put(b"[%d]" % (i * 10), b"[%d]" % (i * 10 + run))
        db.compact_range(b"[0]", b"[1000000]")
    rows = db.scan(b"[0x10]", b"[100]").collect()
    assert [bytes(r["v"]) for r in rows] == [b"[%d]" % (i * 10 + 1) for i in range(2, 10)]
    assert db.view().count() == 40 and Store(spark, root, comparator=NUMERIC).view().count() == 40


def test_concurrent_writers_lose_nothing(spark, root, monkeypatch):
    a, b = Store(spark, root), Store(spark, root)
    real, first = Store._put_file, []

    def late(self, folder, name, data):
        """b commits after a has read the state and before a commits."""
        if self is a and not first:
            first.append(1)
            b.put(b"b", b"2")
        return real(self, folder, name, data)

    monkeypatch.setattr(Store, "_put_file", late)
    assert a.put(b"a", b"1") == 2
    assert contents(a) == contents(b) == "(a->1)(b->2)"
    assert sorted(r["seq"] for r in a.log().collect()) == [1, 2]


def test_a_table_is_written_anew_if_its_numbers_are_taken(spark, root, monkeypatch):
    a, b = Store(spark, root), Store(spark, root)
    real, first = Store._put_file, []

    def late(self, folder, name, data):
        if self is a and not first:
            first.append(1)
            b.put(b"b", b"2")
        return real(self, folder, name, data)

    monkeypatch.setattr(Store, "_put_file", late)
    rows = spark.createDataFrame([(0, 1, b"x", b"1"), (1, 1, b"y", b"2")], "ordinal long, op int, k binary, v binary")
    assert a.write(rows) == 3 and sorted(r["seq"] for r in a.log().collect()) == [1, 2, 3]


def test_compactions_that_meet(spark, root, monkeypatch):
    a, b = Store(spark, root), Store(spark, root)
    make_tables(a, 3, b"a", b"z")
    real, first = Store._add_files, []

    def late(self, *args):
        if self is a and not first:
            first.append(1)
            b.compact_level(0)
            b.put(b"m", b"new")
        return real(self, *args)

    monkeypatch.setattr(Store, "_add_files", late)
    with pytest.raises(Conflict):
        a.compact_level(0)
    assert contents(a) == "(a->begin)(m->new)(z->end)"
    a.compact_range()
    assert contents(b) == "(a->begin)(m->new)(z->end)"


def test_vacuum_close_and_destroy(spark, root):
    db = Store(spark, root)
    make_tables(db, 3, b"a", b"z")
    db.compact_range()
    assert db.vacuum() == 0  # all is young
    assert db.vacuum(older_than_s=-60) == 4 and contents(db) == "(a->begin)(z->end)"
    foreign = f"{root.removeprefix('file://')}/notes.txt"
    with open(foreign, "w") as f:
        f.write("mine")
    db.close()
    db.close()
    for ask in (lambda: db.get(b"a"), lambda: db.put(b"a", b""), lambda: db.view(), lambda: db.flush(), lambda: db.num_files(0)):
        with pytest.raises(StoreError, match="closed"):
            ask()
    Store(spark, root).destroy()
    assert os.listdir(os.path.dirname(foreign)) == ["notes.txt"]


def test_as_a_dictionary(spark, root):
    """Random writes, batches, flushes, compactions and reopenings against a dictionary, with a snapshot."""
    rng, model, db, held = random.Random(301), {}, Store(spark, root), None
    alphabet = [0, 1, 97, 98, 99, 253, 255]
    key = lambda: bytes(rng.choice(alphabet) for _ in range(rng.randrange(3)))
    for step in range(120):
        p = rng.random()
        if p < 0.45:
            k, v = key(), rng.randbytes(rng.choice((3, 150)))
            db.put(k, v)
            model[k] = v
        elif p < 0.9:
            k = key()
            db.delete(k)
            model.pop(k, None)
        else:
            batch = WriteBatch()
            for _ in range(rng.randrange(8)):
                k = key()
                if rng.random() < 0.5:
                    batch.delete(k)
                    model.pop(k, None)
                else:
                    batch.put(k, b"batch")
                    model[k] = b"batch"
            db.write(batch)
        if step % 30 == 29:
            rng.choice((db.flush, db.compact_range, db.maintain))()
            db = Store(spark, root)
            assert {bytes(r["k"]): bytes(r["v"]) for r in db.view().collect()} == model
            if held:
                assert {bytes(r["k"]): bytes(r["v"]) for r in db.view(held[0]).collect()} == held[1]
                db.release(held[0])
            held = (db.snapshot(), dict(model))


# Planning


def _files(*rows):
    return [{"level": n, "file_no": i, "size": size, "lo": lo.encode().hex(), "hi": hi.encode().hex()} for i, (n, size, lo, hi) in enumerate(rows, 1)]


def test_overlapping_files_of_level_0_grow():
    found = _files((0, 1, "150", "600"), (0, 1, "400", "500"), (0, 1, "550", "700"), (0, 1, "800", "900"), (1, 1, "a", "b"))
    hexed = lambda s: s.encode().hex()
    assert [f["file_no"] for f in picking.meets(found, 0, hexed("450"), hexed("460"))] == [1, 2, 3]
    assert [f["file_no"] for f in picking.meets(found, 0, hexed("850"), None)] == [4]
    assert [f["file_no"] for f in picking.meets(found, 0, None, None)] == [1, 2, 3, 4]
    assert picking.meets(found, 0, hexed("701"), hexed("799")) == []


def test_inputs_grow_where_the_next_level_stays_the_same():
    found = _files((1, 10, "c", "d"), (1, 10, "e", "f"), (1, 10, "g", "h"), (2, 10, "b", "f"), (2, 10, "g", "k"), (3, 10, "a", "e"))
    inputs, below, after = picking.others(found, 1, found[:1], 1000)
    assert [f["file_no"] for f in inputs] == [1, 2] and [f["file_no"] for f in below] == [4] and [f["file_no"] for f in after] == [6]
    small, *_ = picking.others(found, 1, found[:1], 1)  # all would be over 25 files' bytes
    assert [f["file_no"] for f in small] == [1]


def test_scores_and_flush_levels():
    found = _files(*[(0, 1, "a", "b")] * 4, (1, 11 << 20, "a", "z"), (2, 1, "a", "c"))
    assert picking.fullest(found) == (1, 1.1) and picking.fullest(found[:4]) == (0, 1.0) and picking.fullest([])[1] == 0
    level = lambda rows, lo, hi: picking.flush_level(_files(*rows), lo.encode().hex(), hi.encode().hex(), 1 << 20)
    assert level([], "a", "b") == 2
    assert level([(0, 1, "a", "b")], "b", "c") == 0 and level([(1, 1, "a", "b")], "b", "c") == 0 and level([(2, 1, "a", "b")], "b", "c") == 1
    assert level([(2, 11 << 20, "a", "z")], "b", "c") == 0 and level([(3, 11 << 20, "a", "z")], "b", "c") == 1
    assert [picking.allowed_seeks(n) for n in (0, 1 << 20, 16 << 20)] == [100, 100, 1024]


def test_an_edit_that_deletes_and_adds_the_same_file():
    state = {**st.empty_state("bytewise"), "files": [{"level": 1, "file_no": 5, "path": "old"}]}
    after = st.folded(state, b"E" + json.dumps({"removed": [[1, 5]], "added": [{"level": 1, "file_no": 5, "path": "new"}]}).encode())
    assert [f["path"] for f in after["files"]] == ["new"] and after["next_file"] == 6
    with pytest.raises(StoreError, match="isn't there"):
        st.folded(state, b"E" + json.dumps({"removed": [[2, 5]]}).encode())
    log = b"B" + codec.wal_encode([codec.encode_batch(9, [(1, b"k", b"v")])])
    assert st.folded(state, log)["last_seq"] == 9
