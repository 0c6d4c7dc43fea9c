"""Relational operators against plain Python, over keys of several types."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stratalog.operators import compaction, files, order, read, write


def log_rows(n=400, keys=40, seed=1):
    rng = random.Random(seed)
    return [(b"k%03d" % rng.randrange(keys), i + 1, int(rng.random() < 0.7), b"v%d" % i) for i in range(n)]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(log_rows(), "k binary, seq long, op int, v binary").repartition(3).cache()


def newest(rows, bound):
    best = {}
    for k, s, op, v in rows:
        if s <= bound and s > best.get(k, (0,))[0]:
            best[k] = (s, op, v)
    return best


def plain(df):
    return [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()]


# Reads


@pytest.mark.parametrize("bound", [0, 1, 100, 400, 10**9])
def test_views(log, bound):
    best = newest(log_rows(), bound)
    assert sorted(plain(read.visible(log, bound))) == sorted((k, s, v) for k, (s, op, v) in best.items() if op)
    assert sorted(plain(read.deleted(log, bound))) == sorted((k, s) for k, (s, op, _) in best.items() if not op)
    key = b"k007"
    want = [(key, best[key][0], best[key][2])] if best.get(key, (0, 0))[1] else []
    assert plain(read.get(log, key, bound)) == want


def test_orders(log):
    view = read.visible(log)
    rows = sorted(plain(view))
    keys = [r[0] for r in rows]
    assert sorted(plain(read.ranked(view).select("k", "position"))) == [(k, i) for i, k in enumerate(keys, 1)]
    assert sorted(plain(read.ranked(view, reverse=True).select("position", "k"))) == [(i, k) for i, k in enumerate(reversed(keys), 1)]
    assert sorted(plain(read.neighbours(view).select("k", "prev_k", "next_k"))) == list(zip(keys, [None, *keys], [*keys[1:], None], strict=False))
    internal = sorted(log_rows(), key=lambda r: (r[0], -r[1]))
    assert [r[:2] for r in plain(read.internal_order(log).orderBy("position").select("k", "seq"))] == [r[:2] for r in internal]
    lists = dict(plain(read.listing(log)))
    by_key = defaultdict(list)
    for k, _, op, v in internal:
        by_key[k].append(v.decode() if op else "DEL")
    assert lists == {k: f"[ {', '.join(v)} ]" for k, v in by_key.items()}


def test_cursor_moves(log):
    view = read.visible(log)
    keys = sorted(r[0] for r in plain(view))
    first = lambda df: [r[0] for r in plain(df)]
    assert first(read.first(view)) == keys[:1] and first(read.last(view)) == keys[-1:]
    for t in (b"", b"k010", b"k010x", b"z"):
        assert first(read.seek(view, t)) == [k for k in keys if k >= t][:1]
        assert first(read.seek_before(view, t)) == [k for k in keys if k < t][-1:]
        assert first(read.page(view, t, 3)) == [k for k in keys if k > t][:3]
        assert first(read.page(view, t, 3, reverse=True)) == [k for k in reversed(keys) if k < t][:3]
    assert sorted(first(read.scan(view, b"k005", b"k020"))) == [k for k in keys if b"k005" <= k < b"k020"]
    assert not read.valid(view.limit(0))


def test_empty_tables(spark, log):
    none = log.limit(0)
    view = read.visible(none)
    for df in (view, read.ranked(view), read.neighbours(view), read.internal_order(none), read.listing(none), compaction.retained(none, 5), read.multi_get(view, view)):
        assert df.collect() == []
    assert order.merged([], "k long", spark).columns == ["k"] and order.merged([log], "", spark) is log
    assert order.merged([log, log, none], "", spark).count() == 800


def test_cells_of_any_sample(spark):
    for keys in ([], [5], [1] * 50, list(range(1000))):
        rows = spark.createDataFrame([(k,) for k in keys], "k long")
        cuts = order.bounds(rows.select(F.col("k").alias("key")), 8)
        assert cuts == sorted(set(cuts)) and len(cuts) < 8
        cells = order.celled(rows, "k", 8).orderBy("k").collect()
        assert [r["__cell"] for r in cells] == sorted(r["__cell"] for r in cells)
    wide = order.celled(spark.range(1000).withColumnRenamed("id", "k"), "k", 8).groupBy("__cell").count().collect()
    assert len(wide) == 8 and max(r["count"] for r in wide) < 200


@pytest.mark.parametrize("as_bytes", [False, True])
def test_next_mark(spark, as_bytes):
    rng = random.Random(3)
    key = (lambda n: b"%05d" % n) if as_bytes else (lambda n: n)
    kind = "binary" if as_bytes else "long"
    marks = [(key(rng.randrange(0, 9000, 7)), i) for i in range(200)]
    targets = [(key(rng.randrange(10_000)), f"x{i}") for i in range(500)] + [(marks[0][0], "same")]
    got = order.next_mark(spark.createDataFrame(targets, f"t {kind}, name string"), spark.createDataFrame(marks, f"key {kind}, mark long"), 16)
    want = {name: min(((k, m) for k, m in marks if k >= t), default=(None, None))[1] for t, name in targets}
    assert {r["name"]: r["mark"] for r in got.collect()} == want
    none = order.next_mark(spark.createDataFrame(targets[:3], f"t {kind}, name string"), spark.createDataFrame([], f"key {kind}, mark long"))
    assert {r["mark"] for r in none.collect()} == {None}


# Files


def random_files(as_bytes, n=120, seed=4):
    rng = random.Random(seed)
    key = (lambda x: b"%06d" % x) if as_bytes else (lambda x: x)
    out = []
    for i in range(n):
        lo = rng.randrange(5000)
        out.append((rng.randrange(4), i, rng.randrange(1, 99) * 10_000, key(lo), key(lo + rng.choice((0, 3, 50, 2000)))))
    return out


@pytest.mark.parametrize("as_bytes", [False, True])
def test_intervals(spark, as_bytes):
    rows, kind = random_files(as_bytes), "binary" if as_bytes else "long"
    table = spark.createDataFrame(rows, f"level int, file_no long, size long, lo {kind}, hi {kind}")
    met = lambda a, b: a[3] <= b[4] and b[3] <= a[4]
    assert sorted(plain(files.overlaps(table).select("a_file_no", "b_file_no"))) == sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and met(a, b))
    below = defaultdict(int)
    for a in rows:
        for b in rows:
            if b[0] == a[0] + 1 and met(a, b):
                below[a[0], a[1]] += b[2]
    assert {(r[0], r[1]): r[2] for r in plain(files.next_level_overlap(table))} == below
    assert files.most_overlap(table).first()[0] == max(n for (level, _), n in below.items() if level >= 1)
    keys = [rows[i][3] for i in range(0, 120, 9)]
    probes = files.files_for_keys(table, spark.createDataFrame([(k,) for k in keys], f"key {kind}"))
    want = [(k, f[1], i) for k in set(keys) for i, f in enumerate(sorted((f for f in rows if f[3] <= k <= f[4]), key=lambda f: (f[0], -f[1])), 1)]
    assert sorted(plain(probes.select("key", "file_no", "probe"))) == sorted(want)
    marked = {r[1]: r for r in plain(files.islands(table).select("level", "file_no", "island"))}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and met(a, b):
                assert marked[a[1]][2] == marked[b[1]][2]
    for level in range(4):
        number, reach = 0, None
        for f in sorted((f for f in rows if f[0] == level), key=lambda f: (f[3], f[1])):
            number, reach = (number + 1, f[4]) if reach is None or f[3] > reach else (number, max(reach, f[4]))
            assert marked[f[1]][2] == number


def rows_of(df, name):
    """The most rows that a node of this name gave, after a run of df."""
    df.collect()
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
        metric = node.metrics().get("numOutputRows")
        if name in kind and metric.isDefined():
            found.append(metric.get().value())
    return max(found)


@pytest.mark.parametrize("same_lo", [False, True])
def test_many_long_files(spark, same_lo):
    """Level 0 files that all overlap: far fewer rows than pairs go into the join, and no task has most of the pairs."""
    n = 600
    rows = [(0, i, 1, 0 if same_lo else i * 7 % n, 5000 + i % 50) for i in range(n)] + [(1, n + i, 1, 10 * i, 10 * i + 9) for i in range(n)]
    table = spark.createDataFrame(rows, "level int, file_no long, size long, lo long, hi long")
    cells = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        pairs = files.overlaps(table).select("a_level", "a_file_no", "b_file_no")
        assert sorted(plain(pairs)) == [(0, a, b) for a in range(n) for b in range(a + 1, n)]
        assert rows_of(pairs, "Generate") < n * (n - 1) // 2 // 10
        tasks = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert max(tasks) < sum(tasks) // 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", cells)


def test_overlapping_pairs_keep_both_sides(spark):
    """Either side of a pair has its own columns, in the order of the files' numbers."""
    rows = [(0, 9, 90, 1, 5), (0, 4, 40, 5, 8), (0, 5, 50, 9, 3), (0, 6, 60, 8, 8), (1, 7, 70, 5, 5)]
    table = spark.createDataFrame(rows, "level int, file_no long, size long, lo long, hi long")
    found = files.overlaps(table)
    assert found.columns == [f"{p}_{c}" for p in "ab" for c in table.columns]
    assert sorted(plain(found)) == [(*rows[1], *rows[3]), (*rows[1], *rows[0])]


def charges_of(rows, asked):
    """The charges by plain Python: every file tried with every key."""
    charges = defaultdict(int)
    for k in asked:
        held = sorted((f for f in rows if k is not None and f[3] <= k <= f[4]), key=lambda f: (f[0], -f[1]))
        if len(held) > 1:
            charges[held[0][1]] += 1
    return charges


@pytest.mark.parametrize("as_bytes", [False, True])
def test_charges(spark, as_bytes):
    """Keys in gaps, at both ends of files, in one file, in many, null; files of one key; ranges with their ends swapped."""
    rng, key, kind = random.Random(8), (lambda x: b"%06d" % x) if as_bytes else (lambda x: x), "binary" if as_bytes else "long"
    rows = random_files(as_bytes, 40, 5) + [(0, 900, 1, key(8000), key(8000)), (0, 901, 1 << 30, key(8000), key(8000)), (3, 902, 1, key(8100), key(8050)), (2, 903, 1, key(9000), key(9001))]
    asked = [rng.choice((key(rng.randrange(9100)), *rng.choice(rows)[3:])) for _ in range(900)] + [key(8000)] * 5 + [key(8070), key(9000), None]
    table = spark.createDataFrame(rows, f"level int, file_no long, size long, lo {kind}, hi {kind}")
    got = {r["file_no"]: (r["charges"], r["allowed_seeks"]) for r in files.charged(table, spark.createDataFrame([(k,) for k in asked], f"key {kind}")).collect()}
    want = charges_of(rows, asked)
    assert got == {f[1]: (want[f[1]], max(f[2] // 16384, 100)) for f in rows} and want[901] >= 5
    assert {r["charges"] for r in files.charged(table, spark.createDataFrame([], f"key {kind}")).collect()} == {0}


def test_charges_of_many_long_files(spark):
    """Keys that each are in all files: the work grows with files and keys, not with the pairs of them."""
    n = 300
    rows = [(0, i, 1, i, 9000 - i) for i in range(n)]
    asked = [1000 + 7 * i for i in range(n)] + [i for i in range(0, n, 9)]
    df = files.charged(spark.createDataFrame(rows, "level int, file_no long, size long, lo long, hi long"), spark.createDataFrame([(k,) for k in asked], "key long"))
    want = charges_of(rows, asked)
    assert {r["file_no"]: r["charges"] for r in df.collect()} == {i: want[i] for i in range(n)}
    assert rows_of(df, "") < n * n // 5


def test_open_ended_overlaps(spark):
    held = spark.createDataFrame([(1, 1, 1, "p", "q"), (2, 2, 1, "150", "200"), (2, 3, 1, "200", "250"), (2, 4, 1, "300", "350"), (2, 5, 1, "400", "450")], "level int, file_no long, size long, lo string, hi string")
    cases = [
        (1, "a", "b", False), (1, "z1", "z2", False), (1, "a", "p", True), (1, "a", "q", True), (1, "p", "p1", True), (1, "p1", "p2", True), (1, "q", "q1", True), (1, None, "j", False), (1, "r", None, False),
        (1, None, "p", True), (1, "q", None, True), (1, None, None, True), (2, "100", "149", False), (2, "251", "299", False), (2, "451", "500", False), (2, "351", "399", False), (2, "100", "150", True),
        (2, "100", "500", True), (2, "375", "400", True), (2, "450", "450", True), (2, None, "149", False), (2, "451", None, False), (3, None, None, False), (3, "a", "z", False),
    ]
    asked = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "range_id int, level int, lo string, hi string")
    assert {r["range_id"]: r["overlaps"] for r in files.has_overlap(held, asked).collect()} == {i: c[3] for i, c in enumerate(cases)}
    found = files.find_file(held.where("level = 2"), spark.createDataFrame([(t,) for t in ("100", "150", "200", "201", "250", "251", "300", "351", "450", "451")], "t string"))
    assert {r["t"]: r["file_no"] for r in found.collect()} == {"100": 2, "150": 2, "200": 2, "201": 3, "250": 3, "251": 4, "300": 4, "351": 5, "450": 5}
    assert [r["level"] for r in files.ranges(held).orderBy("level").collect()] == [1, 2]


def test_sizes_by_blocks(spark):
    rng = random.Random(6)
    entries = [(level, f, b"%02d%03d" % (f, rng.randrange(300)), s, rng.choice((50, 700, 9000))) for s, (level, f) in enumerate((rng.choice((1, 2)), rng.randrange(6)) for _ in range(600))]
    rows = spark.createDataFrame(entries, "level int, file_no long, k binary, seq long, bytes long")
    held = rows.groupBy("level", "file_no").agg(F.sum("bytes").alias("size"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    blocks, want = [], defaultdict(list)
    for key in {e[:2] for e in entries}:
        upto = 0
        for e in sorted((e for e in entries if e[:2] == key), key=lambda e: (e[2], -e[3])):
            if not want[key] or upto // 4096 != want[key][-1][0]:
                want[key].append([upto // 4096, upto, 0, b""])
            want[key][-1][2] += e[4]
            want[key][-1][3] = e[2]
            upto += e[4]
        blocks += [(*key, *b) for b in want[key]]
    index = files.block_index(rows)
    assert sorted(plain(index)) == sorted(blocks)

    def before(t):
        total = 0
        for r in held.collect():
            lo, hi = bytes(r["lo"]), bytes(r["hi"])
            total += r["size"] if hi <= t else 0 if lo > t else min(b[1] for b in want[r["level"], r["file_no"]] if b[3] >= t)
        return total

    asked = [(1, b"", b"99"), (2, b"01100", b"03200"), (3, b"02", b"02"), (4, b"04", b"01"), (5, b"zz", b"zzz"), (6, bytes(entries[0][2]), bytes(entries[0][2]) + b"\0")]
    got = files.approximate_sizes(held, index, spark.createDataFrame(asked, "range_id int, start binary, stop binary"))
    assert dict(plain(got)) == {i: max(0, before(z) - before(a)) for i, a, z in asked}
    one = index.where("level = 1 and file_no = 2")
    targets = [b"", b"02150", b"99"]
    mine = want[1, 2]
    places = {t: min((b[1] for b in mine if b[3] >= t), default=sum(b[2] for b in mine)) for t in targets}
    assert dict(plain(files.block_offsets(one, spark.createDataFrame([(t,) for t in targets], "t binary")))) == places


def test_edits_and_levels(spark):
    schema = "level int, file_no long, size long, lo long, hi long"
    base = spark.createDataFrame([(1, 1, 5, 0, 9), (1, 2, 5, 10, 19), (2, 3, 5, 0, 99)], schema)
    added = spark.createDataFrame([(1, 2, 7, 10, 12), (2, 4, 1, 50, 60)], schema)
    gone = spark.createDataFrame([(1, 2, 0, 0, 0), (1, 1, 0, 0, 0)], schema)
    after = files.apply_edits(base, added, gone)
    assert sorted(plain(after)) == [(1, 2, 7, 10, 12), (2, 3, 5, 0, 99), (2, 4, 1, 50, 60)]
    assert [(r["a_file_no"], r["b_file_no"]) for r in files.misplaced(after).collect()] == [(3, 4)]
    grown = files.overlapping(spark.createDataFrame([(0, 1, 1, 150, 600), (0, 2, 1, 400, 500), (0, 3, 1, 550, 700), (0, 4, 1, 800, 900)], schema), 0, 450, 460)
    assert sorted(r["file_no"] for r in grown.collect()) == [1, 2, 3]
    assert sorted(r["file_no"] for r in files.overlapping(base, 1, None, 9).collect()) == [1]
    pointers = spark.createDataFrame([(1, 9), (2, 99)], "level int, pointer long")
    assert sorted(plain(files.pick_file(base, pointers))) == [(1, 2, False), (2, 3, True)]
    flush = files.output_levels(base, spark.createDataFrame([(1, 5, 6), (2, 60, 70), (3, 1000, 1001)], "range_id int, a long, z long"))
    assert sorted(plain(flush)) == [(1, 0), (2, 1), (3, 2)]


# Compaction


@pytest.mark.parametrize("bound", [0, 150, 400])
def test_retained_versions_by_replay(spark, log, bound):
    deeper = [(b"k010", b"k015"), (b"k030", b"k030")]

    def replay(spans):
        out, last = [], {}
        for k, s, op, v in sorted(log_rows(), key=lambda r: (r[0], -r[1])):
            newer = last.get(k)
            last[k] = s
            if newer is not None and newer <= bound or not op and s <= bound and not any(a <= k <= z for a, z in spans):
                continue
            out.append((k, s, op, v))
        return sorted(out)

    assert sorted(plain(compaction.retained(log, bound))) == replay([])
    table = spark.createDataFrame(deeper, "lo binary, hi binary")
    assert sorted(plain(compaction.retained(log, bound, table))) == replay(deeper)
    kept = len(replay([]))
    reasons = dict(plain(compaction.reasons(log, bound)))
    assert reasons["kept"] == kept and sum(reasons.values()) == 400


def test_cuts(spark):
    rng = random.Random(2)
    rows = [(r, p, rng.randrange(1, 900)) for r in range(3) for p in range(60)]
    got = {(r["run"], r["position"]): r["block"] for r in compaction.cut_by_size(spark.createDataFrame(rows, "run long, position long, bytes long"), 1000).collect()}
    for run in range(3):
        block = size = 0
        for r, p, n in rows:
            if r == run:
                assert got[r, p] == block
                size += n
                if size >= 1000:
                    block, size = block + 1, 0
    keys = sorted({(rng.randrange(3), rng.randrange(2000)) for _ in range(300)})
    below = sorted((hi, rng.randrange(1, 90)) for hi in rng.sample(range(2000), 80))
    cut = compaction.cut_by_grandparents(spark.createDataFrame(keys, "run long, k long"), spark.createDataFrame(below, "hi long, size long"), 150)
    found = {(r["run"], r["k"]): r["output"] for r in cut.collect()}
    for run in range(3):
        at, seen, size, output = 0, False, 0, 0
        for k in (k for r, k in keys if r == run):
            while at < len(below) and k > below[at][0]:
                size += below[at][1] if seen else 0
                at += 1
            seen = True
            if size > 150:
                size, output = 0, output + 1
            assert found[run, k] == output
    assert len(found) == len(keys)


# Writes


def test_numbers_gaps_and_decoded_batches(spark):
    batch = write.WriteBatch(sequence=7).put(b"a", b"1").delete(b"a").put(b"", b"")
    rows = batch.rows(spark)
    assert sorted(plain(write.numbered(rows, 10)), key=lambda r: r[1]) == [(b"a", 11, 1, b"1"), (b"a", 12, 0, None), (b"", 13, 1, b"")]
    assert write.gaps(rows).first()[0] and write.gaps(rows.limit(0)).first()[0]
    assert not write.gaps(rows.where("ordinal > 0")).first()[0] and not write.gaps(rows.unionByName(rows)).first()[0]
    found = write.decoded(spark.createDataFrame([(5, batch.encode())], "id long, data binary"))
    assert plain(found) == [(5, 0, 1, b"a", b"1", 7), (5, 1, 0, b"a", None, 8), (5, 2, 1, b"", b"", 9)]
    with pytest.raises(Exception, match="WriteBatch has wrong count|Malformed"):
        write.decoded(spark.createDataFrame([(5, batch.encode() + b"\x00\x01a")], "id long, data binary")).collect()


def test_group_commit(spark):
    kib = 1 << 10
    rows = [(0, 0, 100 * kib, False), (0, 1, 100 * kib, False), (0, 2, 100 * kib, False), (0, 3, 200 * kib, True), (0, 4, 700 * kib, False), (0, 5, 200 * kib, False), (1, 0, 1, True), (1, 1, 1, False), (1, 2, 1, True)]
    got = {(r["queue"], r["position"]): r["grp"] for r in write.commit_groups(spark.createDataFrame(rows, "queue long, position long, bytes long, sync boolean")).collect()}
    assert [got[0, i] for i in range(6)] == [0, 0, 1, 2, 2, 3] and [got[1, i] for i in range(3)] == [0, 0, 0]


def test_oldest_bound(spark, log):
    assert write.oldest_bound(spark.createDataFrame([(9,), (4,)], "seq long"), log).first()[0] == 4
    assert write.oldest_bound(spark.createDataFrame([], "seq long"), log).first()[0] == 400
