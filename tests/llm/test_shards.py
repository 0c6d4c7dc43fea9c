"""Size-tiered compaction: tiers, target sizes, growing schemas, concurrent writers, vacuum."""

import pytest
from pyspark.sql import functions as F

from stratalog.llm import shards

MB = 1 << 20


def _store(spark, tmp_path):
    return shards.ShardStore(spark, f"file://{tmp_path}/store")


def _sizes(sizes):
    return [{"path": f"p{i:04d}", "bytes": s} for i, s in enumerate(sizes)]


def test_plan_merges_runs_of_similar_size():
    target = 64 * MB
    sizes = [MB // 2] * 8 + [5 * MB] * 2 + [40 * MB, 100 * MB]
    (job,) = shards.plan(_sizes(sizes), target, 4)
    assert sorted(job) == [f"p{i:04d}" for i in range(8)]  # two of a tier are too few, and half the target is finished
    total = {p["path"]: p["bytes"] for p in _sizes(sizes)}
    assert sum(total[p] for p in job) <= target


def test_plan_rises_through_the_tiers_up_to_the_target():
    sizes = [MB] * 64
    jobs = shards.plan(_sizes(sizes), 16 * MB, 4)
    assert sorted(len(j) for j in jobs) == [16] * 4
    assert len({p for j in jobs for p in j}) == 64
    assert shards.plan(_sizes([200 * MB] * 9), 128 * MB, 4) == []
    assert shards.plan([], 128 * MB) == []


def test_plan_of_many_shards_is_quick():
    import time

    began = time.time()
    jobs = shards.plan(_sizes([1000 + i % 7 for i in range(200_000)]))
    assert len({p for j in jobs for p in j}) == 200_000 and time.time() - began < 10


def test_versions_and_compaction(spark, tmp_path):
    store = _store(spark, tmp_path)
    rows = spark.range(1000).select("id", (F.col("id") % 5).alias("__arrival"), F.lit(None).cast("string").alias("t"))
    assert store.append(rows, F.col("id") % 4) == 4  # one version an arrival
    assert store.read(1).count() == 250 and store.read().count() == 1000
    assert store.read().columns == rows.columns
    before = len(store.manifest()["shards"])
    version = store.compact()
    assert version == 5 and len(store.manifest()["shards"]) == 1 < before
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, rows.collect()))
    assert store.read(4).count() == 1000  # older versions stay readable
    assert store.compact() == 5  # nothing to merge


def test_compaction_after_the_schema_has_grown(spark, tmp_path):
    store = _store(spark, tmp_path)
    for _ in range(3):
        store.append(spark.createDataFrame([(1, "a")], "id long, text string"))
    store.append(spark.createDataFrame([("b", 2, 0.5)], "text string, id long, score double"))
    store.append(spark.createDataFrame([(3,)], "id long"))
    store.compact()
    assert len(store.manifest()["shards"]) == 1
    assert sorted(map(tuple, store.read().collect()), key=str) == [*[(1, "a", None)] * 3, (2, "b", 0.5), (3, None, None)]
    with pytest.raises(ValueError, match="id is bigint"):
        store.append(spark.createDataFrame([("x",)], "id string"))
    assert store.read().count() == 5


def test_a_taken_version_is_a_conflict_and_appends_go_on(spark, tmp_path, monkeypatch):
    store, other = _store(spark, tmp_path), _store(spark, tmp_path)
    store.append(spark.range(2))
    with pytest.raises(shards.Conflict):
        store.commit(1, spark.range(1).schema.json(), [])
    stale, first = store.manifest(), []
    real = shards.ShardStore.manifest

    def late(self, version=None):
        """Another writer commits after this one has read the manifest."""
        found = real(self, version)
        if self is store and not first and version is None:
            first.append(1)
            other.append(spark.range(10, 13))
        return found

    monkeypatch.setattr(shards.ShardStore, "manifest", late)
    store.append(spark.range(5, 6))
    assert stale["version"] == 1 and sorted(r["id"] for r in store.read().collect()) == [0, 1, 5, 10, 11, 12]


def test_two_compactions_of_the_same_shards(spark, tmp_path, monkeypatch):
    store, other = _store(spark, tmp_path), _store(spark, tmp_path)
    for i in range(5):
        store.append(spark.range(i, i + 1))
    real = shards.ShardStore._change

    def late(self, change):
        if self is store:
            monkeypatch.setattr(shards.ShardStore, "_change", real)
            other.compact()
        return real(self, change)

    monkeypatch.setattr(shards.ShardStore, "_change", late)
    with pytest.raises(RuntimeError, match="another compaction"):
        store.compact()
    assert sorted(r["id"] for r in store.read().collect()) == list(range(5))


def test_vacuum_spares_what_may_not_be_committed_yet(spark, tmp_path):
    store = _store(spark, tmp_path)
    for i in range(5):
        store.append(spark.range(i, i + 1))
    spark.range(3).write.parquet(f"{store.root}/data/in-flight")
    store.compact()
    assert store.vacuum() == 0
    assert store.vacuum(older_than_s=-60) >= 6
    assert store.read().count() == 5 and store.version() == 6
    with pytest.raises(FileNotFoundError):
        store.read(1)


def test_odd_rows_come_back_as_they_are(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "x" * 300_000)], "doc_id long, text string")
    back = shards.sharded(rows, f"file://{tmp_path}/odd", F.col("doc_id"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    empty = shards.sharded(rows.limit(0), f"file://{tmp_path}/none")
    assert empty.columns == rows.columns and empty.collect() == []
