"""Sharding with size-tiered compaction.

Arrivals are appended as small immutable Parquet shards.  Compaction sorts the shards into tiers by size and merges runs
of similar size, tier by tier, into files of about the target size; a row is rewritten once a call, whatever number of
tiers it rises.  What is in the store is what the newest manifest names: manifests are numbered, a new one is renamed
into place only if its number is still free, and files are never changed, so readers see one version or the next.  A
task that is repeated writes under another name, and what it leaves behind is in no manifest.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import unused

#: Bytes of a finished file; size ratio of two tiers, and shards of one tier that are merged; bytes of the lowest tier.
TARGET_BYTES, FAN_IN, LEAST_BYTES = 128 << 20, 4, 1 << 20
_ROWS_BYTES = 32 << 20
_MERGED = "job int, path string, bytes long"
#: Times that a commit is tried while other writers are first.
TRIES = 20


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def tier(size: int) -> int:
    return max(0, math.floor(math.log(max(size, 1) / LEAST_BYTES, FAN_IN))) if size > LEAST_BYTES else 0


def plan(shards: list[dict], target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> list[list[str]]:
    """Lists of paths, each to be merged into one file.

    Within a tier, shards are packed in order of size up to the target; a merged run counts in the tier of its size, so
    that it may be merged further.  Shards of half the target or more are finished.
    """
    runs = [(s["bytes"], [s["path"]]) for s in shards]
    while True:
        tiers: dict[int, list] = {}
        kept: list = []
        for r in sorted(runs, key=lambda r: (r[0], r[1])):
            (tiers.setdefault(tier(r[0]), []) if 2 * r[0] < target else kept).append(r)
        merged = False
        for members in tiers.values():
            if len(members) < fan_in:
                kept += members
                continue
            lots: list = []
            for size, paths in members:
                if lots and lots[-1][0] + size <= target:
                    merged = True
                    lots[-1][0] += size
                    lots[-1][1].append(paths)
                else:
                    lots.append([size, [paths]])
            kept += [(size, [p for paths in lists for p in paths]) for size, lists in lots]
        runs = kept
        if not merged:
            return [paths for _, paths in runs if len(paths) > 1]


def grown(old: str | None, new: T.StructType) -> T.StructType:
    """The columns of both; a column keeps its type."""
    fields = list(T.StructType.fromJson(json.loads(old)).fields) if old else []
    by_name = {f.name: f for f in fields}
    for f in new.fields:
        if f.name not in by_name:
            fields.append(T.StructField(f.name, f.dataType, True))
        elif by_name[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name} is {by_name[f.name].dataType.simpleString()} in the store, not {f.dataType.simpleString()}")
    return T.StructType(fields)


class ShardStore:
    """A versioned set of Parquet shards below `root`, a URI of a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store, self.folder = fs.FileSystem.from_uri(self.root)
        self.store.create_dir(f"{self.folder}/manifests", recursive=True)

    def version(self) -> int:
        found = self.store.get_file_info(fs.FileSelector(f"{self.folder}/manifests"))
        return max((int(f.base_name[1:-5]) for f in found if f.base_name.startswith("v") and f.base_name.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """version, schema (Spark's JSON, null in an empty store) and shards: path, bytes."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        with self.store.open_input_stream(f"{self.folder}/manifests/v{version:010d}.json") as f:
            return json.loads(f.read())

    def commit(self, version: int, schema: str, shards: list[dict]) -> int:
        """Makes `version` the newest; Conflict if it exists."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        tmp = f"manifests/tmp-{uuid.uuid4().hex}"
        with self.store.open_output_stream(f"{self.folder}/{tmp}") as f:
            f.write(json.dumps({"version": version, "schema": schema, "shards": shards}).encode())
        path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(tmp).toUri(), conf)
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(path(tmp), path(f"manifests/v{version:010d}.json"), never)  # fails where the target exists
        except Exception as e:
            self.store.delete_file(f"{self.folder}/{tmp}")
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    def _change(self, change: Callable[[dict], tuple[str, list[dict]]]) -> int:
        """Commits what `change` makes of the newest manifest, anew if another writer was first."""
        for _ in range(TRIES):
            old = self.manifest()
            try:
                return self.commit(old["version"] + 1, *change(old))
            except Conflict:
                continue
        raise Conflict(f"{TRIES} other writers were first")

    def _sizes(self, folder: str) -> list[dict]:
        files = self.store.get_file_info(fs.FileSelector(f"{self.folder}/{folder}", recursive=True))
        return [{"path": f.path[len(self.folder) + 1 :], "bytes": f.size, "mtime": f.mtime.timestamp()} for f in sorted(files, key=lambda f: f.path) if f.base_name.endswith(".parquet")]

    def append(self, rows: DataFrame, arrival: Column | None = None) -> int:
        """Appends rows as new shards, in one version for each value of `arrival` in ascending order (default: one).  All
        arrivals are written in one pass, without a shuffle: every task adds a shard to each arrival it has rows of.
        Columns that the store doesn't have yet are added to it, and are null in older rows; a column's type can't change."""
        (name,) = unused(rows)
        folder, schema = f"data/{uuid.uuid4().hex}", rows.schema
        grown(self.manifest()["schema"], schema)
        rows.withColumn(name, (F.lit(0) if arrival is None else arrival).cast("long")).write.partitionBy(name).parquet(f"{self.root}/{folder}")
        by: dict[str, list[dict]] = {}
        for s in self._sizes(folder):
            del s["mtime"]
            by.setdefault(s["path"].split(f"{name}=", 1)[1].split("/", 1)[0], []).append(s)
        for key in sorted(by, key=lambda k: (not k.lstrip("-").isdigit(), int(k) if k.lstrip("-").isdigit() else 0)):
            self._change(lambda old, own=by[key]: (grown(old["schema"], schema).json(), old["shards"] + own))
        if not by:
            self._change(lambda old: (grown(old["schema"], schema).json(), old["shards"]))
        return self.version()

    def compact(self, target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> int:
        """Merges by plan() and commits the outcome as one version; without anything to merge, the version stays.  Rows
        that were appended meanwhile stay as they are; Conflict if another compaction has taken an input."""
        old = self.manifest()
        jobs = plan(old["shards"], target, fan_in)
        if not jobs:
            return old["version"]
        folder, root = f"data/{uuid.uuid4().hex}", self.root
        schema = to_arrow_schema(T.StructType.fromJson(json.loads(old["schema"])))
        self.store.create_dir(f"{self.folder}/{folder}", recursive=True)

        def fitted(part: pa.RecordBatch) -> pa.RecordBatch:
            columns = [part.column(f.name).cast(f.type) if f.name in part.schema.names else pa.nulls(part.num_rows, f.type) for f in schema]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = fs.FileSystem.from_uri(root)
            for batch in batches:
                for job, paths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    path = f"{folder}/merged-{uuid.uuid4().hex}.parquet"
                    held, size = [], 0
                    with pq.ParquetWriter(f"{base}/{path}", schema, filesystem=store, compression="snappy", coerce_timestamps="us", allow_truncated_timestamps=True) as writer:
                        for p in paths:
                            with store.open_input_file(f"{base}/{p}") as source:
                                for part in pq.ParquetFile(source).iter_batches(2048):
                                    held.append(fitted(part))
                                    size += part.nbytes
                                    if size > _ROWS_BYTES:
                                        writer.write_table(pa.Table.from_batches(held))
                                        held, size = [], 0
                        if held:
                            writer.write_table(pa.Table.from_batches(held))
                    yield pa.RecordBatch.from_pydict({"job": pa.array([job], pa.int32()), "path": [path], "bytes": [store.get_file_info(f"{base}/{path}").size]})

        todo = self.spark.createDataFrame(list(enumerate(jobs)), "job int, paths array<string>")
        merged = todo.repartition(len(jobs), "job").mapInArrow(merge, _MERGED).collect()  # a row a file
        gone = {p for j in jobs for p in j}
        made = [{"path": r["path"], "bytes": r["bytes"]} for r in sorted(merged, key=lambda r: r["job"])]

        def change(now: dict) -> tuple[str, list[dict]]:
            if not gone <= {s["path"] for s in now["shards"]}:
                raise RuntimeError("another compaction has merged these shards")
            return now["schema"], [s for s in now["shards"] if s["path"] not in gone] + made

        return self._change(change)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (default: the newest)."""
        found = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(found["schema"])) if found["schema"] else T.StructType([])
        if not found["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s['path']}" for s in found["shards"]])

    def vacuum(self, keep: int = 1, older_than_s: float = 86_400) -> int:
        """Deletes the files that none of the newest `keep` versions names, and older manifests; the number of files.  Files
        younger than older_than_s stay: they may belong to an append that hasn't committed yet."""
        before = time.time() - older_than_s
        newest = self.version()
        kept = {s["path"] for v in range(max(1, newest - keep + 1), newest + 1) for s in self.manifest(v)["shards"]}
        gone = [s["path"] for s in self._sizes("data") if s["path"] not in kept and s["mtime"] <= before]
        for p in gone:
            self.store.delete_file(f"{self.folder}/{p}")
        for v in range(1, newest - keep + 1):
            path = f"{self.folder}/manifests/v{v:010d}.json"
            if self.store.get_file_info(path).type == fs.FileType.File:
                self.store.delete_file(path)
        return len(gone)


def sharded(rows: DataFrame, root: str, arrival: Column | None = None, target: int = TARGET_BYTES) -> DataFrame:
    """rows, appended in their arrivals to a store at root, compacted, and read back from the newest manifest.

    Rows are kept as they are: nulls, empty and very long texts, repeated rows, and all columns; a null arrival comes last.
    An empty table makes a version without shards.
    """
    store = ShardStore(rows.sparkSession, root)
    store.append(rows, arrival)
    store.compact(target)
    return store.read()


SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"
