"""A store of keys and values: Parquet files of the change log below a folder, and a log of numbered commits.

A commit is one small file.  It holds either a batch of writes, encoded as a write-ahead log, or an edit of the state:
files that come and go, snapshots, pointers.  A commit is written beside and renamed to the next number, which fails if
that number is taken; the writer then reads what came first and makes its commit anew, so that concurrent writers lose
nothing and no two writes have the same sequence number.  Opening the store replays the commits after the newest
checkpoint, batches included: these are the buffer, which the driver holds and which is bounded by buffer_bytes.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..log import PUT
from ..operators import files, read
from ..operators.write import WriteBatch, entry_bytes, numbered
from ..plans import picking
from .comparator import BYTEWISE, Comparator

LOG_SCHEMA = "k binary, seq long, op int, v binary"
_FILES = "level int, file_no long, path string, size long, n long, lo binary, hi binary, first_seq long, last_seq long"
#: Commits after which the whole state is written once; times that a commit is tried while other writers are first.
CHECKPOINT, TRIES = 20, 50
#: Deeper files up to which a compaction compares tombstones with each one's range.
RANGES = 32


class StoreError(Exception):
    pass


class NotFound(StoreError):
    """The key is absent, or deleted."""


class Conflict(StoreError):
    """Another writer has taken what this one would change."""


def empty_state(comparator: str) -> dict:
    return {"version": 0, "comparator": comparator, "next_file": 1, "last_seq": 0, "files": [], "snapshots": {}, "pointers": {}, "stats": {}, "marks": {}, "manual": [], "tail": []}


def folded(state: dict, commit: bytes, paranoid: bool = True) -> dict:
    """The state after a commit: B and a write-ahead log, or E and an edit.  A log whose record is broken raises, or is
    left out if not paranoid."""
    state = {**state, "version": state["version"] + 1}
    if commit[:1] == b"B":
        records = list(codec.wal_decode(commit[1:]))
        if not records and paranoid:
            raise StoreError(f"commit {state['version']}: its batch is broken")
        for record in records:
            seq, rows = codec.decode_batch(record)
            state["tail"] = [*state["tail"], (seq, rows)]
            state["last_seq"] = seq + len(rows) - 1
        return state
    edit = json.loads(commit[1:])
    if "flushed" in edit:
        state["tail"] = [t for t in state["tail"] if t[0] > edit["flushed"]]
    gone = {tuple(x) for x in edit.get("removed", [])}
    if not gone <= {(f["level"], f["file_no"]) for f in state["files"]}:
        raise StoreError(f"commit {state['version']} removes a file that isn't there")
    state["files"] = [f for f in state["files"] if (f["level"], f["file_no"]) not in gone] + edit.get("added", [])
    state["next_file"] = max([state["next_file"], *(f["file_no"] + 1 for f in edit.get("added", []))])
    state["last_seq"] = max(state["last_seq"], edit.get("last_seq", 0))
    for name in ("snapshots", "pointers", "stats", "marks"):
        merged = {**state[name], **edit.get(name, {})}
        state[name] = {k: v for k, v in merged.items() if v is not None}
    state["manual"] = edit.get("manual", state["manual"])
    return state


def _stored(state: dict) -> str:
    tail = [[seq, [[op, k.hex(), None if v is None else v.hex()] for op, k, v in rows]] for seq, rows in state["tail"]]
    return json.dumps({**state, "tail": tail})


def _loaded(text: bytes) -> dict:
    state = json.loads(text)
    tail = [(seq, [(op, bytes.fromhex(k), None if v is None else bytes.fromhex(v)) for op, k, v in rows]) for seq, rows in state["tail"]]
    return {**state, "tail": tail}


class Store:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        create_if_missing: bool = True,
        error_if_exists: bool = False,
        comparator: Comparator = BYTEWISE,
        buffer_bytes: int = 4 << 20,
        file_bytes: int = 2 << 20,
        keep_versions: int = 1,
        paranoid: bool = True,
    ):
        """Opens the store at root, or makes it.  The comparator's name must be that of the store."""
        self.spark, self.root, self.comparator, self.paranoid = spark, root.rstrip("/"), comparator, paranoid
        self.buffer_bytes = min(max(buffer_bytes, 64 << 10), 1 << 30)
        self.file_bytes = min(max(file_bytes, 1 << 20), 1 << 30)
        self.keep_versions, self.closed = keep_versions, False
        self._jvm, self._conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._seen: dict | None = None
        self._seeks: dict[int, int] = {}
        exists = self.version() > 0
        if not exists and not create_if_missing:
            raise StoreError(f"{root}: does not exist (create_if_missing is false)")
        if exists and error_if_exists:
            raise StoreError(f"{root}: exists (error_if_exists is true)")
        if not exists:
            try:
                self._put_file("log", f"{1:020d}.state", _stored({**empty_state(comparator.name), "version": 1}).encode())
            except Conflict:  # another writer made it
                pass
        if self.state()["comparator"] != comparator.name:
            raise StoreError(f"{comparator.name}: Comparator does not match that of the store, {self.state()['comparator']}")

    @property
    def name(self) -> str:
        return self.root

    # Commits

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _put_file(self, folder: str, name: str, data: bytes) -> None:
        """Writes beside, then renames; Conflict if the name is taken."""
        tmp = self._path(f"{folder}/tmp-{uuid.uuid4().hex}")
        out = self._fs.create(tmp, False)
        out.write(bytearray(data))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(tmp).toUri(), self._conf)
        never = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(tmp), self._fs.makeQualified(self._path(f"{folder}/{name}")), never)
        except Exception as e:
            self._fs.delete(tmp, False)
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(name) from e
            raise

    def _get_file(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def _listed(self) -> tuple[list[int], list[int]]:
        """The numbers of the commits and of the checkpoints."""
        folder = self._path("log")
        if not self._fs.exists(folder):
            return [], []
        found = [m for s in self._fs.listStatus(folder) if (m := re.fullmatch(r"(\d{20})(\.state)?", s.getPath().getName()))]
        return sorted(int(m[1]) for m in found if not m[2]), sorted(int(m[1]) for m in found if m[2])

    def version(self) -> int:
        commits, states = self._listed()
        return max([0, *commits[-1:], *states[-1:]])

    def state(self, version: int | None = None) -> dict:
        """The state at a version, by default the newest: a checkpoint and the commits after it, one after the other."""
        if self.closed:
            raise StoreError("the store is closed")
        commits, states = self._listed()
        newest = max([0, *commits[-1:], *states[-1:]])
        version = newest if version is None else version
        state = self._seen if self._seen and self._seen["version"] <= version else None
        at = max((s for s in states if s <= version), default=0)
        if state is None or state["version"] < at:
            if not at:
                raise StoreError(f"{self.root}: version {version} is gone")
            state = _loaded(self._get_file(f"log/{at:020d}.state"))
        for v in range(state["version"] + 1, version + 1):
            if v not in commits:
                raise StoreError(f"{self.root}: commit {v} is missing")
            state = folded(state, self._get_file(f"log/{v:020d}"), self.paranoid)
        if version == newest:
            self._seen = state
        return state

    def _change(self, make: Callable[[dict], bytes | dict | None]) -> dict:
        """Commits what `make` says for the newest state, anew if another writer was first; None commits nothing."""
        for _ in range(TRIES):
            state = self.state()
            commit = make(state)
            if commit is None:
                return state
            data = commit if isinstance(commit, bytes) else b"E" + json.dumps(commit).encode()
            after = folded(state, data)
            try:
                self._put_file("log", f"{after['version']:020d}", data)
            except Conflict:
                continue
            self._seen = after
            if after["version"] % CHECKPOINT == 0:
                try:
                    self._put_file("log", f"{after['version']:020d}.state", _stored(after).encode())
                except Conflict:
                    pass
            return after
        raise Conflict(f"{TRIES} other writers were first")

    # Writes

    def put(self, key: bytes, value: bytes) -> int:
        return self.write(WriteBatch().put(key, value))

    def delete(self, key: bytes) -> int:
        return self.write(WriteBatch().delete(key))

    def write(self, batch: WriteBatch | DataFrame | None, **marks) -> int:
        """Applies a batch, or a DataFrame (ordinal, op, k, v) with ordinals 0, 1, 2, ..., as one; None flushes.  The last
        sequence number.  marks: notes that are committed with a DataFrame.

        A batch is one commit of its own bytes.  A DataFrame is written as files first; if another writer takes its
        sequence numbers meanwhile, it is written again with the next ones.
        """
        if batch is None:
            return self.flush()
        if isinstance(batch, WriteBatch):
            if not batch.records:
                return self.state()["last_seq"]
            after = self._change(lambda s: b"B" + codec.wal_encode([codec.encode_batch(s["last_seq"] + 1, batch.records)]))
            if self.memory_usage() > self.buffer_bytes:
                self.flush()
            return after["last_seq"]
        for _ in range(TRIES):
            state = self.state()
            made = self._add_files(numbered(batch, state["last_seq"]).select("k", "seq", "op", "v"))
            n = sum(f["n"] for f in made)
            if n:
                first, last = min(f["first_seq"] for f in made), max(f["last_seq"] for f in made)
                different = self._read([f["path"] for f in made]).agg(F.countDistinct("seq")).first()[0]
                if (first, last, different) != (state["last_seq"] + 1, state["last_seq"] + n, n):
                    raise StoreError("ordinals must be 0, 1, 2, ..., each once")
            elif not marks:
                return state["last_seq"]

            def make(now: dict, base=state["last_seq"], made=made, n=n) -> dict:
                if n and now["last_seq"] != base:
                    raise Conflict("other writes came first")
                return {"added": self._numbered_files(made, -1, now), "last_seq": base + n, "marks": marks}

            try:
                return self._change(make)["last_seq"]
            except Conflict:
                continue
        raise Conflict(f"{TRIES} other writers were first")

    def _sorted(self, rows: DataFrame) -> DataFrame:
        """rows with `sk`, the sort key."""
        return rows.withColumn("sk", self.comparator.column(F.col("k")))

    def _add_files(self, rows: DataFrame, n: int | None = None, bounds: list[str] | None = None) -> list[dict]:
        """Writes rows as files of neighbouring keys, in key order and newest first; all versions of a key are in one.

        n: how many files, by default as adaptive execution sees fit.  bounds: keys after which a new file begins.
        """
        path = f"data/{uuid.uuid4().hex}"
        rows = self._sorted(rows).withColumn("cut", F.lit(0))
        if bounds:
            rows = rows.withColumn("cut", reduce(lambda c, b: c + (F.col("sk") > F.lit(bytes.fromhex(b))).cast("int"), bounds, F.lit(0)))
        by_range = rows.repartitionByRange(n, "sk") if n else rows.repartitionByRange("sk")
        by_range.sortWithinPartitions("cut", "sk", F.desc("seq")).select("k", "seq", "op", "v", "cut").write.partitionBy("cut").option("parquet.bloom.filter.enabled#k", "true").parquet(f"{self.root}/{path}")
        made = self._sorted(self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.root}/{path}")).withColumn("file", F.input_file_name())
        size = entry_bytes(F.col("k"), F.col("v"), F.col("op"))
        stats = made.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"), F.min("sk").alias("lo"), F.max("sk").alias("hi"), F.min("seq").alias("a"), F.max("seq").alias("z"))
        found = [{"path": f"{path}/" + "/".join(r["file"].rsplit("/", 2)[1:]), "size": r["size"], "n": r["n"], "lo": bytes(r["lo"]).hex(), "hi": bytes(r["hi"]).hex(), "first_seq": r["a"], "last_seq": r["z"]} for r in stats.collect()]  # a row a file
        return sorted(found, key=lambda f: f["lo"])

    @staticmethod
    def _numbered_files(made: list[dict], level: int, state: dict) -> list[dict]:
        return [{"level": level, "file_no": state["next_file"] + i, **f} for i, f in enumerate(made)]

    # Reads

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(LOG_SCHEMA).parquet(*[f"{self.root}/{p}" for p in paths]).select("k", "seq", "op", "v")

    @staticmethod
    def _tail(state: dict) -> list[tuple[bytes, int, int, bytes | None]]:
        return [(k, seq + i, op, v) for seq, rows in state["tail"] for i, (op, k, v) in enumerate(rows)]

    def log(self, only=lambda f: True, state: dict | None = None, tail: bool = True) -> DataFrame:
        """Every version of every key: the files, and the buffer."""
        state = state or self.state()
        paths = [f["path"] for f in state["files"] if only(f)]
        rows = self._read(paths) if paths else self.spark.createDataFrame([], LOG_SCHEMA)
        held = self._tail(state) if tail else []
        return rows.unionByName(self.spark.createDataFrame(held, LOG_SCHEMA)) if held else rows

    def _newest(self, rows: DataFrame, bound: int) -> DataFrame:
        """The newest row of each key up to bound; keys of one sort key are one."""
        if self.comparator is BYTEWISE:
            return read.newest(rows, bound)
        keyed = self._sorted(rows).withColumnRenamed("k", "key").withColumnRenamed("sk", "k")
        return read.newest(keyed, bound).withColumnRenamed("k", "sk").withColumnRenamed("key", "k")

    def view(self, snapshot: int | None = None, version: int | None = None) -> DataFrame:
        """(k, seq, v) as of a sequence number; unordered."""
        state = self.state(version)
        rows = self._newest(self.log(state=state), state["last_seq"] if snapshot is None else snapshot)
        return rows.where(F.col("op") == PUT).select("k", "seq", "v")

    def scan(self, lo: bytes | None = None, hi: bytes | None = None, snapshot: int | None = None, reverse: bool = False) -> DataFrame:
        """The rows with lo <= key < hi in order.  Files that lie wholly on one side aren't read."""
        state = self.state()
        a, z = None if lo is None else self.comparator.key(lo), None if hi is None else self.comparator.key(hi)
        only = lambda f: (z is None or f["lo"] < z.hex()) and (a is None or f["hi"] >= a.hex())
        rows = self._newest(self.log(only, state), state["last_seq"] if snapshot is None else snapshot).where(F.col("op") == PUT)
        key = self.comparator.column(F.col("k"))
        if a is not None:
            rows = rows.where(key >= F.lit(a))
        if z is not None:
            rows = rows.where(key < F.lit(z))
        return rows.orderBy(key.desc() if reverse else key.asc()).select("k", "seq", "v")

    def get(self, key: bytes, snapshot: int | None = None) -> bytes:
        """The value; NotFound for absent and deleted keys.

        The buffer comes first, and answers alone unless a file whose range holds the key has newer rows (only a table
        that was written after can).  Such files are read in one job.  If there are several, the first that a search level
        by level would try is charged a seek.
        """
        state, sk = self.state(), self.comparator.key(bytes(key))
        bound = state["last_seq"] if snapshot is None else snapshot
        known = [(seq, op, v) for k, seq, op, v in self._tail(state) if seq <= bound and self.comparator.key(k) == sk]
        best = max(known, key=lambda r: r[0], default=(0, None, None))
        holds = [f for f in state["files"] if f["lo"] <= sk.hex() <= f["hi"] and f["first_seq"] <= bound and f["last_seq"] > best[0]]
        if len(holds) > 1:
            first = min(holds, key=lambda f: (f["level"], -f["file_no"]))
            self._seeks[first["file_no"]] = self._seeks.get(first["file_no"], picking.allowed_seeks(first["size"])) - 1
        if holds:
            rows = self._read([f["path"] for f in holds]).where(self.comparator.column(F.col("k")) == F.lit(sk)).where((F.col("seq") <= bound) & (F.col("seq") > best[0]))
            found = rows.orderBy(F.desc("seq")).limit(1).first()
            if found is not None:
                best = (found["seq"], found["op"], None if found["v"] is None else bytes(found["v"]))
        if best[1] != PUT:
            raise NotFound(key)
        return best[2]

    def multi_get(self, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
        return read.multi_get(self.view(snapshot), keys)

    def versions(self, key: bytes) -> str:
        """All versions of a key, newest first, as `[ v2, DEL, v1 ]`."""
        rows = self.log().where(self.comparator.column(F.col("k")) == F.lit(self.comparator.key(key))).orderBy(F.desc("seq")).collect()
        return "[ " + "".join(", " * (i > 0) + (bytes(r["v"]).decode() if r["op"] == PUT else "DEL") for i, r in enumerate(rows)) + " ]" if rows else "[ ]"

    # Snapshots

    def snapshot(self) -> int:
        """Registers the newest sequence number, so that compaction keeps what it sees."""
        return self._change(lambda s: {"snapshots": {str(s["last_seq"]): s["snapshots"].get(str(s["last_seq"]), 0) + 1}})["last_seq"]

    def release(self, snapshot: int) -> None:
        def make(state: dict) -> dict:
            held = state["snapshots"].get(str(snapshot), 0)
            if not held:
                raise StoreError(f"no snapshot {snapshot} is held")
            return {"snapshots": {str(snapshot): held - 1 or None}}

        self._change(make)

    def snapshots(self) -> DataFrame:
        """(seq, held): the registered snapshots."""
        held = [(int(k), n) for k, n in self.state()["snapshots"].items()]
        return self.spark.createDataFrame(held, "seq long, held int")

    def oldest_bound(self) -> int:
        state = self.state()
        return min(map(int, state["snapshots"]), default=state["last_seq"])

    # Maintenance

    def files(self) -> DataFrame:
        rows = [{**f, "lo": bytes.fromhex(f["lo"]), "hi": bytes.fromhex(f["hi"])} for f in self.state()["files"]]
        return self.spark.createDataFrame(rows, _FILES) if rows else self.spark.createDataFrame([], _FILES)

    def flush(self) -> int:
        """The buffer becomes files of the deepest level, up to 2, that it reaches without meeting another."""
        state = self.state()
        tail = [f for f in state["files"] if f["level"] < 0]
        if not tail and not state["tail"]:
            return state["last_seq"]
        flushed = max([0, *(seq for seq, _ in state["tail"])])
        held = sum(f["size"] for f in tail) + self.memory_usage()
        made = self._add_files(self.log(lambda f: f["level"] < 0, state), max(1, -(-held // self.file_bytes)))
        lo, hi = picking.span(made)

        def make(now: dict) -> dict:
            rest = [f for f in now["files"] if f["level"] >= 0]
            if not {f["file_no"] for f in tail} <= {f["file_no"] for f in now["files"] if f["level"] < 0} or not {s for s, _ in state["tail"]} <= {s for s, _ in now["tail"]}:
                raise Conflict("another writer has flushed the buffer")
            level = picking.flush_level(rest, lo, hi, self.file_bytes)
            return {"flushed": flushed, "removed": [(-1, f["file_no"]) for f in tail], "added": self._numbered_files(made, level, now)}

        return self._change(make)["last_seq"]

    def compact(self, level: int, lo: bytes | None = None, hi: bytes | None = None, most: int | None = None) -> bytes | None:
        """Merges the files of `level` that meet [lo, hi] (None: open), and those below that they meet, into the next
        level, without the versions that no reader sees.  most: bytes of inputs after which to stop, beyond level 0.

        The sort key up to which the level is done, to go on from; None if the whole range is.  A single file that meets
        nothing below moves by its metadata alone.  Outputs have about file_bytes each and don't overlap too much of the
        level after next.
        """
        began, state = time.time(), self.state()
        a, z = None if lo is None else lo.hex(), None if hi is None else hi.hex()
        every = picking.meets(state["files"], level, a, z)
        if not every:
            return None
        inputs = picking.first_bytes(every, most) if most and level else every
        done = max(f["hi"] for f in inputs)
        more = bytes.fromhex(done) if len(inputs) < len(every) else None
        inputs, below, grandparents = picking.others(state["files"], level, inputs, self.file_bytes)
        pointers = {str(level): max(f["hi"] for f in inputs)}
        taken = [(f["level"], f["file_no"]) for f in inputs + below]

        def unchanged(now: dict) -> None:
            if not set(taken) <= {(f["level"], f["file_no"]) for f in now["files"]}:
                raise Conflict("another compaction has taken these files")

        if picking.movable(inputs, below, grandparents, self.file_bytes):

            def move(now: dict) -> dict:
                unchanged(now)
                return {"removed": taken, "added": [{**inputs[0], "level": level + 1}], "pointers": pointers}

            self._change(move)
            return more
        read_bytes = picking.total(inputs + below)
        rest = [f for f in state["files"] if (f["level"], f["file_no"]) not in taken]
        first, last = picking.span(inputs, below)
        deeper = [(bytes.fromhex(f["lo"]), bytes.fromhex(f["hi"])) for f in rest if f["level"] > level + 1 and f["lo"] <= last and f["hi"] >= first]
        numbers = {f["file_no"] for f in inputs + below}
        kept = self._retained(self.log(lambda f: f["file_no"] in numbers, state, tail=False), self.oldest_bound(), deeper)
        made = self._add_files(kept, max(1, -(-read_bytes // self.file_bytes)), picking.output_bounds(grandparents, self.file_bytes))

        def install(now: dict) -> dict:
            unchanged(now)
            old = now["stats"].get(str(level + 1), [0, 0, 0])
            stats = [old[0] + int(1e6 * (time.time() - began)), old[1] + read_bytes, old[2] + picking.total(made)]
            return {"removed": taken, "added": self._numbered_files(made, level + 1, now), "pointers": pointers, "stats": {str(level + 1): stats}}

        self._change(install)
        return more

    def _retained(self, rows: DataFrame, bound: int, deeper: list[tuple[bytes, bytes]]) -> DataFrame:
        """The rows that readers at bound and later can still see; a tombstone stays where a deeper range spans its key.  A
        few ranges are a filter, more of them an interval join with the tombstones' keys."""
        after = rows.where(F.col("seq") > bound)
        last = self._newest(rows, bound)
        values, dead = last.where(F.col("op") == PUT), last.where(F.col("op") != PUT)
        if len(deeper) <= RANGES:
            key = self.comparator.column(F.col("k"))
            dead = dead.where(reduce(lambda c, r: c | key.between(F.lit(r[0]), F.lit(r[1])), deeper, F.lit(False)))
        else:
            table = self.spark.createDataFrame(deeper, "lo binary, hi binary")
            keyed = self._sorted(dead.select(*after.columns)).withColumn("to", F.col("sk"))
            dead = files.interval_join(keyed, table, "sk", "to", "lo", "hi").select(*after.columns).distinct()
        return after.unionByName(values.select(*after.columns)).unionByName(dead.select(*after.columns))

    def compact_range(self, lo: bytes | None = None, hi: bytes | None = None) -> None:
        """Flushes, then compacts the range level by level down to the deepest that holds any of it."""
        self.flush()
        a, z = None if lo is None else self.comparator.key(lo), None if hi is None else self.comparator.key(hi)
        found = self.state()["files"]
        deepest = max((n for n in range(files.LEVELS) if picking.meets(found, n, None if a is None else a.hex(), None if z is None else z.hex())), default=0)
        for level in range(max(1, deepest)):
            self.compact_level(level, a, z)

    def compact_level(self, level: int, lo: bytes | None = None, hi: bytes | None = None) -> None:
        """Compacts a level's range of sort keys, in steps of about one file."""
        while (done := self.compact(level, lo, hi, self.file_bytes)) is not None:
            lo = done + b"\0"

    def request(self, level: int, lo: bytes | None = None, hi: bytes | None = None) -> None:
        """Asks for a range of keys of a level to be compacted; maintain() does it step by step, whoever calls it."""
        a, z = [None if b is None else self.comparator.key(b).hex() for b in (lo, hi)]
        self._change(lambda s: {"manual": [*s["manual"], [level, a, z]]})

    def needs_compaction(self) -> bool:
        state = self.state()
        return bool(state["manual"]) or picking.fullest(state["files"])[1] >= 1 or self._worn(state) is not None

    def _worn(self, state: dict) -> dict | None:
        """A file that has been charged as many seeks as it is allowed."""
        return next((f for f in state["files"] if f["level"] < files.LEVELS - 1 and self._seeks.get(f["file_no"], 1) <= 0), None)

    def maintain(self) -> bool:
        """One step: the buffer is flushed if it is full, then a requested compaction goes on, else the fullest level over
        its budget is compacted from its pointer on, else a file that too many lookups tried in vain."""
        if self.memory_usage() > self.buffer_bytes or any(f["level"] < 0 for f in self.state()["files"]):
            self.flush()
        state = self.state()
        if state["manual"]:
            level, lo, hi = state["manual"][0]
            done = self.compact(level, None if lo is None else bytes.fromhex(lo), None if hi is None else bytes.fromhex(hi), self.file_bytes)
            following = [] if done is None else [[level, (done + b"\0").hex(), hi]]
            self._change(lambda s: {"manual": [*following, *s["manual"][1:]]})
            return True
        level, score = picking.fullest(state["files"])
        if score >= 1:
            rows = sorted((f for f in state["files"] if f["level"] == level), key=lambda f: (f["lo"], f["file_no"]))
            first = next((f for f in rows if f["hi"] > state["pointers"].get(str(level), "")), rows[0])
        elif (worn := self._worn(state)) is not None:
            level, first = worn["level"], worn
            self._seeks.pop(worn["file_no"])
        else:
            return False
        self.compact(level, bytes.fromhex(first["lo"]), bytes.fromhex(first["hi"]))
        return True

    def vacuum(self, older_than_s: float = 86_400) -> int:
        """Deletes data files that the newest `keep_versions` versions don't name, and older commits; the number of data
        files.  Files younger than older_than_s stay: they may be of a write that hasn't committed yet."""
        newest, before = self.version(), 1000 * (time.time() - older_than_s)
        oldest = max(1, newest - self.keep_versions + 1)
        states = [s for s in self._listed()[1] if s <= oldest]
        live = {f["path"] for v in range(max(oldest, states[-1]), newest + 1) for f in self.state(v)["files"]}
        gone = 0
        found = self._fs.listFiles(self._path("data"), True) if self._fs.exists(self._path("data")) else None
        while found is not None and found.hasNext():
            s = found.next()
            name = s.getPath().toString()
            if name.endswith(".parquet") and name[name.rindex("/data/") + 1 :] not in live and s.getModificationTime() <= before:
                self._fs.delete(s.getPath(), False)
                gone += 1
        for v in range(1, states[-1] + 1):
            self._fs.delete(self._path(f"log/{v:020d}"), False)
            if v < states[-1]:
                self._fs.delete(self._path(f"log/{v:020d}.state"), False)
        return gone

    # Properties

    def num_files(self, level: int) -> int | None:
        return sum(f["level"] == level for f in self.state()["files"]) if 0 <= level < files.LEVELS else None

    def levels(self) -> str:
        """Files at each level up to the deepest that has any, as "2,1,1"."""
        counts = [self.num_files(n) for n in range(files.LEVELS)]
        while counts and not counts[-1]:
            counts.pop()
        return ",".join(map(str, counts))

    def level_summary(self) -> str:
        return "files[ " + " ".join(str(self.num_files(n)) for n in range(files.LEVELS)) + " ]"

    def stats(self) -> DataFrame:
        """level, files, bytes, micros, read, written of the levels that hold anything or were compacted into."""
        done = self.state()["stats"]
        totals = files.level_totals(self.files().where(F.col("level") >= 0))
        stats = self.spark.createDataFrame([(int(k), *v) for k, v in done.items()], "level int, micros long, read long, written long")
        return totals.join(stats, "level", "full").select("level", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "bytes", "micros", "read", "written")])

    def memory_usage(self) -> int:
        """Bytes of the buffer that the driver holds."""
        return sum(WriteBatch(list(rows)).byte_size() for _, rows in self.state()["tail"])

    def property(self, name: str):
        """num-files-at-level<N>, stats, approximate-memory-usage; None for any other name."""
        if m := re.fullmatch(r"num-files-at-level(\d+)", name):
            return self.num_files(int(m[1]))
        return {"stats": self.stats, "approximate-memory-usage": self.memory_usage}.get(name, lambda: None)()

    def most_overlap(self) -> int:
        """The most bytes of the next level that a file of level 1 and deeper overlaps."""
        found = self.state()["files"]
        return max((picking.total(picking.meets(found, f["level"] + 1, f["lo"], f["hi"])) for f in found if 1 <= f["level"] < files.LEVELS - 1), default=0)

    def approximate_size(self, start: bytes, stop: bytes) -> int:
        """Bytes of flushed rows with start <= key < stop.  Only files that a bound cuts are read."""
        a, z = self.comparator.key(start), self.comparator.key(stop)
        if a >= z:
            return 0
        total, cut = 0, []
        for f in self.state()["files"]:
            if f["level"] < 0 or f["hi"] < a.hex() or f["lo"] >= z.hex():
                continue
            if f["lo"] >= a.hex() and f["hi"] < z.hex():
                total += f["size"]
            else:
                cut.append(f["path"])
        if cut:
            key = self.comparator.column(F.col("k"))
            rows = self._read(cut).where((key >= F.lit(a)) & (key < F.lit(z)))
            total += rows.agg(F.sum(entry_bytes(F.col("k"), F.col("v"), F.col("op")))).first()[0] or 0
        return total

    def close(self) -> None:
        """Whatever is asked of the store from now on raises; closing again is fine."""
        self.closed = True

    def destroy(self) -> None:
        """Deletes the store's own folders, and root if nothing else is in it."""
        for name in ("data", "log"):
            self._fs.delete(self._path(name), True)
        if self._fs.exists(self._path("")) and not len(self._fs.listStatus(self._path(""))):
            self._fs.delete(self._path(""), False)
        self.closed = True
