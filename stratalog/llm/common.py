"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from itertools import count, islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of `[\x20\x09-\x0D]`.
BLANKS = " \t\n\x0b\x0c\r"


#: The folder of the tables that `written` makes just now, below the shared one.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.  Where it is unset, one of our own, but only for a local
    master: on a cluster each machine would have another."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="stratalog-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{_SCRATCH.get() or shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are `written` inside are deleted at the end; those that are `kept` stay."""
    path = fresh_dir(spark, "scratch")
    token = _SCRATCH.set(path)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        remove(spark, path)


def unused(table: DataFrame, n: int = 1) -> list[str]:
    """n column names that the table doesn't have."""
    taken = {c.lower() for c in table.columns}
    return list(islice((c for c in (f"__{i}" for i in count()) if c not in taken), n))


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `most` bytes each; a longer text is a slice of its own."""
    texts = batch.column(column)
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts' bytes; a null is an empty text."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Hands memory that is free in this process back to the system, as far as the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


_RESIDENT: list[tuple] = []


def resident(make: Callable) -> Callable:
    """make, whose last value stays in the process for further tasks.  There is one such value whichever function made it,
    so that workers that live through several stages hold the tables of one."""

    @wraps(make)
    def get(*key):
        if not _RESIDENT or _RESIDENT[0][:2] != (make, key):
            _RESIDENT.clear()
            give_back()
            value = make(*key)
            _RESIDENT[:] = [(make, key, value)]
        return _RESIDENT[0][2]

    return get


class Memo:
    """A bounded memo in two generations; the values of missing keys are made in one call.

    It never holds more than about twice `capacity` entries plus one batch, whatever the corpus.
    """

    def __init__(self, make: Callable[[list], Iterable], capacity: int):
        self.make, self.capacity = make, capacity
        self.young: dict = {}
        self.old: dict = {}

    def ready(self, keys: list[Hashable]) -> Callable:
        """A lookup that knows all these keys."""
        missing = set(keys).difference(self.young)
        if missing:
            if len(self.young) > self.capacity:
                self.old, self.young = self.young, {}
                missing = set(keys)
            young, old, new = self.young, self.old, []
            for k in missing:
                v = old.get(k)
                if v is None:
                    new.append(k)
                else:
                    young[k] = v
            young.update(zip(new, self.make(new), strict=True))
        return self.young.__getitem__


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: what is read from it again doesn't depend on the executors that made it."""
    return _stored(df, fresh_dir(df.sparkSession, what))


def kept(df: DataFrame, what: str) -> DataFrame:
    """As `written`, for a result that outlives the scratch tables it is made from."""
    return _stored(df, f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}")


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` returned and nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.stored_at)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def salted(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = 8) -> DataFrame:
    """left joined with right, whose keys are unique, null keys matching.  The rows of a hot key are spread over `salts`
    tasks by `spread`; right, the smaller table, is repeated that often.  Columns: left's, then right's others."""
    left = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = right.select(*[F.col(k).alias(f"__r_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys], F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__r_salt"))
    on = F.col("__salt") == F.col("__r_salt")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"__r_{i}"))
    return left.join(right, on, how).drop("__salt", "__r_salt", *[f"__r_{i}" for i in range(len(keys))])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row wherever body uses it, also inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
