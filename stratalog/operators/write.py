"""Batches, sequence numbers and the snapshot registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.codec import varint_length
from ..log import DELETE, PUT

BATCH_SCHEMA = "ordinal long, op int, k binary, v binary"


@dataclass
class WriteBatch:
    """Writes that are applied together, in order; sequence is the number of the first, once it is known."""

    records: list[tuple[int, bytes, bytes | None]] = field(default_factory=list)
    sequence: int = 0

    def put(self, key: bytes, value: bytes) -> WriteBatch:
        self.records.append((PUT, bytes(key), bytes(value)))
        return self

    def delete(self, key: bytes) -> WriteBatch:
        self.records.append((DELETE, bytes(key), None))
        return self

    def append(self, other: WriteBatch) -> WriteBatch:
        self.records.extend(other.records)
        return self

    def clear(self) -> WriteBatch:
        self.records.clear()
        return self

    def count(self) -> int:
        return len(self.records)

    def byte_size(self) -> int:
        """The length of the encoded batch: a header of 12 bytes, and each record's tag, lengths and bytes."""
        size = lambda b: varint_length(len(b)) + len(b)
        return 12 + sum(1 + size(k) + (size(v) if op == PUT else 0) for op, k, v in self.records)

    def encode(self) -> bytes:
        return codec.encode_batch(self.sequence, self.records)

    @classmethod
    def decode(cls, data: bytes) -> WriteBatch:
        sequence, records = codec.decode_batch(data)
        return cls(records, sequence)

    def iterate(self, put: Callable[[bytes, bytes], object], delete: Callable[[bytes], object]) -> None:
        """Calls put or delete for each record, in order."""
        for op, k, v in self.records:
            put(k, v) if op == PUT else delete(k)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, op, k, v) for i, (op, k, v) in enumerate(self.records)], BATCH_SCHEMA)


def decoded(batches: DataFrame) -> DataFrame:
    """(id, ordinal, op, k, v, seq) of the records of batches(id, data), data being encoded batches.  A broken batch raises."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i, data in zip(part["id"], part["data"], strict=True):
                first, records = codec.decode_batch(bytes(data))
                rows += [(i, n, op, k, v, first + n) for n, (op, k, v) in enumerate(records)]
            yield pd.DataFrame(rows, columns=["id", "ordinal", "op", "k", "v", "seq"])

    return batches.select("id", "data").mapInPandas(run, "id long, ordinal long, op int, k binary, v binary, seq long")


def gaps(batch: DataFrame) -> DataFrame:
    """One row `whole`: whether the ordinals of batch(ordinal) are 0, 1, 2, ..., each once."""
    o = F.col("ordinal")
    return batch.agg((F.coalesce(F.min(o), F.lit(0)) == 0) & (F.coalesce(F.max(o) + 1, F.lit(0)) == F.count(F.lit(1))) & (F.countDistinct(o) == F.count(F.lit(1)))).toDF("whole")


def numbered(batch: DataFrame, last: int) -> DataFrame:
    """batch(ordinal, op, k, v) as log rows: record i gets the sequence number last + 1 + i.  Ordinals are 0, 1, 2, ..."""
    return batch.select("k", (F.col("ordinal") + (last + 1)).alias("seq"), "op", F.when(F.col("op") == PUT, F.col("v")).alias("v"))


def varint_bytes(n: Column) -> Column:
    """Length of the base-128 code of a number that isn't negative."""
    return F.when(n == 0, F.lit(1)).otherwise(F.ceil(F.length(F.bin(n)) / 7)).cast("long")


def entry_bytes(k: Column, v: Column, op: Column) -> Column:
    """Bytes of a record in the write buffer: key with its 8-byte tag and value, both with their lengths."""
    size = lambda n: varint_bytes(n) + n
    return size(F.octet_length(k) + 8) + size(F.when(op == PUT, F.octet_length(v)).otherwise(F.lit(0)))


def oldest_bound(snapshots: DataFrame, log: DataFrame) -> DataFrame:
    """One row `seq`: the oldest registered snapshot, or the newest sequence number without any."""
    return snapshots.agg(F.min("seq").alias("s")).join(log.agg(F.max("seq").alias("m")), F.lit(True)).select(F.coalesce("s", "m").alias("seq"))


#: Bytes by which a group of small writers may grow, and the most that a group holds.
GROW_BYTES, GROUP_BYTES = 128 << 10, 1 << 20


def commit_groups(writers: DataFrame) -> DataFrame:
    """writers(queue, position, bytes, sync) with `grp`, the number of the commit in its queue that takes each writer.

    A group starts at its leader and takes the next writers while their bytes fit: 128 KiB more than a small leader, or
    1 MiB; a writer that must be synced doesn't join a leader that isn't.  A queue is taken by one task.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        out, group, size, most, leader_sync = [], -1, 0, 0, False
        for n, sync in zip(rows["bytes"], rows["sync"], strict=True):
            if group < 0 or (sync and not leader_sync) or size + n > most:
                group, size, leader_sync = group + 1, n, sync
                most = n + GROW_BYTES if n <= GROW_BYTES else GROUP_BYTES
            else:
                size += n
            out.append(group)
        return rows.assign(grp=out)[["queue", "position", "grp"]]

    return writers.groupBy("queue").applyInPandas(pack, "queue long, position long, grp long")
