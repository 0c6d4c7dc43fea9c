"""Write-ahead logs as a source and a sink: files of 32 KiB blocks with checksummed fragments of encoded batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec

_ROWS = "path string, seq long, op int, k binary, v binary"


def encode_log(batches: list[tuple[int, list[tuple[int, bytes, bytes | None]]]]) -> bytes:
    """A log file of batches (first sequence number, records)."""
    return codec.wal_encode(codec.encode_batch(seq, records) for seq, records in batches)


def read_logs(spark: SparkSession, path: str, first_seq: int = 0) -> DataFrame:
    """(path, seq, op, k, v) of the log files at path, record by record, from first_seq on.  Files are decoded side by
    side; order is by seq.  Records that a crash cut short, or whose checksum is wrong, are left out; a record too short
    for a batch is skipped; a batch that is broken inside raises."""

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                rows = []
                for record in codec.wal_decode(bytes(content)):
                    if len(record) < 12:
                        continue
                    seq, records = codec.decode_batch(record)
                    rows += [(name, seq + i, op, k, v) for i, (op, k, v) in enumerate(records) if seq + i >= first_seq]
                yield pd.DataFrame(rows, columns=["path", "seq", "op", "k", "v"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path).select("path", "content")
    return files.mapInPandas(decode, _ROWS)


def write_logs(rows: DataFrame, folder: str, batch_rows: int = 1000) -> DataFrame:
    """Writes rows(seq, op, k, v) as log files below folder, a URI, one a task: in a file, runs of following sequence
    numbers are batches of up to batch_rows records.  (path, records, bytes) of each file; a repeated task's earlier file
    isn't among them."""

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        path, size, n, out = f"{base}/{uuid.uuid4().hex}.log", 0, 0, None
        for part in parts:
            batches: list[tuple[int, list]] = []
            for seq, op, k, v in zip(part["seq"], part["op"], part["k"], part["v"], strict=True):
                if not batches or seq != batches[-1][0] + len(batches[-1][1]) or len(batches[-1][1]) >= batch_rows:
                    batches.append((int(seq), []))
                batches[-1][1].append((int(op), bytes(k), None if v is None else bytes(v)))
            if batches:
                out = out or store.open_output_stream(path)
                data = codec.wal_encode((codec.encode_batch(seq, records) for seq, records in batches), size)
                out.write(data)
                size, n = size + len(data), n + len(part)
        if out:
            out.close()
            yield pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    made = rows.repartitionByRange("seq").sortWithinPartitions("seq").select("seq", "op", "k", "v").mapInPandas(encode, "path string, records long, bytes long")
    made.write.parquet(f"{folder}/made")
    return rows.sparkSession.read.parquet(f"{folder}/made")


def replay(flushed: DataFrame, tail: DataFrame) -> DataFrame:
    """The log after a restart: the rows that were flushed, and the tail's rows beyond them."""
    last = flushed.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("__last"))
    newer = tail.crossJoin(last).where(F.col("seq") > F.col("__last"))  # one row
    return flushed.unionByName(newer.select(flushed.columns))
