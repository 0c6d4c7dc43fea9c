"""Token-ID output in bit-plane files.

A file holds the ids of a range of documents as one stream.  The stream is cut into blocks of a fixed number of ids; a
block is transposed into byte planes (all lowest bytes, then all second bytes, ...) or bit planes, and each plane is
compressed by itself with zstandard, so that the empty high planes cost next to nothing.  After the blocks come the
documents' ids and lengths (an Arrow stream), then the chunk index, and at the end the index's place:

    "SLPLANE1" | block planes ... | documents | index (JSON) | u64 place of the index | "SLPLANE1"

The index has one entry a block: place, number of ids, and the compressed size of each plane; a reader can fetch any
range of ids from it.  Tasks write files under names of their own, so a repeated or lost attempt leaves at most a file
that no manifest names; the manifest is a Parquet table that Spark commits after all tasks have ended.
"""

from __future__ import annotations

import io
import json
import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import byte_bpe
from .common import by_bytes, fresh_dir, utf8

MAGIC = b"SLPLANE1"
#: Ids in a block, bytes of text encoded at a time, zstandard's level.
BLOCK_IDS, BATCH_BYTES, LEVEL = 1 << 16, 4 << 20, 1
#: Bytes of text in a file, and in one of a smaller table, which is spread over all cores.
FILE_BYTES, LEAST_BYTES = 256 << 20, 8 << 20
_MANIFEST = "part int, path string, n_docs long, n_ids long, n_bytes long"


def planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of little-endian unsigned 32-bit ids: 4 byte planes or 32 bit planes, lowest first."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [octets[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def unplanes(parts: list[bytes], n: int) -> np.ndarray:
    """The ids of which `parts` are the planes."""
    if len(parts) == 4:
        octets = np.empty((n, 4), np.uint8)
        for k, p in enumerate(parts):
            octets[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.empty((n, 32), np.uint8)
        for k, p in enumerate(parts):
            bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


class PlaneWriter:
    """Writes one file; holds one block of ids and the documents' lengths."""

    def __init__(self, out, id_type: pa.DataType, kind: str = "byte", block: int = BLOCK_IDS, level: int = LEVEL):
        self.out, self.kind, self.block = out, kind, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.id_type, self.docs, self.lengths, self.index = id_type, [], [], []
        self.held: list[bytes] = []
        self.held_ids = self.n_ids = self.place = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.place += len(data)

    def add(self, doc, ids: bytes) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids) // 4)
        self.held.append(ids)
        self.held_ids += len(ids) // 4
        if self.held_ids >= self.block:
            data, full = b"".join(self.held), self.held_ids // self.block * self.block
            for i in range(0, full, self.block):
                self._flush(data[4 * i : 4 * (i + self.block)])
            self.held, self.held_ids = [data[4 * full :]], self.held_ids - full

    def _flush(self, data: bytes) -> None:
        n, place = len(data) // 4, self.place
        packed = [self.zstd.compress(p) for p in planes(np.frombuffer(data, "<u4"), self.kind)]
        for p in packed:
            self._put(p)
        self.index.append([place, n, [len(p) for p in packed]])
        self.n_ids += n

    def close(self) -> None:
        if self.held_ids:
            self._flush(b"".join(self.held))
        table = pa.table({"doc": pa.array(self.docs, self.id_type), "n": pa.array(self.lengths, pa.int64())})
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table, max_chunksize=1 << 16)
        docs_at = self.place
        self._put(sink.getvalue())
        index_at = self.place
        self._put(json.dumps({"docs": docs_at, "blocks": self.index}).encode())
        self._put(struct.pack("<Q", index_at) + MAGIC)


class PlaneReader:
    """Reads a file through its index, block by block."""

    def __init__(self, source):
        size = source.size()
        source.seek(size - 16)
        at, magic = struct.unpack("<Q8s", source.read(16))
        if magic != MAGIC:
            raise ValueError("not a bit-plane file")
        source.seek(at)
        meta = json.loads(source.read(size - 16 - at))
        self.source, self.blocks, self.docs_at, self.docs_end = source, meta["blocks"], meta["docs"], at

    def block(self, k: int) -> bytes:
        place, n, sizes = self.blocks[k]
        self.source.seek(place)
        data, parts, zstd = self.source.read(sum(sizes)), [], zstandard.ZstdDecompressor()
        for s in sizes:
            parts.append(zstd.decompress(data[:s]))
            data = data[s:]
        return unplanes(parts, n).tobytes()

    def documents(self) -> Iterator[tuple[object, bytes]]:
        """(document id, ids) in the order they were written."""
        self.source.seek(self.docs_at)
        table = pa.ipc.open_stream(self.source.read(self.docs_end - self.docs_at)).read_all()
        rest, k = b"", 0
        for doc, n in zip(table["doc"].to_pylist(), table["n"].to_pylist(), strict=True):
            parts, have = [rest], len(rest)
            while have < 4 * n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            data = b"".join(parts) if len(parts) > 1 else rest
            yield doc, data[: 4 * n]
            rest = data[4 * n :]


def write_planes(docs: DataFrame, tokenizer: str, end_id: int, root: str, kind: str = "byte", block: int = BLOCK_IDS, files: int | None = None) -> DataFrame:
    """Encodes each text (null: empty), adds end_id, and writes ids in ascending doc_id order below `root`.

    Documents are range-partitioned by doc_id, so file p holds smaller ids than file p + 1; null ids come first, equal
    ids lie side by side in the order of their texts.  Returns the manifest: part, path, n_docs, n_ids, n_bytes.  An
    empty table has an empty manifest.  Other columns of docs are left out.  The number of files follows from the bytes of
    text, unless `files` says it.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, end = byte_bpe(tokenizer), None, struct.pack("<I", end_id)
        for batch in batches:
            for rows in by_bytes(batch, 1, BATCH_BYTES):
                if writer is None:
                    store, folder = fs.FileSystem.from_uri(root)
                    part = TaskContext.get().partitionId()
                    path = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex}.planes"
                    out = store.open_output_stream(path)
                    writer = PlaneWriter(out, rows.schema.field(0).type, kind, block)
                for doc, ids in zip(rows.column(0).to_pylist(), encoder.encode_batch(utf8(rows.column(1))), strict=True):
                    writer.add(doc, ids.tobytes() + end)
        if writer:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids], "n_bytes": [writer.place]})

    store, folder = fs.FileSystem.from_uri(root)
    store.create_dir(folder, recursive=True)
    by_id = F.col("doc_id").asc_nulls_first()
    rows = docs.select("doc_id", "text")
    if files is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1, math.ceil(size / FILE_BYTES), min(4 * spark.sparkContext.defaultParallelism, math.ceil(size / LEAST_BYTES)))
    rows = rows.repartitionByRange(files, by_id)
    rows.sortWithinPartitions(by_id, "text").mapInArrow(write, _MANIFEST).write.parquet(f"{root}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")


def read_planes(spark: SparkSession, root: str, id_type: T.DataType) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files that the manifest names.

    `start` counts the ids of all documents before it: a running sum over the manifest's rows, one a file, and over
    the lengths inside a file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")
    files = files.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, _ = fs.FileSystem.from_uri(root)
                with store.open_input_file(path) as source:
                    rows: list[tuple] = []
                    for doc, ids in PlaneReader(source).documents():
                        rows.append((doc, base, len(ids) // 4, zlib.crc32(ids)))
                        base += len(ids) // 4
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        doc, start, n, crc = zip(*rows, strict=True)
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, arrow_type), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_type = to_arrow_type(id_type)
    schema = T.StructType([T.StructField("doc_id", id_type)] + [T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")])
    width = max(1, spark.sparkContext.defaultParallelism * 4)
    return files.repartition(width).mapInArrow(read, schema)


def token_planes(docs: DataFrame, tokenizer: str, end_id: int, root: str | None = None) -> DataFrame:
    """Writes the ids of docs(doc_id, text) and returns what read_planes finds in the files."""
    root = root or fresh_dir(docs.sparkSession, "planes")
    write_planes(docs, tokenizer, end_id, root)
    return read_planes(docs.sparkSession, root, docs.schema["doc_id"].dataType)
