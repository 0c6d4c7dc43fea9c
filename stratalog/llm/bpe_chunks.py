"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 16 bytes cuts every text where its content says so, so that passages which documents share
give equal chunks wherever they stand.  A worker encodes each different chunk once, inside the chunk's own first and
last safe break, and keeps the ids in a store of bounded size.  Where two chunks meet, the open ends on both sides are
re-encoded together with a growing margin of whole parts, until the new ids agree exactly with the stored ids on both
sides; then the ids are joined.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .byte_bpe import ByteBPE, byte_bpe
from .common import Memo, by_bytes, resident, utf8

#: Bytes under the rolling hash; one cut in so many bytes; least and most bytes of a chunk; chunks a worker remembers.
WINDOW, MEAN_BYTES, LEAST_BYTES, MOST_BYTES, MEMO_CHUNKS = 16, 1024, 256, 8192, 8_000
BATCH_BYTES = 1 << 20

#: A space between printable ASCII and printable ASCII or a Latin letter: a safe break (see byte_bpe.py).
_BREAK = re.compile(rb"(?<=[!-~]) (?=[!-~\xc3])")
_GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=4).digest() for b in range(256)), "<u4").copy()


def cuts(data: bytes) -> list[int]:
    """The ends of the content-defined chunks of UTF-8 bytes; never inside a character."""
    n = len(data)
    octets = np.frombuffer(data, np.uint8)
    h = _GEAR[octets]
    step = 1
    while step < WINDOW:  # h[i] = sum of gear[octet[i - j]] << j over the window, in log2(WINDOW) passes
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    marks = np.flatnonzero((h >> np.uint32(16)) % MEAN_BYTES == 0) + 1
    ends, last = [], 0
    for m in marks.tolist() + [n]:
        while m - last > MOST_BYTES:
            last = _start_of_character(octets, last + MOST_BYTES)
            ends.append(last)
        if m - last >= LEAST_BYTES and m < n:
            m = _start_of_character(octets, m)
            if m < n:
                last = m
                ends.append(m)
    return ends if not n or ends and ends[-1] == n else [*ends, n]


def _start_of_character(octets: np.ndarray, i: int) -> int:
    while i < len(octets) and octets[i] & 0xC0 == 0x80:
        i += 1
    return i


class ChunkEncoder:
    def __init__(self, encoder: ByteBPE):
        self.encoder = encoder
        self.chunks = Memo(self._encode, MEMO_CHUNKS)

    def _encode(self, chunks: list[bytes]) -> list[tuple]:
        """Of each chunk: the open head before its first safe break, the ids up to the last one, the open tail, and the
        bytes between; without two breaks: the chunk alone."""
        out: list[tuple] = [()] * len(chunks)
        inner, which = [], []
        for i, c in enumerate(chunks):
            first, last = _BREAK.search(c), c.rfind(b" ")
            while last >= 0 and _BREAK.match(c, last) is None:
                last = c.rfind(b" ", 0, last)
            if first is None or last == first.start():
                out[i] = (c,)
                continue
            inner.append(c[first.start() : last])
            which.append((i, c[: first.start()], c[last:]))
        for (i, head, tail), middle, ids in zip(which, inner, self.encoder.encode_batch(inner), strict=True):
            out[i] = (head, ids, tail, middle)
        return out

    def encode_batch(self, texts: list[bytes]) -> list[np.ndarray]:
        cut_up = []
        for data in texts:
            ends = cuts(data)
            cut_up.append([data[a:z] for a, z in zip([0, *ends], ends, strict=False)])
        get = self.chunks.ready([c for x in cut_up for c in x])
        seams, plans = [], []
        for x in cut_up:
            plan: list = []
            left = pending = b""
            for c in x:
                got = get(c)
                if len(got) == 1:
                    pending += c
                    continue
                head, ids, tail, middle = got
                plan += [len(seams), ids]
                seams.append((left, pending + head, middle))
                pending, left = tail, middle
            plan.append(len(seams))
            seams.append((left, pending, b""))
            plans.append(plan)
        repaired = self._repair(seams)
        return [np.concatenate([repaired[p] if isinstance(p, int) else p for p in plan]) for plan in plans]

    def _repair(self, seams: list[tuple[bytes, bytes, bytes]]) -> list[np.ndarray]:
        """Ids of each seam.  It is encoded with the last part before and the first part after it; the ids found must
        begin with those of the part before and end with those of the part after, else the margins grow."""
        out: list = [None] * len(seams)
        todo, margin = list(range(len(seams))), 1
        while todo:
            sides = [(_last_parts(seams[i][0], margin), _first_parts(seams[i][2], margin)) for i in todo]
            ids = self.encoder.encode_batch([s for (a, z), i in zip(sides, todo, strict=True) for s in (a, a + seams[i][1] + z, z)])
            again = []
            for k, i in enumerate(todo):
                a, whole, z = ids[3 * k : 3 * k + 3]
                end = len(whole) - len(z)
                if end >= len(a) and np.array_equal(whole[: len(a)], a) and np.array_equal(whole[end:], z):
                    out[i] = whole[len(a) : end]
                elif sides[k] == (seams[i][0], seams[i][2]):
                    raise ValueError("a seam of chunks finds no agreement")
                else:
                    again.append(i)
            todo, margin = again, 2 * margin
        return out


def _last_parts(text: bytes, n: int) -> bytes:
    at = len(text)
    for _ in range(n):
        at = text.rfind(b" ", 0, at)
        while at > 0 and _BREAK.match(text, at) is None:
            at = text.rfind(b" ", 0, at)
        if at <= 0:
            return text
    return text[at:]


def _first_parts(text: bytes, n: int) -> bytes:
    at = 0
    for _ in range(n):
        found = _BREAK.search(text, at + 1)
        if found is None:
            return text
        at = found.start()
    return text[:at]


@resident
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(byte_bpe(path))


def bpe_round_trip(docs: DataFrame, tokenizer: str, digests: bool = True) -> DataFrame:
    """Encodes each text of docs(doc_id, text) and decodes the ids again.

    Returns doc_id, n_tokens and either the ids and the decoded text (digests=False: ids array<int>, decoded string), or
    ids_sha256 (decimal ids joined by commas) and decoded_sha256, in lowercase hex.  A null text counts as an empty one;
    repeated rows give repeated results, an empty table an empty one; other columns are left out.  No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(tokenizer)
        decimal = [str(i) for i in range(len(encoder.encoder.token_bytes))]
        token = encoder.encoder.token_bytes
        for batch in batches:
            for rows in by_bytes(batch, 1, BATCH_BYTES):
                found = [x.tolist() for x in encoder.encode_batch(utf8(rows.column(1)))]
                decoded = (b"".join(map(token.__getitem__, x)).decode("utf-8", "replace") for x in found)
                columns = [rows.column(0), pa.array(map(len, found), pa.int64())]
                if digests:
                    columns.append(pa.array([hashlib.sha256(",".join(map(decimal.__getitem__, x)).encode()).hexdigest() for x in found], pa.string()))
                    columns.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()))
                else:
                    columns += [pa.array(found, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kinds = [T.StringType(), T.StringType()] if digests else [T.ArrayType(T.IntegerType()), T.StringType()]
    schema = T.StructType([docs.schema["doc_id"], T.StructField(names[1], T.LongType()), *map(T.StructField, names[2:], kinds)])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
