"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes.  Texts are split where no piece of the vocabulary can reach over: before a space that
follows neither a space nor U+2581, since no piece has U+2581 after another character.  Each part is encoded with that
space left out, for which the library's own dummy prefix stands in; the lengths add up to that of the whole text.
Equal parts of a worker are encoded once, in a memo of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, resident, utf8
from .units import UnitMemo, joined

#: Bytes of text that are encoded at a time, and parts that a worker remembers.
BATCH_BYTES, MEMO_PARTS = 4 << 20, 1_000_000


@resident
def part_lengths(model: str) -> UnitMemo:
    """Memo from a part to its number of tokens.  An empty part stands for a lone space: one token."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    lone = len(library.encode("a ")) - len(library.encode("a"))

    def lengths(parts: list[bytes]) -> list[list[int]]:
        return [[len(ids) if part else lone] for part, ids in zip(parts, library.encode([p.decode() for p in parts], num_threads=1), strict=True)]

    return UnitMemo(lengths, MEMO_PARTS)


def text_lengths(texts: list[bytes], model: str) -> np.ndarray:
    """The number of tokens of each text, in UTF-8."""
    data, places = joined(texts)
    space = np.flatnonzero(data == 0x20)
    inside = np.zeros(len(data), bool)
    inside[places[:-1]] = True
    space = space[~inside[space]]  # a space at a text's start is part of its first part
    safe = data[space - 1] != 0x20
    for i in np.flatnonzero(safe & (data[space - 1] == 0x81)):
        safe[i] = data[space[i] - 3 : space[i]].tobytes() != b"\xe2\x96\x81"
    space = space[safe]
    first = places[:-1][np.diff(places) > 0]
    starts = np.sort(np.concatenate([first, space + 1]), kind="stable")
    # A part ends at the next safe space or at its text's end; a text's start is never after a safe space of the text before.
    ends = np.sort(np.concatenate([places[1:][np.diff(places) > 0], space]), kind="stable")
    memo = part_lengths(model)
    rows = memo.rows(data, starts, ends)
    counts = memo.flat[memo.begin[rows]].astype(np.int64)
    total = np.append(0, np.cumsum(counts))
    at = np.searchsorted(ends, places, side="right")  # parts that end at or before each place
    at[0] = 0
    return total[at[1:]] - total[at[:-1]]


def token_counts(docs: DataFrame, model: str, limit: int = 4096, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row of docs(doc_id, text).

    A null text counts as an empty one: 0 bytes, 0 tokens.  Repeated rows give repeated results, an empty table an empty
    one; other columns are left out.  No shuffle; a task holds one Arrow batch and the bounded memo.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, batch_bytes):
                n = pa.array(text_lengths(utf8(part.column(1)), model), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), n], names=["doc_id", "n_bytes", "n_tokens"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
