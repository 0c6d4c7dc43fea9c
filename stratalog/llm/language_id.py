"""Language identification by compression.

A bounded sample of whole labelled texts gives each language a raw-content zstandard dictionary.  A text is cut into blocks,
each block is compressed with every dictionary, and the language with the fewest bytes in all is the answer; where the
runner-up is nearly as small, the text is rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, resident

#: The sample that is learned from: of each language at most SAMPLE_TEXTS different labelled texts, each whole, in the order
#: of their hashes, until they hold DICT_CHARS characters.  The driver holds, for each language, fewer characters than
#: DICT_CHARS and one text more; rows beyond the sample are counted in nothing.
SAMPLE_TEXTS, DICT_CHARS = 256, 80_000
#: Bytes of a block, zstandard's level, and the narrowest margin, as a part of the runner-up's size, that isn't rejected.
BLOCK_BYTES, LEVEL, MIN_MARGIN = 1024, 6, 0.005
UNKNOWN = "und"

_NO_LETTERS = re.compile(r"\W+|[\d_]+")


def plain(text: str) -> bytes:
    """The text in lower case, with a space for each run of other characters than letters."""
    return _NO_LETTERS.sub(" ", text.lower()).encode()


def learn(labelled: DataFrame) -> dict[str, bytes]:
    """A dictionary for each language of labelled(text, lang): the different texts whose hashes are smallest.

    Every language that occurs is learned.  Rows without a text or a language teach nothing, repeated rows and copies
    count once, and an empty table gives an empty model, which calls every text unknown.  The hashes are put in order
    without their texts, so that copies of one text are a few bytes each; only the sample's texts are shuffled.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.xxhash64("text").alias("h"), "text")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = rows.select("lang", "h").distinct().withColumn("n", place).where(F.col("n") <= SAMPLE_TEXTS).select("lang", "h")
    texts = rows.join(F.broadcast(sample), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))  # SAMPLE_TEXTS hashes a language
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    found: dict[str, list[bytes]] = {}
    for r in texts.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < DICT_CHARS).orderBy("lang", "h").select("lang", "text").collect():
        found.setdefault(r["lang"], []).append(plain(r["text"]))
    return {k: b" ".join(v) for k, v in found.items()}


@resident
def _compressors(model: tuple[tuple[str, bytes], ...]) -> dict[str, zstandard.ZstdCompressor]:
    out = {}
    for lang, content in model:
        content = content if len(content) > 8 else content.ljust(9)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    return out


def judge(text: str | None, model: tuple[tuple[str, bytes], ...]) -> tuple[str, float]:
    """The language of the smallest encoding, and its margin over the next as a part of that one's size."""
    if not model or not text or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    raw = plain(text)
    blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in _compressors(model).items())
    if len(sizes) == 1:
        return sizes[0][1], 1.0
    return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def identify(docs: DataFrame, model: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs(text, ...) with lang_pred, score (0 to 1, rising with the margin), and lang_rejected.

    lang_pred is `und` for a null text and for one without a letter, and for all if nothing was learned; these are
    rejected, and so is a text whose margin is under min_margin (ties included; then lang_pred is the first of the tied
    names).  Columns of those names are replaced, all others stay.  No shuffle; repeated rows come back each.
    """
    fixed = tuple(sorted(model.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in by_bytes(batch, at, 1 << 20):
                found = [judge(t, fixed) for t in rows.column(at).to_pylist()]
                columns = [
                    *rows.columns,
                    pa.array([lang for lang, _ in found], pa.string()),
                    pa.array([1 - math.exp(-12 * m) for _, m in found], pa.float64()),
                    pa.array([lang == UNKNOWN or m < min_margin for lang, m in found], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kept = docs.drop("lang_pred", "score", "lang_rejected")
    at, names = kept.columns.index("text"), [*kept.columns, "lang_pred", "score", "lang_rejected"]
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *map(T.StructField, names[-3:], kinds)]))
