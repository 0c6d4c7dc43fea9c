"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, and BPE of what is left."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import bpe_chunks, decontamination, language_id, line_dedup, order_minhash
from stratalog.llm.common import discard, written


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a sufficient margin; the dictionaries are learned from the labelled ones."""
    rows = language_id.identify(docs, language_id.learn(docs))
    return rows.where(~F.col("lang_rejected")).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat across documents; n_chars follows the text."""
    rows = line_dedup.line_dedup(docs)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return order_minhash.one_of_each(docs).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    return bpe_chunks.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", keep_identified),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("BPE", encode),
]
#: Compression, sketches and BPE are beyond SQL; tests/llm/test_pipeline.py compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the tables between the stages are deleted as soon as the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
            if before is not None:
                discard(before)
            before = docs
    return docs
