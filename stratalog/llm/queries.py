"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitplane_store import token_planes
from .bpe_chunks import bpe_round_trip
from . import decontamination, host_quality, language_id, line_dedup, order_minhash, shards, url_reputation
from .common import fresh_dir
from .token_counts import token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    rows = language_id.identify(docs.select("doc_id", "text"), language_id.learn(docs.where(fold != 0)))
    return rows.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "lang_rejected")


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are of documents; as pages have none, doc_id n is taken for page_id n.  Low quality and toxic ones are bad."""
    labels = _table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    rows = url_reputation.url_filter(_table(spark, sf_dir, "pages"), outcomes)
    return rows.select("page_id", "host", "path", "rule", "verdict")


def op6_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = shards.sharded(docs, fresh_dir(spark, "shards"), arrival=F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)))
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = host_quality.host_quality(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_language_id,
        op3_order_minhash,
        op4_line_dedup,
        op5_url_reputation,
        op6_size_tiered_shards,
        op7_host_quality,
        op8_bpe_chunk_reuse,
        op9_simhash_decontamination,
        op10_bitplane_ids,
    )
}
ORACLES: dict[str, str] = {
    "op4_line_dedup": line_dedup.SQL,
    "op5_url_reputation": url_reputation.SQL,
    "op6_size_tiered_shards": shards.SQL,
    "op7_host_quality": host_quality.SQL,
}
