"""The sample that dictionaries are learned from, held-out accuracy, and odd rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from stratalog.llm import language_id

DATA = "/root/testdata/sf0.01"


def test_copies_take_one_place_of_the_sample(spark):
    names = [f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in "lm"]
    rows = [(f"{n} speaks", "en") for n in names for _ in range(language_id.SAMPLE_TEXTS + 10)]
    model = language_id.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(model["en"].decode().split()) == sorted(names + ["speaks"] * len(names))


def test_texts_are_whole_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "DICT_CHARS", 1000)
    rows = [(" ".join(f"{chr(97 + i)}{chr(97 + j % 26)}x" for j in range(100)), "aa") for i in range(26)]
    model = language_id.learn(spark.createDataFrame(rows, "text string, lang string"))
    words = model["aa"].decode().split()
    assert len(words) == 300  # texts of 399 characters: the third brings the sum to 1000 and more


def test_every_language_is_learned(spark):
    rows = [(f"wort{i % 10} ding", f"l{i:03d}") for i in range(300)]
    assert len(language_id.learn(spark.createDataFrame(rows, "text string, lang string"))) == 300


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    rows = language_id.identify(docs, language_id.learn(docs.where(fold != 0))).where((fold == 0) & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    right, every = rows.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert every > 100 and right / every > 0.97


def test_smallest_encoding_wins_as_by_hand():
    import zstandard

    rng = random.Random(2)
    words = {k: ["".join(rng.choice(letters) for _ in range(6)) for _ in range(60)] for k, letters in (("a", "abcdef"), ("u", "uvwxyz"))}
    model = tuple(sorted((k, " ".join(rng.choice(w) for _ in range(400)).encode()) for k, w in words.items()))
    for k, w in words.items():
        text = " ".join(rng.choice(w) for _ in range(500))
        lang, margin = language_id.judge(text, model)
        raw, size = language_id.plain(text), {}
        for name, content in model:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            size[name] = sum(len(c.compress(raw[i : i + language_id.BLOCK_BYTES])) for i in range(0, len(raw), language_id.BLOCK_BYTES))
        assert lang == k == min(size, key=size.get)
        assert 0 < margin < 1


def test_odd_rows(spark):
    model = {"en": b"the cat and the dog and the bird sat there " * 20, "de": b"die katze und der hund und der vogel sitzen da " * 20}
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "the cat and the dog", None), (4, "the cat and the dog", None), (None, "der hund und die katze " * 20_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    found = language_id.identify(docs, model)
    assert found.columns == ["doc_id", "text", "lang_pred", "score", "lang_rejected"]
    got = sorted((r["doc_id"] or 0, r["lang_pred"], r["lang_rejected"]) for r in found.collect())
    assert got == [(0, "de", False), (1, "und", True), (2, "und", True), (3, "und", True), (4, "en", False), (4, "en", False)]
    assert all(0 <= r["score"] <= 1 for r in found.collect())
    assert language_id.identify(docs.limit(0), model).collect() == []
    assert language_id.learn(docs.limit(0).withColumn("lang", F.lit("en"))) == {}
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}
    assert language_id.judge("a tie", (("x", b"same"), ("y", b"same"))) == ("x", 0.0)
