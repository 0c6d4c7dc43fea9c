"""Token counts, BPE round trips and bit-plane files against the libraries themselves."""

import hashlib
import json
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stratalog.llm import bitplane_store, bpe_chunks, token_counts

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  b", "▁ a▁ b ▁", "</s> <unk><s>", "<|endoftext|> x<|endoftext|>", "a\x00b", "\U0001f600 é́", "don't  we'll\n\n x", "﻿ a", "　x y", "l'été 12 345", "\r\n\t z", "ÀÖ×÷ a"]


def texts(n, seed=1):
    rng = random.Random(seed)
    parts = ["word ", " the", "ing", "  ", "\n", "é", "▁", "1984", "don't", "<|endoftext|>", " ", "漢字", "\U0001f600", "...", "A", "\t", "</s>"]
    passage = "".join(rng.choice(parts) + " passage" for _ in range(900))
    out = list(ODD)
    for _ in range(n):
        own = "".join(rng.choice(parts) for _ in range(rng.randrange(200)))
        out.append(own + passage + own if rng.random() < 0.2 else own)
    return [*out, "long text, " * 40_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts(150))]
    return spark.createDataFrame([*rows, (7, None, None), (7, "again", "y"), (7, "again", "y"), (None, "no id", "z")], "doc_id long, text string, n_tokens string").repartition(3)


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_token_counts_as_the_library(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(((d, len(t.encode()), n := len(library.encode(t)), n > 4096) for d, t in rows_of(docs)), key=str)
    found = token_counts.token_counts(docs, PIECES)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert sorted(map(tuple, token_counts.token_counts(docs, PIECES, batch_bytes=100).collect()), key=str) == want
    assert any(w[3] for w in want)
    assert token_counts.token_counts(docs.limit(0), PIECES).collect() == []


def test_counts_of_random_characters():
    import sentencepiece

    library, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(3)
    some = ["".join(rng.choice(" ▁ab<s>.é\n") for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert token_counts.text_lengths([t.encode() for t in some], PIECES).tolist() == [len(library.encode(t)) for t in some]


def test_round_trip_as_the_library(docs):
    library = Tokenizer.from_file(BYTES)
    want = []
    for d, t in rows_of(docs):
        ids = library.encode(t, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, bpe_chunks.bpe_round_trip(docs, BYTES).collect()), key=str) == sorted(want, key=str)
    plain = {(r["doc_id"], r["decoded"]) for r in bpe_chunks.bpe_round_trip(docs, BYTES, digests=False).collect()}
    assert plain == set(rows_of(docs))
    assert bpe_chunks.bpe_round_trip(docs.limit(0), BYTES).collect() == []


def test_chunks_of_a_shared_passage_are_encoded_once():
    rng = random.Random(5)
    passage = " ".join(f"word{rng.randrange(10**6)}" for _ in range(4000))
    encoder = bpe_chunks.ChunkEncoder(bpe_chunks.byte_bpe(BYTES))
    seen = []
    real = encoder.chunks.make
    encoder.chunks.make = lambda chunks: (seen.extend(chunks), real(chunks))[1]
    some = [(" ".join(f"own{rng.randrange(10**6)}" for _ in range(rng.randrange(300))) + " " + passage).encode() for _ in range(20)]
    for t in some:
        encoder.encode_batch([t])
    cut = [len(bpe_chunks.cuts(t)) for t in some]
    assert len(seen) == len(set(seen)) < 0.25 * sum(cut)  # wherever the passage stands, its chunks are the same
    ids = Tokenizer.from_file(BYTES).encode(some[3].decode(), add_special_tokens=False).ids
    assert encoder.encode_batch([some[3]])[0].tolist() == ids


def test_cuts_are_whole_characters_within_bounds():
    data = ("漢é\U0001f600a" * 30_000).encode()
    ends = bpe_chunks.cuts(data)
    assert ends[-1] == len(data) and all(b - a <= bpe_chunks.MOST_BYTES + 3 for a, b in zip([0, *ends], ends, strict=False))
    assert "".join(data[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)).encode() == data
    assert bpe_chunks.cuts(b"") == []


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 65_536])
def test_planes_come_back(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n).astype("<u4")
    parts = bitplane_store.planes(ids, kind)
    assert len(parts) == (4 if kind == "byte" else 32)
    assert np.array_equal(bitplane_store.unplanes(parts, n), ids)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files_as_brute_force(spark, docs, tmp_path, kind):
    library, start, want = Tokenizer.from_file(BYTES), 0, []
    order = sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for d, t in order:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    root = f"file://{tmp_path}/planes"
    manifest = bitplane_store.write_planes(docs, BYTES, 2, root, kind, block=1000, files=3).collect()
    found = [tuple(r) for r in bitplane_store.read_planes(spark, root, docs.schema["doc_id"].dataType).orderBy("start").collect()]
    assert found == want
    assert len(manifest) <= 3 and sum(r["n_docs"] for r in manifest) == len(want) and sum(r["n_ids"] for r in manifest) == start
    with pa.OSFile(manifest[0]["path"]) as f:
        reader = bitplane_store.PlaneReader(f)
        assert all(n == 1000 for _, n, _ in reader.blocks[:-1]) and len(reader.blocks[0][2]) == (4 if kind == "byte" else 32)
        last = reader.block(len(reader.blocks) - 1)  # a block is read by itself
        assert len(last) == 4 * reader.blocks[-1][1]


def test_query_form_and_empty_table(spark, docs):
    assert bitplane_store.token_planes(docs, BYTES, 2).count() == docs.count()
    assert bitplane_store.token_planes(docs.limit(0), BYTES, 2).collect() == []


def test_a_damaged_file_is_refused(tmp_path):
    path = os.path.join(tmp_path, "x")
    with open(path, "wb") as f:
        f.write(json.dumps({"no": "planes"}).encode() * 3)
    with pa.OSFile(path) as f, pytest.raises(ValueError, match="not a bit-plane file"):
        bitplane_store.PlaneReader(f)
