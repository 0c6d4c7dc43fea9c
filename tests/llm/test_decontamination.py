"""Every passage that shares 0.8 of an item's shingle weight is found, also where all of its edits are in one place."""

import random

import pytest

from stratalog.llm import decontamination as dc


def _words(rng, n, vocabulary=10**6):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def _brute(item, text):
    w, t = item.split(), text.encode().split()
    weights = dc.shingles([x.encode() for x in w], min(dc.SHINGLE, len(w)))
    return max(dc.similarity(weights, t[a : a + len(w)]) for a in range(len(t)))


@pytest.mark.parametrize(("size", "part"), [(20, 0.1), (59, 0.1), (100, 0.12), (100, 0.15), (300, 0.15), (1000, 0.15)])
def test_one_replaced_run(size, part):
    rng = random.Random(size)
    reached = 0
    for _ in range(12 if size < 300 else 3):
        item = _words(rng, size)
        run = round(part * size)
        at = rng.randrange(size - run)
        text = " ".join(_words(rng, 37) + item[:at] + _words(rng, run) + item[at + run :] + _words(rng, 50))
        value = _brute(" ".join(item), text)
        found = dc.Matcher([(7, " ".join(item))]).search([text])
        assert [f[:2] for f in found] == [(0, 0)] * (value >= dc.SIMILARITY)
        if found:
            reached += 1
            assert found[0][2] == pytest.approx(value)
    assert reached


def test_random_edits_as_brute_force():
    rng = random.Random(5)
    items = [(i, " ".join(_words(rng, rng.choice((1, 3, 4, 5, 7, 20, 60)), 30 if i % 2 else 10**6))) for i in range(25)]
    texts = []
    for _ in range(60):
        words = _words(rng, rng.randrange(20), 30)
        for _ in range(2):
            passage = rng.choice(items)[1].split()
            for _ in range(rng.randrange(3)):
                passage[rng.randrange(len(passage))] = "x"
            words += passage + _words(rng, rng.randrange(10), 30)
        texts.append(" ".join(words))
    found = {(d, i): v for d, i, v, _ in dc.Matcher(items).search(texts)}
    whole = {(d, i): v for d, t in enumerate(texts) for i, item in items if t and (v := _brute(item, t)) >= dc.SIMILARITY}
    assert found == pytest.approx(whole)


def test_insertions_and_deletions_in_long_items():
    rng = random.Random(11)
    for size in (40, 2500):
        item = _words(rng, size)
        for edit in ("insert", "delete"):
            passage = list(item)
            at = rng.randrange(5, size - 5)
            if edit == "insert":
                passage[at:at] = _words(rng, max(1, size // 60))
            else:
                del passage[at : at + max(1, size // 60)]
            text = " ".join(_words(rng, 80) + passage + _words(rng, 80))
            value = _brute(" ".join(item), text)
            found = dc.Matcher([(7, " ".join(item))]).search([text])
            assert (len(found) == 1) == (value >= dc.SIMILARITY)
            if found:
                assert found[0][2] == pytest.approx(value)


def test_strides_follow_the_item():
    for n in (4, 9, 14, 100, 1500, 10**6):
        s = dc.window_stride(n)
        assert 5 * s - 1 <= n < 5 * (s + (s + 1) // 2) - 1


def test_index_finds_every_fingerprint_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 300).astype(np.uint64)
    queries = np.concatenate([prints[:100] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (100, 1 + r)).astype(np.uint64), axis=1) for r in range(13)])
    near = np.bitwise_count(queries[:, None] ^ prints[None, :]) <= dc.RADIUS
    q, p = dc.MultiIndex(prints).search(queries)
    assert sorted(zip(q.tolist(), p.tolist(), strict=True)) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))


def _rows(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank today"
    docs = spark.createDataFrame(
        [("a", f"x y {item} z. And again: {item}", 1), (None, item.upper(), 2), ("b", None, 3), ("c", "", 4), ("d", "nothing here", 5), ("a", f"x y {item} z. And again: {item}", 1), ("e", "w " * 100_000, 6)],
        "doc_id string, text string, similarity int",
    )
    items = [("q1", item), ("q1", "seven words that only one item has"), ("q2", item), (None, None), ("q3", ""), ("q4", "red hen")]
    return docs, spark.createDataFrame(items, "item_id string, text string")


def test_odd_rows(spark):
    docs, items = _rows(spark)
    found = sorted(((r["doc_id"] or "", r["item_id"], r["similarity"], r["first_word"], r["n_words"]) for r in dc.leaks(docs, items).collect()))
    assert found == [("", "q1", 1.0, 0, 15), ("", "q2", 1.0, 0, 15), *[("a", "q1", 1.0, 2, 15)] * 2, *[("a", "q2", 1.0, 2, 15)] * 2]
    kept = dc.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == ["b", "c", "d", "e"]
    assert dc.leaks(docs.limit(0), items).collect() == [] and dc.leaks(docs, items.limit(0)).collect() == []
    assert dc.decontaminate(docs, items.limit(0)).count() == docs.count()


def test_a_larger_benchmark_takes_several_passes(spark, monkeypatch):
    docs, items = _rows(spark)
    whole = sorted(map(str, dc.leaks(docs, items).collect()))
    monkeypatch.setattr(dc, "PASS_BYTES", 150)
    assert len(list(dc.lots(items, dc.PASS_BYTES))) > 1
    assert sorted(map(str, dc.leaks(docs, items).collect())) == whole
    assert dc.decontaminate(docs, items).count() == 4
