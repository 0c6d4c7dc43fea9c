"""Near-dedup against brute force, with families that are larger than a bucket of which all pairs are candidates."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest

from tests_lcs import lcs

from stratalog.llm import common
from stratalog.llm import order_minhash as om


def _words(rng, n, of=10**9):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


def similarity(a, b):
    return lcs(a, b) / max(len(a), len(b)) if a and b else 0.0


def groups(comp):
    out = defaultdict(set)
    for i, c in enumerate(comp):
        out[c].add(i)
    return {frozenset(g) for g in out.values()}


def joined_by_brute_force(texts, roots, sides):
    comp = list(roots)
    for x in range(len(texts)):
        for y in range(x):
            if (not any(sides) or sides[x] != sides[y]) and similarity(list(texts[x]), list(texts[y])) >= 0.8 - 1e-9:
                a, b = comp[x], comp[y]
                comp = [a if c == b else c for c in comp]
    return groups(comp)


def hot_family(n, seed=1):
    """A passage of 500 words, which each document follows with 0 to 124 words of its own."""
    rng = random.Random(seed)
    passage = _words(rng, 500)
    return [" ".join(passage + _words(rng, i % 125)) for i in range(n)]


def test_alignment_is_the_common_subsequence():
    rng = random.Random(3)
    for _ in range(400):
        a = [rng.randrange(rng.choice((3, 30, 1000))) for _ in range(rng.randrange(1, 60))]
        b = list(a)
        for _ in range(rng.randrange(len(a) // 3 + 2)):
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randrange(len(b) + 1), rng.randrange(1000))
        want, got = similarity(a, b), om.alignment(np.array(a, np.uint64), np.array(b, np.uint64))
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


@pytest.mark.parametrize("rows", [7, 64, 1000])
def test_alignment_in_chunks_of_rows(monkeypatch, rows):
    monkeypatch.setattr(om, "ROWS", rows)
    rng = random.Random(rows)
    for _ in range(60):
        a = [rng.randrange(rng.choice((4, 60))) for _ in range(rng.randrange(20, 300))]
        b = [w for w in a if rng.random() > 0.1]
        at = rng.randrange(len(b))
        b[at:at] = [rng.randrange(60) for _ in range(rng.randrange(len(a) // 8))]
        want, got = similarity(a, b), om.alignment(np.array(a, np.uint64), np.array(b, np.uint64))
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def test_alignment_of_long_texts_is_bounded_in_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    a = rng.integers(0, 50_000, 120_000).astype(np.uint64)
    b = np.delete(a, rng.integers(0, len(a), 12_000))
    tracemalloc.start()
    assert om.alignment(a, b) == pytest.approx(len(b) / len(a))
    assert tracemalloc.get_traced_memory()[1] < 60e6


def test_repeated_shingles_have_different_labels():
    words = np.array([1, 2, 3, 4, 5] * 4 + [7] + [1, 2, 3, 4, 5], np.uint64)
    h, at = om.labelled(words, np.array([0, 20, 21, 26]))
    assert at.tolist() == [0, 16, 17, 18] and len(set(h[:16].tolist())) == 16
    assert h[17] == h[0]  # the first occurrence of a shingle is the same in every text


def test_links_join_what_brute_force_joins():
    for seed in range(30):
        rng = random.Random(seed)
        passages = [_words(rng, rng.choice((3, 6, 30))) for _ in range(3)]
        docs = []
        for _ in range(40):
            p = list(rng.choice(passages))
            for _ in range(rng.choice((0, 0, 1, 2))):
                p[rng.randrange(len(p))] = f"x{rng.randrange(10**9)}"
            docs.append(p + _words(rng, rng.randrange(12)))
        texts = om.WordHashes().of([" ".join(d).encode() for d in docs])
        roots = np.array([rng.randrange(40) if seed % 2 else i for i in range(40)])
        sides = np.array([i % 2 if seed % 3 == 0 else 0 for i in range(40)], np.int8)
        comp = list(roots)
        for x, y in om.links(texts, roots, sides):
            a, b = comp[x], comp[y]
            assert a != b and om.alignment(texts[x], texts[y]) >= om.SIMILARITY - 1e-9
            comp = [a if c == b else c for c in comp]
        assert groups(comp) == joined_by_brute_force(docs, roots, sides)


def _classes(spark, texts, first=0):
    docs = spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: r["class_id"] for r in om.near_duplicates(docs).collect()}


def test_recall_of_exact_and_near_copies_and_no_false_ones(spark):
    rng = random.Random(8)
    vocabulary = _words(rng, 3000, 3000)
    texts, family = [], []
    for f in range(150):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((30, 80, 250)))]
        for k in range(4):
            w = list(base)
            for _ in range(0 if k < 2 else len(w) // 25):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice(([], [rng.choice(vocabulary)], [w[at], rng.choice(vocabulary)]))
            texts.append(" ".join(w))
            family.append(f)
    found = _classes(spark, texts)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if family[i] == family[j] and similarity(texts[i].split(), texts[j].split()) >= 0.8]
    caught = [found[i] == found[j] for i, j in pairs]
    exact = [found[i] == found[j] for i, j in pairs if texts[i] == texts[j]]
    assert all(exact) and sum(caught) >= 0.97 * len(pairs)
    assert all(family[d] == family[c] for d, c in found.items())


def test_hot_family_is_one_class(spark):
    assert set(_classes(spark, hot_family(1000)).values()) == {0}


def test_hot_family_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(om, "BLOCK", 20_000)
    assert set(_classes(spark, hot_family(300, seed=2), 5).values()) == {5}


def test_a_shared_passage_alone_makes_no_class(spark):
    rng = random.Random(6)
    passage = _words(rng, 60)
    texts = [" ".join(_words(rng, 40) + passage + _words(rng, 60)) for _ in range(200)]
    assert all(d == c for d, c in _classes(spark, texts).items())


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "one", "x"), (5, "ONE ", "x"), (6, "zwei drei", None), (6, "zwei drei", None), (None, "zwei drei", "x"), (None, "allein", "x"), (7, "y " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    key = lambda p: tuple(-1 if x is None else x for x in p)
    found = sorted(((r["doc_id"], r["class_id"]) for r in om.near_duplicates(docs).collect()), key=key)
    assert found == [(None, None), (None, 6), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (6, 6), (7, 7)]
    assert om.near_duplicates(docs.limit(0)).collect() == []


def test_one_of_each_keeps_unique_texts_and_one_row_a_class(spark):
    long, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, long, "p"), (1, long, "q"), (2, long, "r"), (2, other, "s"), (None, long, "t"), (None, "only here", "u"), (3, None, "v"), (4, "", "w"), (5, other + " tail", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __0 string")
    left = om.one_of_each(docs)
    assert left.columns == docs.columns
    found = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert sorted(found, key=str) == sorted([(1, long), (2, other), (None, "only here"), (3, None), (4, "")], key=str)


def test_intermediate_tables_are_deleted(spark):
    root = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    _classes(spark, hot_family(40))
    assert [n.split("-")[0] for n in set(os.listdir(root)) - before] == ["classes"]


def test_a_crowded_bucket_is_a_tree_of_few_neighbours(spark):
    """No node of a bucket of thousands meets more than a few others, and all hang together."""
    n = 5000
    nodes = spark.createDataFrame([(i, 100, [7, 1000 + i]) for i in range(n)], "node long, n int, sketch array<long>")
    pairs, many = om.candidates(nodes)
    rows = [(r["a"], r["b"]) for r in pairs.collect()]
    degree, root = defaultdict(int), list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in rows:
        degree[a] += 1
        degree[b] += 1
        root[find(a)] = find(b)
    assert max(degree.values()) <= 4 * om.FAN and len({find(i) for i in range(n)}) == 1
    assert many.count() == n
