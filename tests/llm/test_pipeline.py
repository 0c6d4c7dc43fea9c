"""Each stage of the pipeline on its own input against a brute-force version, and the whole."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tests_lcs import lcs
from tokenizers import Tokenizer

from stratalog.llm import decontamination, language_id

pipeline = pytest.importorskip("corpus_pipeline")
WORDS = {k: ["".join(random.Random(f"{k}{i}").choice(letters) for _ in range(random.Random(i).randrange(3, 9))) for i in range(400)] for k, letters in (("aa", "abcdefgh"), ("mm", "mnopqrst"))}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(20)
    some = lambda k, n: [rng.choice(WORDS[k]) for _ in range(n)]
    repeated = "this line is longer than forty characters and it comes " + " ".join(some("aa", 4))
    items = [" ".join(some("aa", 30)) for _ in range(5)]
    rows = []
    for i in range(120):
        k = "aa" if i % 3 else "mm"
        words = some(k, rng.choice((60, 120, 200)))
        text = "\n".join(" ".join(words[j : j + 20]) for j in range(0, len(words), 20))
        if i % 10 == 0:
            text += "\n" + repeated
        if i % 17 == 5:
            text += " " + items[i % 5]
        rows.append((i, text, k))
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(0, 30, 2)]  # exact copies
    for i in range(1, 30, 2):  # near copies
        w = rows[i][1].split(" ")
        w[len(w) // 2] = "changed"
        rows.append((200 + i, " ".join(w), rows[i][2]))
    rows += [(300, None, None), (301, "12 34", "aa"), (302, "", "aa"), (303, rows[3][1], None), (303, rows[3][1], None), (None, rows[3][1], None)]
    return [(d, t, lang, "s", len(t or "")) for d, t, lang in rows], items


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs, items = corpus()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def stage(name):
    return dict(pipeline.STAGES)[name]


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_are_the_five_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "line dedup", "near-dedup", "decontamination", "BPE"]


def test_language_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = tuple(sorted(language_id.learn(docs).items()))
    want = Counter()
    for r in docs.collect():
        lang, margin = language_id.judge(r["text"], model)
        if lang != language_id.UNKNOWN and margin >= language_id.MIN_MARGIN:
            want[tuple(r)] += 1
    left = stage("language ID")(spark, docs, sf_dir)
    assert left.columns == docs.columns and rows_of(left) == want
    assert sum(want.values()) >= docs.count() - 6


def test_line_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    holders = defaultdict(set)
    for r in docs.collect():
        for x in (r["text"] or "").split("\n"):
            holders[x.strip().lower()].add(r["doc_id"])
    hot = {k: max((d for d in h if d is not None), default=None) for k, h in holders.items() if len(k) >= 40 and len(h) >= 5}
    want = Counter()
    for r in docs.collect():
        text = "\n".join(x for x in (r["text"] or "").split("\n") if hot.get(x.strip().lower(), r["doc_id"]) == r["doc_id"])
        want[(r["doc_id"], text, r["lang"], r["source"], len(text))] += 1
    assert hot and rows_of(stage("line dedup")(spark, docs, sf_dir)) == want


def test_near_dedup_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, root = docs.collect(), {}
    texts = [tuple((r["text"] or "").lower().split()) for r in rows]

    def same(a, b):
        return bool(a) and bool(b) and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and (a == b or lcs(a, b) >= 0.8 * max(len(a), len(b)))

    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and same(texts[i], texts[j]):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    want = Counter()
    for c in set(root):
        members = [rows[i] for i in range(len(rows)) if root[i] == c]
        want[min((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in members)] += 1
    found = Counter((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in stage("near-dedup")(spark, docs, sf_dir).collect())
    assert found == want and len(want) < len(rows) - 25


def test_decontamination_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def leaks(text):
        words = (text or "").lower().encode().split()
        for item in items:
            w = item.encode().split()
            weights = decontamination.shingles(w)
            if any(decontamination.similarity(weights, words[a : a + len(w)]) >= 0.8 for a in range(len(words))):
                return True
        return False

    want = Counter(tuple(r) for r in docs.collect() if not leaks(r["text"]))
    assert rows_of(stage("decontamination")(spark, docs, sf_dir)) == want and sum(want.values()) < docs.count()


def test_bpe_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    library, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[(r["doc_id"], len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))] += 1
    assert rows_of(stage("BPE")(spark, docs, sf_dir)) == want


def test_run_is_the_stages_one_after_the_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in pipeline.STAGES:
        docs = spark.createDataFrame(f(spark, docs, sf_dir).collect(), docs.schema if name != "BPE" else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    whole = pipeline.run(spark, sf_dir)
    assert rows_of(whole) == rows_of(docs) and docs.count() > 60


def test_every_stage_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, f in pipeline.STAGES:
        assert f(spark, docs, sf_dir).collect() == []


def test_queries_and_pipeline_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 11))
    assert os.path.exists(pipeline.__file__)
