"""Near-duplicate documents by order MinHash.

The word 5-shingles of a text are labelled with their occurrence, so that they are all different.  Each of HASHES
independent hash functions picks the ORDER labelled shingles of least value and lists them in text order; the list's
hash is one entry of the sketch.  Two texts agree in an entry with about the ORDER-th power of the part of shingles that
they share in the same order, so that the sketch is sensitive to edits and moves alike.

Texts of the same words are one node.  Nodes that agree in an entry share a bucket, and every pair of a bucket is a
candidate; a candidate is a link if a banded alignment of its words keeps SIMILARITY of the longer text in order.  A class
is a connected component of links.  Buckets of up to PAIRS nodes are compared pair by pair.  In a larger one the nodes
are first compared along a tree in which none has more than about 2 x FAN neighbours, which makes one component of a
family of copies of any size; only if several components are left, the bucket is joined with itself in blocks by an exact
filter over the pairs of neighbouring words, which finds each link that is missing between them.  So no pair of a bucket
is left out, whatever the bucket's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, discard, give_back, kept, salted, scratch, unused, utf8, written
from .components import components
from .units import UnitMemo, joined

#: Words of a shingle, least part of the longer text's words that align, entries of a sketch, shingles an entry.
SHINGLE, SIMILARITY, HASHES, ORDER = 5, 0.8, 24, 3
#: Nodes of a bucket that are all paired, nodes of a larger bucket that are compared with one of them first.
PAIRS, FAN = 12, 32
#: Words of a block of a larger bucket; a task joins one block with another.  Words of a text that are aligned at a time.
BLOCK, ROWS = 1 << 18, 8192
BATCH_BYTES = 1 << 20

_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SEEDS = np.array([xxhash.xxh64_intdigest(b"order", seed=i) for i in range(64)], np.uint64)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WordHashes:
    """64-bit hashes of words, by way of a bounded memo."""

    def __init__(self, capacity: int = 500_000):
        self.memo = UnitMemo(self._hash, capacity)

    @staticmethod
    def _hash(words: list[bytes]) -> list[tuple[int, int]]:
        return [(h & 0xFFFFFFFF, h >> 32) for h in map(xxhash.xxh64_intdigest, words)]

    def flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all texts' words, `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, and the number of words before each text."""
        data, places = joined(texts)
        data = _LOWER[data]
        inside = np.zeros(len(data) - 14, bool)
        inside[1:-1] = ~_BLANK[data[:-16]]
        edge = inside[1:] != inside[:-1]
        starts, ends = np.flatnonzero(edge & inside[1:]), np.flatnonzero(edge & inside[:-1])
        inner = np.unique(places[1:-1])
        inner = inner[inside[inner] & inside[inner + 1]]
        if len(inner):
            starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        rows = self.memo.rows(data, starts, ends)
        at = self.memo.begin[rows]
        return self.memo.flat[at].astype(np.uint64) | (self.memo.flat[at + 1].astype(np.uint64) << np.uint64(32)), np.searchsorted(starts, places)

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        hashes, before = self.flat(texts)
        return [hashes[a:z] for a, z in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]


def labelled(words: np.ndarray, before: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text in order, each with its occurrence in the text, and the number of
    shingles before each text.  A text of fewer words is one shingle, one without words has none."""
    n = np.diff(before)
    size = np.minimum(n, k)
    count = np.where(n > 0, n - size + 1, 0)
    at = np.append(0, np.cumsum(count))
    text = np.repeat(np.arange(len(n)), count)
    first = np.arange(at[-1]) - at[text] + before[text]
    width = size[text]
    h = width.astype(np.uint64)
    for i in range(k):
        more = width > i
        step = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[np.minimum(first + i, len(words) - 1)]) if len(words) else h
        h = step if more.all() else np.where(more, step, h)
    own = _mix(h + text.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))  # equal only in one text
    s = np.sort(own)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if len(twice):
        rows = np.flatnonzero(np.isin(own, twice))
        rows = rows[np.argsort(own[rows], kind="stable")]
        group = np.flatnonzero(np.append(True, own[rows][1:] != own[rows][:-1]))
        nth = np.arange(len(rows)) - np.repeat(group, np.diff(np.append(group, len(rows))))
        later = rows[nth > 0]
        h[later] = _mix(h[later] + nth[nth > 0].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, at


def sketches_of(shingles: np.ndarray, at: np.ndarray, hashes: int = HASHES, order: int = ORDER) -> np.ndarray:
    """A row of entries for each text, as signed 64-bit integers.  Texts have a shingle at least."""
    n = np.diff(at)
    bits = np.uint64(max(1, int(n.max(initial=1)).bit_length()))
    place = (np.arange(len(shingles)) - np.repeat(at[:-1], n)).astype(np.uint64)
    out = np.empty((len(n), hashes), np.uint64)
    for k in range(hashes):
        value = (shingles ^ _SEEDS[k]) * (_SEEDS[63 - k] | np.uint64(1))
        value ^= value >> np.uint64(32)
        value = ((value * np.uint64(0x7FB5D329728EA185)) >> bits << bits) | place  # the place breaks ties, and says where the least is
        least = np.empty((len(n), order), np.uint64)
        for i in range(order):
            best = np.minimum.reduceat(value, at[:-1])
            some = best != _NONE
            where = at[:-1] + (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            least[:, i] = np.where(some, where.astype(np.uint64), _NONE)
            value[where[some]] = _NONE
        least.sort(axis=1)
        entry = np.full(len(n), _SEEDS[k])
        for i in range(order):
            here = least[:, i] != _NONE
            entry[here] = _mix(entry[here] * np.uint64(0x9E3779B97F4A7C15) + shingles[least[here, i].astype(np.int64)])
        out[:, k] = entry
    return out.view(np.int64)


def alignment(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> float:
    """The words that two texts have in common in order (their longest common subsequence) as a part of the longer
    text's words; some lower number where that is under the threshold.

    Where `threshold` is reached, no aligned pair of words is shifted by more than (1 - threshold) of the longer text, so
    only that band is looked at.  Rows are the bits of a number, in chunks of ROWS; what a chunk carries over in each
    column goes into the next one, so that a long text takes no more memory than a chunk's and a byte a word.
    """
    n, m = len(a), len(b)
    most = max(n, m)
    if not n or not m or min(n, m) < threshold * most - 1e-9:
        return 0.0
    low = min(n, m)
    head = int(np.argmin(same)) if not (same := a[:low] == b[:low]).all() else low
    low -= head
    tail = int(np.argmin(same)) if low and not (same := a[n - low :][::-1] == b[m - low :][::-1]).all() else low
    a, b = a[head : n - tail].tolist(), b[head : m - tail].tolist()
    band, total, least = int((1 - threshold) * most + 1e-9) + 1, head + tail, threshold * most - 1e-9
    carried = bytearray(len(b))
    for lo in range(0, len(a), ROWS):
        if total + min(len(a) - lo, len(b)) < least:
            return 0.0
        rows = a[lo : lo + ROWS]
        places: dict[int, int] = {}
        for i, w in enumerate(rows):
            places[w] = places.get(w, 0) | 1 << i
        full = row = (1 << len(rows)) - 1  # a bit for each word, 0 where the subsequence has grown
        first, stop = max(0, lo - band), min(len(b), lo + len(rows) + band)
        for c in range(first, stop):
            used = row & places.get(b[c], 0)
            if used or carried[c]:
                grown = row + used + carried[c]
                row = (grown | (row - used)) & full
                carried[c] = grown > full
        carried[:first] = bytes(first)
        total += len(rows) - row.bit_count()
    return total / most


def pairs_needed(n: int | np.ndarray, threshold: float = SIMILARITY):
    """Pairs of neighbouring words (labelled) that two texts share at least if they align to the threshold and the longer
    has n words: each of its (1 - threshold) n words that don't align breaks two of its n - 1 pairs, each of the other's,
    of which there are no more, one."""
    return np.ceil((1 - 3 * (1 - threshold)) * n - 1 - 1e-9)


def _postings(ids: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The owners of each id 0 to n - 1, and where each id's begin."""
    return owner[np.argsort(ids, kind="stable")], np.append(0, np.cumsum(np.bincount(ids, minlength=n)))


def links(texts: list[np.ndarray], roots: np.ndarray, sides: np.ndarray, threshold: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of texts (hashes of words) that align to the threshold and join the components `roots` as all such pairs would.

    If some of the texts have side 1, only pairs of different sides count.  Two texts align only if they share so many
    pairs of neighbouring words (pairs_needed) that one is among the first of either in an order of all pairs, rare ones
    first; so only those are looked up.  A text of so few words that none may be needed is compared with all of its
    length.  Texts of the main component needn't be looked up, since those outside of it are compared with all.
    """
    n, many = np.array([len(t) for t in texts]), len(texts)
    comp = np.unique(roots, return_inverse=True)[1]
    if not comp.any():
        return []
    grams, begin = labelled(np.concatenate(texts), np.append(0, np.cumsum(n)), 2)
    size = np.diff(begin)
    owner = np.repeat(np.arange(many), size)
    ids = np.unique(grams, return_inverse=True)[1]
    often = np.bincount(ids)
    ids = ids[np.lexsort((ids, often[ids], owner))]
    needed = np.minimum(pairs_needed(n, threshold), size)  # of a pair, the longer text's number holds, and it grows with n
    first = np.clip(size - needed + 1, 0, size).astype(np.int64)
    bare = needed < 1
    early = np.arange(len(ids)) - begin[owner] < first[owner]
    post, offset = _postings(ids[early], owner[early], len(often))
    whole: list[tuple[np.ndarray, np.ndarray]] = []
    two_sided, done, out = bool(sides.any()), np.zeros(many, bool), []

    def compare(x: int) -> None:
        mine = ids[begin[x] : begin[x + 1]]
        hit = bare.copy() if not bare[x] else np.ones(many, bool)
        for t in mine[: first[x]].tolist():
            hit[post[offset[t] : offset[t + 1]]] = True
        hit &= ~done & (comp != comp[x]) & (np.minimum(n, n[x]) >= threshold * np.maximum(n, n[x]) - 1e-9)
        if two_sided:
            hit &= sides != sides[x]
        near = np.flatnonzero(hit)
        if len(near) > 8:
            if not whole:
                whole.append(_postings(ids, owner, len(often)))
            shared = np.zeros(many, np.int64)
            for t in mine.tolist():
                shared[whole[0][0][whole[0][1][t] : whole[0][1][t + 1]]] += 1
            near = near[shared[near] >= np.minimum(pairs_needed(np.maximum(n[near], n[x]), threshold), np.minimum(size[near], size[x]))]
            near = near[np.argsort(-shared[near], kind="stable")]
        at = 0
        while at < len(near):
            y = int(near[at])
            at += 1
            if alignment(texts[x], texts[y], threshold) >= threshold - 1e-9:
                out.append((x, y))
                comp[comp == comp[y]] = comp[x]
                near, at = near[at:][comp[near[at:]] != comp[x]], 0
        done[x] = True

    by_length = np.argsort(n, kind="stable").tolist()
    for x in {by_length[0], by_length[-1], by_length[many // 2]}:  # likely to have many links
        compare(x)
    main = int(np.argmax(np.bincount(comp)))
    member = int(np.flatnonzero(comp == main)[0])
    for x in by_length:
        if not done[x] and comp[x] != comp[member]:  # comp[member] is the main component, whatever it is called by now
            compare(x)
    return out


_FOUND = [("t", T.LongType()), ("key", T.BinaryType()), ("n", T.IntegerType()), ("sketch", T.ArrayType(T.LongType())), ("words", T.BinaryType())]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, t (a hash of the text), key (128 bits of the words), n (words), sketch, and words (32 bits of each word's
    hash, in order) of each row that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for rows in by_bytes(batch, 1, BATCH_BYTES):
                words, before = hashes.flat(utf8(rows.column(1)))
                n = np.diff(before)
                which = np.flatnonzero(n)
                if not len(which):
                    continue
                flat = pa.array(sketches_of(*labelled(words, np.append(0, before[1:][which]))).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, HASHES), pa.int32()), flat)
                ends = list(zip(before[which].tolist(), before[which + 1].tolist(), strict=True))
                short = words.astype("<u4")
                keys = pa.array([xxhash.xxh3_128_digest(words[a:z].tobytes()) for a, z in ends], pa.binary())
                kept = pa.array(which)
                columns = [rows.column(0).take(kept), rows.column(2).take(kept), keys, pa.array(n[which], pa.int32()), lists, pa.array([short[a:z].tobytes() for a, z in ends], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *[c for c, _ in _FOUND]])
        del hashes
        give_back()

    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(*f) for f in _FOUND]])
    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).where(F.col("text").isNotNull()).mapInArrow(run, schema)


def candidates(nodes: DataFrame, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(a, b): different nodes of nodes(node, n, sketch) that share a bucket and whose lengths allow the similarity, each
    pair once.  Entries of different hash functions are different, so an entry names its bucket.  Also the members of the
    larger buckets, (bucket, node, n), of whose pairs only a tree is among the candidates."""
    members = nodes.select("node", "n", F.explode("sketch").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    rows = written(salted(members, sizes, ["bucket"], F.col("node"), "inner"), "buckets")
    few, many = rows.where(F.col("size") <= PAIRS), rows.where(F.col("size") > PAIRS)
    lists = few.groupBy("bucket").agg(F.collect_list(F.struct("node", "n")).alias("nodes"))
    lists = lists.select("nodes", F.posexplode("nodes").alias("i", "x")).select("x", F.explode(F.slice("nodes", F.col("i") + 2, F.lit(PAIRS))).alias("y"))
    pairs = lists.select(F.col("x.node").alias("x"), F.col("x.n").alias("xn"), F.col("y.node").alias("y"), F.col("y.n").alias("yn"))
    grouped = many.withColumn("grp", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / FAN)))
    leaders = grouped.groupBy("bucket", "grp").agg(F.min(F.struct("node", "n")).alias("y"))
    below = grouped.join(leaders, ["bucket", "grp"]).select(F.col("node").alias("x"), F.col("n").alias("xn"), "y")
    up = leaders.select("bucket", F.floor(F.col("grp") / FAN).alias("grp"), F.col("y").alias("x"))
    above = up.join(leaders, ["bucket", "grp"]).select(F.col("x.node").alias("x"), F.col("x.n").alias("xn"), "y")
    tree = below.unionByName(above).select("x", "xn", F.col("y.node").alias("y"), F.col("y.n").alias("yn"))
    pairs = pairs.unionByName(tree).where((F.col("x") != F.col("y")) & (F.least("xn", "yn") >= threshold * F.greatest("xn", "yn") - 1e-9))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), many.select("bucket", "node", "n")


def _words(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(w, "<u4") for w in column.to_pylist()]


def verified(pairs: DataFrame, nodes: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Those of pairs(a, b) whose nodes(node, words) align to the threshold or more.  Words go once to each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 2, BATCH_BYTES):
                good = [alignment(x, y, threshold) >= threshold - 1e-9 for x, y in zip(_words(part.column(2)), _words(part.column(3)), strict=True)]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in part.columns[:2]], names=["a", "b"])

    one = pairs.join(nodes.select(F.col("node").alias("a"), F.col("words").alias("x")), "a")
    both = one.join(nodes.select(F.col("node").alias("b"), F.col("words").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def missing_links(many: DataFrame, roots: DataFrame, nodes: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(a, b): roots of components of roots(node, root) that a pair of nodes of one bucket of many(bucket, node, n) links.
    A node without a root is its own.

    Buckets of one component have none.  The others are cut into blocks of about BLOCK words by the node's hash, and each
    two blocks of a bucket, and each block with itself, meet in one task.
    """

    def run(group: pa.Table) -> pa.Table:
        root = group.column("root").to_numpy()
        sides = (group.column("block").to_numpy() != group.column("i").to_numpy()).astype(np.int8)
        found = links([w.astype(np.uint64) for w in _words(group.column("words"))], root, sides, threshold)
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": root[a], "b": root[b]})

    rows = many.join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = rows.groupBy("bucket").agg(F.min("root").alias("one"), F.max("root").alias("other"), F.ceil(F.sum("n") / BLOCK).alias("blocks")).where(F.col("one") != F.col("other")).select("bucket", "blocks")
    rows = salted(rows, mixed, ["bucket"], F.col("node"), "inner")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.join(nodes.select("node", "words"), "node")
    rows = rows.select("bucket", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "root", "words")
    return rows.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, t, key, and least (null, doc_id, t of the document that stands for its class) of each row with a word."""
    spark = docs.sparkSession
    with scratch(spark):
        found = written(sketches(docs), "sketches")
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
        nodes = found.groupBy("key").agg(F.min(place).alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("words").alias("words"))
        nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written, so that the numbers stay
        rows = written(found.select("doc_id", "t", "key"), "rows")
        discard(found)
        pairs, many = candidates(nodes, threshold)
        pairs = written(pairs, "candidates")
        edges = written(verified(pairs, nodes, threshold), "verified")
        roots = components(edges)
        more = written(missing_links(many, roots, nodes, threshold), "missing-links")
        if not more.isEmpty():
            ends = more.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            roots = roots.unionByName(ends.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
            joined_roots = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
            roots = roots.join(joined_roots, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        classes = roots.join(nodes.select("node", "least"), "node")
        least = classes.groupBy("root").agg(F.min("least").alias("first"))
        named = salted(classes.select("node", "root"), least, ["root"], F.col("node"), "inner").select("node", "first")
        node_class = nodes.select("node", "key", "least").join(named, "node", "left").select("key", F.coalesce("first", "least").alias("least"))
        return kept(salted(rows, node_class, ["key"], F.struct("doc_id", "t"), "inner"), "classes")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id of each row of docs(doc_id, text): class_id is the least doc_id of the row's class.

    Texts of the same words are copies, whatever their case and blanks.  A null text, or one without words, is a class of
    its own.  A null doc_id is never a class's least, unless the class has no other.  Repeated rows come back each; rows
    of one doc_id and different texts may be in different classes.  An empty table gives an empty one; other columns are
    left out.
    """
    found = _classes(docs, threshold).select("doc_id", F.col("least.doc_id").alias("class_id"))
    alone = docs.select("doc_id", "text").where(F.col("text").isNull() | ~F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return found.unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id")))


def one_of_each(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: that of the least doc_id, of several texts under it the one of least hash, of
    repeated rows any.  A row without a doc_id stays only where its class has no row with one.  Null texts and those
    without words all stay."""
    rows = _classes(docs, threshold).groupBy("doc_id", "t").agg(F.first("least").alias("least"), F.count(F.lit(1)).alias("times"))
    stands = (F.col("least.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("least.t") == F.col("t"))
    h1, h2, m1, m2, stays, nth = unused(docs, 6)
    both = lambda doc, t: (F.xxhash64(doc, t), F.xxhash64(t, F.lit(7), doc))
    row, marked = both(F.col("doc_id"), F.xxhash64("text")), rows.where(~stands | (F.col("times") > 1))
    marked = written(marked.select(*[c.alias(m) for c, m in zip(both(F.col("doc_id"), F.col("t")), (m1, m2), strict=True)], stands.alias(stays)), "marked")
    # What is marked grows with the corpus: a merge join at every size, which shuffles the texts once; repeated rows meet in it.
    found = docs.withColumn(h1, row[0]).withColumn(h2, row[1]).join(marked.hint("merge"), (F.col(h1) == F.col(m1)) & (F.col(h2) == F.col(m2)), "left")
    found = found.withColumn(nth, F.row_number().over(Window.partitionBy(h1, h2).orderBy(h1)))
    return found.where(F.col(stays).isNull() | (F.col(stays) & (F.col(nth) == 1))).select(docs.columns)
