"""Benchmark decontamination by SimHash of item-sized windows.

Every benchmark item gives the 64-bit SimHashes of all its windows of the largest size that leaves room for a stride.
Documents are hashed in windows of the same sizes, one a stride, so any passage of an item's length holds a window that
starts where one of the item's does.  A multi-index finds all pairs within the radius: with 4 blocks of 16 bits, two
fingerprints that differ in RADIUS bits or fewer differ in at most RADIUS // 4 bits in one of the blocks, and each block
has a table from every value to the fingerprints within that distance.  The document's passage around each pair is then
compared with the item by the exact weights of shared word shingles.

Edits in one place can put all fingerprints of a passage beyond the radius.  So each item also has a few rare shingles,
of more weight than a passage may lack: a passage that is similar enough holds one of them.  In the documents that do, the
best passage is looked for at every word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import by_bytes, resident, unused
from .units import UnitMemo, joined

#: Words of a shingle, least part of an item's shingle weight that a passage shares with it, bits that fingerprints may differ in.
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 11
#: Bytes of items of one index; a larger benchmark is taken in several passes over the documents.
PASS_BYTES, BATCH_BYTES = 1 << 20, 1 << 20

_IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, where words begin and end, and the number of words before each text.

    A word is a run of ASCII letters and digits and of characters beyond ASCII; texts are in lower case already.
    """
    data, places = joined(texts)
    inside = np.zeros(len(data) - 14, bool)
    inside[1:-1] = _IN_WORD[data[:-16]]
    edge = inside[1:] != inside[:-1]
    starts, ends = np.flatnonzero(edge & inside[1:]), np.flatnonzero(edge & inside[:-1])
    inner = np.unique(places[1:-1])
    inner = inner[inside[inner] & inside[inner + 1]]  # a word doesn't go on in the next text
    if len(inner):
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    return data, starts, ends, np.searchsorted(starts, places)


def window_stride(n: int) -> int:
    """The largest stride for which an item of n words has a window at each offset of a stride; 0 for an item of fewer
    than four words, which is one window.  Windows have four strides; strides are 1, 2, 3, 5, 8, 12, 18, ..., each half
    as much again."""
    stride, following = 0, 1
    while 5 * following - 1 <= n:
        stride, following = following, following + (following + 1) // 2
    return stride


def _weight(word: bytes) -> int:
    """Longer words say more."""
    return min(len(word), 8)


class Signs:
    """The signs of the hash of each word, times its weight, as rows of 64, by way of a bounded memo."""

    def __init__(self, capacity: int = 500_000):
        self.memo = UnitMemo(self._add, capacity)
        self.table = np.zeros((4096, 64), np.int8)
        self.hashes = np.zeros(4096, np.uint64)

    def _add(self, words: list[bytes]) -> list[tuple]:
        if words:
            n, m = self.memo.n, self.memo.n + len(words)
            while m > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.hashes[n:m] = [xxhash.xxh64_intdigest(w) for w in words]
            bits = np.unpackbits(self.hashes[n:m].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            self.table[n:m] = (2 * bits.astype(np.int8) - 1) * np.array([_weight(w) for w in words], np.int8)[:, None]
        return [()] * len(words)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.both(data, starts, ends)[0]

    def both(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The signs and the hashes of the words."""
        rows = self.memo.rows(data, starts, ends)
        return self.table[rows], self.hashes[rows]


def simhashes(signs: np.ndarray, before: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of the windows of four strides that begin at each stride of each text: (fingerprint, text, first word
    in the text).  before: the number of words before each text."""
    n = np.diff(before) // step
    text = np.repeat(np.arange(len(n)), n)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * step
    if len(text) < 4:
        return np.zeros(0, np.uint64), text[:0], first[:0]
    at = before[text] + first
    sums = signs[at].astype(np.int16)
    for k in range(1, step):
        sums += signs[at + k]
    two = sums[:-1] + sums[1:]
    prints = np.packbits(two[:-2] + two[2:] > 0, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    whole = text[:-3] == text[3:]
    return prints[whole], text[:-3][whole], first[:-3][whole]


class MultiIndex:
    """All fingerprints within `radius` bits of a query, by 4 tables of 2 ** 16 entries."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        flips = [sum(1 << b for b in c) for n in range(radius // 4 + 1) for c in combinations(range(16), n)]
        values = np.arange(1 << 16)
        self.tables = []
        for k in range(4):
            block = ((prints >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
            sizes, order = np.bincount(block, minlength=1 << 16), np.argsort(block, kind="stable").astype(np.int32)
            first = np.cumsum(sizes) - sizes
            offset = np.zeros((1 << 16) + 1, np.int64)
            np.cumsum(sum(sizes[values ^ f] for f in flips), out=offset[1:])
            owner, free = np.empty(offset[-1], np.int32), offset[:-1].copy()
            sorted_block = block[order]
            rank = np.arange(len(order)) - first[sorted_block]
            for f in flips:  # one flip's entries at a time, so that little more than the table itself is held
                value = sorted_block ^ f
                owner[free[value] + rank] = order
                free += sizes[values ^ f]
            self.tables.append((offset, owner))

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, fingerprint) numbers of all pairs within the radius, each once."""
        found_q, found_p = [], []
        for k, (offset, owner) in enumerate(self.tables):
            block = ((queries >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
            begin, n = offset[block], offset[block + 1] - offset[block]
            some = np.flatnonzero(n)
            begin, n = begin[some], n[some]
            ends = np.cumsum(n)
            q = np.repeat(some, n)
            p = owner[np.repeat(begin - (ends - n), n) + np.arange(len(q))]
            near = np.bitwise_count(queries[q] ^ self.prints[p]) <= self.radius
            found_q.append(q[near])
            found_p.append(p[near])
        pairs = np.unique(np.stack([np.concatenate(found_q), np.concatenate(found_p)]), axis=1)
        return pairs[0], pairs[1]


def shingles(words: list[bytes], k: int = SHINGLE) -> Counter:
    """Weights of the shingles of k words."""
    out: Counter = Counter()
    for i in range(len(words) - k + 1):
        out[tuple(words[i : i + k])] += sum(map(_weight, words[i : i + k]))
    return out


def similarity(item: Counter, words: list[bytes]) -> float:
    """The part of the item's shingle weight that the passage shares."""
    have = shingles(words, len(next(iter(item))))
    return sum(min(w, have[s]) for s, w in item.items()) / sum(item.values())


def lower(text: str | None) -> bytes:
    return (text or "").lower().encode()


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the shingles of k words."""
    out = np.full(max(0, len(hashes) - k + 1), k, np.uint64)
    for i in range(k if len(out) else 0):
        out = (out ^ hashes[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class RareShingles:
    """Items by some of their shingles of k words, of more than 1 - threshold of the item's weight, rare ones first."""

    def __init__(self, k: int, items: dict[int, list[bytes]], threshold: float):
        self.k, self.length, self.threshold = k, {i: len(w) for i, w in items.items()}, threshold
        hashed = {i: rolled(np.array([xxhash.xxh64_intdigest(x) for x in w], np.uint64), k) for i, w in items.items()}
        self.known, ids, often = np.unique(np.concatenate(list(hashed.values())), return_inverse=True, return_counts=True)
        at, number, owner = 0, [], []
        self.most: dict[int, dict[int, tuple[int, int]]] = {}  # of an item's shingles: how often it has them, and the weight of one
        for i, w in items.items():
            mine = ids[at : at + len(hashed[i])].tolist()
            at += len(mine)
            count, weight = Counter(mine), {s: sum(map(_weight, w[j : j + k])) for j, s in enumerate(mine)}
            self.most[i] = {s: (n, weight[s]) for s, n in count.items()}
            left = (1 - threshold) * sum(n * v for n, v in self.most[i].values()) + 1e-6
            for s in sorted(count, key=lambda s: (often[s], s)):
                if left < 0:
                    break
                number.append(s)
                owner.append(i)
                left -= count[s] * weight[s]
        order = np.argsort(number, kind="stable")
        self.owner = np.array(owner)[order]
        self.offset = np.append(0, np.cumsum(np.bincount(number, minlength=len(self.known))))

    def search(self, hashes: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, first word) of the passage of most weight of each text and item that may be similar enough."""
        found = rolled(hashes, self.k)
        s = np.searchsorted(self.known, found)
        place = np.flatnonzero(self.known[np.minimum(s, len(self.known) - 1)] == found)
        text = np.searchsorted(before, place, "right") - 1
        inside = place + self.k <= before[text + 1]
        place, text = place[inside], text[inside]
        s = s[place]
        n = self.offset[s + 1] - self.offset[s]
        some = np.flatnonzero(n)
        pairs = {(int(text[h]), int(i)) for h in some for i in self.owner[self.offset[s[h]] : self.offset[s[h] + 1]]}
        edges = np.searchsorted(text, np.arange(len(before)))
        for d, i in sorted(pairs):
            a, z = edges[d], edges[d + 1]
            at = self._best(i, (place[a:z] - before[d]).tolist(), s[a:z].tolist())
            if at is not None:
                yield d, i, at

    def _best(self, i: int, places: list[int], numbers: list[int]) -> int | None:
        """The first word of the passage of most weight.  As it moves on, its weight only grows where a shingle enters."""
        most, room = self.most[i], self.length[i] - self.k
        hits = [(p, x) for p, x in zip(places, numbers, strict=True) if x in most]
        least = self.threshold * sum(n * v for n, v in most.values()) - 1e-6
        have: Counter = Counter()
        value, tail, best, start = 0, 0, least, None
        for p, x in hits:
            while hits[tail][0] < p - room:
                y = hits[tail][1]
                value -= most[y][1] * (have[y] <= most[y][0])
                have[y] -= 1
                tail += 1
            have[x] += 1
            value += most[x][1] * (have[x] <= most[x][0])
            if value > best or start is None and value >= least:
                best, start = value, max(0, p - room)
        return start


class Matcher:
    """All windows of a set of items; finds their passages in documents."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = SIMILARITY, radius: int = RADIUS):
        self.threshold, self.signs = threshold, Signs()
        data, starts, ends, before = split([lower(t) for _, t in items])
        words = [data[a:z].tobytes() for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
        words = [words[a:z] for a, z in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
        self.items = [(i, w) for (i, _), w in zip(items, words, strict=True) if w]
        self.weights = [shingles(w, min(SHINGLE, len(w))) for _, w in self.items]
        by_size: dict[int, dict[int, list[bytes]]] = {}
        for k, (_, w) in enumerate(self.items):
            by_size.setdefault(min(SHINGLE, len(w)), {})[k] = w
        self.rare = [RareShingles(size, members, threshold) for size, members in sorted(by_size.items())]
        by_step: dict[int, list[int]] = {}
        for k, (_, w) in enumerate(self.items):
            by_step.setdefault(window_stride(len(w)), []).append(k)
        self.tiny: dict[tuple, list[int]] = {}
        for k in by_step.pop(0, []):
            self.tiny.setdefault(tuple(self.items[k][1]), []).append(k)
        self.steps = []
        for step, members in sorted(by_step.items()):
            rests = [(k, o) for k in members for o in range(step)]  # windows at all offsets: those of an item without its first o words
            data, starts, ends, before = split([b" ".join(self.items[k][1][o:]) for k, o in rests])
            prints, text, first = simhashes(self.signs.of(data, starts, ends), before, step)
            owner, offset = np.array(rests)[text].T
            self.steps.append((step, MultiIndex(prints, radius), owner, offset + first))

    def search(self, texts: list[str | None]) -> list[tuple[int, int, float, int]]:
        """(text number, place of the item, similarity, first word) of the best passage of each pair of a text and an
        item, the earliest of equals."""
        data, starts, ends, before = split([lower(t) for t in texts])
        if not len(starts) or not self.items:
            return []
        signs, hashes = self.signs.both(data, starts, ends)
        votes: Counter = Counter()
        for step, index, owner, offset in self.steps:
            prints, text, first = simhashes(signs, before, step)
            queries, found = index.search(prints)
            votes.update(zip(text[queries].tolist(), owner[found].tolist(), np.maximum(0, first[queries] - offset[found]).tolist(), strict=True))
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for (d, k, at), _ in votes.most_common():  # nothing is better than a whole copy, so the likeliest places come first
            if (found := best.get((d, k), (0.0, 0)))[0] == 1.0 and at >= -found[1]:
                continue
            a = int(before[d]) + at
            z = min(a + len(self.items[k][1]), int(before[d + 1]))
            value = similarity(self.weights[k], [data[i:j].tobytes() for i, j in zip(starts[a:z].tolist(), ends[a:z].tolist(), strict=True)])
            if value >= self.threshold and (value, -at) > best.get((d, k), (0.0, 0)):
                best[d, k] = (value, -at)
        for rare in self.rare:
            for d, k, at in rare.search(hashes, before):
                a = int(before[d]) + at
                z = min(a + len(self.items[k][1]), int(before[d + 1]))
                value = similarity(self.weights[k], [data[i:j].tobytes() for i, j in zip(starts[a:z].tolist(), ends[a:z].tolist(), strict=True)])
                if value >= self.threshold and (value, -at) > best.get((d, k), (0.0, 0)):
                    best[d, k] = (value, -at)
        if self.tiny:
            self._search_tiny(data, starts, ends, before, best)
        return [(d, k, v, -at) for (d, k), (v, at) in sorted(best.items())]

    def _search_tiny(self, data, starts, ends, before, best) -> None:
        """Items of fewer than four words: the windows of their size that are equal."""
        for size in sorted({len(w) for w in self.tiny}):
            for d in range(len(before) - 1):
                words = [data[starts[i] : ends[i]].tobytes() for i in range(before[d], before[d + 1])]
                for i in range(len(words) - size, -1, -1):
                    for k in self.tiny.get(tuple(words[i : i + size]), ()):
                        best[d, k] = (1.0, -i)


_FOUND = [T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())]


@resident
def _matcher(lot: tuple[tuple[object, str], ...], threshold: float, radius: int) -> Matcher:
    """Kept by each Python worker for its further tasks."""
    return Matcher(list(lot), threshold, radius)


def lots(benchmark: DataFrame, most: int) -> Iterator[tuple[tuple[object, str], ...]]:
    """The items in lots of `most` bytes of text; the driver reads them one by one."""
    lot: list[tuple[object, str]] = []
    size = 0
    for r in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        n = len(r["text"].encode()) + 64
        if lot and size + n > most:
            yield tuple(lot)
            lot, size = [], 0
        lot.append((r["item_id"], r["text"]))
        size += n
    if lot:
        yield tuple(lot)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words of each pair of docs(doc_id, text) and benchmark(item_id, text)
    of which a passage of the document has the item's length and shares `threshold` of its shingle weight: the passage of
    most weight, the earliest of equals.

    Items go to the tasks in lots of at most PASS_BYTES, whose index a worker keeps for all its tasks; a larger benchmark
    makes further passes over docs.  Ids may be of any type.  Null and wordless texts match nothing, an item of fewer
    words than a shingle counts as one shingle.  Repeated documents come back each, repeated items and ids too; empty
    tables give an empty result; other columns are left out.  A batch takes about 100 bytes a word, of its longest text at
    least.  No shuffle.
    """
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"], *_FOUND])
    rows, out = docs.select("doc_id", "text"), None

    def with_items(lot: tuple[tuple[object, str], ...], kind: pa.DataType):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(lot, threshold, radius)
            for batch in batches:
                for part in by_bytes(batch, 1, BATCH_BYTES):
                    if found := matcher.search(part.column(1).to_pylist()):
                        doc, item, value, at = zip(*found, strict=True)
                        ids = pa.array([matcher.items[k][0] for k in item], kind)
                        columns = [part.column(0).take(pa.array(doc)), ids, pa.array(value), pa.array(at, pa.int64()), pa.array([len(matcher.items[k][1]) for k in item], pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return run

    for lot in lots(benchmark, PASS_BYTES):
        one = rows.mapInArrow(with_items(lot, to_arrow_type(benchmark.schema["item_id"].dataType)), schema)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """docs without the rows that hold a passage of the benchmark, whatever their doc_id; every other row stays as it is.

    If the benchmark is one lot, rows are dropped where they are matched, without a shuffle.  Else each lot makes a pass
    over docs, and the rows that any of them matched, known by 128 bits of their doc_id and text, go in one join.
    """
    every = list(lots(benchmark, PASS_BYTES))
    if not every:
        return docs
    h1, h2, m1, m2 = unused(docs, 4)
    keyed = docs.withColumn(h1, F.xxhash64("doc_id", F.xxhash64("text"))).withColumn(h2, F.xxhash64(F.xxhash64("text"), F.lit(7), "doc_id"))

    def hits(lot: tuple[tuple[object, str], ...], at: int, drop: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(lot, threshold, radius)
            for batch in batches:
                for part in by_bytes(batch, at, BATCH_BYTES):
                    found = {d for d, *_ in matcher.search(part.column(at).to_pylist())}
                    if drop:
                        yield part.filter(pa.array([i not in found for i in range(part.num_rows)], pa.bool_())) if found else part
                    elif found:
                        yield pa.RecordBatch.from_arrays([c.take(pa.array(sorted(found))) for c in part.columns[:2]], names=[m1, m2])

        return run

    if len(every) == 1:
        return docs.mapInArrow(hits(every[0], docs.columns.index("text"), True), docs.schema)
    found = reduce(DataFrame.unionByName, [keyed.select(h1, h2, "text").mapInArrow(hits(lot, 2, False), f"`{m1}` long, `{m2}` long") for lot in every]).distinct()
    return keyed.join(found, (F.col(h1) == F.col(m1)) & (F.col(h2) == F.col(m2)), "left_anti").select(docs.columns)
