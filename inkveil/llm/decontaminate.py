"""Benchmark decontamination by SimHash of item-sized windows.

An item is a benchmark text. For each item, the windows of its own length in every document are
compared with it by weighted similarity of five-word shingles: the sum over shingles of the smaller
count divided by the sum of the larger. At ``similarity`` or more the document holds the item.

A window can be similar only if it shares a shingle with the item, so windows are taken around
shared shingles alone (a test of every shingle of the corpus against the items'). Their
SimHash fingerprints go through a multi-index: the 64 bits are cut into ``radius + 1`` blocks, two
fingerprints within the radius agree in a block, and the items with an equal block are looked up,
kept within the radius, and then verified exactly. At radius 20 of 64 bits a similarity of 0.8
(an angle of 27 degrees, 10 bits expected, deviation 3) is missed about three times in ten thousand
windows, and neighbouring windows give a document further chances.

The index of at most ``items_at_once`` items is broadcast; a longer benchmark is taken in blocks of
so many, each against all documents. Windows run over the text's ends, where they are cut.

Defined results: words are lower-cased (A-Z), separated by ASCII characters other than letters and
digits; null, empty and wordless texts and items match nothing; an item of fewer than five words is
one shingle; repeated documents are judged each by itself; repeated items, and items that share an id or have none, are
items of their own, each giving a row; an empty table on either side gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import discard, row_ids, slices

SHINGLE = 5
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of each word, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: bytes, known: WordHashes) -> np.ndarray:
    words = text.translate(_TABLE).split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, k):
        h = (h ^ (h >> np.uint64(29))) * _FACTOR + words[i : n + i]
    return (h ^ (h >> np.uint64(32))) * _FACTOR


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums of +1 and -1 by bit, with a first row of zeros."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    return np.vstack([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def simhashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return np.packbits(sums[end] - sums[start] > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    x, y = Counter(a.tolist()), Counter(b.tolist())
    return (x & y).total() / max(1, (x | y).total())


class Items:
    """Index of one block of items."""

    def __init__(self, rows: list[tuple[int, str]], radius: int):
        known = WordHashes()
        self.radius, self.id, self.size, self.shingle, fps = radius, [], [], [], []
        for item, text in rows:
            words = word_hashes((text or "").encode(), known)
            if len(words):
                own = shingles(words, min(SHINGLE, len(words)))
                self.id.append(item)
                self.size.append(len(words))
                self.shingle.append(own)
                fps.append(simhashes(bit_sums(own), np.array([0]), np.array([len(own)]))[0])
        self.fp = np.array(fps, np.uint64)
        self.size = np.array(self.size, np.int64)
        #: By shingle length: the shingles of all items, sorted, with the window size each asks for.
        self.by_length = {}
        for k in sorted({min(SHINGLE, s) for s in self.size.tolist()}):
            pairs = sorted({(h, s) for own, s in zip(self.shingle, self.size.tolist()) if min(SHINGLE, s) == k for h in own.tolist()})
            self.by_length[k] = np.array([h for h, _ in pairs], np.uint64), np.array([s for _, s in pairs], np.int64)
        bounds = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(bounds[:-1], bounds[1:])]
        self.table = {}
        for s in set(self.size.tolist()):
            own = np.flatnonzero(self.size == s)
            for j, (shift, mask) in enumerate(self.blocks):
                keys = self.fp[own] >> shift & mask
                order = np.argsort(keys, kind="stable")
                self.table[s, j] = keys[order], own[order]

    def near(self, fps: np.ndarray, size: int) -> np.ndarray:
        """(window, item) pairs within the radius."""
        found = []
        for j, (shift, mask) in enumerate(self.blocks):
            keys, own = self.table[size, j]
            value = fps >> shift & mask
            lo, hi = np.searchsorted(keys, value, "left"), np.searchsorted(keys, value, "right")
            window = np.repeat(np.arange(len(fps)), hi - lo)
            item = own[np.arange(len(window)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
            keep = np.bitwise_count(fps[window] ^ self.fp[item]) <= self.radius
            found.append(np.column_stack([window[keep], item[keep]]))
        return np.unique(np.concatenate(found), axis=0)

    def search(self, words: np.ndarray, similarity: float):
        """(item, similarity, first word) of the best window for each item found in a text."""
        best: dict[int, tuple[float, int]] = {}
        for k, (known, sizes) in self.by_length.items():
            own = shingles(words, k)
            lo = np.searchsorted(known, own)
            hit = np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == own) if len(known) else []
            if not len(hit):
                continue
            hi = np.searchsorted(known, own[hit], "right")
            starts: dict[int, list] = {}
            for at, a, b in zip(hit.tolist(), lo[hit].tolist(), hi.tolist()):
                for s in sizes[a:b].tolist():
                    starts.setdefault(s, []).append(at)
            for size, places in starts.items():
                self._windows(own, k, size, np.array(places), similarity, best)
        return [(self.id[i], v, at) for i, (v, at) in sorted(best.items())]

    def _windows(self, own, k, size, places, similarity, best):
        width = size - k + 1  # shingles of a window
        for part in np.split(places, np.flatnonzero(np.diff(places) > 64) + 1):
            for piece in np.split(part, range(512, len(part), 512)):
                first, last = piece[0] - width + 1, piece[-1]
                base = max(0, first)
                end = min(len(own), last + width)
                start = np.arange(first, last + 1)
                a, b = np.clip(start, base, end), np.clip(start + width, base, end)
                fps = simhashes(bit_sums(own[base:end]), a - base, b - base)
                for w, i in self.near(fps, size):
                    value = weighted_similarity(own[a[w] : b[w]], self.shingle[i])
                    if value >= similarity and (value, -a[w]) > (best.get(i, (0, 0))[0], -best.get(i, (0, 0))[1]):
                        best[i] = (value, int(a[w]))


def benchmark_blocks(benchmark: DataFrame, items_at_once: int):
    """The items, so many at a time, by a number of their own: ids may repeat or be missing."""
    items = row_ids(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), "number")
    after = -1
    while True:
        rows = items.where(F.col("number") > after).orderBy("number").limit(items_at_once).collect()
        if rows:
            yield [(r.item_id, r.text) for r in rows]
            after = rows[-1].number
        if len(rows) < items_at_once:
            discard(items)
            return


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 20, items_at_once: int = 20_000) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): every document and item that it holds."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, similarity double, first_word long"
    out = spark.createDataFrame([], schema)
    for block in benchmark_blocks(benchmark, items_at_once):
        out = out.union(leaks_of_block(docs, spark.sparkContext.broadcast(cloudpickle.dumps(Items(block, radius))), similarity, schema))
    return out


def leaks_of_block(docs: DataFrame, shared, similarity: float, schema: str) -> DataFrame:
    def run(batches):
        items, known = cloudpickle.loads(shared.value), WordHashes()
        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in slices(batch.column("text")):
                rows = [(first + n, *x) for n, t in enumerate(texts) for x in items.search(word_hashes(t, known), similarity)]
                if rows:
                    n, item, value, at = zip(*rows)
                    yield pa.RecordBatch.from_pydict({"doc_id": ids.take(pa.array(n)), "item_id": pa.array(item, pa.int64()), "similarity": pa.array(value, pa.float64()), "first_word": pa.array(at, pa.int64())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 20, items_at_once: int = 20_000) -> DataFrame:
    """The rows that hold no item, as they are."""
    context = docs.sparkSession.sparkContext
    for block in benchmark_blocks(benchmark, items_at_once):
        docs = docs.where(~holds_item(context.broadcast(cloudpickle.dumps(Items(block, radius))), similarity)("text"))
    return docs


def holds_item(shared, similarity: float):
    @F.arrow_udf("boolean")
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items, known = cloudpickle.loads(shared.value), WordHashes()
        for batch in batches:
            yield pa.array([bool(items.search(word_hashes(t, known), similarity)) for _, texts in slices(batch) for t in texts], pa.bool_())

    return holds
