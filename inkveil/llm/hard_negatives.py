"""Hard negatives by an inverted multi-index that is searched exactly.

Vectors are whole numbers (``floor(256 x)``), a score is an inner product. Each half of the vector has a
codebook; the two nearest codewords of a row name its cell. For an anchor, a codeword bounds the half-score
of its rows by the half-score of the codeword plus the length of the anchor's half times the codeword's
radius (over all rows), and a cell by the sum of its two bounds. A heap over both sorted sequences (multi-sequence) visits the
cells of an anchor from the highest bound down.

Each search has two rounds of Spark jobs. In the first an anchor visits cells until they hold ``SEED`` rows;
the k-th best score there is a floor. In the second it visits every further cell whose bound reaches
the floor, which certifies the result: no cell left out can hold a row of the first k. Positives are
searched first; their scores open the windows in which negatives are searched, each window certified by
itself. Rows and anchors meet by cell in sorted partitions that are read as a stream.

Bounds. The codebooks are fitted on ``SAMPLE_BYTES`` of vectors at most (those of least hash); all rows
are indexed. The index has ``MOST_WORDS`` ** 2 cells at most, whose sizes and radii are collected and
broadcast. A cell larger than ``BUCKET`` rows is dealt into buckets. Of rows that share label and vector only the
smallest ids can be chosen (equal scores go by id), so the index holds no more copies than a list has places, and
one: a vector that makes up a third of the table is a handful of rows here. Every row stays an anchor.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part; shorter
vectors count as filled up with zeros; rows that share an id are rows of their own; a list with fewer rows than asked for is returned as
it is; a positive score below zero has an empty window; other columns are left aside. Scores beyond 64 bits are refused.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import discard, stage

SAMPLE_BYTES, ROUNDS = 16 << 20, 8
MOST_WORDS, CELL, BUCKET = 256, 800, 4096
#: Rows of the first round; anchors multiplied at once; candidates a task holds before it thins them.
SEED, AT_ONCE, HELD = 2048, 256, 1 << 20
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

ROWS = "row long, vec_id long, label long, anchor boolean, q binary"
MET = "cell int, salt int, kind int, row long, vec_id long, label long, q binary, low binary, high binary"
FOUND = "anchor_row long, place int, score long, vec_id long, row long"
PAIRS = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_vectors(vectors: DataFrame, label: Column, is_anchor: Column) -> DataFrame:
    """Rows that take part: ``vec_id``, ``label``, ``anchor``, ``q`` as whole numbers."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & label.isNotNull() & x.isNotNull() & fine)
    q = F.transform(x, lambda v: F.floor(v * 256).cast("long"))
    return rows.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), q.alias("q"))


def packed(rows: DataFrame, dims: int, kind: str) -> DataFrame:
    """The rows with a number each, their vectors as bytes, filled up to ``dims``."""

    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            q = batch.column("q")
            own = np.diff(q.offsets.to_numpy())
            out = np.zeros((len(batch), dims), kind)
            out[np.arange(dims) < own[:, None]] = q.flatten().to_numpy()
            yield pa.RecordBatch.from_pydict({
                "row": pa.array(np.arange(at, at + len(batch))),
                **{c: batch.column(c) for c in ("vec_id", "label", "anchor")},
                "q": blobs(out),
            })
            at += len(batch)

    return stage(rows.mapInArrow(run, ROWS))


def blobs(matrix: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize if matrix.ndim == 2 else 0
    offsets = np.arange(len(matrix) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)]).cast(pa.binary())


def matrix(column, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def nearest(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest word of each row, and the distance to it."""
    best = ((words * words).sum(1) - 2 * (x @ words.T)).argmin(1)
    return best, np.sqrt(((x - words[best]) ** 2).sum(1))


def fit(x: np.ndarray, most: int) -> np.ndarray:
    """Codewords of one half by Lloyd's rounds, begun at rows spread over the sample."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    words = np.unique(x[np.linspace(0, len(x) - 1, min(most, len(x))).astype(int)], axis=0)
    for _ in range(ROUNDS):
        own = nearest(x, words)[0]
        n = np.bincount(own, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, own, x)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


class Index:
    """Codebooks, radii and sizes of the cells; small, of a size bounded by ``MOST_WORDS``."""

    def __init__(self, words, kind: str, dims: int):
        self.words, self.kind, self.dims, self.half = words, kind, dims, dims // 2

    def halves(self, q: np.ndarray) -> list[np.ndarray]:
        q = q.astype(np.float64)
        return [q[:, : self.half], q[:, self.half :]]

    def place(self, q: np.ndarray):
        """Cell of each row and its distances to the two codewords."""
        (a, r1), (b, r2) = (nearest(x, w) for x, w in zip(self.halves(q), self.words))
        return (a * len(self.words[1]) + b).astype(np.int32), r1, r2

    def measure(self, cells: list) -> None:
        """Take in (cell, rows, largest distance of either half) of all cells."""
        n = len(self.words[1])
        self.sizes = np.zeros(len(self.words[0]) * n, np.int64)
        self.radii = [np.zeros(len(w)) for w in self.words]
        for cell, rows, *radii in cells:
            self.sizes[cell] = rows
            for radius, word, r in zip(self.radii, divmod(cell, n), radii):
                radius[word] = max(radius[word], r)
        self.buckets = -(-self.sizes // BUCKET)

    def bounds(self, q: np.ndarray) -> list[np.ndarray]:
        """For each half: highest half-score that rows of a codeword can have, a hair above for rounding."""
        out = []
        for x, words, radius in zip(self.halves(q), self.words, self.radii):
            top = x @ words.T + np.sqrt((x * x).sum(1))[:, None] * radius
            out.append(top + 1e-9 * np.abs(top) + 1e-3)
        return out

    def visits(self, one: np.ndarray, two: np.ndarray):
        """(bound, cell) of the cells that hold rows, from the highest bound down."""
        first, second = np.argsort(-one), np.argsort(-two)
        heap = [(-(one[first[0]] + two[second[0]]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            cell = first[i] * len(two) + second[j]
            if self.sizes[cell]:
                yield -bound, int(cell)
            if j + 1 < len(second):
                heapq.heappush(heap, (-(one[first[i]] + two[second[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(first):
                heapq.heappush(heap, (-(one[first[i + 1]] + two[second[0]]), i + 1, 0))


def build(rows: DataFrame, kind: str, dims: int, count: int, copies: int) -> tuple[DataFrame, Index]:
    """The rows with their cell and bucket, staged, and the index over them."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(max(1, SAMPLE_BYTES // (8 * max(dims, 1)))).select("q")
    x = matrix(sample.toArrow().column("q"), kind, dims).astype(np.float64)
    most = int(np.clip(np.sqrt(count / CELL), 1, MOST_WORDS))
    index = Index([fit(x[:, : dims // 2], most), fit(x[:, dims // 2 :], most)], kind, dims)

    def assign(batches):
        for batch in batches:
            cell, r1, r2 = index.place(matrix(batch.column("q"), kind, dims))
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cell), "r1": pa.array(r1), "r2": pa.array(r2), **{c: batch.column(c) for c in ("row", "vec_id", "label", "q")}})

    first = F.row_number().over(Window.partitionBy("label", "q").orderBy("vec_id", "row"))
    fewer = rows.drop("anchor").withColumn("n", first).where(F.col("n") <= copies).drop("n")
    placed = stage(fewer.mapInArrow(assign, "cell int, r1 double, r2 double, row long, vec_id long, label long, q binary"))
    index.measure(placed.groupBy("cell").agg(F.count("*"), F.max("r1"), F.max("r2")).collect())  # a row for each cell
    buckets = spark.createDataFrame([(int(c), int(index.buckets[c])) for c in np.flatnonzero(index.buckets > 1)], "cell int, buckets int")
    salted = placed.join(buckets, "cell", "left").withColumn("salt", F.pmod(F.xxhash64("row"), F.coalesce("buckets", F.lit(1))).cast("int"))
    return salted.select("cell", "salt", "row", "vec_id", "label", "q"), index


def probes(anchors: DataFrame, index: Index, further: bool) -> DataFrame:
    """A row for each anchor and bucket it visits; ``low``, ``high``: its windows, packed.

    The first round visits cells until they hold ``SEED`` rows, the further one those that follow, down to the
    least of the anchor's lower limits.
    """

    def run(batches):
        for batch in batches:
            q = matrix(batch.column("q"), index.kind, index.dims)
            floors = [np.frombuffer(x, np.int64).min() for x in batch.column("low").to_pylist()]
            for start in range(0, len(q), AT_ONCE):
                one, two = index.bounds(q[start : start + AT_ONCE])
                at, cells, salts = [], [], []
                for i in range(len(one)):
                    seen = 0
                    for bound, cell in index.visits(one[i], two[i]):
                        if seen >= SEED and (not further or bound < floors[start + i]):
                            break
                        if (seen >= SEED) == further:
                            salts.extend(range(index.buckets[cell]))
                            cells.extend([cell] * index.buckets[cell])
                            at.extend([start + i] * index.buckets[cell])
                        seen += index.sizes[cell]
                if at:
                    own = batch.take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_pydict({
                        "cell": pa.array(cells, pa.int32()), "salt": pa.array(salts, pa.int32()), "kind": pa.array(np.ones(len(at), np.int32)),
                        **{c: own.column(c) for c in ("row", "vec_id", "label", "q", "low", "high")},
                    })

    return stage(anchors.select("row", "vec_id", "label", "q", "low", "high").mapInArrow(run, MET))


def thinned(parts: list[tuple], most: int) -> list[tuple]:
    """The first ``most`` of each (anchor, window) by score downwards, then by id."""
    anchor, place, score, vec_id, row = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((row, vec_id, -score, place, anchor))
    anchor, place = anchor[order], place[order]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1])]
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    keep = nth < most
    return [(anchor[keep], place[keep], score[order][keep], vec_id[order][keep], row[order][keep])]


def search(rows: DataFrame, visits: DataFrame, index: Index, same: bool, most: int, exact: bool) -> DataFrame:
    """The first ``most`` rows in each window of each anchor, among the buckets it visits."""
    kind, dims = index.kind, index.dims

    def scores(a, b):
        wide = np.float64 if exact else np.int64
        return (a.astype(wide) @ b.astype(wide).T).astype(np.int64)

    def met(anchors, held, parts):
        numbers, labels, q, low, high = anchors
        ids, own, own_labels, own_q = held
        s = scores(q, own_q)
        fits = (labels[:, None] == own_labels) if same else (labels[:, None] != own_labels)
        fits &= numbers[:, None] != own
        for w in range(low.shape[1]):
            i, j = np.nonzero(fits & (s >= low[:, w, None]) & (s <= high[:, w, None]))
            if len(i):
                parts.append((numbers[i], np.full(len(i), w), s[i, j], ids[j], own[j]))
        return len(parts) and sum(len(p[0]) for p in parts)

    def found(parts):
        anchor, place, score, vec_id, row = parts[0]
        return pa.RecordBatch.from_pydict({"anchor_row": pa.array(anchor), "place": pa.array(place, pa.int32()), "score": pa.array(score), "vec_id": pa.array(vec_id), "row": pa.array(row)})

    def run(batches):
        key, gathered, held, parts = None, [], None, []
        for batch in batches:
            cells = batch.column("cell").to_numpy().astype(np.int64) << 32 | batch.column("salt").to_numpy()
            kinds = batch.column("kind").to_numpy()
            number, ids, labels = (batch.column(c).to_numpy() for c in ("row", "vec_id", "label"))
            change = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])])
            for a, z in zip(change, [*change[1:], len(batch)]):
                if cells[a] != key:
                    key, gathered, held = cells[a], [], None
                q = matrix(batch.column("q").slice(a, z - a), kind, dims)
                if kinds[a] == 0:
                    gathered.append((ids[a:z], number[a:z], labels[a:z], q))
                    continue
                if held is None and gathered:
                    held = [np.concatenate(c) for c in zip(*gathered)]
                if held is None:
                    continue
                for i in range(a, z, AT_ONCE):
                    n = min(AT_ONCE, z - i)
                    limits = [np.array([np.frombuffer(x, np.int64) for x in batch.column(c).slice(i, n).to_pylist()]) for c in ("low", "high")]
                    if met((number[i : i + n], labels[i : i + n], q[i - a : i - a + n], *limits), held, parts) > HELD:
                        parts = thinned(parts, most)
                        if len(parts[0][0]) > HELD // 2:
                            yield found(parts)
                            parts = []
        if parts:
            yield found(thinned(parts, most))

    none = F.lit(None).cast("binary")
    visited = rows.join(visits.select("cell").distinct(), "cell", "left_semi")
    both = visited.select("cell", "salt", F.lit(0).alias("kind"), "row", "vec_id", "label", "q", none.alias("low"), none.alias("high")).unionByName(visits)
    dealt = both.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind")
    return dealt.mapInArrow(run, FOUND)


def first_ones(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def packed_limits(limits: Column) -> Column:
    """An array of whole numbers as bytes, eight each, least byte first."""
    eight = lambda v: F.reverse(F.lpad(F.hex(v), 16, "0"))
    # the hex digits reversed are bytes from the least up, with the two digits of each byte exchanged
    swapped = F.transform(limits, lambda v: F.regexp_replace(eight(v), "(.)(.)", "$2$1"))
    return F.unhex(F.array_join(swapped, ""))


def two_rounds(rows, anchors, index: Index, same: bool, most: int, exact: bool) -> DataFrame:
    """First rows of each window; ``anchors`` have ``low`` and ``high`` as arrays."""
    limits = lambda df: df.select("row", "vec_id", "label", "q", packed_limits(F.col("low")).alias("low"), packed_limits(F.col("high")).alias("high"))
    visits = probes(limits(anchors), index, further=False)
    seeds = stage(first_ones(search(rows, visits, index, same, most, exact), most))
    discard(visits)
    reached = seeds.where(F.col("rank") == most).groupBy("anchor_row").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("reached"))
    raised = anchors.join(reached.withColumnRenamed("anchor_row", "row"), "row", "left")
    floor = F.transform("low", lambda v, i: F.greatest(v, F.coalesce(F.try_element_at("reached", i), v)))
    visits = probes(limits(raised.withColumn("low", floor)), index, further=True)
    every = seeds.drop("rank").unionByName(search(rows, visits, index, same, most, exact))
    best = stage(first_ones(every, most))
    discard(visits, seeds)
    return best


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    For each anchor its first ``positives`` other rows of the same label, and for each of these the first ``negatives``
    rows of other labels with a score from ``low`` to ``high`` per cent of the positive's.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, label, is_anchor)
    highest = F.array_max(F.transform("q", lambda v: F.abs(v)))
    count, dims, largest, lowest = whole.agg(F.count("*"), F.max(F.size("q")), F.max(highest), F.min(F.array_min("q"))).first()
    if not count:
        return spark.createDataFrame([], PAIRS)
    dims, largest = max(dims, 2), max(largest or 0, -(lowest or 0))  # either half has a component at least
    if dims * largest * largest >= 1 << 62 or largest < 0:
        raise ValueError("scores of these vectors do not fit into 64 bits")
    kind = "int16" if largest < 1 << 15 else "int32" if largest < 1 << 31 else "int64"
    exact = dims * largest * largest < 1 << 53
    table = packed(whole, dims, kind)
    rows, index = build(table, kind, dims, count, max(positives + 1, negatives))
    anchors = table.where("anchor").select("row", "vec_id", "label", "q")
    open_ends = [F.array(F.lit(int(v)).cast("long")).alias(c) for v, c in ((LEAST, "low"), (MOST, "high"))]
    best = two_rounds(rows, anchors.select("*", *open_ends), index, True, positives, exact)
    score = F.col("score")
    # 50 p <= 100 n <= 95 p, in whole numbers; below zero the upper limit lies under the lower one
    down = F.call_function("div", score * high - F.pmod(score * high, F.lit(100)), F.lit(100).cast("long"))
    up = -F.call_function("div", -score * low - F.pmod(-score * low, F.lit(100)), F.lit(100).cast("long"))
    windows = F.array_sort(F.collect_list(F.struct("rank", up.alias("low"), down.alias("high"))))
    opened = best.groupBy(F.col("anchor_row").alias("row")).agg(windows.alias("w"))
    opened = opened.select("row", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    worst = two_rounds(rows, anchors.join(opened, "row"), index, False, negatives, exact)
    chosen = best.select("anchor_row", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = worst.select("anchor_row", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(chosen, ["anchor_row", "place"]).join(anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id")), "anchor_row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
