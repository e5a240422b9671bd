"""Toxicity by a classifier chain.

The categories are predicted one after another, each by a linear (logistic) model over the words of
a text and the probabilities of the categories before it. In training, these probabilities come from
models that have not seen the row (out of fold), so that a later model learns from what it will meet.

The models are fitted on a bounded sample of the labelled documents (``most_rows``, by a hash of the
id); every document is scored. A feature is a distinct word or run of signs, or the first four or five
letters of a word, hashed into ``2 ** BITS`` cells. Only cells whose share differs between the two classes
of a category by ``LEAST_Z`` standard errors and a factor of ``LEAST_RATIO``, and that stand in
``LEAST_DOCS`` rows and ``LEAST_SHARE`` of the rows of a class, get a weight. Copies and near copies in the sample count once: else every word of a
toxic text that was copied would seem to be toxic.

Defined results: null, empty and wordless texts are scored by the intercepts alone; labels that are
null or of unknown documents teach nothing; of several labels of a document each counts as a row; a
category whose sample has one class only is predicted by its share; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import re
from binascii import crc32
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 20
LEAST_Z, LEAST_DOCS, LEAST_SHARE = 5.0, 5, 0.01
#: Copies in the sample are found by so many bands of so many minimum hashes.
BANDS, BAND = 3, 10
#: Frequencies in the two classes of a category differ by this factor at least.
LEAST_RATIO = 4.0
_WORD = re.compile(r"\w+|[^\w\s]{2,}")


def features(text: str | None) -> np.ndarray:
    """Distinct cells of a text."""
    own = set(_WORD.findall((text or "").lower()))
    keys = own | {w[:4] + "~" for w in own if len(w) > 4} | {w[:5] + "~" for w in own if len(w) > 5}
    return np.unique(np.fromiter((crc32(w.encode()) for w in keys), np.int64, len(keys)) & ((1 << BITS) - 1))


class Rows:
    """A sample as one list of cells and the row of each.

    Cells that too few rows hold to get a weight are left out, and the others numbered anew: ``known`` has the cell of
    each number. So no array of a fit is larger than the sample.
    """

    def __init__(self, cells: list[np.ndarray]):
        self.n = len(cells)
        every = np.concatenate([*cells, np.zeros(0, np.int32)])
        self.known = np.flatnonzero(np.bincount(every, minlength=1) >= LEAST_DOCS)
        at = np.searchsorted(self.known, every).astype(np.int32)
        kept = self.known[np.minimum(at, len(self.known) - 1)] == every if len(self.known) else np.zeros(len(every), bool)
        self.cell = at[kept]
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(c) for c in cells])[kept]

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.cell], self.n)

    def by_cell(self, weights: np.ndarray) -> np.ndarray:
        """Weights by the cell itself."""
        out = np.zeros(1 << BITS, np.float32)
        out[self.known] = weights
        return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def without_copies(cells: list[np.ndarray]) -> list[int]:
    """Numbers of the rows whose cells are not, nearly, those of an earlier row."""
    odd = np.random.default_rng(5).integers(1, 1 << 62, (2, BANDS * BAND), np.int64).view(np.uint64) | np.uint64(1)
    seen: set[tuple] = set()
    kept = []
    for i, own in enumerate(cells):
        if len(own):
            mixed = (own.astype(np.uint64)[:, None] + np.uint64(1)) * odd[0] ^ odd[1]
            least = (mixed * np.uint64(0x9E3779B97F4A7C15)).min(axis=0)
            keys = [(b, *least[b * BAND : (b + 1) * BAND].tolist()) for b in range(BANDS)]
            if not seen.isdisjoint(keys):
                continue
            seen.update(keys)
        kept.append(i)
    return kept


def fit(rows: Rows, extra: np.ndarray, y: np.ndarray, use: np.ndarray, steps: int = 300, l2: float = 1e-5):
    """Weights of the cells, of the earlier probabilities, and the intercept, from the rows in ``use``."""
    share = y[use].mean() if use.any() else 0.0
    size = len(rows.known)
    weights, chain = np.zeros(size), np.zeros(extra.shape[1])
    if share in (0.0, 1.0):
        return weights, chain, 20.0 * share - 10.0
    kept = use[rows.row]
    cell, row = rows.cell[kept], rows.row[kept]
    n1, n0 = (y[use] == 1).sum(), (y[use] == 0).sum()
    c1 = np.bincount(cell[y[row] == 1], minlength=size)
    c0 = np.bincount(cell[y[row] == 0], minlength=size)
    p = (c1 + c0) / (n1 + n0)
    z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    frequent = (c1 + c0 >= LEAST_DOCS) & (np.maximum(c1 / n1, c0 / n0) >= LEAST_SHARE)
    apart = np.abs(np.log((c1 + 1) / (n1 + 2)) - np.log((c0 + 1) / (n0 + 2))) >= np.log(LEAST_RATIO)
    chosen = np.flatnonzero((z >= LEAST_Z) & frequent & apart)
    at = np.full(size, -1)
    at[chosen] = np.arange(len(chosen))
    here = at[cell] >= 0
    col, row = at[cell[here]], row[here]
    w, b, rate = np.zeros(len(chosen) + extra.shape[1]), np.log(share / (1 - share)), 0.05
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    k = len(chosen)
    for i in range(1, steps + 1):  # Adam on the whole sample
        score = np.bincount(row, w[:k][col], rows.n) + extra @ w[k:] + b
        error = np.where(use, sigmoid(score) - y, 0.0) / use.sum()
        g = np.concatenate([np.bincount(col, error[row], k) + l2 * w[:k], extra.T @ error + l2 * w[k:], [error.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weights[chosen] = w[:k]
    return weights, w[k:], b


def fit_chain(rows: Rows, labels: np.ndarray, fold: np.ndarray, folds: int):
    """One model for each category, in order."""
    extra, models = np.zeros((rows.n, 0)), []
    for y in labels.T:
        weights, chain, b = fit(rows, extra, y, np.ones(rows.n, bool))
        models.append((rows.by_cell(weights), chain, b))
        held = np.zeros(rows.n)
        for k in range(folds):
            weights, chain, b = fit(rows, extra, y, fold != k)
            out = fold == k
            held[out] = sigmoid(rows.sums(weights) + extra @ chain + b)[out]
        extra = np.column_stack([extra, held])
    return models


def train(docs: DataFrame, labels: DataFrame, categories: list[str], most_rows: int = 8000, folds: int = 4):
    """``labels``: doc_id and a column of 0 or 1 for each category."""
    known = labels.dropna(subset=["doc_id", *categories]).select(F.col("doc_id").alias("own"), *(F.col(c).cast("double").alias(f"is_{c}") for c in categories))
    sample = known.orderBy(F.xxhash64("own"), "own").limit(most_rows)
    names = [f"is_{c}" for c in categories]

    def run(batches):
        for batch in batches:
            cells = [features(t.as_py()).astype("<i4").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"own": batch.column("own"), **{c: batch.column(c) for c in names}, "cells": pa.array(cells, pa.binary())})

    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("own")).select(sample["own"].cast("long"), *names, "text")
    schema = "own long, " + ", ".join(f"{c} double" for c in names) + ", cells binary"
    # a doc_id may stand in many rows: equal ones count once, and the bound holds for what is left
    rows = texts.mapInArrow(run, schema).distinct().orderBy(F.xxhash64("own"), "own", *names, "cells").limit(most_rows)
    got = rows.toArrow().sort_by([("own", "ascending"), *((c, "ascending") for c in names)])
    cells = [np.frombuffer(c.as_buffer(), "<i4") for c in got["cells"]]
    kept = without_copies(cells)
    y = np.column_stack([got[c].to_numpy()[kept] for c in names])
    fold = np.array([crc32(str(d).encode()) % folds for d in got["own"].to_numpy()[kept]], int)
    return fit_chain(Rows([cells[i] for i in kept]), y, fold, folds)


def probabilities(spark: SparkSession, models):
    """A function from a text column to the probability of each category."""
    shared = spark.sparkContext.broadcast(models)

    @F.arrow_udf("array<double>")
    def chain(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        models = shared.value
        for batch in batches:
            rows = []
            for text in batch:
                cells, known = features(text.as_py()), []
                for weights, before, b in models:
                    known.append(float(sigmoid(weights[cells].sum(dtype=np.float64) + before @ np.array(known) + b)))
                rows.append(known)
            yield pa.array(rows, pa.list_(pa.float64()))

    return chain


#: Low quality first, then toxic.
CHAIN = ["low_quality", "toxic"]


def fitted(docs: DataFrame, labels: DataFrame):
    """The chain of ``CHAIN``, as a function of the text."""
    known = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return probabilities(docs.sparkSession, train(docs, known, CHAIN))


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, toxic) of every document."""
    scored = docs.select(F.col("doc_id").cast("long"), fitted(docs, labels)("text").alias("p"))
    return scored.select("doc_id", F.col("p")[0].alias("p_low_quality"), F.col("p")[1].alias("p_toxic"), (F.col("p")[1] >= threshold).alias("toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows that are not toxic, as they are."""
    return docs.where(fitted(docs, labels)("text")[1] < threshold)
