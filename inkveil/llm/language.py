"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, everything but letters becomes a space, runs of spaces become one, and every
run of one to three characters counts as a feature, hashed into ``2 ** BITS`` cells. Spark sums the
features of all labelled documents by language; the matrix of log probabilities (cells x languages,
bounded by both) is broadcast, and numpy adds up the entries of each document.

Defined results: a text that is null or has no letter is ``und`` with score 0; rows without a
language teach nothing; without any labelled row every document is ``und``; equal languages share
their ties by name (the first in order wins). The score is the posterior probability of the answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16
#: Cells of the model, at most: so many languages.
MOST_LANGUAGES = 500
#: Characters handled at once, so that a very long text needs no more memory.
PIECE = 1 << 18
_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which characters of the first plane are letters."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(1 << 16)]))
    return _LETTERS[0]


def normal_codes(text: str) -> np.ndarray:
    """Lower-case letters as code points, single spaces between words and at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    table = letter_table()
    known = table[np.minimum(codes, 0xFFFF)]
    high = codes > 0xFFFF
    if high.any():
        known[high] = [chr(c).isalpha() for c in codes[high]]
    codes = np.concatenate([[32], np.where(known, codes, 32), [32]]).astype(np.uint64)
    return codes[1 - np.r_[False, (codes[1:] == 32) & (codes[:-1] == 32)].astype(np.int8) == 1]


def cells(text: str):
    """Feature cells of a text, piece by piece; nothing for a text without letters."""
    codes = normal_codes(text)
    if len(codes) < 3:
        return
    for first in range(0, len(codes), PIECE):
        c = codes[first : first + PIECE + 2]
        own = min(PIECE, len(codes) - first)
        two = c[:-1] * np.uint64(0x110000) + c[1:] if len(c) > 1 else c[:0]
        three = two[:-1] * np.uint64(0x110000) + c[2:] if len(c) > 2 else c[:0]
        grams = np.concatenate([c[:own], two[:own], three[:own]])
        yield ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def count_features(labelled: DataFrame) -> DataFrame:
    """(lang, cell, n): how often each feature stands in texts of each language."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                own = sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for c in cells(text.as_py()):
                    own += np.bincount(c, minlength=1 << BITS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "cell": pa.array(at), "n": pa.array(own[at])})

    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    return rows.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, alpha: float = 0.05) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and the log probabilities with the log prior in a last row."""
    known = labelled.where("text is not null and lang is not null")
    docs = {r[0]: r[1] for r in known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(docs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(docs)
    counts = np.zeros((1 << BITS, len(langs)))
    table = count_features(known).toPandas()  # at most 2 ** BITS rows for each language
    counts[table["cell"], table["lang"].map(langs.index)] = table["n"]
    logs = np.log((counts + alpha) / (counts.sum(0) + alpha * (1 << BITS)))
    prior = np.log(np.array([docs[x] for x in langs]) / max(1, sum(docs.values())))
    return langs, np.vstack([logs, prior])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``doc_id``, ``held_out`` as given, ``lang_pred``, ``score``."""
    langs, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def run(batches):
        logs = shared.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column("text"):
                total = None
                for c in cells(text.as_py() or "") if langs else ():
                    total = (logs[-1] if total is None else total) + logs[c].sum(0)
                if total is None:
                    names.append("und")
                    scores.append(0.0)
                else:
                    best = int(total.argmax())
                    names.append(langs[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(scores, pa.float64()),
            })

    rows = docs.select(F.col("doc_id").cast("long"), "held_out", "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from two thirds of the documents, chosen by a checksum of the id, and predict all."""
    third = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3
    marked = docs.select("doc_id", "text", "lang", (third == 1).alias("held_out"))
    return predict(marked, train(marked.where(~F.col("held_out")).select("text", "lang")))
