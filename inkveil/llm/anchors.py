"""Which parts of a corpus may repeat: anchors of text windows.

A window (so many words or bytes) is anchored at the short run inside it whose hash is smallest, the
leftmost of equals. Equal windows have equal anchors at equal places, so a window whose anchor stands
nowhere else repeats nowhere. Neighbouring windows mostly share their anchor: only about two in a
window's width are looked up, instead of every window.

An anchor counts as repeated if it stands in two different texts or, if asked for, twice in one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import dealt, discard, slices, stage

#: Low bits of a hash that give way to the place in the text.
PLACE = np.uint64((1 << 24) - 1)
#: Places handled at once.
PIECE = 1 << 21


def tag_of(content: bytes) -> int:
    """64 bits that tell texts of equal ``doc_id`` apart, and find equal texts."""
    return xxhash.xxh3_64_intdigest(content) - (1 << 63)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def anchor_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` hashes the place of its anchor."""
    n = len(hashes) - width + 1
    out = []
    for first in range(0, n, PIECE):
        own = hashes[first : first + PIECE + width - 1]
        keys = own & ~PLACE | np.arange(len(own), dtype=np.uint64)
        out.append((sliding_minimum(keys, width) & PLACE).astype(np.int64) + first)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def arrays(parts, kind: pa.DataType) -> pa.ListArray:
    """One list for each of some numpy arrays."""
    offsets = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts), kind, safe=False))


def mark(docs: DataFrame, measure, within: bool, digest=None) -> DataFrame:
    """(row, doc_id, tag, n, hash[], at[], again[]) of every document with an id, staged; with ``digest`` (of the content).

    ``measure(text)`` gives the content that makes texts equal, its length, and the hashes and the anchor of
    each window. ``again``: the hashes that repeat within the document, if ``within`` asks for them.
    """

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                rows = []
                for text in texts:
                    content, n, hashes, anchor = measure(text)
                    at = anchor[np.r_[True, anchor[1:] != anchor[:-1]]] if len(anchor) else anchor
                    own = hashes[at].view(np.int64)
                    value, times = np.unique(own, return_counts=True) if within else (own, np.zeros(len(own)))
                    rows.append((tag_of(content), n, own, at, value[times > 1], digest(content).digest() if digest else None))
                tag, n, hashes, at, again, digests = zip(*rows)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(first, len(texts)),
                    "tag": pa.array(tag, pa.int64()), "n": pa.array(n, pa.int64()),
                    "hash": arrays(hashes, pa.int64()), "at": arrays(at, pa.int32()), "again": arrays(again, pa.int64()),
                    "digest": pa.array(digests, pa.binary()),
                })

    known = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    marked = known.mapInArrow(run, "doc_id long, tag long, n long, hash array<long>, at array<int>, again array<long>, digest binary")
    return stage(marked.select(F.monotonically_increasing_id().alias("row"), "*"))


def candidates(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copies (doc_id, tag) of texts with a smaller id, and (doc_id, tag, at[]) of repeated anchors in the rest.

    ``marked`` is discarded.
    """
    rows = stage(marked.select("row", "doc_id", "tag", "n"))
    firsts = rows.groupBy("tag", "n").agg(F.min("doc_id").alias("first"))
    known = stage(rows.join(firsts, ["tag", "n"]))
    copies = known.where("doc_id > first").select("doc_id", "tag").distinct()

    anchors = marked.select("tag", F.explode("hash").alias("hash"))
    in_two = anchors.groupBy("hash").agg(F.min("tag").alias("low"), F.max("tag").alias("high")).where("low != high")
    repeated = stage(in_two.select("hash").union(marked.select(F.explode("again"))).distinct())
    places = marked.select("row", F.inline(F.arrays_zip("hash", "at")))
    found = places.join(dealt(repeated), "hash").groupBy("row").agg(F.collect_list("at").alias("at"))
    kept = known.where("doc_id = first").join(found, "row").select("doc_id", "tag", "at")
    out = stage(kept.groupBy("doc_id", "tag").agg(F.first("at").alias("at")))  # repeated rows once
    discard(marked, repeated)
    return copies, out
