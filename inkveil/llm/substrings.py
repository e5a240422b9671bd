"""Substring removal by De Bruijn compaction.

A window is ``WINDOW`` consecutive words of one document. Windows that may repeat (``anchors``) become
edges of a De Bruijn graph: an edge leads from the node of its first ``WINDOW`` - 1 words to the node
of its last. Edges that stand in two documents keep the place of their first source. A node with one
edge in and one edge out is nonbranching; consecutive edges of one source that meet at such a node are
compacted into a path (degrees, and then the paths, are joined to the edges). The edges of every
other document lead, through a join, to paths and their source coordinates, and those that follow
one another on a path make one span. Each span is verified: the words at its source coordinates have
to give the digest of its own words. Verified spans are removed.

Copies of a whole text are found first, by text: the first stays, windows of the others all start in it.

Defined results: null, empty and short texts lose nothing; a null ``doc_id`` is neither smaller nor larger
than others, so such rows stay whole and remove nothing; rows that share a ``doc_id`` remove nothing
from each other; repeated rows give repeated results; an empty table gives an empty result. Extra
columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.anchors import anchor_of, arrays, candidates, mark, tag_of
from inkveil.llm.common import dealt, discard, slices, stage

#: Words of an anchor.
ANCHOR = 6
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, k):
        h = (h ^ (h >> np.uint64(29))) * _FACTOR + words[i : n + i]
    return (h ^ (h >> np.uint64(32))) * _FACTOR


def measure(window: int):
    """Content, length, hashes and anchors of a text, for ``anchors.mark``."""

    def run(text: bytes):
        words = text.split()
        hashes = grams(word_hashes(words), ANCHOR)
        return b" ".join(words), len(words), hashes, anchor_of(hashes, window - ANCHOR + 1)

    return run


def with_text(docs: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """(doc_id, text, ...) of the documents that ``other`` has rows for, by ``doc_id`` alone."""
    return docs.select(F.col("doc_id").cast("long"), "text").join(dealt(other), "doc_id", how)


def window_runs(docs: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """(doc_id, tag, first, nodes[]): runs of consecutive windows with a repeated anchor, as nodes."""

    def run(batches):
        width = window - ANCHOR + 1
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                part = batch.slice(first, len(texts))
                rows = []
                for text, doc, tag, at in zip(texts, *(part.column(c).to_pylist() for c in ("doc_id", "tag", "at"))):
                    words = text.split()
                    if tag_of(b" ".join(words)) != tag:
                        continue  # another text with this doc_id
                    hashes = word_hashes(words)
                    anchor = anchor_of(grams(hashes, ANCHOR), width)
                    # neighbouring windows mostly share their anchor: each is looked up once
                    change = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
                    held = np.repeat(np.isin(anchor[change], at), np.diff(np.r_[change, len(anchor)]))
                    kept = np.flatnonzero(held)
                    if not len(kept):
                        continue
                    base = kept[0]
                    nodes = grams(hashes[base : kept[-1] + window], window - 1).view(np.int64)
                    for own in np.split(kept, np.flatnonzero(np.diff(kept) > 1) + 1):
                        rows.append((doc, tag, int(own[0]), nodes[own[0] - base : own[-1] + 2 - base]))
                for a in range(0, len(rows), 4096):
                    doc, tag, start, nodes = zip(*rows[a : a + 4096])
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "tag": pa.array(tag, pa.int64()), "first": pa.array(start, pa.int32()), "nodes": arrays(nodes, pa.int64())})

    return with_text(docs, found).mapInArrow(run, "doc_id long, tag long, first int, nodes array<long>")


def edges_of(runs: DataFrame) -> DataFrame:
    """(a, b, doc_id, tag, at): every window as an edge between nodes."""
    n = F.size("nodes") - 1
    pairs = F.arrays_zip(F.slice("nodes", 1, n).alias("a"), F.slice("nodes", 2, n).alias("b"))
    return runs.select("doc_id", "tag", "first", F.posexplode(pairs).alias("i", "e")).select(
        F.col("e.a"), F.col("e.b"), "doc_id", "tag", (F.col("first") + F.col("i")).alias("at")
    )


def compact(edges: DataFrame) -> DataFrame:
    """(a, b, source, source_at, path): edges of two documents or more, by first source and path."""
    # the first place as one whole number: unlike a struct it is aggregated without a sort
    order = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)")
    firsts = edges.withColumn("place", order + F.col("at")).groupBy("a", "b").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.min("place").alias("place"))
    source_at = F.col("place") - F.col("source").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)")
    shared = stage(firsts.where("source < last").select("a", "b", "source", source_at.cast("int").alias("source_at")))
    ends = shared.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(
        shared.select("b", F.lit(0), F.lit(1))
    )
    through = ends.groupBy("node").agg(F.sum("out").alias("o"), F.sum("in").alias("i")).where("o = 1 and i = 1").select("node", F.lit(True).alias("through"))
    marked = shared.join(through, shared.a == through.node, "left")
    along = Window.partitionBy("source").orderBy("source_at")
    follows = F.col("through").isNotNull() & (F.lag("source_at").over(along) == F.col("source_at") - 1)
    start = F.when(~F.coalesce(follows, F.lit(False)), F.col("source_at"))
    path = F.last("start", ignorenulls=True).over(along)
    out = stage(marked.withColumn("start", start).select("a", "b", "source", "source_at", path.alias("path")))
    discard(shared)
    return out


def spans_of(edges: DataFrame, paths: DataFrame, window: int) -> DataFrame:
    """(doc_id, tag, start, words, source, source_start): what follows a path of an earlier document."""
    met = edges.join(paths.hint("shuffle_hash"), ["a", "b"]).where("doc_id > source")  # an edge has one path: no key is large on that side
    # A document may leave a path by a window of its own and come back to it, at the same distance.
    stay = F.col("at") - F.dense_rank().over(Window.partitionBy("doc_id", "tag").orderBy("at"))
    off = F.col("at") - F.col("source_at")
    spans = met.withColumn("stay", stay).groupBy("doc_id", "tag", "stay", "source", "path", off.alias("off")).agg(
        F.min("at").alias("start"), F.max("at").alias("end"), F.min("source_at").alias("source_start")
    )
    return spans.select("doc_id", "tag", "start", (F.col("end") - F.col("start") + window).alias("words"), "source", "source_start")


def digest_words(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def source_digests(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(source, source_start, words, digest) of every span at its source coordinates."""
    wanted = spans.select(F.col("source").alias("doc_id"), "source_start", "words").distinct()
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("source_start", "words")).alias("wanted"))

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                part = batch.slice(first, len(texts))
                rows = []
                for text, doc, want in zip(texts, part.column("doc_id").to_pylist(), part.column("wanted").to_pylist()):
                    words = text.split()
                    rows += [(doc, w["source_start"], w["words"], digest_words(words[w["source_start"] : w["source_start"] + w["words"]])) for w in want]
                doc, start, n, digest = zip(*rows)
                yield pa.RecordBatch.from_pydict({"source": pa.array(doc, pa.int64()), "source_start": pa.array(start, pa.int32()), "words": pa.array(n, pa.int32()), "digest": pa.array(digest, pa.binary())})

    found = with_text(docs, wanted).mapInArrow(run, "source long, source_start int, words int, digest binary")
    return found.distinct()


def removed_words(docs: DataFrame, window: int, marked: DataFrame | None = None) -> DataFrame:
    """(doc_id, parts): by document the tag of the text, start, words and source digest of each span.

    A copy of a whole text has one part without a digest. ``marked`` is discarded.
    """
    copies, found = candidates(marked or mark(docs, measure(window), within=False))
    runs = stage(window_runs(docs, found, window))
    paths = compact(edges_of(runs))
    spans = stage(spans_of(edges_of(runs), paths, window))
    discard(runs, paths)
    checked = dealt(spans).join(source_digests(docs, spans), ["source", "source_start", "words"]).select("doc_id", F.struct("tag", "start", "words", "digest").alias("part"))
    whole = copies.select("doc_id", F.struct("tag", F.lit(0).alias("start"), F.lit(-1).alias("words"), F.lit(None).cast("binary").alias("digest")).alias("part"))
    return stage(checked.union(whole).groupBy("doc_id").agg(F.collect_list("part").alias("parts")))


def kept_words(words: list[bytes], parts: list[dict] | None, window: int) -> np.ndarray:
    """Which words stay."""
    kept = np.ones(len(words), bool)
    if parts:
        tag = tag_of(b" ".join(words))
        for p in parts:
            if p["tag"] != tag:
                continue
            if p["words"] < 0:
                kept[:] = len(words) < window
            elif digest_words(words[p["start"] : p["start"] + p["words"]]) == p["digest"]:
                kept[p["start"] : p["start"] + p["words"]] = False
    return kept


def without_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` with ``text`` less its repeated words (the rest joined by a space), ``n_words`` and ``n_removed``.

    A text that loses nothing stays as it is. Columns called ``n_words`` and ``n_removed`` are replaced.
    """
    docs = docs.drop("n_words", "n_removed")
    out = docs.drop("parts_", "text").columns
    parts = removed_words(docs, window).withColumnsRenamed({"doc_id": "id_", "parts": "parts_"})
    joined = docs.join(dealt(parts), docs["doc_id"].cast("long") == F.col("id_"), "left").drop("id_")

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                part = batch.slice(first, len(texts))
                null = part.column("text").is_null().to_pylist()
                text, n, removed = [], [], []
                for own, parts, is_null in zip(texts, part.column("parts_").to_pylist(), null):
                    words = own.split()
                    kept = kept_words(words, parts, window)
                    n.append(len(words))
                    removed.append(int((~kept).sum()))
                    left = b" ".join([w for w, k in zip(words, kept.tolist()) if k]) if removed[-1] else own
                    text.append(None if is_null else left.decode())
                rest = {c: part.column(c) for c in out}
                yield pa.RecordBatch.from_pydict({**rest, "text": pa.array(text, pa.string()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64())})

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in out)
    return joined.mapInArrow(run, f"{fields}, text string, n_words long, n_removed long")


def digests(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of documents with a column ``parts`` (null: nothing is removed)."""

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                part = batch.slice(first, len(texts))
                rows = []
                for text, parts in zip(texts, part.column("parts").to_pylist()):
                    words = text.split()
                    kept = kept_words(words, parts, window)
                    left = b" ".join([w for w, k in zip(words, kept.tolist()) if k])
                    rows.append((len(words), int((~kept).sum()), hashlib.sha256(left).hexdigest()))
                n, removed, digest = zip(*rows)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def repeat_digest(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document.

    Number of words and digest of a whole text are taken when it is first read, so only documents that lose words are
    read again.
    """
    marked = mark(docs, measure(window), within=False, digest=hashlib.sha256)
    whole = stage(marked.select("doc_id", F.col("n").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lower(F.hex("digest")).alias("kept_sha256")))
    parts = removed_words(docs, window, marked)
    null = docs.where("doc_id is null").select(F.col("doc_id").cast("long"), "text", F.lit(None).cast(parts.schema["parts"].dataType).alias("parts"))
    lost = with_text(docs, parts)
    return whole.join(dealt(parts), "doc_id", "left_anti").union(digests(lost, window)).union(digests(null, window))
