"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A suffix counts by its first ``WINDOW`` bytes. Suffixes that may repeat (``anchors``) are kept as
segments: the bytes of neighbouring suffixes that share an anchor. All suffixes of one anchor meet in
one task, where those at the same distance before it are a bucket; equal suffixes share the bucket.
Buckets are sorted a block at a time, so memory is bounded by the block:

1. The places of the block that lie in a difference cover (modulo ``PERIOD``, counted from the
   anchor) are the sample; the sample suffixes are ranked first, by their next 64 bytes.
2. The suffixes of each bucket are sorted by their first 8 bytes. Ties are resolved by the rank of the
   sample suffix that follows within 5 bytes, and what is still tied by the bytes behind it.

Of equal suffixes all but the earliest mark their bytes as removed. Equal segments of one task send
one segment to the sort: the others repeat it. So an anchor that very many documents share brings at
most one row from each task for each different surrounding.

Copies of a whole text are found first, by text; the first stays, all strings of the others start in it.

Defined results: null, empty and short texts lose nothing; rows with a null ``doc_id`` lose nothing and
remove nothing; rows that share a ``doc_id`` count as one document, equal rows as one; repeated rows give
repeated results; an empty table gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.anchors import anchor_of, candidates, mark, tag_of
from inkveil.llm.common import discard, slices, stage

WINDOW = 100
#: Bytes of an anchor.
ANCHOR = 32
PERIOD = 36
#: Bytes of segments sorted at once.
BLOCK = 2 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def difference_cover(period: int) -> np.ndarray:
    """The first s residues and the multiples of s: every difference is one of a multiple and a small residue."""
    s = int(np.ceil(np.sqrt(period)))
    return np.unique(np.r_[np.arange(s), np.arange(0, period, s)])


def words8(data: np.ndarray) -> np.ndarray:
    """At each place, its next eight bytes as a number (places near the end left out)."""
    n = len(data) - 7
    out = np.empty(max(0, n), np.uint64)
    for k in range(min(8, max(0, n))):
        own = data[k : k + (n - k + 7) // 8 * 8].view("<u8")
        out[k::8] = own
    return out


def grams32(text: bytes) -> np.ndarray:
    """Hash of every run of ``ANCHOR`` bytes."""
    w = words8(np.frombuffer(text, np.uint8))
    n = len(text) - ANCHOR + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = w[:n].copy()
    for o in (8, 16, 24):
        h = (h ^ (h >> np.uint64(29))) * _FACTOR + w[o : o + n]
    return (h ^ (h >> np.uint64(32))) * _FACTOR


def measure(text: bytes):
    """Content, length, hashes and anchors of a text, for ``anchors.mark``."""
    hashes = grams32(text)
    return text, len(text), hashes, anchor_of(hashes, WINDOW - ANCHOR + 1)


SEGMENT = "hash long, doc_id long, tag long, start int, end int, back int, segment binary"


def segments(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Segments by the hash of their anchor; and spans (no hash, no segment) that repeat a segment of the task."""

    def run(batches):
        seen: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                part = batch.slice(first, len(texts))
                rows = []
                for text, doc, tag, at in zip(texts, *(part.column(c).to_pylist() for c in ("doc_id", "tag", "at"))):
                    if tag_of(text) != tag:
                        continue  # another text with this doc_id
                    hashes = grams32(text)
                    anchor = anchor_of(hashes, WINDOW - ANCHOR + 1)
                    kept = np.flatnonzero(np.isin(anchor, at))
                    cut = np.r_[True, np.diff(anchor[kept]) != 0] if len(kept) else []
                    begin = kept[np.flatnonzero(cut)]
                    last = kept[np.r_[np.flatnonzero(cut)[1:] - 1, len(kept) - 1]] if len(kept) else begin
                    spans: list[list[int]] = []
                    for a, b in zip(begin.tolist(), (last + WINDOW).tolist()):
                        own = text[a:b]
                        key = xxhash.xxh3_128_digest(own)
                        earlier = seen.get(key)
                        if earlier is None or earlier > (doc, a):
                            seen[key] = (doc, a)
                            place = int(anchor[a])
                            rows.append((int(hashes[place].view(np.int64)), doc, tag, a, b, place - a, own))
                        elif earlier < (doc, a):
                            if spans and a <= spans[-1][1]:
                                spans[-1][1] = b
                            else:
                                spans.append([a, b])
                    rows += [(None, doc, tag, a, b, None, None) for a, b in spans]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                for a in range(0, len(rows), 8192):
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows[a : a + 8192]), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SEGMENT.split(", ")])

    with_text = docs.select(F.col("doc_id").cast("long"), "text").join(found, "doc_id")
    return with_text.mapInArrow(run, SEGMENT)


def classes(ids: np.ndarray, keys) -> tuple[np.ndarray, np.ndarray]:
    """Class numbers of rows that agree in ``ids`` and in every key, and the rows not alone in theirs.

    Each key is a function of row numbers. Rows that are alone take no part in later keys. The second
    result is in order of class, then row.
    """
    ids, active = ids.astype(np.int64), np.arange(len(ids))
    fresh = int(ids.max(initial=0)) + 1
    for key in keys:
        if not len(active):
            break
        a, k = ids[active], key(active)
        order = np.lexsort((k, a))
        a, k, active = a[order], k[order], active[order]
        c = np.cumsum(np.r_[False, (a[1:] != a[:-1]) | (k[1:] != k[:-1])])
        ids[active] = fresh + c
        fresh += int(c[-1]) + 1
        active = active[np.bincount(c)[c] > 1]
    return ids, active


def repeated_windows(group: np.ndarray, back: np.ndarray, parts: list[bytes]):
    """(segment, offset) of windows equal to an earlier one of their group; segments in order of place."""
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    base = np.cumsum(length) - length
    w = words8(np.frombuffer(b"".join(parts) + bytes(8), np.uint8))
    windows = length - WINDOW + 1
    segment = np.repeat(np.arange(len(parts)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = base[segment] + offset
    bucket = group[segment] * WINDOW + back[segment] - offset  # distance to the anchor

    cover = difference_cover(PERIOD)
    residues = np.arange(PERIOD)
    ahead = np.array([min((c - r) % PERIOD for c in cover) for r in residues])
    sample = at + ahead[(offset - back[segment]) % PERIOD]
    places, which = np.unique(sample, return_inverse=True)
    first = np.unique(which, return_index=True)[1]
    start = group[segment[first]] * 2 * WINDOW + (places - base[segment[first]]) - back[segment[first]] + WINDOW
    rank, _ = classes(start, [lambda i, o=o: w[places[i] + o] for o in range(0, 64, 8)])

    keys = [lambda i: w[at[i]], lambda i: rank[which[i]], *(lambda i, o=o: w[at[i] + o] for o in (64, 72, 80, 88, 92))]
    ids, tied = classes(bucket, keys)
    later = np.sort(tied[1:][ids[tied[1:]] == ids[tied[:-1]]])
    return segment[later], offset[later]


def sort_blocks(batches):
    """Spans that repeat, from segments in order of anchor and place."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        rest = now if rest is None else pa.concat_tables([rest, now])
        while rest is not None:
            key = rest.column("hash").to_numpy()
            size = np.cumsum(rest.column("end").to_numpy() - rest.column("start").to_numpy())
            ends = np.flatnonzero(key[1:] != key[:-1]) + 1  # a group may go on in the next batch
            fit = ends[size[ends - 1] >= BLOCK]
            if not len(fit):
                break
            yield from sort_block(rest.slice(0, fit[0]))
            rest = rest.slice(fit[0])
    if rest is not None and len(rest):
        yield from sort_block(rest)


def sort_block(rows: pa.Table):
    key, doc, tag, start, back = (rows.column(c).to_numpy() for c in ("hash", "doc_id", "tag", "start", "back"))
    same = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (start[1:] == start[:-1])
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    used = np.r_[True, ~same] & (np.bincount(group)[group] > 1)
    if not used.any():
        return
    doc, tag, start, back, group = doc[used], tag[used], start[used].astype(np.int64), back[used].astype(np.int64), group[used]
    segment, offset = repeated_windows(group, back, rows.column("segment").filter(pa.array(used)).to_pylist())
    if len(segment):
        new = np.r_[True, (segment[1:] != segment[:-1]) | (offset[1:] != offset[:-1] + 1)]
        a = np.flatnonzero(new)
        b = np.r_[a[1:] - 1, len(segment) - 1]
        s = segment[a]
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(doc[s]), "tag": pa.array(tag[s]),
            "start": pa.array((start[s] + offset[a]).astype(np.int32)), "end": pa.array((start[s] + offset[b] + WINDOW).astype(np.int32)),
        })


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, parts): tag, start and end of what repeats earlier bytes; an end of -1 stands for a whole copy."""
    copies, found = candidates(mark(docs, measure, within=True))
    pieces = stage(segments(docs, found))
    sorted_pieces = pieces.where("hash is not null").repartition("hash").sortWithinPartitions("hash", "doc_id", "start", "tag")
    spans = sorted_pieces.mapInArrow(sort_blocks, "doc_id long, tag long, start int, end int")
    again = pieces.where("hash is null").select("doc_id", "tag", "start", "end")
    whole = copies.select("doc_id", "tag", F.lit(0), F.lit(-1))
    every = spans.union(again).union(whole)
    out = stage(every.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "start", "end")).alias("parts")))
    discard(pieces, found)
    return out


def removed_runs(text: bytes, parts: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal removed runs of a text."""
    if not parts:
        return []
    tag, out = tag_of(text), []
    for a, b in sorted((p["start"], p["end"]) for p in parts if p["tag"] == tag):
        if b < 0:
            return [(0, len(text))] if len(text) >= WINDOW else []
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeat_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    joined = docs.select(F.col("doc_id").cast("long"), "text").join(repeated_spans(docs), "doc_id", "left")

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                part = batch.slice(first, len(texts))
                rows = []
                for text, parts in zip(texts, part.column("parts").to_pylist()):
                    runs = removed_runs(text, parts)
                    digest, at = hashlib.sha256(), 0
                    for a, b in runs:
                        digest.update(text[at:a])
                        at = b
                    digest.update(text[at:])
                    rows.append((len(text), sum(b - a for a, b in runs), len(runs), digest.hexdigest()))
                n, removed, runs, digest = zip(*rows)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
