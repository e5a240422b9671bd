"""SimHash near-duplicates through the Golay code.

The fingerprint of a text has 64 bits; a bit is set if it is set in over half the hashes of the
text's shingles. Two fingerprints link at ``max_distance`` (4 at most) or fewer differing bits.

Keys. Bits 0-22 and 23-45 are words A and B of 23 bits, bits 46-63 are the rest C. In the perfect
(23, 12) Golay code every word lies within 3 bits of one codeword. The keys of a word are the indices
of all codewords within 4 bits of it (one or six): two words at most 2 bits apart have a key in
common, since a word half way lies within 3 bits of a codeword, which is then within 4 bits of both.
Of 4 errors in all, either A and B have at most 2 each, and a pair of their keys is shared; or A has 3
or more, and then B is equal, or B has at most one error and C is equal; or the same with A and B
exchanged. So five kinds of keys find every link:

    keys of A x keys of B | B | keys of B x C | A | keys of A x C        (about 41 a fingerprint)

Copies are one row before keys are made. A key of two fingerprints is one candidate pair. The
fingerprints of a key with more are joined by a search over its members that compares each against
those not yet reached, and only the links that connect them are kept; a key with more than
``CHUNK`` members is cut into chunks, and every pair of chunks is searched by itself.

Defined results: null, empty and wordless texts have fingerprint zero and link like any other; a null
``doc_id`` is kept, and a component of such rows alone has a null id; repeated rows stay repeated;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import dealt, slices, stage
from inkveil.llm.components import components

#: Generator polynomial of the Golay code (fixed value).
GENERATOR = 0b110001110101
CHUNK = 2048
SEED = 42


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit SimHash over word shingles; A-Z are lower-cased, words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for first in range(0, n, 1 << 15):
        last = min(n, first + (1 << 15))
        a = starts[first:last].tolist()
        b = ends[first + shingle - 1 : last + shingle - 1].tolist() if len(words) >= shingle else [len(joined)]
        hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) of every document."""

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                fps = pa.array([fingerprint(t, shingle) for t in texts], pa.int64())
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(first, len(texts)), "fp": fps})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def remainder(word: int) -> int:
    """Of a 23-bit word, divided by the generator."""
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and high 11 bits; error patterns by remainder (six, -1 where fewer)."""
    single = [remainder(1 << i) for i in range(23)]
    low = np.array([np.bitwise_xor.reduce([single[i] for i in range(12) if v >> i & 1] + [0]) for v in range(1 << 12)])
    high = np.array([np.bitwise_xor.reduce([single[12 + i] for i in range(11) if v >> i & 1] + [0]) for v in range(1 << 11)])
    errors: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            rest = 0
            for i in bits:
                rest ^= single[i]
            errors[rest].append(sum(1 << i for i in bits))
    return low, high, np.array([e + [-1] * (6 - len(e)) for e in errors])


def word_keys(words: np.ndarray, tables) -> np.ndarray:
    """(n, 6) indices of codewords within 4 bits; -1 where there are fewer."""
    low, high, errors = tables
    e = errors[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(e >= 0, (words[:, None] ^ e) >> 11, -1)


def keys_of(fps: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """Keys and, for each, the number of its fingerprint."""
    u = fps.view(np.uint64)
    a = (u & np.uint64(0x7FFFFF)).astype(np.int64)
    b = (u >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
    c = (u >> np.uint64(46)).astype(np.int64)
    ka, kb = word_keys(a, tables), word_keys(b, tables)
    both = np.where((ka[:, :, None] >= 0) & (kb[:, None, :] >= 0), ka[:, :, None] << 12 | kb[:, None, :], -1).reshape(len(u), -1)
    with_c = lambda k: np.where(k >= 0, k << 18 | c[:, None], -1)
    kinds = [both, b[:, None], with_c(kb), a[:, None], with_c(ka)]
    keys = np.concatenate([np.where(k >= 0, k | i << 40, -1) for i, k in enumerate(kinds)], axis=1)
    row, col = np.nonzero(keys >= 0)
    return keys[row, col], row


def forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links (numbers of fingerprints) that connect all that are connected at ``most`` bits."""
    fps = fps.view(np.uint64)  # bits of negative numbers would be counted by their size
    left, found = np.arange(len(fps)), []
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            i = reached.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= most
            found += [(i, j) for j in left[near]]
            reached += list(left[near])
            left = left[~near]
    return found


def links(classes: DataFrame, max_distance: int = 4) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` within ``max_distance`` bits."""
    if not 0 <= max_distance <= 4:
        raise ValueError("the keys find links of at most 4 bits")
    tables = golay_tables()

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                fps = batch.column("fp").slice(first, 4096).to_numpy(zero_copy_only=False)
                key, row = keys_of(fps, tables)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key), "fp": pa.array(fps[row])})

    keyed = classes.select("fp").mapInArrow(run, "key long, fp long")
    by_key = stage(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    pairs = by_key.where("n = 2").where(near).select("a", "b")

    more = by_key.where("n > 2").select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    members = dealt(keyed).join(more, "key").withColumn("own", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    groups = members.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")

    def search(batches):
        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            cols = [now.column(c).to_numpy() for c in ("key", "i", "j")]
            new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in cols])) + 1
            last = int(new[-1]) if len(new) else 0
            rest = now.slice(last)
            yield from found(now.column("fp").to_numpy()[:last], np.r_[0, new])
        if rest is not None:
            yield from found(rest.column("fp").to_numpy(), np.array([0, len(rest)]))

    def found(fps, bounds):
        out = []
        for s, e in zip(bounds[:-1], bounds[1:]):
            own = fps[s:e]
            out += [(own[i], own[j]) for i, j in forest(own, max_distance)]
        if out:
            a, b = np.array(out, np.int64).T
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    sorted_groups = groups.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return pairs.union(sorted_groups.mapInArrow(search, "a long, b long")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest id that links lead to, for every document."""
    marked = stage(fingerprints(docs, shingle))
    found = components(links(marked.select("fp").distinct(), max_distance))
    joined = marked.join(found, marked.fp == found.node, "left").select("doc_id", "fp", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return joined.join(least, "component").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """The row with the smallest id of each component, as it is; equal rows once, rows without an id all."""
    first = near_duplicates(docs, shingle, max_distance).where("doc_id = component_id").select(F.col("doc_id").alias("kept_")).distinct()
    kept = docs.join(first, docs["doc_id"].cast("long") == F.col("kept_"), "left_semi")
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    once = kept.withColumn("nth_", F.row_number().over(same)).where("nth_ = 1").drop("nth_")
    return once.unionByName(docs.where("doc_id is null"))
