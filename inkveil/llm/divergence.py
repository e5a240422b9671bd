"""How far each source's use of words is from that of its language: all pairs of sources, leading terms.

A term is a run of letters (ASCII letters, lower-cased, and everything beyond ASCII). Each language keeps
the terms that stand in ``least_docs`` of its documents or more. A group (language, source) gives a kept
term that occurs n times in it the share ``p = 1 + floor(scale * (n + 5) / (N + 5 V))``; the language the same from its own sums.

* Counting: each task counts its documents by group and term; sums by (lang, source, term) follow, so a
  source with a third of all rows is spread by its terms.
* ``term``: a dominance skyband. A term that ``most`` others beat or equal in group count and in language
  count (more here, fewer there) and precede in UTF-8 cannot be among the first ``most``: the shares follow the
  counts, rounding makes ties at worst, and ties go by UTF-8. Every partition keeps its skyband, the
  skybands of a group are merged by the same sweep, and what remains is ranked by its exact value.
* ``pair``: sources of a language are dealt into tiles of ``TILE``. A group of rows holds two tiles and
  one bucket of terms; it is read as a stream and keeps ``TILE * TILE`` sums, whatever the vocabulary.
  Terms that no source of the two tiles has differ by the shares of a count of zero, times their number.

Counts go through decimals of 38 digits, so the arithmetic is exact at any size of the table.

Defined results: null text, lang or source count as empty strings; a language without a kept term has
pairs of value 0 and no terms; repeated rows are documents of their own; ``doc_id`` is not read; an empty table gives
no rows; other columns are left aside.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import discard, stage

#: Bytes that are no part of a term become spaces, capital letters small ones; all bytes beyond ASCII stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Bytes of a text that are split at once, and terms a task holds before it hands them on.
PIECE, MOST_HELD = 1 << 20, 400_000
#: Sources in a tile, terms in a dense block, terms of a bucket (about), rows compared at once in a sweep.
TILE, BLOCK, BUCKET, SWEEP = 64, 512, 1024, 1024

COUNTS = "lang string, source string, term string, n long, docs long"
RESULT = ("lang", "source", "part", "item", "value", "rank")


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time; no term is cut."""
    folded = text.translate(FOLD)
    first = 0
    while first < len(folded):
        last = folded.find(b" ", first + PIECE) if first + PIECE < len(folded) else -1
        last = len(folded) if last < 0 else last
        yield folded[first:last].split()
        first = last + 1


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): sums over documents; a row with a null term for each group."""

    def flush(held):
        for (lang, source), (n, docs, rows) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * (len(terms) + 1), pa.string()),
                "source": pa.array([source] * (len(terms) + 1), pa.string()),
                "term": pa.array([None, *terms], pa.binary()).cast(pa.string()),
                "n": pa.array([0, *n.values()], pa.int64()),
                "docs": pa.array([rows[0], *(docs[t] for t in terms)], pa.int64()),
            })

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            columns = (batch.column(c) for c in range(3))
            for text, lang, source in zip(*columns):
                n, docs, rows = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter(), [0]))
                rows[0] += 1
                before, distinct = len(n), set()
                for terms in pieces(text.as_buffer().to_pybytes()):
                    n.update(terms)
                    distinct.update(terms)
                docs.update(distinct)
                size += len(n) - before
                if size > MOST_HELD:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    counted = docs.select(text, lang, source).mapInArrow(run, COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n, total, kept, scale: int):
    """1 + floor(scale * (n + 5) / (total + 5 * kept)), in whole numbers; null without kept terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    above = (whole(n) + F.lit(5).cast("decimal(1,0)")) * F.lit(scale).cast("decimal(12,0)")
    below = whole(total + 5 * kept)
    return F.when(kept > 0, F.lit(1) + F.call_function("div", above, below))


def sweep(batches, most: int):
    """Rows of the k-skyband of each group; rows come sorted by group, n downwards, ln, term.

    Whatever dominates a row stands before it, and a row with ``most`` dominators has ``most`` of them in
    the skyband, so it is enough to compare with the rows that were kept.
    """
    group, kept_ln, kept_term = None, np.zeros(0, np.int64), []
    for batch in batches:
        lang, source, term = (batch.column(c).to_pylist() for c in ("lang", "source", "term"))
        ln = batch.column("ln").to_numpy(zero_copy_only=False)
        cuts = [0, *(i for i in range(1, len(lang)) if (lang[i], source[i]) != (lang[i - 1], source[i - 1])), len(lang)]
        chosen = []
        for first, last in zip(cuts, cuts[1:]):
            if first < last and (lang[first], source[first]) != group:
                group, kept_ln, kept_term = (lang[first], source[first]), np.zeros(0, np.int64), []
            for a in range(first, last, SWEEP):
                z = min(a + SWEEP, last)
                names = [t.encode() for t in term[a:z]]
                place = {t: i for i, t in enumerate(sorted({*names, *kept_term}))}
                own, own_ln = np.array([place[t] for t in names]), ln[a:z]
                old = np.array([place[t] for t in kept_term], np.int64)
                beaten = ((kept_ln[:, None] <= own_ln) & (old[:, None] < own)).sum(0)
                earlier = (own_ln[:, None] <= own_ln) & (own[:, None] < own)
                beaten += np.triu(earlier, 1).sum(0)
                stay = np.flatnonzero(beaten < most)
                chosen.extend((a + stay).tolist())
                kept_ln = np.concatenate([kept_ln, own_ln[stay]])
                kept_term.extend(names[i] for i in stay)
        yield batch.take(pa.array(chosen, pa.int64()))


def leading_terms(shares: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` terms of each group by value, then by UTF-8."""
    order = ["lang", "source", F.desc("n"), "ln", "term"]
    schema = "lang string, source string, term string, n long, ln long, value long"
    band = lambda df: df.sortWithinPartitions(*order).mapInArrow(lambda batches: sweep(batches, most), schema)
    over = shares.where("p > q").select("lang", "source", "term", "n", "ln", (F.col("p") - F.col("q")).alias("value"))
    merged = band(band(over).repartition("lang", "source"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= most)


def tile_sums(batches):
    """Sums over the terms of a bucket for the sources of two tiles.

    Rows of a key come together: first one for each source (term null, p the share of a count of zero),
    then the cells in order of term.
    """
    key, sources, block, result = None, None, None, None

    def start(own):
        nonlocal key, sources, block
        key, sources, block = own, {}, {}

    def close_block():
        nonlocal result, block
        numbers = sorted(sources)
        if result is None:
            result = np.zeros((len(numbers), len(numbers)), np.int64), [0]
        if not block:
            return
        row = {x: i for i, x in enumerate(numbers)}
        dense = np.repeat(np.array([sources[x] for x in numbers], np.int64)[:, None], len(block), axis=1)
        for at, cells in enumerate(block.values()):
            for x, p in cells:
                dense[row[x], at] = p
        for i in range(len(numbers)):
            result[0][i, i + 1 :] += np.abs(dense[i + 1 :] - dense[i]).sum(1)
        result[1][0] += len(block)
        block = {}

    def finish():
        nonlocal result
        if key is None:
            return None
        close_block()
        (lang, a, b, _), numbers, (sums, seen) = key, sorted(sources), result
        result = None
        x, y = np.triu_indices(len(numbers), 1)
        number = np.array(numbers, np.int64)
        across = (a == b) | (number[x] // TILE != number[y] // TILE)  # pairs within a tile belong to its own key
        x, y = x[across], y[across]
        return pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * len(x), pa.string()),
            "x": pa.array(number[x], pa.int64()),
            "y": pa.array(number[y], pa.int64()),
            "value": pa.array(sums[x, y], pa.int64()),
            "seen": pa.array(np.full(len(x), seen[0]), pa.int64()),
        })

    for batch in batches:
        for lang, a, b, bucket, term, number, p in zip(*(c.to_pylist() for c in batch.columns)):
            if (lang, a, b, bucket) != key:
                if (done := finish()) is not None:
                    yield done
                start((lang, a, b, bucket))
            if term is None:
                sources[number] = p
                continue
            if term not in block and len(block) == BLOCK:
                close_block()
            block.setdefault(term, []).append((number, p))
    if (done := finish()) is not None:
        yield done


def distances(groups: DataFrame, shares: DataFrame, buckets: int) -> DataFrame:
    """Sum of the differences over all kept terms, for each two sources of a language, both ways."""
    tile = F.floor(F.col("number") / TILE).cast("long")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    two = lambda df: df.withColumn("tile", tile).withColumn("other", other)
    key = ["lang", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b")]
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long")))
    heads = two(groups).select(*key, every.alias("bucket"), F.lit(None).cast("string").alias("term"), "number", F.coalesce("zero", F.lit(0)).alias("p"))
    cells = two(shares).select(*key, bucket.alias("bucket"), "term", "number", "p")
    rows = heads.unionByName(cells).repartition("lang", "a", "b", "bucket")
    rows = rows.sortWithinPartitions("lang", "a", "b", "bucket", F.asc_nulls_first("term"))
    sums = rows.mapInArrow(tile_sums, "lang string, x long, y long, value long, seen long")
    sums = sums.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    named = lambda at: groups.select("lang", F.col("number").alias(at), F.col("source").alias(f"{at}_source"), F.col("zero").alias(f"{at}_zero"))
    sums = sums.join(named("x"), ["lang", "x"]).join(named("y").join(groups.select("lang", "kept").distinct(), "lang"), ["lang", "y"])
    unseen = F.coalesce((F.col("kept") - F.col("seen")) * F.abs(F.col("x_zero") - F.col("y_zero")), F.lit(0))
    both = F.array(F.struct(F.col("x_source").alias("source"), F.col("y_source").alias("item")), F.struct(F.col("y_source").alias("source"), F.col("x_source").alias("item")))
    return sums.select("lang", F.inline(both), (F.col("value") + unseen).cast("long").alias("value"))


def audit(docs: DataFrame, least_docs: int = 30, most: int = 50, scale: int = 1_000_000_000) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``."""
    counts = stage(count_terms(docs))
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("ln"), F.sum("docs").alias("docs"))
    kept = stage(terms.where(F.col("docs") >= least_docs).select("lang", "term", "ln"))
    cells = stage(counts.where("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("ln").alias("lang_total"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = Window.partitionBy("lang")
    groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["kept", "total", "lang_total"])
    groups = groups.withColumn("number", F.row_number().over(by_lang.orderBy("source")).cast("long") - 1)
    groups = groups.withColumn("tiles", F.floor((F.count("*").over(by_lang) + TILE - 1) / TILE).cast("long"))
    groups = stage(groups.withColumn("zero", share(F.lit(0), F.col("total"), F.col("kept"), scale)))
    discard(counts)
    shares = cells.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"), scale))
    shares = shares.withColumn("q", share(F.col("ln"), F.col("lang_total"), F.col("kept"), scale))
    largest = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    leaders = leading_terms(shares, most).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    pairs = distances(groups, shares, largest // BUCKET + 1)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    return pairs.unionByName(leaders).select(*RESULT)
