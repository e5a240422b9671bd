"""License scans: an exact set-similarity join of text blocks with license templates.

A block of a template of m words is a window of ``m + ceil(m / 4)`` consecutive words of a text, line feeds or not, that
begins at a word of the template; it meets the template when it holds at least ``threshold`` of the template's distinct
words. Words are ordered by how many texts of the whole corpus hold them, rarest first. A block that meets a
template of n words must hold one of the template's first n - ceil(threshold * n) + 1 words in that order (prefix
filter), so only the surroundings of such words leave the scan of a text: as *stretches*, the template words within a window's
reach of a prefix word. A stretch is joined with the templates by its prefix words; it must have enough template words at
all (length filter), and enough of them behind the place of the shared word (positional filter). What is left is
verified window by window. Of windows that overlap the most specific counts: the one that holds more template words, at equal
numbers the one with the larger share of its template; equal ones all count.

Beside the join, base phrases are counted wherever their words stand consecutively.

Defined results: null and empty texts have no words and no labels; repeated rows are scanned each by
itself; an empty table gives an empty result; other columns of the input are not looked at. ``score``
is the largest share of a template found, 1 for a document with a base phrase, else 0.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import row_ids, slices

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label and text of each template.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
]

#: A-Z to a-z; digits, letters and bytes from 0x80 stay; others become a space.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32
    for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def window_words(template: str) -> int:
    """Words of a window in which a template is looked for: its own and a quarter more."""
    n = len(words(template.encode()))
    return n + math.ceil(n / 4)


def text_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> DataFrame:
    """(word, texts): how many texts hold each word of the vocabulary."""

    def count(batches):
        found = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                for text in texts:
                    for w in vocabulary.intersection(words(text)):
                        found[w] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in found], pa.string()), "texts": pa.array(list(found.values()), pa.int64())})

    return docs.select("text").mapInArrow(count, "word string, texts long").groupBy("word").agg(F.sum("texts").alias("texts"))


def phrase_places(phrases: dict[str, str]):
    """A function from a text's words, joined, to every place and label of a phrase."""
    #: The look-ahead finds places that overlap; the first word after the space is at the number of spaces before it.
    found = re.compile(b"(?= (?:" + b"|".join(b"(" + re.escape(p.encode()) + b")" for p in phrases) + b") )")
    label = list(phrases.values())

    def places(joined: bytes) -> list[tuple[int, str]]:
        out, at, seen = [], 0, 0
        for m in found.finditer(joined):
            seen += joined.count(b" ", at, m.start())
            at = m.start()
            out += [(seen, label[i]) for i, x in enumerate(m.groups()) if x is not None]
        return out

    return places


def stretches(own: list[bytes], order: dict[bytes, int], rare: frozenset[bytes], reach: int) -> list[list[dict]]:
    """The template words (place and rank) around each rare word, as far as a window reaches; in runs that do not meet."""
    known = [(i, order[w]) for i, w in enumerate(own) if w in order]
    out: list[list[dict]] = []
    end, at = -1, 0
    for centre in [i for i, w in enumerate(own) if w in rare]:
        if not out or centre - reach > end:
            out.append([])
        while at < len(known) and known[at][0] < centre - reach:
            at += 1
        while at < len(known) and known[at][0] <= centre + reach:
            out[-1].append({"pos": known[at][0], "rank": known[at][1]})
            at += 1
        end = centre + reach
    return out


STRETCH = "array<struct<pos:int,rank:int>>"


def scan(docs: DataFrame, order: dict[bytes, int], rare: frozenset[bytes], phrases: dict[str, str], reach: int) -> DataFrame:
    """One row per document: word and phrase counts, and its stretches around prefix words."""
    places = phrase_places(phrases)

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                rows = []
                for text in texts:
                    own = words(text)
                    at = places(b" " + b" ".join(own) + b" ")
                    found = [] if rare.isdisjoint(own) else stretches(own, order, rare, reach)
                    starts = [i for i, _ in at]
                    rows.append((len(own), len(at), min(starts, default=None), max(starts, default=None), sorted({x for _, x in at}), found))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(first, len(texts)),
                    **{n: pa.array(c, pa.int64()) for n, c in zip(("n_words", "n_base", "first_word", "last_word"), cols)},
                    "base": pa.array(cols[4], pa.list_(pa.string())),
                    "stretches": pa.array(cols[5], pa.list_(pa.list_(pa.struct([("pos", pa.int32()), ("rank", pa.int32())])))),
                })

    schema = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, stretches array<{STRETCH}>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def met_windows() -> Column:
    """Windows of a stretch that meet a template: first and last place held, number of words held, label, share."""

    def window(t: Column, i: Column) -> Column:
        near = F.slice("stretch", i + 1, F.col("words"))  # places differ, so there are no more words in a window
        held = F.filter(near, lambda x: (x["pos"] < t["pos"] + F.col("words")) & F.array_contains("template", x["rank"]))
        n = F.size(F.array_distinct(F.transform(held, lambda x: x["rank"])))
        last = F.try_element_at(held, F.lit(-1))["pos"]
        return F.struct(t["pos"].alias("first"), last.alias("last"), n.alias("n"), (n / F.size("template")).alias("share"), F.col("label"))

    begun = F.filter(F.transform("stretch", lambda t, i: F.struct(F.array_contains("template", t["rank"]).alias("own"), window(t, i).alias("w"))), lambda x: x["own"])
    return F.filter(F.transform(begun, lambda x: x["w"]), lambda w: w["n"] >= F.col("need"))


def most_specific(windows: Column, near: int) -> Column:
    """The windows that no overlapping one outdoes. Those that overlap stand within ``near`` places of each other."""
    outdoes = lambda v, w: (v["n"] > w["n"]) | ((v["n"] == w["n"]) & (v["share"] > w["share"]))
    meets = lambda v, w: (v["first"] <= w["last"]) & (w["first"] <= v["last"])

    def stays(w: Column, i: Column) -> Column:
        first = F.greatest(i - near, F.lit(0))
        return ~F.exists(F.slice(windows, first + 1, F.lit(2 * near + 1)), lambda v: meets(v, w) & outdoes(v, w))

    return F.filter(windows, stays)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = 0.8) -> DataFrame:
    spark = docs.sparkSession
    sets = [(label, frozenset(words(text.encode())), window_words(text)) for label, text in templates]
    counts = text_counts(docs, frozenset().union(*(s for _, s, _ in sets)))
    # One row for each word of the templates, however large the corpus.
    rarest = sorted((n, w.encode()) for w, n in counts.collect())
    order = {w: i for i, (_, w) in enumerate(rarest)}
    index = []
    for label, own, width in sets:
        ranks, need = sorted(order.get(w, -1) for w in own), math.ceil(threshold * len(own) - 1e-9)
        index += [(r, p, label, ranks, need, width) for p, r in enumerate(ranks[: len(ranks) - need + 1])]
    prefix = spark.createDataFrame(index, "rank int, place int, label string, template array<int>, need int, words int")
    names = {i: w for w, i in order.items()}
    rare = frozenset(names[r] for r, *_ in index if r in names)
    reach = max((w for *_, w in sets), default=1) - 1

    scanned = row_ids(scan(docs, order, rare, phrases, reach), "row")
    found = scanned.select("row", F.posexplode("stretches").alias("nth", "stretch"))
    found = found.withColumn("ranks", F.array_sort(F.array_distinct("stretch.rank")))
    tokens = found.select("*", F.posexplode("ranks").alias("at", "rank")).where(F.col("rank").isin(sorted({x[0] for x in index})))
    rest = F.least(F.size("ranks") - F.col("at"), F.size("template") - F.col("place"))
    candidates = (
        tokens.join(F.broadcast(prefix), "rank")  # the templates are a parameter
        .where(F.size("ranks") >= F.col("need"))
        # The shared word is the first one that both have, if none stands before it in both.
        .where(F.least(F.col("at"), F.col("place")) + rest >= F.col("need"))
        .select("row", "nth", "stretch", "label", "template", "need", "words")
        .dropDuplicates(["row", "nth", "label"])
    )
    windows = candidates.select("row", "nth", met_windows().alias("met")).where(F.size("met") > 0)
    together = windows.groupBy("row", "nth").agg(F.array_sort(F.flatten(F.collect_list("met"))).alias("met"))
    kept = together.select("row", F.inline(most_specific(F.col("met"), (reach + 1) * len(sets))))
    labelled = kept.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", none)))
    return scanned.join(labelled, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", labels).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
