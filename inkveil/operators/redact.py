"""Redaction of whole blocks and of single spans."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from inkveil.functions import scan
from inkveil.functions.arrays import let
from inkveil.operators.detect import BLOCK_KEYS, Block, by_order, reported, reported_by, with_label_hint
from inkveil.operators.layout import page_context
from inkveil.rules import DEFAULT_RULES, RuleSet
from inkveil.sources.blocks import pages_from_text
from inkveil.sources.store import stage

# Fixed value: the score from which a block is redacted. Only hits with a label reach it.
MIN_CONFIDENCE = 0.7

#: Names of helper columns that no table has.
_ROW, _CHANGES = "_inkveil_row", "_inkveil_changes"

MATCH_KEYS = [*BLOCK_KEYS, "category", "pattern_idx", "match_idx"]
_BOX = ["x0", "y0", "x1", "y1"]


def redact_blocks(
    context: DataFrame,
    rules: RuleSet = DEFAULT_RULES,
    min_confidence: float = MIN_CONFIDENCE,
    selection: Mapping[str, bool] | None = None,
) -> DataFrame:
    """Replace the text of every block that holds a match by the tokens of its categories.

    Each category stands once, in rule order. Other blocks keep their text as it was. Whether
    a block holds a match is decided in its own row, so nothing is joined or shuffled, and no
    match is made into a row.
    """
    chosen = rules.selected(selection)
    tokens = block_tokens(chosen, min_confidence)
    hinted = with_label_hint(context, chosen, min_confidence)
    return _with_tokens(hinted.select(*BLOCK_KEYS, *_BOX, "raw_text", tokens.alias("tokens")))


def block_tokens(rules: RuleSet, min_confidence: float, block: Block = F.col, profile: Column | None = None) -> Column:
    """Tokens of the categories of which the block holds a match, in rule order. With a ``profile``
    (a map from category to its settings) thresholds, selection and tokens come from the row."""

    def token(c) -> Column:
        if profile is None:
            return F.when(reported(c, min_confidence, block) & scan.any_occurs(block("text"), c), c.token)
        own = F.try_element_at(profile, F.lit(c.name))
        here = reported_by(c, own, min_confidence, block) & scan.any_occurs(block("text"), c)
        return F.when(here, F.coalesce(own["replacement"], F.lit(c.token)))

    return F.array_compact(F.array(*[token(c) for c in rules.categories]))


def redact_matched(context: DataFrame, matches: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Redact the blocks of a match table, as left by ``exclude_matches`` for instance.

    A block's matches shrink to one entry per category before they are shuffled.
    """
    tokens = (
        matches.where(F.col("confidence") >= min_confidence)
        .groupBy(*BLOCK_KEYS)
        .agg(F.collect_set(F.struct("category_ord", "replacement")).alias("found"))
        .select(
            *BLOCK_KEYS,
            F.transform(F.array_sort("found"), lambda f: f["replacement"]).alias("tokens"),
        )
    )
    joined = context.select(*BLOCK_KEYS, *_BOX, "raw_text").join(tokens, BLOCK_KEYS, "left")
    return _with_tokens(joined.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))))


def _with_tokens(blocks: DataFrame) -> DataFrame:
    redacted = F.size("tokens") > 0
    return blocks.select(
        *BLOCK_KEYS, *_BOX,
        F.when(redacted, F.array_join(F.array_distinct("tokens"), " ")).otherwise(F.col("raw_text")).alias("text"),
        redacted.alias("redacted"),
    )


def exclude_matches(matches: DataFrame, excluded: DataFrame) -> DataFrame:
    """Matches without those deselected by hand; ``excluded`` holds match keys."""
    return matches.join(excluded.select(*MATCH_KEYS).distinct(), MATCH_KEYS, "left_anti")


_SPAN = "struct<start:int,end:int,category_ord:int,pattern_idx:int,match_text:string>"
_RANKED = "struct<rank:int,category_ord:int,pattern_idx:int,start:int,end:int,match_text:string>"


def kept_spans(rules: RuleSet, min_confidence: float, block: Block = F.col, profile: Column | None = None) -> Column:
    """The non-overlapping spans of a block: longest first, ties by category, pattern, position.

    Equal patterns give equal spans, of which the first pattern's wins; so each is run once.
    """

    runs = []
    for i, c in enumerate(rules.categories):
        of_category = F.array(
            *[
                F.struct(
                    F.lit(i).alias("category_ord"),
                    F.lit(numbers[0]).alias("pattern_idx"),
                    F.lit(p.valid).cast("string").alias("check"),
                    scan.fenced(block("text"), p).alias("fenced"),
                )
                for p, numbers in c.distinct_patterns()
            ]
        )
        if profile is None:
            here = reported(c, min_confidence, block)
        else:
            here = reported_by(c, F.try_element_at(profile, F.lit(c.name)), min_confidence, block)
        runs.append(F.when(here, of_category))

    checked = [p for c in rules.categories for p in c.patterns if p.valid]

    def valid_hits(run: Column) -> Column:
        hits = scan.hits(run["fenced"])
        return F.filter(hits, lambda h: scan.passes(run["check"], h["match_text"], checked)) if checked else hits

    def as_spans(run: Column) -> Column:
        return F.transform(
            valid_hits(run),
            lambda h: F.struct(
                h["start"].alias("start"),
                h["end"].alias("end"),
                run["category_ord"].alias("category_ord"),
                run["pattern_idx"].alias("pattern_idx"),
                h["match_text"].alias("match_text"),
            ),
        )

    with_hits = F.filter(
        F.flatten(F.array_compact(F.array(*runs))), lambda r: r["fenced"].contains(scan.FENCE)
    )
    spans = F.sort_array(F.flatten(F.transform(with_hits, as_spans)))
    return let(spans, lambda s: F.flatten(F.transform(_apart(s), _longest_first)))


#: Spans are looked at in chunks of at least and at most this many to find where the text is free of them.
_CHUNK = 8, 64


def _apart(spans: Column) -> Column:
    """Cuts spans in order of ``start`` into groups of which none reaches into another.

    A group begins where all spans before have ended: the largest end of the chunks before, and of
    the spans before in the same chunk.
    """

    def groups(ends: Column) -> Column:
        # each span is compared with those before it in its chunk, each chunk with those before it
        step = F.least(F.lit(_CHUNK[1]), F.greatest(F.lit(_CHUNK[0]), F.sqrt(F.size(ends)).cast("int")))
        return let(step, lambda n: in_chunks(ends, n))

    def in_chunks(ends: Column, step: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(ends), step)
        highest = F.transform(firsts, lambda f: F.array_max(F.slice(ends, f, step)))
        return let(highest, lambda h: let(F.flatten(F.transform(firsts, lambda f, j: begins(ends, h, f, j, step))), cut))

    def begins(ends: Column, highest: Column, first: Column, chunk: Column, step: Column) -> Column:
        earlier = F.coalesce(F.array_max(F.slice(highest, F.lit(1), chunk)), F.lit(0))
        places = F.sequence(first, F.least(first + step - 1, F.size(ends)))
        reach = lambda i: F.greatest(F.lit(0), F.array_max(F.slice(ends, first, i - first)))
        return let(earlier, lambda e: F.filter(places, lambda i: F.greatest(e, reach(i)) <= F.get(spans, i - 1)["start"]))

    def cut(begin: Column) -> Column:
        until = lambda k: F.coalesce(F.get(begin, k + 1), F.size(spans) + 1)
        return F.transform(begin, lambda b, k: F.slice(spans, b, until(k) - b))

    none = F.array().cast(f"array<array<{_SPAN}>>")
    return F.when(F.size(spans) > 0, let(F.transform(spans, lambda s: s["end"]), groups)).otherwise(none)


#: Groups of up to so many spans are chosen from by comparing each with those kept.
_FEW = 32


def _longest_first(group: Column) -> Column:
    """The spans of a group that are kept, in order."""
    ranked = F.sort_array(F.transform(group, lambda s: _struct(s, _RANKED, rank=s["start"] - s["end"])))
    return F.when(F.size(group) <= 1, group).when(F.size(group) <= _FEW, _by_comparison(ranked)).otherwise(_on_a_row(group, ranked))


def _by_comparison(ranked: Column) -> Column:
    """Each span in order of rank, unless it overlaps one kept before."""
    return F.aggregate(
        ranked,
        F.array().cast(f"array<{_RANKED}>"),
        lambda kept, s: F.when(
            F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept
        ).otherwise(F.concat(kept, F.array(s))),
        lambda kept: F.sort_array(F.transform(kept, lambda s: _struct(s, _SPAN))),
    )


def _on_a_row(group: Column, ranked: Column) -> Column:
    """The same for groups of any size.

    The group's stretch of text is a row of bytes. The spans are laid on it by rank, each only where nothing lies yet: a 2
    for its first place, a 1 for the others. What lies there in the end tells which were kept. So a span costs its
    own length and a copy of the row, however many were kept before.
    """

    def bytes_of(digits: str, n: Column, first: str = "") -> Column:
        return F.unhex(F.concat(F.lit(first), F.repeat(F.lit(digits), n)))

    def part(row: Column, s: Column, base: Column) -> Column:
        return F.substring(row, s["start"] - base + 1, s["end"] - s["start"])

    def laid(s: Column) -> Column:
        return bytes_of("01", s["end"] - s["start"] - 1, "02")

    def chosen(frame: Column) -> Column:
        base = frame["base"]
        row = F.aggregate(
            ranked,
            bytes_of("00", frame["end"] - base),
            lambda row, s: F.when(
                part(row, s, base) == bytes_of("00", s["end"] - s["start"]), F.overlay(row, laid(s), s["start"] - base + 1)
            ).otherwise(row),
        )
        return let(row, lambda r: F.filter(group, lambda s, i: lies(r, s, i, base)))

    def lies(row: Column, s: Column, i: Column, base: Column) -> Column:
        before = F.get(group, i - 1)
        again = (i > 0) & (before["start"] == s["start"]) & (before["end"] == s["end"])  # the first of equal ones ranks highest
        ends = F.substring(row, s["end"] - base + 1, F.lit(1)) != F.unhex(F.lit("01"))
        return ~F.coalesce(again, F.lit(False)) & (part(row, s, base) == laid(s)) & ends

    frame = F.struct(F.get(group, 0)["start"].alias("base"), F.array_max(F.transform(group, lambda s: s["end"])).alias("end"))
    return let(frame, chosen)


def _struct(span: Column, shape: str, **own: Column) -> Column:
    names = [f.split(":")[0] for f in shape.removeprefix("struct<").removesuffix(">").split(",")]
    return F.struct(*[own.get(n, span[n]).alias(n) for n in names])


def dedupe_spans(context: DataFrame, rules: RuleSet = DEFAULT_RULES, min_confidence: float = 0.0) -> DataFrame:
    """Matches of which no two overlap. Decided within the block's row, without a shuffle."""
    hinted = with_label_hint(context, rules, min_confidence)
    return hinted.select(*BLOCK_KEYS, F.inline(kept_spans(rules, min_confidence))).select(
        *BLOCK_KEYS,
        by_order("category_ord", [F.lit(c.name) for c in rules.categories]).alias("category"),
        "pattern_idx", "start", "end", "match_text",
    )


def redact_spans(
    context: DataFrame,
    rules: RuleSet = DEFAULT_RULES,
    min_confidence: float = MIN_CONFIDENCE,
    selection: Mapping[str, bool] | None = None,
) -> DataFrame:
    """Replace just the matched spans, in the cleaned text, by their category's token."""
    chosen = rules.selected(selection)
    spans = with_label_hint(context, chosen, min_confidence).select(
        *BLOCK_KEYS, *_BOX, "raw_text", "text", kept_spans(chosen, min_confidence).alias("spans")
    )

    def piece(s: Column, i: Column) -> Column:
        gap_from = F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)["end"])
        token = F.get(F.array(*[F.lit(c.token) for c in chosen.categories]), s["category_ord"])
        return F.concat(F.substring("text", gap_from + 1, s["start"] - gap_from), token)

    tail = F.substring("text", F.get("spans", F.size("spans") - 1)["end"] + 1, F.length("text"))
    rebuilt = F.concat(F.array_join(F.transform("spans", piece), ""), tail)
    redacted = F.size("spans") > 0
    return spans.select(
        *BLOCK_KEYS, *_BOX,
        F.when(redacted, rebuilt).otherwise(F.col("raw_text")).alias("text"),
        redacted.alias("redacted"),
    )


def audit_log(matches: DataFrame) -> DataFrame:
    """What was changed and why, without the personal data itself: its digest stands in."""
    return matches.select(
        *BLOCK_KEYS, "category", "pattern_idx", "start", "end", "confidence", "replacement",
        F.sha2("match_text", 256).alias("match_sha256"),
    )


def redact_documents(
    documents: DataFrame,
    rules: RuleSet = DEFAULT_RULES,
    min_confidence: float = MIN_CONFIDENCE,
    selection: Mapping[str, bool] | None = None,
    text: str = "text",
) -> DataFrame:
    """The documents with their text redacted line by line: every row and column stays, in place.

    Lines without a match stay as they were, blank ones too; a null text stays null. The table's rows
    are numbered and staged, so keys of any type, repeated keys and missing ones are all the same. Only
    redacted lines travel, one short array for each document that has any.
    """
    numbered = stage(documents.withColumn(_ROW, F.monotonically_increasing_id()))
    lines = numbered.where(F.col(text).isNotNull()).select(F.col(_ROW).alias("doc_id"), F.col(text).alias("text"))
    context = page_context(pages_from_text(lines))
    blocks = redact_blocks(context, rules, min_confidence, selection)
    # Not a filter: Spark would move one below cleaning and scoring and work both out again wherever the patterns name them.
    line = F.struct("doc_id", "block_no", "text", "redacted")
    redacted = blocks.select(F.inline(F.filter(F.array(line), lambda b: b["redacted"])))
    by_line = F.map_from_entries(F.collect_list(F.struct("block_no", "text")))
    changes = redacted.groupBy(F.col("doc_id").alias(_ROW)).agg(by_line.alias(_CHANGES))
    rebuilt = F.array_join(
        F.transform(F.split(F.col(text), "\n", -1), lambda line, i: F.coalesce(F.try_element_at(F.col(_CHANGES), i.cast("long")), line)), "\n"
    )
    joined = numbered.join(changes, _ROW, "left")
    return joined.withColumn(text, F.when(F.col(_CHANGES).isNull(), F.col(text)).otherwise(rebuilt)).select(*documents.columns)
