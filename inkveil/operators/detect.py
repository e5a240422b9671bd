"""Scoring and matching.

The score of a hit depends only on its block and category: 0.5, plus 0.3 if a label stands
beside the block, plus 0.1 if the block is a table cell. So blocks are scored first, and the
patterns run only where a hit could be reported. Everything here works row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from inkveil.functions import scan
from inkveil.functions.origin import origin, source_span
from inkveil.rules import DEFAULT_RULES, Category, RuleSet

# The parts of the score and the shortest text that is searched.
BASE_CONFIDENCE = 0.5
LABEL_BOOST = 0.3
TABLE_BOOST = 0.1
MIN_LENGTH = 2

#: How a block's fields are read: as columns of the row, or from a struct within it.
Block = Callable[[str], Column]

BLOCK_KEYS = ["doc_id", "page_no", "block_no"]
MATCH_COLUMNS = [
    *BLOCK_KEYS, "category", "category_ord", "pattern_idx", "match_idx",
    "match_text", "start", "end", "confidence", "replacement",
]


def label_near(rules: RuleSet, min_confidence: float | None = None, block: Block = F.col) -> Column:
    """Can a label of any category occur beside the block?

    One search for the words of all labels spares most blocks the search for each category's. With
    ``min_confidence`` blocks whose score is settled without labels are not searched at all.
    """
    before, after = block("preceding_text"), block("following_text")
    regex = rules.label_hint
    near = F.lit(False)
    if regex:
        near = ((before != "") & before.rlike(regex)) | ((after != "") & after.rlike(regex))

    def hint(table: float) -> Column:
        open_ = min_confidence is None or any(
            _settled(c, table, min_confidence) is None for c in rules.categories
        )
        return near if open_ else F.lit(False)

    return F.when(block("is_table_cell"), hint(TABLE_BOOST)).otherwise(hint(0.0))


def with_label_hint(
    blocks: DataFrame, rules: RuleSet, min_confidence: float | None = None
) -> DataFrame:
    """Adds ``label_near``."""
    return blocks.withColumn("label_near", label_near(rules, min_confidence))


def labelled(category: Category, block: Block = F.col) -> Column:
    """Does a label of the category occur in the text beside the block?

    The block's own text is not asked, and text that is empty on one side is not asked either.
    """
    regex = category.label_regex
    if regex is None:
        return F.lit(False)
    before, after = block("preceding_text"), block("following_text")
    return block("label_near") & (before.rlike(regex) | after.rlike(regex))


def _settled(category: Category, table: float, min_confidence: float) -> bool | None:
    """Whether hits are reported, if that is the same with and without a label."""
    needed = max(category.threshold, min_confidence)
    plain = BASE_CONFIDENCE + 0.0 + table >= needed
    with_label = BASE_CONFIDENCE + LABEL_BOOST + table >= needed
    return plain if plain == with_label else None


def confidence(category: Category) -> Column:
    return (
        F.lit(BASE_CONFIDENCE)
        + F.when(labelled(category), LABEL_BOOST).otherwise(0.0)
        + F.when(F.col("is_table_cell"), TABLE_BOOST).otherwise(0.0)
    )


def searchable(block: Block = F.col) -> Column:
    return F.length(block("text")) >= MIN_LENGTH


def reported(category: Category, min_confidence: float = 0.0, block: Block = F.col) -> Column:
    """Would a hit of the category be reported in this block?

    Same as ``confidence(category) >= threshold``; but a score that passes, or fails, whatever
    the labels say is settled without looking for labels.
    """

    def passes(table: float) -> Column:
        settled = _settled(category, table, min_confidence)
        return labelled(category, block) if settled is None else F.lit(settled)

    return searchable(block) & F.when(block("is_table_cell"), passes(TABLE_BOOST)).otherwise(passes(0.0))


def reported_by(category: Category, setting: Column, min_confidence: float, block: Block = F.col) -> Column:
    """``reported`` with threshold and selection from the row: ``setting`` is a struct (threshold, enabled), or null.

    Labels are looked for only where they decide.
    """
    needed = F.greatest(F.coalesce(setting["threshold"], F.lit(category.threshold)), F.lit(min_confidence))
    table = F.when(block("is_table_cell"), TABLE_BOOST).otherwise(0.0)
    enabled = F.coalesce(setting["enabled"], F.lit(True))
    passes = F.when(F.lit(BASE_CONFIDENCE) + F.lit(0.0) + table >= needed, F.lit(True)).when(
        F.lit(BASE_CONFIDENCE) + F.lit(LABEL_BOOST) + table >= needed, labelled(category, block)
    )
    return searchable(block) & enabled & F.coalesce(passes, F.lit(False))


def score_table(blocks: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """One row per block and category: label hit, confidence, and whether hits are reported."""
    rows = F.array(
        *[
            F.struct(
                F.lit(c.name).alias("category"),
                labelled(c).alias("label_hit"),
                confidence(c).alias("confidence"),
                reported(c).alias("reported"),
            )
            for c in rules.categories
        ]
    )
    hinted = with_label_hint(blocks.where(searchable()), rules)
    return hinted.select(*BLOCK_KEYS, "is_table_cell", F.inline(rows))


def detect(
    blocks: DataFrame,
    rules: RuleSet = DEFAULT_RULES,
    min_confidence: float = 0.0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per match of a pattern in a block with context.

    Matches of one pattern do not overlap; those of different patterns may, and equal hits of
    several patterns are all reported. ``keep`` names block columns to carry along.
    """
    keys = [*BLOCK_KEYS, *keep]
    by_category = []
    for i, c in enumerate(rules.categories):
        runs = F.array(
            *[
                F.struct(
                    F.array(*[F.lit(n) for n in numbers]).alias("pattern_idxs"),
                    F.lit(p.valid).cast("string").alias("check"),
                    scan.fenced(F.col("text"), p).alias("fenced"),
                )
                for p, numbers in c.distinct_patterns()
            ]
        )
        with_hits = F.filter(runs, lambda r: r["fenced"].contains(scan.FENCE))
        by_category.append(
            F.struct(
                F.lit(i).alias("category_ord"),
                F.when(reported(c, min_confidence), with_hits).alias("runs"),
            )
        )
    # Rows of one block and category, then the score, then rows of one match: labels that decide
    # nothing but the score are looked for once, and only where there is a hit.
    found = F.filter(
        F.array(*by_category), lambda c: F.coalesce(F.size(c["runs"]), F.lit(0)) > 0
    )
    per_category = with_label_hint(blocks, rules, min_confidence).select(
        *dict.fromkeys([*keys, "preceding_text", "following_text", "is_table_cell"]),
        F.inline(found),
    )
    scored = with_label_hint(per_category, rules).select(
        *keys,
        by_order("category_ord", [F.lit(c.name) for c in rules.categories]).alias("category"),
        "category_ord",
        by_order("category_ord", [confidence(c) for c in rules.categories]).alias("confidence"),
        by_order("category_ord", [F.lit(c.token) for c in rules.categories]).alias("replacement"),
        F.inline("runs"),
    )
    hits = scan.hit_rows(scored, [*keys, "category", "category_ord", "pattern_idxs", "check", "confidence", "replacement"])
    checked = [p for c in rules.categories for p in c.patterns if p.valid]
    if checked:
        hits = hits.where(scan.passes(F.col("check"), F.col("match_text"), checked))
    return hits.withColumn("pattern_idx", F.explode("pattern_idxs")).select(*MATCH_COLUMNS, *keep)


def detect_in_source(
    blocks: DataFrame, rules: RuleSet = DEFAULT_RULES, min_confidence: float = 0.0, keep: Sequence[str] = ()
) -> DataFrame:
    """Matches with ``raw_start`` and ``raw_end``, the place of each in the text as it was before cleaning.

    Where the places differ is worked out once for each block, and only in blocks that cleaning shortened.
    """
    known = blocks.withColumn("origin", origin(F.col("raw_text"), F.col("text")))
    matches = detect(known, rules, min_confidence, keep=["origin", *keep])
    start, end = source_span(F.col("start"), F.col("end"), F.col("origin"))
    return matches.select(*MATCH_COLUMNS, *keep, start.alias("raw_start"), end.alias("raw_end"))


def by_order(column: str, values: Sequence[Column]) -> Column:
    """The value at the position a column names; only that one is evaluated."""
    chosen = F.when(F.col(column) == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        chosen = chosen.when(F.col(column) == i, v)
    return chosen


def match_counts(blocks: DataFrame, rules: RuleSet = DEFAULT_RULES, min_confidence: float = 0.0) -> DataFrame:
    """Adds ``counts``: the number of reported matches for each category, in rule order.

    Counts match for match what ``detect`` returns, without making a row for any.
    """
    counts = []
    for c in rules.categories:
        n = F.lit(0)
        for p, numbers in c.distinct_patterns():
            n = n + scan.occurrences(F.col("text"), p) * len(numbers)
        counts.append(F.when(reported(c, min_confidence), n).otherwise(0))
    return with_label_hint(blocks, rules, min_confidence).withColumn("counts", F.array(*counts))
