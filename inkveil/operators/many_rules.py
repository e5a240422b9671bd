"""Thousands of rules as a table.

A rule set's patterns are literals in the plan, one expression each, and every block is searched for all of them. That is right
for dozens. Here rules are rows, each with a *literal*: a word that any match's text has to hold. An index from
literals to rules is joined with the distinct words of the blocks, and a block is searched only for the rules it meets. Words and
block numbers travel; a text is sent once, to its own rules. The plan is the same for ten rules and for a million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkveil.functions import scan
from inkveil.operators.detect import BLOCK_KEYS, by_order, confidence, reported, with_label_hint
from inkveil.rules import RuleSet, check_regex
from inkveil.sources.store import stage

#: A rule: its number, the category whose labels, threshold and token hold, the literal, and the expression.
SCHEMA = "rule_id long, category string, literal string, regex string"
#: Name of a helper column that no table has.
_BLOCK = "_inkveil_block"
_NOT_A_WORD = r"(?U)[^\p{L}\p{N}]+"


def rule_rows(rules) -> list[tuple]:
    """Rules given in Python, checked: (rule_id, category, literal, regex)."""
    out = []
    for rule_id, category, literal, regex in rules:
        check_regex(regex)
        if not literal.isalnum():
            raise ValueError(f"the literal of a rule is one word of letters and digits: {literal!r}")
        out.append((rule_id, category, literal.lower(), regex))
    return out


def words(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), _NOT_A_WORD, -1), lambda w: w != ""))


def rules_met(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """For each block with a literal, the rules to be run on it: number, category and expression.

    ``blocks`` have a number of their own. A rule stands once, however often its word does.
    """
    found = blocks.select(_BLOCK, F.explode(words(F.col("text"))).alias("literal")).join(rules, "literal")
    rule = F.struct("rule_id", "category", "regex")
    return found.groupBy(_BLOCK).agg(F.array_sort(F.collect_list(rule)).alias("rules"))


def detect_many(context: DataFrame, rules: DataFrame, categories: RuleSet, min_confidence: float = 0.0) -> DataFrame:
    """Matches of a table of rules in blocks with context, as ``detect`` gives them; ``rule_id`` says which rule.

    ``categories`` has labels, threshold and token of each category; rules of others are left aside. Scores come first: the rules
    of a category run only where a match would be reported.
    """
    scored = with_label_hint(context, categories, min_confidence)
    entry = lambda i, c: F.when(
        reported(c, min_confidence), F.struct(F.lit(c.name).alias("category"), F.lit(i).alias("category_ord"), confidence(c).alias("confidence"))
    )
    scores = F.array_compact(F.array(*[entry(i, c) for i, c in enumerate(categories.categories)]))
    open_blocks = scored.select(*BLOCK_KEYS, "text", scores.alias("scores")).where(F.size("scores") > 0)
    blocks = stage(open_blocks.withColumn(_BLOCK, F.monotonically_increasing_id()))
    met = blocks.join(rules_met(blocks, rules), _BLOCK)
    runs = met.select(*BLOCK_KEYS, "text", "scores", F.explode("rules").alias("rule"))
    score = F.get(F.filter("scores", lambda s: s["category"] == F.col("rule.category")), 0)
    runs = runs.select(*BLOCK_KEYS, "text", "rule", score.alias("score")).where("score is not null")
    fenced = F.regexp_replace("text", F.concat(F.lit("(?iU)"), F.col("rule.regex")), F.lit(f"{scan.FENCE}$0{scan.FENCE}"))
    with_hits = runs.select(*BLOCK_KEYS, "rule", "score", fenced.alias("fenced")).where(F.col("fenced").contains(scan.FENCE))
    hits = with_hits.select(*BLOCK_KEYS, "rule.category", "score.category_ord", "rule.rule_id", "score.confidence", F.inline(scan.hits(F.col("fenced"))))
    tokens = by_order("category_ord", [F.lit(c.token) for c in categories.categories])
    return hits.select(*BLOCK_KEYS, "category", "rule_id", "match_idx", "match_text", "start", "end", "confidence", tokens.alias("replacement"))
