"""A table of rules, joined with the words of the blocks."""

import pytest

from inkveil.operators import detect as D, many_rules
from inkveil.plans.pipeline import text_context
from inkveil.rules import RuleSet

CATEGORIES = RuleSet().add_pattern("Code", r"never-met", ("client",), "[CODE]", 0.5).add_pattern("Place", r"never-met", (), "[PLACE]", 0.65)
TEXTS = [
    (1, "Alpha 12 met beta-7, ALPHA 3 and alphabet\nbeta 1\nnone of them"),
    (2, "Straße 9\nalpha alpha 5 alpha\nx y\nclient of a long line here\ngamma 4 x"),
    (3, None),
    (4, ""),
]
RULES = [(7, "Code", "alpha", r"\balpha\b(?: \d+)?"), (8, "Code", "Beta", r"\bbeta\W\d"), (9, "Place", "straße", r"straße \d"), (11, "Place", "gamma", r"gamma \d"), (12, "Unknown", "alpha", r"alpha"), (13, "Code", "absent", r"\d")]


def rules_table(spark, rules):
    return spark.createDataFrame(many_rules.rule_rows(rules), many_rules.SCHEMA)


def test_same_as_rules_in_the_plan(spark):
    context = text_context(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    in_plan = CATEGORIES
    for _, category, _, regex in RULES:
        if category != "Unknown" and regex != r"\d":
            in_plan = in_plan.add_pattern(category, regex)
    want = D.detect(context, in_plan)
    got = many_rules.detect_many(context, rules_table(spark, RULES), CATEGORIES)
    keys = [*D.BLOCK_KEYS, "category", "match_idx", "match_text", "start", "end", "confidence", "replacement"]
    rows = lambda df: sorted(map(tuple, df.select(*keys).collect()))
    assert rows(got) == rows(want) and len(rows(got)) >= 6


def test_the_plan_does_not_grow(spark):
    context = text_context(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    sizes = []
    for n in (10, 5000):
        rules = many_rules.stage(rules_table(spark, [(i, "Code", f"word{i}", rf"\bword{i}\b") for i in range(n)]))
        plan = many_rules.detect_many(context, rules, CATEGORIES)._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(len(plan))
    assert abs(sizes[0] - sizes[1]) < 200


def test_a_word_in_every_block_and_rules_that_share_a_word(spark):
    texts = [(i, f"common {i}\ncommon x") for i in range(500)]
    rules = rules_table(spark, [(i, "Code", "common", rf"common {i}\b") for i in range(40)] + [(99, "Code", "common", "common")])
    got = many_rules.detect_many(text_context(spark.createDataFrame(texts, "doc_id long, text string")), rules, CATEGORIES, 0.5)
    found = sorted((r.doc_id, r.rule_id) for r in got.collect())
    assert found == sorted([(i, i) for i in range(40)] + [(i, 99) for i in range(500) for _ in range(2)])


def test_rules_are_checked():
    with pytest.raises(ValueError):
        many_rules.rule_rows([(1, "Code", "two words", "x")])
    with pytest.raises(ValueError):
        many_rules.rule_rows([(1, "Code", "x", "x*")])
