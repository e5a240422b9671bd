import json
import re
import warnings

import pytest

from inkveil.plans.pipeline import get_supported_categories
from inkveil.rules import DEFAULT_RULES, any_of, check_regex, update_patterns
from inkveil.settings import DEFAULT_SETTINGS, load_settings


def test_supported_categories_in_order():
    assert get_supported_categories() == [
        "Names", "Account Numbers", "Addresses", "Phone Numbers", "Email Addresses"
    ]


def test_add_pattern_new_category():
    rules = DEFAULT_RULES.add_pattern("Plates", r"\b[A-Z]{2}-\d{4}\b", ["plate"], None)
    c = rules.get("Plates")
    assert (c.token, c.threshold) == ("[REDACTED Plates]", 0.7)
    assert DEFAULT_RULES.get("Plates") is None


def test_add_pattern_appends_and_ignores_settings():
    rules = DEFAULT_RULES.add_pattern("Names", r"\bxx+\b", ["who"], "[X]", 0.1)
    c, before = rules.get("Names"), DEFAULT_RULES.get("Names")
    assert (c.replacement, c.threshold) == (before.replacement, before.threshold)
    assert len(c.patterns) == len(before.patterns) + 1 and c.labels[-1] == "who"


def test_override_ignores_unknown_categories():
    rules = DEFAULT_RULES.override({"Names": {"threshold": 0.9}, "Nobody": {"threshold": 0.1}})
    assert rules.names() == DEFAULT_RULES.names()
    assert rules.get("Names").threshold == 0.9 and rules.get("Names").token == "[REDACTED NAME]"


def test_selection_keeps_missing_categories():
    assert DEFAULT_RULES.selected(None) == DEFAULT_RULES
    assert DEFAULT_RULES.selected({"Names": False, "Addresses": True}).names() == [
        "Account Numbers", "Addresses", "Phone Numbers", "Email Addresses"
    ]


def test_update_patterns_replaces_everything():
    rules = update_patterns({"Only": {"patterns": [r"\bfoo\b"], "labels": [], "replacement": "[F]"}})
    assert rules.names() == ["Only"] and rules.get("Only").threshold == 0.7


def test_regex_checks():
    for bad in (r"\d*", r"a?", r"\b"):
        with pytest.raises(ValueError):
            check_regex(bad)
    with pytest.warns(UserWarning):
        check_regex(r"\bW(?:\s+W)*\b")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        check_regex(r"\bW(?:\s+W)*+")


def test_labels_in_one_expression():
    assert any_of([]) is None
    assert any_of([r"\ba", r"\bb|c", "^d"]) == r"(?iU)(?:\bb|c)|(?:^d)|\b(?:(?:a))"


def test_label_words_miss_no_label():
    tokens = sorted({w for c in DEFAULT_RULES.categories for l in c.labels for w in re.findall(r"[a-z#-]{2,}", l)})
    hint = re.compile(DEFAULT_RULES.label_hint.replace("(?iU)", ""), re.I)
    found = 0
    for first in tokens:
        for text in [f": {first}", f"{first}. x", *(f"x {first} {t}: " for t in tokens), *(f"{first}{t}" for t in tokens)]:
            if any(re.search(l, text, re.I) for c in DEFAULT_RULES.categories for l in c.labels):
                found += 1
                assert hint.search(text), text
    assert found > 1000
    # Added labels are searched for themselves.
    assert "plate" in DEFAULT_RULES.add_pattern("Names", r"\bxx+\b", ["plate"]).label_hint


def test_rule_tables(spark):
    rows = DEFAULT_RULES.to_dataframe(spark)
    assert rows.where("kind = 'pattern'").count() == 27
    assert rows.select("category").distinct().count() == 5
    assert DEFAULT_RULES.settings_dataframe(spark).where("threshold = 0.6").count() == 1


def test_profiles(spark):
    strict = DEFAULT_RULES.override({"Names": {"threshold": 0.95, "replacement": "[N]"}})
    table = DEFAULT_RULES.settings_dataframe(spark).union(strict.settings_dataframe(spark, "strict"))
    assert DEFAULT_RULES.with_profile(table, "strict") == strict
    assert DEFAULT_RULES.with_profile(table, "default") == DEFAULT_RULES


def test_settings(spark, tmp_path):
    assert load_settings(spark) == DEFAULT_SETTINGS
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"enabled_categories": ["SSN"], "replacement_patterns": {"A": {"default": "x"}, "B": {"format": "y"}}}, indent=1))
    got = load_settings(spark, str(path))
    assert got["enabled_categories"] == ["SSN"]
    assert got["replacement_patterns"] == {"A": {"default": "x"}, "B": {"format": "y"}}
    assert got["confidence_thresholds"] == DEFAULT_SETTINGS["confidence_thresholds"]


def test_unreadable_settings_give_defaults(spark, tmp_path):
    assert load_settings(spark, str(tmp_path / "none.json")) == DEFAULT_SETTINGS
    bad = tmp_path / "bad.json"
    bad.write_text("{not json")
    assert load_settings(spark, str(bad)) == DEFAULT_SETTINGS
