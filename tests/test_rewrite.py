"""Numbered replacements written into texts; documents known by keys of any type."""

import re

import pytest

from inkveil.functions.replacement import ReplacementRule
from inkveil.operators import reports, rewrite
from inkveil.plans import pipeline
from inkveil.rules import RuleSet
from inkveil.sources import keys

CODES = RuleSet().add_pattern("Code", r"K[0-9]+", replacement="#", confidence_threshold=0.5)


def expected(rows, scope, consistent):
    """The texts by key, replaced one match after the other."""
    numbers, counts, out = {}, {}, {}
    for n, (key, text) in sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or "", r[0])):

        def token(m):
            area = n if scope == "document" else None
            value = m.group().lower() if consistent else object()
            if (area, value) not in numbers:
                counts[area] = numbers[area, value] = counts.get(area, 0) + 1
            return f"[Code-{numbers[area, value]}]"

        out[n] = text if text is None else re.sub(r"(?i)K[0-9]+", token, text)
    return [(key, out[n], n) for n, (key, _) in enumerate(rows)]


ROWS = [
    ("b/2", "K7\tand k8\n\n  O K7!"), ("a/1", "x K9 K8"), ("b/2", "K1 K7"), (None, "K0"), ("c", None), ("d", ""), ("e", "\n \n"),
    ("z", "\n".join(f"line {i} K{i % 50}" if i % 3 else "" for i in range(4000))), ("y", "K5 " * 3000),
]


@pytest.mark.parametrize("scope", ["corpus", "document"])
@pytest.mark.parametrize("consistent", [True, False])
def test_same_as_plain_python(spark, scope, consistent):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "path string, text string, n int")
    got = rewrite.replace_numbered(df, CODES, 0.5, key="path", scope=scope, consistent=consistent).collect()
    assert sorted(map(tuple, got), key=lambda r: r[2]) == expected(ROWS, scope, consistent)


def test_own_rules_and_whole_numbers(spark):
    df = spark.createDataFrame([(2, "K22 K1"), (10, "K1")], "doc_id long, text string")
    own = {"Code": ReplacementRule("<{index:03d}>", preserve_last=True)}
    got = {r.doc_id: r.text for r in rewrite.replace_numbered(df, CODES, 0.5, replacements=own).collect()}
    assert got == {2: "<001>-K22 <002>-K1", 10: "<002>-K1"}


def test_job_with_numbers_and_paths(spark, tmp_path):
    path, log = str(tmp_path / "t"), str(tmp_path / "log")
    spark.createDataFrame([("b", "K1 K2", 1), ("a", "K2", 2), (None, "K3", 3), ("c", None, 4)], "path string, text string, n int").write.parquet(path)
    out = pipeline.anonymize(spark, path, rules=CODES, min_confidence=0.5, numbers="value", key="path", audit_path=log)
    assert {r.n: r.text for r in spark.read.parquet(out).collect()} == {3: "[Code-1]", 2: "[Code-2]", 1: "[Code-3] [Code-2]", 4: None}
    assert sorted(r.doc_id for r in spark.read.parquet(log).collect()) == ["a", "b", "b"]
    with pytest.raises(ValueError):
        pipeline.anonymize(spark, path, str(tmp_path / "o"), text_table=False, numbers="value")


def test_keys_of_any_type(spark):
    rows = [("b", "K1"), ("a", "K2"), ("ä", "K3"), ("b", "K4"), (None, "K5")]
    df = spark.createDataFrame(rows, "path string, text string").repartition(3)
    known = keys.dictionary(df, "path")
    assert [r.key for r in known.orderBy("number").collect()] == ["a", "b", "ä"]
    numbered = keys.numbered(df, "path", known)
    assert numbered.count() == 5 and numbered.where("doc_id is null").count() == 1
    counts = keys.restored(reports.document_counts(pipeline.text_context(numbered.where("doc_id is not null")), CODES), "path", known)
    assert sorted((r.path, r.n_matches) for r in counts.collect()) == [("a", 1), ("b", 2), ("ä", 1)]
    assert not keys.is_whole(df, "path") and keys.is_whole(spark.range(1), "id")
