"""Settings as data, quantiles, lists of matches."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from inkveil.operators import detect as D, profiles, reports
from inkveil.plans import pipeline
from inkveil.rules import RuleSet
from inkveil.settings import DEFAULT_SETTINGS, load_settings

CODES = RuleSet().add_pattern("Code", r"K[0-9]+", replacement="#", confidence_threshold=0.5).add_pattern("Tag", r"@[a-z]+", replacement="<tag>", confidence_threshold=0.5)


@pytest.mark.parametrize("spans", [False, True])
def test_each_row_under_its_profile(spark, spans):
    settings = spark.createDataFrame(
        [("a", "Code", "[A]", 0.5, None), ("b", "Code", None, 0.6, None), ("b", "Tag", None, None, False), ("c", "Tag", "T", 0.55, True)], profiles.SCHEMA
    )
    text = "one K1 @x"
    rows = [(1, "a", text), (2, "b", text), (3, "c", text), (4, "unknown", text), (5, None, text), (6, "a", None)]
    got = {r.n: r.text for r in profiles.redact_by_profile(spark.createDataFrame(rows, "n int, profile string, text string"), settings, rules=CODES, spans=spans).collect()}
    # one line alone is no table cell: 0.5 for every hit
    whole = {1: "[A] <tag>", 2: text, 3: "#", 4: text, 5: text, 6: None}
    within = {1: "one [A] <tag>", 2: text, 3: "one # @x", 4: text, 5: text, 6: None}
    assert got == (within if spans else whole)


def test_one_plan_for_any_number_of_profiles(spark):
    df = spark.createDataFrame([("p1", "K1")], "profile string, text string")
    sizes = []
    for n in (2, 500):
        settings = spark.createDataFrame([(f"p{i}", "Code", f"[{i}]", 0.5, True) for i in range(n)], profiles.SCHEMA)
        redacted = profiles.redact_by_profile(df, settings, rules=CODES)
        assert redacted.first().text == "[1]"
        sizes.append(len(redacted._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(sizes[0] - sizes[1]) < 100


def test_job_under_settings_files(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [("Name:", "s"), ("call 202-555-0143 now\nthe phone is in the hall today\nx y z", "s"), ("x", "u"), (None, "s")]
    spark.createDataFrame(rows, "text string, kind string").write.parquet(path)
    file = tmp_path / "s.json"
    file.write_text(json.dumps({"enabled_categories": ["PhoneNumbers"], "confidence_thresholds": {"pattern_matching": 0.6}}))
    loaded = profiles.settings_table(spark, {"s": load_settings(spark, str(file))}).collect()
    assert {r.category for r in loaded if r.enabled} == {"Phone Numbers"} and {r.threshold for r in loaded} == {0.6}
    assert {r.replacement for r in loaded if r.category == "Phone Numbers"} == {DEFAULT_SETTINGS["replacement_patterns"]["PhoneNumbers"]["custom"]}
    out = spark.read.parquet(pipeline.anonymize(spark, path, settings={"s": str(file)}, profile="kind", spans=True))
    assert out.columns == ["text", "kind"]
    texts = {r.text for r in out.collect()}
    assert texts == {"Name:", "call XXX-XXX-XXXX now\nthe phone is in the hall today\nx y z", "x", None}
    one = spark.read.parquet(pipeline.anonymize(spark, path, str(tmp_path / "o"), settings={"s": str(file)}))
    assert {r.text for r in one.collect()} == {"Name:", "XXX-XXX-XXXX\nthe phone is in the hall today\nx y z", "x", None}
    with pytest.raises(ValueError):
        pipeline.anonymize(spark, path, str(tmp_path / "p"), settings={"s": str(file), "t": str(file)})


def test_quantiles_and_lists_same_as_plain_python(spark):
    r = random.Random(3)
    texts = [(i, "\n".join(" ".join(["K1"] * r.randrange(6) + ["@a"] * r.randrange(2)) or "-" for _ in range(r.randrange(1, 130)))) for i in range(60)]
    context = pipeline.text_context(spark.createDataFrame(texts, "doc_id long, text string")).cache()
    units = {}
    for d, t in texts:
        for i, line in enumerate(t.split("\n")):
            for level, unit in (("document", d), ("page", (d, i // 40))):
                for word, key in (("K1", ("Code", 0)), ("@a", ("Tag", 0))):
                    n = line.split().count(word) if len(line) >= 2 else 0
                    for k in (key, (key[0], None), (None, None)):
                        units.setdefault((level, *k), {}).setdefault(unit, [0])[0] += n
    want = {}
    for k, found in units.items():
        values = sorted(v[0] for v in found.values() if v[0])
        at = lambda p: values[max(0, math.ceil(len(values) * p / 100) - 1)]
        want[k] = (len(values), at(50), at(90), at(99), values[-1])
    got = {(x.level, x.category, x.pattern_idx): (x.n_units, x.p50, x.p90, x.p99, x.most) for x in reports.hit_quantiles(context, CODES).collect()}
    assert got == want

    matches = D.detect(context, CODES).cache()
    parts = reports.match_lists(matches, part_size=50).collect()
    lists = {}
    for p in sorted(parts, key=lambda p: p.part):
        own = lists.setdefault((p.doc_id, p.category), [])
        assert (p["first"], p.n_matches) == (len(own), len(p.matches)) and len(p.matches) <= 50
        own += [(m.page_no, m.block_no, m.pattern_idx, m.start) for m in p.matches]
    every = {}
    for m in matches.collect():
        every.setdefault((m.doc_id, m.category), []).append((m.page_no, m.block_no, m.pattern_idx, m.start))
    assert lists == {k: sorted(v) for k, v in every.items()}
    assert matches.agg(F.count("*")).first()[0] == sum(map(len, lists.values()))
