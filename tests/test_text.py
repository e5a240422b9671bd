import random
import re
import time

import pytest
from pyspark.sql import functions as F, types as T

from inkveil.functions import scan
from inkveil.functions.text import PIECE, clean_text, in_pieces, luhn_valid, normalize_ws, preview, preview_in, ssn_valid
from inkveil.operators import detect, redact, reports
from inkveil.rules import DEFAULT_RULES, EXTENDED_RULES, Pattern
import models

CONTEXT = "doc_id long, page_no long, block_no long, text string, preceding_text string, following_text string, is_table_cell boolean"


def one(spark, expr, *rows, schema="t string"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(expr.alias("v")).collect()]


CLEAN_CASES = [
    ("foo\nbar", "foobar"),
    ("a\tb", "ab"),
    ("L|NE ¦ ¡", "LINE I i"),
    ("PHONE 1O0", "PH0NE 100"),
    ("a—b–c­d", "a-b-c-d"),
    ("zero​width no break", "zerowidth nobreak"),
    ("  two   spaces ", "two spaces"),
    ("it's \"l\"", "it's \"l\""),
    ("", ""),
    ("\n\n", ""),
]


def test_clean_text(spark):
    assert one(spark, clean_text(F.col("t")), *[(a,) for a, _ in CLEAN_CASES]) == [b for _, b in CLEAN_CASES]


def test_clean_text_random(spark):
    rnd = random.Random(1)
    alphabet = "aOl|¡¦ \t\n ​ —–­é'\"0ßñ＠\x1c　😀"
    texts = ["".join(rnd.choices(alphabet, k=rnd.randrange(40))) for _ in range(400)]
    assert one(spark, clean_text(F.col("t")), *[(t,) for t in texts]) == [models.clean(t) for t in texts]
    spaced = one(spark, normalize_ws(F.col("t")), *[(t,) for t in texts])
    assert spaced == [" ".join(t.split()) for t in texts]


def test_luhn(spark):
    rnd = random.Random(2)
    texts = ["4539 1488 0343 6467", "8273 1232 7352 0569", "", "none", "0", "79927398713"]
    texts += ["".join(rnd.choices("0123456789 -", k=rnd.randrange(24))) for _ in range(300)]
    assert one(spark, luhn_valid(F.col("t")), *[(t,) for t in texts]) == [models.luhn(t) for t in texts]


@pytest.mark.parametrize(
    "text, ok",
    [("123-45-6789", True), ("000-12-3456", False), ("666-12-3456", False), ("900-12-3456", False),
     ("123-00-4567", False), ("123-45-0000", False), ("123456789", False)],
)
def test_ssn(spark, text, ok):
    assert one(spark, ssn_valid(F.col("t")), (text,)) == [ok]


def test_preview_in_pieces(spark):
    """The same from pieces as from the whole text, at every place around the ends of pieces."""
    text = "".join("ab\né😀 x"[i % 7] for i in range(3 * PIECE + 5))
    places = [(text[:n], s, e) for n in (1, PIECE, PIECE + 1, len(text)) for s in range(0, n, 3) for e in (s + 1, s + 25, n) if e <= n]
    schema = "t string, s int, e int"
    args = (F.col("s"), F.col("e"), F.lit("[R]"))
    assert one(spark, preview_in(in_pieces(F.col("t")), *args), *places, schema=schema) == one(spark, preview(F.col("t"), *args), *places, schema=schema)


def test_match_preview_reads_pieces(spark, tmp_path):
    """A hit does not go through the whole of a long text."""
    from inkveil.plans.catalog import QUERIES

    spark.createDataFrame([(1, "name: John Smith\nname: Ann Lee")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    shown = QUERIES["match_preview"](spark, str(tmp_path))
    assert not re.search(r"substring\(text#", shown._jdf.queryExecution().optimizedPlan().toString())


def test_preview(spark):
    text = "x" * 30 + "HIT" + "y" * 30
    shown = preview(F.col("t"), F.lit(30), F.lit(33), F.lit("[R]"), 5)
    assert one(spark, shown, (text,))[0].asDict() == {"before": "xxxxx", "after": "yyyyy", "proposed": "xxxxx[R]yyyyy"}
    early = preview(F.col("t"), F.lit(2), F.lit(3), F.lit("*"), 5)
    assert one(spark, early, ("abcdefghijk",))[0].proposed == "ab*defgh"


def test_offsets_in_texts_of_any_length(spark):
    pattern = Pattern(r"\d+")
    texts = ["a1" * n for n in (0, 1, 31, 32, 33, 64, 65, 200)] + ["7", "é12ß3", "12"]
    got = one(spark, scan.hits(scan.fenced(F.col("t"), pattern)), *[(t,) for t in texts])
    for t, hits in zip(texts, got):
        want = [(k, m.group(), m.start(), m.end()) for k, m in enumerate(re.finditer(r"\d+", t))]
        assert [tuple(h) for h in hits] == want


def test_hit_rows_are_the_hits(spark):
    r = random.Random(8)
    some = lambda n: "".join(r.choice(["7", "ab ", "\u00e9", "\U0001f600", "12-3 "]) for _ in range(n))
    texts = [(i, some(n)) for i, n in enumerate([0, 1, 5, 40, 300, 700, 3000, 20000])] + [(8, "7" * 64), (9, "7x" * 1600)]
    pattern = Pattern(r"\d+|\u00e9")
    fenced = spark.createDataFrame(texts, "id int, t string").withColumn("fenced", scan.fenced(F.col("t"), pattern))
    rows = scan.hit_rows(fenced.select("id", "fenced"), ["id"])
    assert rows.columns == ["id", "match_idx", "match_text", "start", "end"]
    want = [
        (i, k, m.group(), m.start(), m.end()) for i, t in texts for k, m in enumerate(re.finditer(r"[0-9]+|\u00e9", t))
    ]
    assert sorted(map(tuple, rows.collect())) == want
    inline = fenced.select("id", F.inline(scan.hits(F.col("fenced"))))
    assert sorted(map(tuple, inline.collect())) == want
    assert rows.schema["start"].dataType == rows.schema["end"].dataType == rows.schema["match_idx"].dataType == T.IntegerType()


def test_time_of_hits_grows_with_the_text(spark):
    """A chunk used to read all text before it."""
    text = F.repeat(F.lit(f"ab{scan.FENCE}cde{scan.FENCE}"), 100_000)
    long = spark.range(1).select("id", text.alias("fenced"))
    began = time.perf_counter()
    last = F.max(F.struct("end", "match_idx", "start"))
    inline = long.select(F.inline(scan.hits(F.col("fenced"))))
    for rows in (inline, scan.hit_rows(long, ["id"])):
        assert tuple(rows.agg(last.alias("last")).first().last) == (500_000, 99_999, 499_997)
    assert time.perf_counter() - began < 60


def test_detection_makes_rows_without_array_functions(spark):
    blocks = spark.createDataFrame([(1, 0, 0, "a 12", "", "", True)], CONTEXT)
    plan = detect.detect(blocks)._jdf.queryExecution().executedPlan().toString()
    assert "substring_index" in plan and "transform(filter(transform(split(" not in plan


def test_spans_are_sorted_without_a_comparison_function(spark):
    blocks = spark.createDataFrame([(1, 0, 0, "a 12", "", "", True)], CONTEXT)
    plan = redact.dedupe_spans(blocks)._jdf.queryExecution().executedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan.replace("sort_array(", "")
    pages = reports.matches_by_page(detect.detect(blocks))
    assert "array_sort(" not in pages._jdf.queryExecution().executedPlan().toString()



# Own samples for each kind of pattern: found, not found.
SAMPLES = {
    ("Names", 0): (["Jane Doe", "john smith-jones", "Anna", "Renée Dupont", "Foo Bar 5"], ["Bob", "x1 y2", "Äöß"]),
    ("Names", 3): (["word", "CamelCase", "over there"], ["abc", "né"]),
    ("Names", 4): (["Oliver Stone", "0liver Stone"], ["12"]),
    ("Names", 5): (["J. R. Tolkien", "W Smith Jones Lee and more", "one two three"], ["ab", "7"]),
    ("Account Numbers", 0): (["1234 5678 9012 3456", "1999", "12-34-56-78"], ["123", "abc"]),
    ("Account Numbers", 1): (["GB82 1234 5698 7654", "de12-3456-7890"], ["G82 1234"]),
    ("Account Numbers", 2): (["1234567890", "1234567890123456"], ["123456789", "12345678901234567"]),
    ("Account Numbers", 3): (["1lI4567890"], ["1lI456"]),
    ("Account Numbers", 4): (["1234-5678-9012-3456", "1234567890123456"], ["1234 5678 9012 345"]),
    ("Account Numbers", 5): (["12/03/1999", "10.0.0.1", "1 2 3"], ["12/03", "1--2--3"]),
    ("Addresses", 0): (["12 Main Street", "7 Long Hill Road", "12 Broadway"], ["Main Street", "12Main"]),
    ("Addresses", 1): (["PO Box 12", "P.O. Box 7", "post office box 3"], ["Box 12"]),
    ("Addresses", 2): (["Apt. 4B", "Suite 100", "united"], ["Floor 3"]),
    ("Addresses", 3): (["5 Elm St", "9 Oak Blvd."], ["Elm St"]),
    ("Addresses", 4): (["K1A 0B1", "k1a-ob1"], ["K1A 0B"]),
    ("Addresses", 5): (["90210", "90210-1234"], ["9021", "902101"]),
    ("Phone Numbers", 0): (["+44 20 7946 0958", "+1-202-555-0143"], ["+1 (202) 555-0143", "+12345"]),
    ("Phone Numbers", 1): (["202-555-0143", "2025550143"], ["202-555-014"]),
    ("Phone Numbers", 2): (["ext. 123", "x 4455", "EX12"], ["ext 1", "text 12"]),
    ("Phone Numbers", 3): (["2O2 55l 0143"], ["2O2 55l 014"]),
    ("Phone Numbers", 4): (["202.555.0143"], ["202-555-0143"]),
    ("Email Addresses", 0): (["a@b.com", "a.b @ mail . org"], ["a@b", "a at b.com"]),
    ("Email Addresses", 1): (["a＠b.com", "ann (at) mail.com", "whatever.it"], ["a b.com"]),
    ("Email Addresses", 2): (["x@mail.org"], ["x@mail.xyz", "x @mail.org"]),
    ("Email Addresses", 3): (["x ＠ mail.xyz"], ["x at mail.xyz"]),
}


def test_every_pattern_has_samples():
    keys = {(c.name, i) for c in DEFAULT_RULES.categories for p, n in c.distinct_patterns() for i in n[:1]}
    assert keys == set(SAMPLES)


def test_patterns_accept_and_reject(spark):
    cases = [
        (c, i, t, want)
        for (c, i), groups in SAMPLES.items()
        for want, texts in zip((True, False), groups)
        for t in texts
    ]
    found = F.lit(None).cast("boolean")
    for c in DEFAULT_RULES.categories:
        for i, p in enumerate(c.patterns):
            found = F.when((F.col("c") == c.name) & (F.col("i") == i), scan.occurs(F.col("t"), p)).otherwise(found)
    rows = spark.createDataFrame(cases, "c string, i int, t string, want boolean")
    wrong = rows.withColumn("found", found).where("found is distinct from want").collect()
    assert wrong == []


def test_bracketed_phone_only_in_extended_rules(spark):
    text = "call +1 (202) 555-0143 now"
    hit = lambda rules: F.lit(False) if not rules else F.greatest(
        *[scan.occurs(F.col("t"), p) for p in rules.get("Phone Numbers").patterns]
    )
    assert one(spark, hit(DEFAULT_RULES), (text,)) == [False]
    assert one(spark, hit(EXTENDED_RULES), (text,)) == [True]


def test_long_run_of_words_does_not_exhaust_the_stack(spark):
    text = " ".join(["Word"] * 20000)
    pattern = DEFAULT_RULES.get("Names").patterns[5]
    (hits,) = one(spark, scan.hits(scan.fenced(F.col("t"), pattern)), (text,))
    assert [(h.start, h.end) for h in hits] == [(0, len(text))]
