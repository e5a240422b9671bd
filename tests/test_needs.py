"""What a pattern needs is found in its every match; places of matches, measured both ways."""

import random

from pyspark.sql import functions as F

from inkveil.functions import scan
from inkveil.rules import DEFAULT_RULES

PATTERNS = [p for c in DEFAULT_RULES.categories for p, _ in c.distinct_patterns()]
MATCHED = [
    "1234 5678", "1 2 3 4", "1-o-O-4", "1 2 3 4", "oO12", "GB12 1234 5678 1234", "0123456789", "OIl0123456", "oıİl0123456", "İoı0 12İ3 oı45",
    "1234-5678-1234-5678", "12.34/56", "12 Long Street", "7-Oak Rd.", "٣ Oak St", "P.O. Box 12", "po box oo", "P0-Box 9", "Rm 5", "Apt.-4", "ſuite 12",
    "K1A 0B1", "K1ſ-oı0", "12345-6789", "ooooo", "+49 1234567", "(212) 555-1234", "١٢٣-456-7890", "ext. 12", "x١٢", "lIO-123-4567",
    "212.555.1234", "ann@example.org", "ann at example dot com", "ann at example.ıİ", "ann at host(dot)ſK", "ann＠host.de",
]


def test_letters_that_fold(spark):
    """The letters the needs are written with cover all that the patterns' classes take."""
    points = spark.range(1, 0x110000).where("id < 55296 or id > 57343").selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') as c")
    taken = lambda regex: {r.c for r in points.where(F.col("c").rlike(f"(?iU)^{regex}$")).collect()}
    ascii_letters = {chr(i) for i in range(128) if chr(i).isalpha()}
    assert taken("[A-Z]") <= ascii_letters | set("\u017f\u212a\u0131\u0130")
    assert taken("[0-9O]") == set("0123456789Oo")
    assert taken("[O0-9lI]") <= set("0123456789OoLlIi\u0131\u0130")
    assert taken("[box]") == set("BbOoXx") and taken("[dot]") == set("DdOoTt")


def test_needs(spark):
    """Alone, amid words, and cut and joined at random: a text without what is needed has no match."""
    rng = random.Random(5)
    texts = MATCHED + [f"see {m}, then" for m in MATCHED]
    for _ in range(3000):
        a, b = rng.choice(MATCHED), rng.choice(MATCHED)
        texts.append(a[rng.randrange(len(a)) :] + rng.choice(["", " ", "-", ". "]) + b[: rng.randrange(1, len(b) + 1)])
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    guarded = [p for p in PATTERNS if p.needs]
    assert len(guarded) >= 15
    counts = [F.count_if(F.col("text").rlike(p.java)) for p in guarded]
    missed = [F.count_if(F.col("text").rlike(p.java) & ~F.col("text").rlike(p.needs)) for p in guarded]
    *found, = df.select(*[c.alias(f"c{i}") for i, c in enumerate(counts + missed)]).first()
    assert all(n > 0 for n in found[: len(guarded)]), [p.regex for p, n in zip(guarded, found) if not n]
    assert not any(found[len(guarded) :])


def test_short_and_long_hits(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aé\U0001d518 b") for _ in range(n)) for n in (0, 1, 2, 7, 40, 300, 3000) for _ in range(5)]
    df = spark.createDataFrame([(t, t) for t in [*texts, None]], "text string, own string")
    fence = F.regexp_replace("text", "[aé\U0001d518]+", f"{scan.FENCE}$0{scan.FENCE}")
    df = df.withColumn("fenced", fence)
    rows = df.select("own", *[f(F.col("fenced")).alias(n) for n, f in (("s", scan._short_hits), ("l", scan._long_hits), ("h", scan.hits))]).collect()
    for r in rows:
        assert r.s == r.l == r.h
        for i, h in enumerate(r.h or ()):
            assert h.match_idx == i and r.own[h.start : h.end] == h.match_text
