"""Places of matches in texts of every size, and how they are found."""

import random

import pytest
from pyspark.sql import functions as F

from inkveil.functions import scan
from inkveil.operators import redact


def fenced_texts():
    r = random.Random(5)
    texts = ["", "abc", "\u0001é\u0001", "a\u0001b\u0001\u0001c\u0001d"]
    for n in (1, 7, 8, 9, 15, 16, 17, 31, 33, 100, 700):
        texts.append("".join("".join(r.choice("aé日😀") for _ in range(r.randrange(4))) + scan.FENCE + r.choice(["x", "ñy"]) + scan.FENCE for _ in range(n)) + "z" * r.randrange(3))
    return texts


def want(text):
    out, at = [], 0
    for i, piece in enumerate(text.split(scan.FENCE)):
        if i % 2:
            out.append((i // 2, piece, at, at + len(piece)))
        at += len(piece)
    return out


def test_places_of_matches(spark):
    texts = fenced_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "id long, fenced string")
    assert {r.id: [tuple(h) for h in r.hits] for r in df.select("id", scan.hits(F.col("fenced")).alias("hits")).collect()} == {i: want(t) for i, t in enumerate(texts)}
    rows = scan.hit_rows(df, ["id"]).collect()
    assert sorted((r.id, r.match_idx, r.match_text, r.start, r.end) for r in rows) == [(i, *h) for i, t in enumerate(texts) for h in want(t)]


def test_text_is_not_read_again_for_each_match():
    assert "substring_index" not in str(scan.hits(F.col("fenced")))


@pytest.mark.parametrize("n", [1, 7, 8, 9, 63, 64, 65, 200, 4200])
def test_groups_that_do_not_reach_into_another(spark, n):
    r = random.Random(n)
    spans = sorted((s := r.randrange(4 * n), s + r.choice([1, 2, 9]), r.randrange(2), 0, "t") for _ in range(n))
    want, reach = [], -1
    for s in spans:
        if s[0] >= reach:
            want.append([])
        want[-1].append(s)
        reach = max(reach, s[1])
    df = spark.createDataFrame([(spans,)], f"s array<{redact._SPAN}>")
    got = [[tuple(x) for x in g] for g in df.select(redact._apart(F.col("s")).alias("g")).first().g]
    assert got == want


def test_short_lists_are_cut_in_short_chunks():
    """Every span of a chunk looks at those before it."""
    assert redact._CHUNK[0] < 64 and "sqrt" in str(redact._apart(F.col("s"))).lower()
