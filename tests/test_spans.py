"""Span choice in long groups."""

import random
import time

import pytest
from pyspark.sql import functions as F

from inkveil.operators import redact


def chosen(spans):
    """By rank, each that overlaps none chosen before."""
    kept = []
    for s in sorted(set(spans), key=lambda s: (s[0] - s[1], s[2], s[3], s[0])):
        if all(k[1] <= s[0] or s[1] <= k[0] for k in kept):
            kept.append(s)
    return sorted(kept)


def by_spark(spark, groups):
    rows = [(i, [(*s, "t") for s in sorted(set(g))]) for i, g in enumerate(groups)]
    df = spark.createDataFrame(rows, f"id int, spans array<{redact._SPAN}>")
    kept = F.flatten(F.transform(redact._apart(F.col("spans")), redact._longest_first))
    return {r.id: [tuple(s)[:4] for s in r.kept] for r in df.select("id", kept.alias("kept")).collect()}


@pytest.mark.parametrize("few", [32, 1, 1000])
def test_same_as_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(redact, "_FEW", few)
    r = random.Random(6)
    groups = [[]]
    for _ in range(300):
        n, reach = r.randrange(1, 40), r.choice([15, 60, 300])
        groups.append([(a, a + r.choice([1, 2, 3, 5, 9, 30]), r.randrange(3), r.randrange(4)) for a in (r.randrange(reach) for _ in range(n))])
    groups.append([(0, 9, 0, 1), (0, 9, 0, 0), (0, 9, 1, 0), (9, 18, 1, 1), (8, 10, 0, 0)])
    got = by_spark(spark, groups)
    assert [got[i] for i in range(len(groups))] == [chosen(g) for g in groups]


def chain(n):
    """Each span reaches into the next; every length comes up, longer ones behind shorter ones and before them."""
    r, at, out = random.Random(1), 0, []
    for i in range(n):
        size = 4 + (i * 7) % 13
        out.append((at, at + size, i % 3, 0))
        at += size - 1 - r.randrange(2)
    return out


def test_a_long_chain_takes_time_in_proportion(spark):
    by_spark(spark, [chain(100)])
    seconds = {}
    for n in (2_500, 10_000):
        start = time.perf_counter()
        got = by_spark(spark, [chain(n)])
        seconds[n] = time.perf_counter() - start
        if n == 2_500:
            assert got[0] == chosen(chain(n))
    assert sum(b <= a for (_, a, *_), (b, *_) in zip(got[0], got[0][1:])) == 0
    assert seconds[10_000] < 8 * seconds[2_500] + 2
