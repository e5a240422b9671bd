import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=3):
    """All scores of all anchors."""
    own = []
    for vec_id, x, label, *_ in rows:
        if vec_id is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        own.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(v))) for v in x]))
    out = []
    for i, (a, label, q) in enumerate(own):
        if a % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(q, p)), b, other) for j, (b, other, p) in enumerate(own) if j != i]
        for s, b, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            met = sorted(x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)
            out += [(a, b, k, n, -s, -t) for k, (t, n, _) in enumerate(met[:negatives], 1)]
    return sorted(out)


def mined(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 50 == 0, label).collect())


def clustered(n, dims, seed=5, labels=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dims))
    x = centres[r.integers(0, 12, n)] + 0.3 * r.normal(size=(n, dims))
    return [(i, [float(v) for v in row], int(k)) for i, (row, k) in enumerate(zip(x, r.integers(0, labels, n)))]


@pytest.mark.parametrize("seed_rows,dims", [(20, 6), (100_000, 7), (20, 1)])
def test_same_as_brute_force(spark, monkeypatch, seed_rows, dims):
    monkeypatch.setattr(hard_negatives, "CELL", 5)
    monkeypatch.setattr(hard_negatives, "SEED", seed_rows)
    monkeypatch.setattr(hard_negatives, "BUCKET", 7)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 3)
    monkeypatch.setattr(hard_negatives, "HELD", 50)
    rows = clustered(700, dims)
    want = brute(rows)
    assert len(want) > 100
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(5)) == want


def test_far_cells_are_not_visited(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CELL", 10)
    monkeypatch.setattr(hard_negatives, "SEED", 20)
    rows = clustered(2000, 8)
    made = []
    kept = hard_negatives.probes
    monkeypatch.setattr(hard_negatives, "probes", lambda *a, **k: made.append(kept(*a, **k)) or made[-1])
    monkeypatch.setattr(hard_negatives, "discard", lambda *a: None)
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    anchors, cells = 40, made[0].union(made[1]).select("cell").distinct().count()
    assert made[0].count() + made[1].count() < 0.5 * anchors * cells


def test_copies_ties_nulls_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CELL", 5)
    monkeypatch.setattr(hard_negatives, "SEED", 10)
    r = random.Random(1)
    one = [1.0, 0.5, -0.25]
    rows = [(i, one, i % 2) for i in range(300)]  # one vector a third of the time
    rows += [(i, [r.choice([0.0, 0.5, 1.0]) for _ in range(3)], r.randrange(3)) for i in range(300, 900)]
    rows += [(50, [0.9, 0.5, 0.0], 1), (50, one, 1), (-50, one, 0), (None, one, 0), (901, None, 0), (902, one, None), (903, [1.0, None, 0.0], 0)]
    rows += [(904, [float("nan"), 0.0, 0.0], 0), (905, [float("inf"), 0.0, 0.0], 0), (950, [], 1), (951, [1.0], 1), (1000, [-1.0, -1.0, -1.0], 2)]
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], SCHEMA + ", row int, cell string")
    assert mined(df) == brute(rows)


def test_large_components_and_few_rows(spark):
    rows = [(0, [70000.0, 1.0], 1), (50, [60000.0, -3.0], 1), (3, [50000.0, 2.0], 2), (4, [40000.0, 2.0], 2)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)) == []
    with pytest.raises(ValueError):
        mined(spark.createDataFrame([(0, [3e30], 1)], SCHEMA))


def test_recall_is_whole(spark, monkeypatch):
    """Random vectors, for which bounds say little: nothing is lost."""
    monkeypatch.setattr(hard_negatives, "CELL", 30)
    monkeypatch.setattr(hard_negatives, "SEED", 100)
    r = np.random.default_rng(2)
    x = r.normal(size=(1500, 32))
    rows = [(i, [float(v) for v in row], i % 10) for i, row in enumerate(x / np.linalg.norm(x, axis=1)[:, None])]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
