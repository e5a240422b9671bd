import hashlib
import random

import numpy as np

from inkveil.llm import suffixes


def brute(rows, window=100):
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        if d is not None:
            for i in range(len(t) - window + 1):
                k = t[i : i + window]
                first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - window + 1):
            if d is not None and first[t[i : i + window]] < (d, i):
                gone[i + 1 : i + 1 + window] = True
        own = gone[1:-1]
        spans = int((own & ~gone[:-2]).sum())
        kept = bytes(b for b, g in zip(t, own) if not g)
        out.append((d, len(t), int(own.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=5):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("ab é") for _ in range(n))
    passages = [text(n) for n in (99, 100, 101, 150, 400)]
    rows = []
    for i in range(100):
        parts = [text(r.randrange(120)) for _ in range(3)]
        for p in r.sample(passages, r.randrange(3)):
            parts.insert(r.randrange(3), p)
        rows.append((i * 3 - 50, "".join(parts)))
    rows += [(1000 + i, rows[5][1] + passages[3]) for i in range(40)] + [(2000 + i, passages[4] + text(9) + passages[4]) for i in range(30)]
    rows += [(3000, None), (3001, ""), (3002, "a" * 99), (3003, "a" * 700), (3004, "ab" * 300), (3005, "a" * 701 + "b"), (None, passages[4]), (None, passages[4])]
    rows += [(4000, passages[3]), (4000, passages[3]), (4001, text(50000) + passages[3]), (4002, "xyz" * 100 + passages[4] + "xyz" * 90)]
    r.shuffle(rows)
    return rows


KEY = lambda r: (r[0] is None, r[0] or 0, *r[1:])


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 3000)  # many blocks
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(5)
    got = sorted((tuple(r) for r in suffixes.repeat_digest(docs).collect()), key=KEY)
    assert got == sorted(brute(rows), key=KEY)


def test_empty_table(spark):
    assert suffixes.repeat_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cover_has_every_difference():
    for period in (7, 36, 50):
        cover = suffixes.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
