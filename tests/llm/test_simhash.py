import random
from collections import Counter

import numpy as np
import xxhash

from inkveil.llm import simhash
from inkveil.llm.components import components


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    ones = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g, 42) >> b & 1)
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(grams))


def roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_every_link_is_found_whatever_bits_differ():
    r = np.random.default_rng(4)
    tables = simhash.golay_tables()
    a = r.integers(0, 1 << 63, 3000, np.int64)
    b = a.copy()
    for n in range(len(a)):
        for bit in r.choice(64, r.integers(0, 5), replace=False):
            b[n] ^= np.int64(np.uint64(1 << int(bit)).view(np.int64))
    keys = []
    for x in (a, b):
        key, row = simhash.keys_of(x, tables)
        keys.append(set(zip(row.tolist(), key.tolist())))
    assert {n for n, _ in keys[0] & keys[1]} == set(range(len(a)))


def test_components_of_fingerprints_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 20)  # many chunks
    r = np.random.default_rng(9)
    fps = list(r.integers(-(1 << 63), (1 << 63) - 1, 60, np.int64)) + [0, 1, 3]
    for base in fps[:4]:  # dense groups, and chains that wander off
        now = base
        for _ in range(70):
            change = np.uint64(0)
            for bit in r.choice(64, r.integers(1, 5), replace=False):
                change |= np.uint64(1 << int(bit))
            now = (now if r.random() < 0.5 else base) ^ np.int64(change.view(np.int64))
            fps.append(now)
    fps = sorted({int(x) for x in fps})
    got = {(x.node, x.component) for x in components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect()}
    linked = [(x, y) for i, x in enumerate(fps) for y in fps[:i] if ((x ^ y) & (1 << 64) - 1).bit_count() <= 4]
    want = {(n, c) for n, c in roots(fps, linked).items() if any(n in p for p in linked)}
    assert got == want


def test_documents_same_as_brute_force(spark):
    r = random.Random(6)
    text = lambda n: " ".join(r.choice(["a", "B", "cc", "dé", "Ñ"]) + r.choice("xyz") for _ in range(n))
    rows = [(i, text(r.randrange(1, 40))) for i in range(50)]
    rows += [(100 + i, rows[3][1] + "\n tail" * (i % 2)) for i in range(20)] + [(200, None), (201, ""), (202, " \t"), (203, "A b"), (204, "a B"), (205, text(70000)), (3, rows[3][1])]
    docs = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, fp int")
    got = sorted((x.doc_id, x.fingerprint, x.component_id) for x in simhash.near_duplicates(docs).collect())
    fps = {d: plain(t) for d, t in rows}
    ids = sorted(fps)
    root = roots(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    assert got == sorted((d, f"{fps[d]:016x}", root[d]) for d, _ in rows)


def test_nulls_ties_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (5, "three"), (5, "three"), (4, "three")], "doc_id long, text string")
    got = sorted(((x.doc_id or 0), x.component_id) for x in simhash.near_duplicates(docs).collect())
    assert got == [(0, None), (0, None), (4, 4), (5, 4), (5, 4)]
    assert sorted((x.doc_id or 0) for x in simhash.one_of_each(docs).collect()) == [0, 0, 4]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keys_are_never_broadcast(spark, monkeypatch):
    """Spark takes the keys, some forty for each fingerprint, for a table as small as the fingerprints."""
    fps = spark.createDataFrame([(x,) for x in range(8)], "fp long")
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "BroadcastHashJoin [key" not in plan
