import binascii

import numpy as np

from inkveil.llm import sharding


def rows(n):
    return [(i if i % 9 else None, None if i % 7 == 0 else "té xt " * (i % 11), i) for i in range(n)] + [(5, "same", 1)] * 20


def test_counts_slots_and_rows(spark):
    docs = spark.createDataFrame(rows(300), "doc_id long, text string, size int").repartition(4)
    for shards in (1, 3, 8):
        got = sharding.shard_documents(docs, shards, bucket_bytes=900).collect()
        assert sorted(map(str, (tuple(r)[:3] for r in got))) == sorted(map(str, rows(300)))
        per = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(shards)}
        assert all(v == list(range(len(v))) for v in per.values())
        assert max(map(len, per.values())) - min(map(len, per.values())) <= 1


def test_order_is_shuffled_and_repeats_with_the_seed(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(200)], "doc_id long, text string")
    order = lambda seed, d: [r.doc_id for r in sorted(sharding.shard_documents(d, 2, seed, bucket_bytes=300).collect(), key=lambda r: (r.shard, r.slot))]
    assert order(1, docs) == order(1, docs.repartition(7)) != order(2, docs)
    assert order(1, docs) != sorted(order(1, docs))


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame(rows(50), "doc_id long, text string, size int")
    got = sharding.shard_digest(spark, sharding.shard_documents(docs)).collect()
    assert len(got) == 70
    for r in got:
        assert (r.law, r.grown_shard) == ("rows", None)
    texts = {(len((t or "").encode()) + 1, binascii.crc32((t or "").encode())) for _, t, _ in rows(50)}
    assert {(r["size"], r.text_crc32) for r in got} == texts


def test_fewer_rows_than_shards_no_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert sorted(r.slot for r in sharding.shard_documents(docs, 8).collect()) == [0, 0]
    assert sharding.shard_documents(docs.limit(0), 8).count() == 0
    named = spark.createDataFrame([(i, str(i), 1, 2, 3, 4, "s", "t") for i in range(30)], "doc_id long, text string, rows int, bucket int, place int, before int, shard string, slot string")
    got = sharding.shard_documents(named, 3, bucket_bytes=20).collect()
    assert {(r["rows"], r.bucket, r.place, r.before) for r in got} == {(1, 2, 3, 4)}
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(3) for i in range(10)]
    assert sharding.shard_digest(spark, sharding.shard_documents(named)).count() == 30


def test_rows_repeated_very_often_spread(spark):
    """A third of all rows are equal, another third has no id."""
    rows = [(7, "the same text", i) for i in range(600)] + [(None, "text without an id", i) for i in range(600)] + [(100 + i, f"text {i}", i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(5)
    scattered = sharding.scatter(docs, 40, 700, seed=17)
    assert max(r["count"] for r in scattered.groupBy(sharding._BUCKET).count().collect()) < 90
    got = sharding.shard_documents(docs, 8, bucket_bytes=700).collect()
    assert sorted(map(str, (tuple(r)[:3] for r in got))) == sorted(map(str, rows))
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(8) for i in range(225)]


def test_same_order_as_plain_python(spark):
    """Buckets one after the other, each shuffled by itself."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string").repartition(3)
    total = sum(len(f"text {i}") + 1 for i in range(300))
    buckets = -(-total // 400)
    held = {}
    for r in sharding.scatter(docs, buckets, 400, 17).collect():
        held.setdefault(r[sharding._BUCKET], []).append((r.doc_id, r.text))
    want = []
    for b in sorted(held):
        own, random = sorted(held[b]), np.random.default_rng([17, b])
        draws = random.integers(0, np.arange(len(own), 1, -1)).tolist()
        for i, j in zip(range(len(own) - 1, 0, -1), draws):
            own[i], own[j] = own[j], own[i]
        want += [d for d, _ in own]
    got = sharding.shard_documents(docs, 7, 17, bucket_bytes=400).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] == want


def test_every_order_is_as_likely():
    seen = {}
    for seed in range(6000):
        order = tuple(sharding.fisher_yates(3, np.random.default_rng(seed)))
        seen[order] = seen.get(order, 0) + 1
    assert len(seen) == 6 and min(seen.values()) > 850
    assert sharding.fisher_yates(0, np.random.default_rng(1)).tolist() == []
