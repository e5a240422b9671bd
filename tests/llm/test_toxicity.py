import random

from inkveil.llm import toxicity


def rows(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "the", "er", "ti", "ou", "wh"]) for _ in range(r.randrange(1, 5)))
    out = []
    for i in range(n):
        own = [word() for _ in range(r.randrange(20, 200))]
        toxic, low = int(r.random() < 0.2), int(r.random() < 0.3)
        for _ in range(5 * toxic):
            own.insert(r.randrange(len(own)), r.choice(["scum", "moron", "loweix" + word()]))
        for _ in range(5 * low):
            own.insert(r.randrange(len(own)), "$$$ click")
        out.append((i, " ".join(own), 1 - low, toxic))
    return out


def test_held_out_rows(spark):
    data = rows(900, 1)
    docs = spark.createDataFrame([(d, t, 0) for d, t, _, _ in data], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(d, q, t) for d, _, q, t in data if d % 3] + [(None, 1, 1), (5, None, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxic_documents(docs, labels).collect()}
    held = [(got[d], q, t) for d, _, q, t in data if d % 3 == 0]
    assert sum(r.toxic == bool(t) for r, _, t in held) / len(held) > 0.98
    assert sum((r.p_low_quality > 0.5) == (q == 0) for r, q, _ in held) / len(held) > 0.95
    assert all(0 <= r.p_toxic <= 1 for r in got.values())


def test_chain_hands_probabilities_on():
    """A category that is another with its sign turned needs no words of its own."""
    import numpy as np

    r = np.random.default_rng(0)
    y = (r.random(600) < 0.4).astype(float)
    cells = toxicity.Rows([np.array([7 if v else 8], np.int32) for v in y])
    models = toxicity.fit_chain(cells, np.column_stack([y, y]), np.arange(600) % 4, 4)
    assert len(models[0][1]) == 0 and len(models[1][1]) == 1 and models[1][1][0] > 0.5


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "scum"), (3, "..."), (3, "...")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxic_documents(docs, none).count() == 5
    one_class = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert not any(r.toxic for r in toxicity.toxic_documents(docs, one_class).collect())
    assert toxicity.toxic_documents(docs.limit(0), one_class).count() == 0
    assert toxicity.without_toxic(docs, one_class).count() == 5


def test_copies_in_the_sample_count_once():
    import numpy as np

    r = np.random.default_rng(2)
    texts = [np.unique(r.integers(0, 1 << toxicity.BITS, 150)) for _ in range(40)]
    near = [np.delete(t, 3) for t in texts]  # one word exchanged or gone
    empty = np.zeros(0, np.int64)
    kept = toxicity.without_copies(texts + texts + [empty, empty])
    assert kept == [*range(40), 80, 81]  # rows without words are not copies
    again = toxicity.without_copies(texts + near)
    assert again[:40] == list(range(40)) and len(again) <= 42


def test_the_bound_holds_for_repeated_ids(spark, monkeypatch):
    """A doc_id in many rows, equal and different ones; a very long text."""
    seen = []
    fit = toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda rows, *a: seen.append(rows.n) or fit(rows, *a))
    rows = [(1, f"{i} scum " + "word " * (i % 7)) for i in range(300)] + [(1, "same scum")] * 200 + [(i, f"good {i}") for i in range(2, 40)]
    docs = spark.createDataFrame([*rows, (40, "x y " * 500_000)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, int(i == 1)) for i in range(1, 41)], "doc_id long, quality int, toxic int")
    known = labels.selectExpr("doc_id", "1 - quality as low_quality", "toxic")
    toxicity.train(docs, known, toxicity.CHAIN, most_rows=10)
    assert seen == [10] or 0 < seen[0] <= 10
    assert toxicity.toxic_documents(docs, labels).count() == docs.count()
