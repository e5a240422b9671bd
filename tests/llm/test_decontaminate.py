import random
import re

from inkveil.llm import decontaminate as d


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def counts(own, k):
    out = {}
    for i in range(len(own) - k + 1):
        out[tuple(own[i : i + k])] = out.get(tuple(own[i : i + k]), 0) + 1
    return out


def brute(docs, items, least=0.8):
    found = {}
    for doc, text in docs:
        own = words(text)
        for item, target in items:
            want = words(target)
            if not want:
                continue
            k = min(5, len(want))
            b = counts(want, k)
            for s in range(1 - len(want), len(own)):
                a = counts(own[max(0, s) : max(0, s + len(want))], k)
                value = sum(min(a.get(x, 0), b.get(x, 0)) for x in a | b) / max(1, sum(max(a.get(x, 0), b.get(x, 0)) for x in a | b))
                if value >= least:
                    found[doc, item] = max(value, found.get((doc, item), 0))
    return found


def corpus():
    r = random.Random(8)
    text = lambda n: " ".join(r.choice("abcdefgh") + r.choice(["", "é", "x", "yy"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((1, 3, 5, 9, 14, 14, 30, 30, 60))] + [(20, None), (21, " .,"), (22, "la " * 12)]
    rows = []
    for i in range(60):
        own = text(r.randrange(50)).split()
        item = r.choice(items[3:9])[1].split()
        cut = r.randrange(4)
        own[r.randrange(len(own) + 1) : 0] = item[cut : len(item) - r.randrange(4)]
        if i % 3 == 0:
            own[r.randrange(len(own)) :] = []
        rows.append((i, " ".join(own)))
    rows += [(100, None), (101, ""), (102, items[6][1].upper().replace(" ", ", ")), (103, "la " * 40), (104, items[8][1] + " " + items[5][1]), (105, items[7][1] * 2), (106, "la " * 11)]
    return rows, items


def test_same_as_brute_force_in_blocks_of_items(spark):
    rows, items = corpus()
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(x.doc_id, x.item_id, round(x.similarity, 9)) for x in d.leaks(docs, bench, items_at_once=5).collect()]
    want = sorted((*k, round(v, 9)) for k, v in brute(rows, items).items())
    assert sorted(got) == want and len(want) > 40
    clean = {x.doc_id for x in d.without_leaks(docs, bench, items_at_once=5).collect()}
    assert clean == {x for x, _ in rows} - {k[0] for k in want}


def test_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "One two three; four five SIX!"), (8, "one two three four five six")], "item_id int, text string")
    assert sorted(((x.doc_id or 0), x.item_id) for x in d.leaks(docs, bench).collect()) == [(0, 7), (0, 8), (1, 7), (1, 7), (1, 8), (1, 8)]
    assert d.leaks(docs.limit(0), bench).count() == 0
    assert d.leaks(docs, bench.limit(0)).count() == 0
    assert d.without_leaks(docs, bench.limit(0)).count() == 3


def test_repeated_and_missing_item_ids_over_block_edges(spark):
    texts = [f"item {i} alpha{i} beta{i} gamma{i} delta{i} epsilon{i}" for i in range(7)]
    ids = [1, 1, 1, 1, None, None, 2]
    bench = spark.createDataFrame(list(zip(ids, texts)), "item_id long, text string").repartition(3)
    docs = spark.createDataFrame([(i, f"x{i} {t} y") for i, t in enumerate(texts)] + [(99, "nothing here of any of it")], "doc_id long, text string")
    for at_once in (1, 2, 3, 7, 100):
        got = sorted((x.doc_id, x.item_id or 0) for x in d.leaks(docs, bench, items_at_once=at_once).collect())
        assert got == [(i, own or 0) for i, own in enumerate(ids)]
        assert [x.doc_id for x in d.without_leaks(docs, bench, items_at_once=at_once).collect()] == [99]


def test_very_long_text(spark):
    item = "one two three four five six seven"
    docs = spark.createDataFrame([(1, "word " * 300_000 + item), (2, "word " * 300_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(x.doc_id, x.first_word) for x in d.leaks(docs, bench).collect()] == [(1, 300_000)]
