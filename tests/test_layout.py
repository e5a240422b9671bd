import random

import pytest
from pyspark.sql import functions as F

from inkveil.operators import layout, wide_pages
from inkveil.sources import blocks as B
import models

COLUMNS = ["block_no", "raw_text", "text", "preceding_text", "following_text", "is_table_cell"]


def table(spark, pages):
    """``pages``: {(doc, page): [(no, x0, y0, x1, y1, text)]}"""
    rows = [(d, p, *b) for (d, p), bs in pages.items() for b in bs]
    return spark.createDataFrame(rows, B.BLOCK_SCHEMA)


def b(no, x0, y0, x1, y1, text="t"):
    return (no, float(x0), float(y0), float(x1), float(y1), text)


MERGE_CASES = {
    "dy 4.9": [b(0, 0, 0, 10, 9), b(1, 20, 4.9, 30, 9)],
    "dy 5": [b(0, 0, 0, 10, 9), b(1, 20, 5, 30, 9)],
    "dx 14.9": [b(0, 0, 0, 10, 9), b(1, 24.9, 0, 30, 9)],
    "dx 15": [b(0, 0, 0, 10, 9), b(1, 25, 0, 30, 9)],
    "three": [b(0, 0, 0, 10, 9, "a"), b(1, 12, 1, 20, 9, "b"), b(2, 22, 2, 30, 9, "c")],
    "line of the first": [b(0, 0, 0, 10, 9), b(1, 12, 4, 20, 9), b(2, 22, 8, 30, 9)],
    "one": [b(0, 0, 0, 10, 9)],
}


def test_merge_cases(spark):
    pages = {(i, 0): bs for i, bs in enumerate(MERGE_CASES.values())}
    got = layout.merge_blocks(layout.assemble_pages(table(spark, pages))).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(tuple(r)[2:])
    for (doc, _), bs in pages.items():
        assert sorted(by_doc[doc]) == models.merge(bs)


TABLE_CASES = [
    ([b(0, 0, 0, 9, 9), b(1, 99, 9.9, 109, 19), b(2, 9.9, 99, 20, 109)], {0}),
    ([b(0, 0, 0, 9, 9), b(1, 99, 10, 109, 19), b(2, 9.9, 99, 20, 109)], set()),
    ([b(0, 0, 0, 9, 9), b(1, 0, 0, 9, 9), b(2, 0, 0, 9, 9)], set()),
    ([b(0, 0, 0, 50, 9), b(1, 0, 0, 48, 9), b(2, 0, 0, 48, 9)], {0}),
    ([b(0, 0, 0, 50, 9), b(1, 0, 40, 50, 49), b(2, 0, 80, 50, 89)], {0, 1, 2}),
]


@pytest.mark.parametrize("wide", [False, True])
def test_table_cells(spark, wide):
    pages = {(i, 0): bs for i, (bs, _) in enumerate(TABLE_CASES)}
    got = layout.block_context(table(spark, pages), 0 if wide else 100).collect()
    cells = {(r.doc_id, r.block_no) for r in got if r.is_table_cell}
    assert cells == {(i, n) for i, (_, ns) in enumerate(TABLE_CASES) for n in ns}


def random_pages(seed, count, size):
    rnd = random.Random(seed)
    pages = {}
    for d in range(count):
        bs, x, y = [], 0.0, 0.0
        for n in range(rnd.randrange(1, size)):
            if rnd.random() < 0.3:
                x, y = rnd.choice([0.0, 3.0, 80.0, 200.0]), y + rnd.choice([0, 4, 6, 9.5, 12, 40, -30])
            else:
                x, y = x + rnd.choice([5, 14, 15, 40, 160, -9]), y + rnd.choice([0, 0, 1, 4.5, -4.5])
            w, h = rnd.choice([8, 20, 60, 300]), rnd.choice([0, 8, 10, 30, 200, 1000])
            text = rnd.choice(["Name:", "tel", "a\nb", " ", "​", "O|x y", "Main  Street"])
            bs.append(b(n * rnd.choice([1, 1]) , x, y, x + w, y + h, text))
            x += w
        pages[(d, d % 3)] = bs
    return pages


@pytest.mark.parametrize("max_page_blocks", [4096, 12, 0])
def test_context_equals_model(spark, max_page_blocks):
    pages = random_pages(4, 40, 40)
    got = {}
    for r in layout.block_context(table(spark, pages), max_page_blocks).collect():
        got.setdefault((r.doc_id, r.page_no), []).append(tuple(r[c] for c in COLUMNS))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(models.context(v)) for k, v in pages.items()}


def test_wide_page_over_several_chunks(spark):
    rnd = random.Random(5)
    bs = []
    for line in range(1800):
        x = 0.0
        for _ in range(rnd.randrange(1, 6)):
            bs.append(b(len(bs), x, 20.0 * line + rnd.choice([0, 3]), x + 30, 20.0 * line + 10, f"w{len(bs)}"))
            x += 30 + rnd.choice([5, 30])
    pages = {(1, 1): bs}
    wide = layout.block_context(table(spark, pages)).select(*COLUMNS)
    rows = layout.page_context(layout.assemble_pages(table(spark, pages))).select(*COLUMNS)
    assert len(bs) > layout.MAX_PAGE_BLOCKS and wide.count() == rows.count()
    assert wide.exceptAll(rows).count() == 0


def same_in_both_forms(spark, pages):
    wide = layout.block_context(table(spark, pages), 0).select("doc_id", "page_no", *COLUMNS)
    rows = layout.page_context(layout.assemble_pages(table(spark, pages))).select("doc_id", "page_no", *COLUMNS)
    got, want = (sorted(map(tuple, df.collect())) for df in (wide, rows))
    assert got == want
    return got


def test_blocks_that_share_a_key(spark):
    """Twins far apart have their own neighbours; blocks equal in all are blocks of their own."""
    twins = [b(0, 0, 0, 60, 10, "aaa"), b(1, 200, 0, 260, 10, "bbb"), b(1, 500, 0, 560, 10, "ddd"), b(2, 620, 0, 640, 10, "ccc"), b(2, 620, 0, 640, 10, "ccc")]
    got = same_in_both_forms(spark, {(0, 0): twins, **{(i + 1, 0): [(x[0] // 4, *x[1:]) for x in bs] for i, bs in enumerate(random_pages(9, 25, 40).values())}})
    texts = {(r[4], r[5], r[6]) for r in got if r[0] == 0}
    assert texts == {("aaa", "", "bbb"), ("bbb", "aaa", ""), ("ddd", "", "ccc ccc"), ("ccc", "ddd", "")}


def run_of_fragments(n, seed, step):
    """Each fragment begins near the end of the one before; the line wanders."""
    rnd, y, bs = random.Random(seed), 0.0, []
    for i in range(n):
        y += rnd.choice([-step, 0, step, step / 3])
        bs.append(b(i, 10 * i, y, 10 * i + 8, y + 8, f"f{i}"))
    return bs


def test_merging_by_levels(spark, monkeypatch):
    monkeypatch.setattr(wide_pages, "CHUNK_BITS", 2)
    monkeypatch.setattr(wide_pages, "ROW_BITS", 5)
    pages = {(i, 0): run_of_fragments(300, i, step) for i, step in enumerate([0.0, 0.7, 1.9, 2.5, 4.9, 5.1])}
    pages |= {(100 + k[0], 1): bs for k, bs in random_pages(8, 20, 60).items()}
    merged = wide_pages.merge_blocks(wide_pages.in_reading_order(table(spark, pages)))
    got = {}
    for r in merged.drop("seq").collect():
        got.setdefault((r.doc_id, r.page_no), []).append(tuple(r)[2:])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(models.merge(bs)) for k, bs in pages.items()}


def test_endless_run(spark):
    bs = run_of_fragments(60_000, 3, 1.3)
    merged = wide_pages.merge_blocks(wide_pages.in_reading_order(table(spark, {(0, 0): bs})))
    assert sorted(tuple(r)[2:] for r in merged.drop("seq").collect()) == sorted(models.merge(bs))


def test_one_band_and_one_crowded_spot(spark, monkeypatch):
    """A band of many blocks is cut along x; a spot with many boxes is dealt into parts."""
    monkeypatch.setattr(wide_pages, "MOST_IN_CELL", 16)
    band = [b(i, 40.0 * i, 0, 40.0 * i + 20, 10, f"w{i}") for i in range(400)]
    spot = [b(i, 5.0 * (i % 3), 3.0 * (i % 5), 30.0 + i, 30 + i % 7, f"s{i}") for i in range(150)]
    tall = [b(i, 300.0 * (i % 9), 50.0 * i, 300.0 * (i % 9) + 2000, 50.0 * i + 900, f"t{i}") for i in range(60)]
    same_in_both_forms(spark, {(0, 0): band, (1, 0): spot, (2, 0): tall, (3, 0): band[:3] + spot[:30] + tall[:9]})


def test_no_cell_of_a_long_band_is_large(spark):
    n = 100_000
    band = spark.range(n).selectExpr("0L doc_id", "0L page_no", "id block_no", "id * 40.0D x0", "0D y0", "id * 40.0D + 20 x1", "10D y1", "concat('w', id) text")
    box = F.struct(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    items = band.select("doc_id", "page_no", box.alias("box"), *[wide_pages._grid(a).alias(f"grid_{a}") for a in wide_pages.CELL])
    used = items.groupBy("doc_id", "page_no").agg(*[F.collect_set(f"grid_{a}").alias(f"grids_{a}") for a in wide_pages.CELL])
    cells = wide_pages._on_grids(items, used, F.col("box")).groupBy("level_x", "cell_x", "level_y", "cell_y").count()
    assert cells.agg(F.max("count")).first()[0] < 20


def test_neighbours_at_the_edges(spark):
    page = [b(0, 200, 0, 260, 10, "mid"), b(1, 0, 0, 51, 10, "left"), b(2, 0, 0, 50, 10, "far"),
            b(3, 409, 0, 420, 10, "right"), b(4, 410, 0, 430, 10, "out"), b(5, 210, 20, 250, 30, "below")]
    for limit in (100, 0):
        got = {r.block_no: r for r in layout.block_context(table(spark, {(0, 0): page}), limit).collect()}
        assert (got[0].preceding_text, got[0].following_text) == ("left", "right")
        assert got[1].preceding_text == ""


def test_blocks_from_text(spark):
    df = spark.createDataFrame([(7, "a\n\nbcd" + "\nx" * 40), (8, ""), (9, None)], "doc_id long, text string")
    got = [tuple(r) for r in B.blocks_from_text(df).orderBy("doc_id", "block_no").collect()]
    assert got[:2] == [(7, 0, 0, 0.0, 0.0, 6.0, 10.0, "a"), (7, 0, 2, 0.0, 24.0, 18.0, 34.0, "bcd")]
    assert got[-1] == (7, 1, 42, 0.0, 24.0, 6.0, 34.0, "x") and len(got) == 42


def test_turns_begin_new_pages(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 2, "b" + "\nc" * 40)], "c long, t long, text string")
    got = {(r.page_no, r.block_no): r.text for r in B.blocks_from_text(df, doc_id="c", part="t").collect()}
    assert got[(0, 0)] == "a" and got[(2 << 32, 0)] == "b" and got[((2 << 32) + 1, 40)] == "c"


def test_rejects_keep_every_row(spark):
    nan = float("nan")
    rows = [(1, 0, 0, 0.0, 0.0, 1.0, 1.0, "ok"), (None, 0, 0, 0.0, 0.0, 1.0, 1.0, "t"), (1, 0, 1, 0.0, 0.0, 1.0, 1.0, None),
            (1, 0, 2, None, 0.0, 1.0, 1.0, "t"), (1, 0, 3, nan, 0.0, 1.0, 1.0, "t"), (1, 0, 4, 2.0, 0.0, 1.0, 1.0, "t")]
    good, bad = B.split_rejects(spark.createDataFrame(rows, B.BLOCK_SCHEMA))
    assert good.count() == 1
    assert sorted(r.reason for r in bad.collect()) == ["inverted_box", "missing_box", "missing_box", "missing_key", "missing_text"]
