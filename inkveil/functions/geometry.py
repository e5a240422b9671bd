"""Geometry of blocks on a page, as expressions on block structs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from inkveil.functions.text import clean_text, normalize_ws
from inkveil.sources.blocks import BLOCK_STRUCT

# Distances, in page units, that decide what is near or aligned.
SAME_LINE = 5.0
MERGE_GAP = 15.0
ALIGN_TOLERANCE = 10.0
MIN_ALIGNED = 2
SEARCH_WIDTH = 150.0
SEARCH_MARGIN = 10.0


def merged(raw: Column) -> Column:
    """Fold nearby blocks into one.

    A block joins the current one if it is on the current one's line and starts near its right
    edge; then only the right edge and the text grow. The line is that of the first block, so
    this is not a comparison of neighbours but a fold.
    """

    def step(state: Column, b: Column) -> Column:
        cur = state["cur"]
        joins = (F.abs(b["y0"] - cur["y0"]) < SAME_LINE) & (F.abs(b["x0"] - cur["x1"]) < MERGE_GAP)
        grown = F.struct(
            cur["block_no"].alias("block_no"),
            cur["x0"].alias("x0"),
            cur["y0"].alias("y0"),
            b["x1"].alias("x1"),
            cur["y1"].alias("y1"),
            F.concat(cur["text"], F.lit(" "), b["text"]).alias("text"),
        )
        return (
            F.when(joins, F.struct(state["done"].alias("done"), grown.alias("cur")))
            .when(cur.isNull(), F.struct(state["done"].alias("done"), b.alias("cur")))
            .otherwise(
                F.struct(F.concat(state["done"], F.array(cur)).alias("done"), b.alias("cur"))
            )
        )

    start = F.struct(
        F.array().cast(f"array<{BLOCK_STRUCT.simpleString()}>").alias("done"),
        F.lit(None).cast(BLOCK_STRUCT).alias("cur"),
    )
    folded = F.aggregate(raw, start, step, lambda s: F.concat(s["done"], F.array(s["cur"])))
    return F.when(_may_merge(raw), folded).otherwise(raw)


def _may_merge(raw: Column) -> Column:
    """Is there any pair of successive blocks that could merge? If not the fold is needless."""
    pairs = F.zip_with(
        raw,
        F.slice(raw, F.lit(2), F.size(raw)),
        lambda a, b: may_follow(a, b),
    )
    return F.exists(pairs, lambda p: p)


def may_follow(a: Column, b: Column) -> Column:
    """Could ``b``, next after ``a``, join the block that ``a`` ends in, whatever came before?

    The current right edge is always that of the block before. Two blocks on the line of the
    first lie within twice SAME_LINE of each other; the unit more leaves room for rounding.
    """
    return (F.abs(b["y0"] - a["y0"]) < 2 * SAME_LINE + 1) & (F.abs(b["x0"] - a["x1"]) < MERGE_GAP)


def same_box(a: Column, b: Column) -> Column:
    return (
        (a["x0"] == b["x0"]) & (a["y0"] == b["y0"]) & (a["x1"] == b["x1"]) & (a["y1"] == b["y1"])
    )


def aligned(a: Column, b: Column) -> Column:
    return (F.abs(b["y0"] - a["y0"]) < ALIGN_TOLERANCE) | (F.abs(b["x0"] - a["x0"]) < ALIGN_TOLERANCE)


def left_rect(b) -> tuple[Column, Column, Column, Column]:
    return (
        F.greatest(F.lit(0.0), b["x0"] - SEARCH_WIDTH),
        b["y0"] - SEARCH_MARGIN,
        b["x0"],
        b["y1"] + SEARCH_MARGIN,
    )


def right_rect(b) -> tuple[Column, Column, Column, Column]:
    return b["x1"], b["y0"] - SEARCH_MARGIN, b["x1"] + SEARCH_WIDTH, b["y1"] + SEARCH_MARGIN


def overlaps(rect, b) -> Column:
    """A block belongs to a rectangle, as a whole, if they overlap; a rectangle without width,
    as at the page's left edge, holds none."""
    rx0, ry0, rx1, ry1 = rect
    return (rx0 < rx1) & (b["x0"] < rx1) & (b["x1"] > rx0) & (b["y0"] < ry1) & (b["y1"] > ry0)


def beside_text(text: Column) -> Column:
    """A block's text as its neighbours see it.

    White space is normalised before the text is cleaned, unlike in the block's own text: line
    feeds separate words here and vanish there. Doing this block by block, once, gives the same
    as doing it for every joined text.
    """
    return clean_text(normalize_ws(text))
