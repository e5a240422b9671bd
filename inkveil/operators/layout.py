"""Layout operators: merging of neighbouring blocks, table cells, text to the left and right.

All of them look at one page at a time. On page rows they are array expressions within a row:
no shuffle and no join. ``block_context`` takes a plain block table, brings pages together with
one shuffle, and sends pages too large for a row through the joins of ``wide_pages``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkveil.functions.geometry import (
    MIN_ALIGNED, aligned, beside_text, left_rect, merged, overlaps, right_rect, same_box,
)
from inkveil.functions.text import clean_text
from inkveil.operators import wide_pages
from inkveil.sources.blocks import BLOCK_STRUCT, PAGE_KEYS
from inkveil.sources.store import stage

MAX_PAGE_BLOCKS = 4096


def assemble_pages(blocks: DataFrame) -> DataFrame:
    """Page rows of a block table, in reading order. For pages known to be of moderate size."""
    block = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in BLOCK_STRUCT.fields])
    return blocks.groupBy(*PAGE_KEYS).agg(F.array_sort(F.collect_list(block)).alias("blocks"))


def beside(blocks: Column) -> Column:
    """The blocks of a page as others see them: boxes, and texts as read beside a block."""
    return F.transform(
        blocks,
        lambda b: F.struct(
            *[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")],
            beside_text(b["text"]).alias("beside"),
        ),
    )


def context_of(m: Column, raw: Column) -> Column:
    """A merged block with its context, from the raw blocks of its page (``beside``).

    Merging the neighbours of a block before joining their texts would change nothing: both
    put a single space between texts.
    """

    def near(rect) -> Column:
        found = F.filter(raw, lambda b: overlaps(rect, b) & (b["beside"] != ""))
        return F.array_join(F.transform(found, lambda b: b["beside"]), " ")

    return F.struct(
        *[m[f.name].alias(f.name) for f in BLOCK_STRUCT.fields],
        # Nothing lies left of the page's edge.
        F.when(m["x0"] > 0, near(left_rect(m))).otherwise("").alias("preceding_text"),
        near(right_rect(m)).alias("following_text"),
        (F.size(F.filter(raw, lambda b: aligned(m, b) & ~same_box(m, b))) >= MIN_ALIGNED).alias("is_table_cell"),
    )


def page_context(pages: DataFrame) -> DataFrame:
    """Merged blocks with context, from page rows."""
    prepared = pages.select(*PAGE_KEYS, merged(F.col("blocks")).alias("merged"), beside(F.col("blocks")).alias("raw"))
    contexts = F.transform("merged", lambda m: context_of(m, F.col("raw")))
    return _cleaned(prepared.select(*PAGE_KEYS, F.inline(contexts)))


def block_context(blocks: DataFrame, max_page_blocks: int = MAX_PAGE_BLOCKS) -> DataFrame:
    """Merged blocks with context, from a block table whose pages may have any size.

    Pages of up to ``max_page_blocks`` blocks become rows. Larger ones are found by a count first,
    which is combined before its shuffle and reads the key columns only; both ways give the same rows.
    """
    large = stage(
        blocks.groupBy(*PAGE_KEYS)
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > max_page_blocks)
        .select(*PAGE_KEYS)
    )
    if large.isEmpty():
        return page_context(assemble_pages(blocks))
    usual = assemble_pages(blocks.join(large, list(PAGE_KEYS), "left_anti"))
    wide = wide_pages.context(blocks.join(large, list(PAGE_KEYS), "left_semi"))
    return page_context(usual).unionByName(_cleaned(wide))


def merge_blocks(pages: DataFrame) -> DataFrame:
    """Merged blocks of page rows."""
    return pages.select(*PAGE_KEYS, F.inline(merged(F.col("blocks"))))


def _cleaned(context: DataFrame) -> DataFrame:
    """The block's text in the form that is searched; the text as it was stays as ``raw_text``."""
    return context.select(
        "doc_id", "page_no", "block_no", "x0", "y0", "x1", "y1",
        F.col("text").alias("raw_text"),
        clean_text(F.col("text")).alias("text"),
        "preceding_text", "following_text", "is_table_cell",
    )
