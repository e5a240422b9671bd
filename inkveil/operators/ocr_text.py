"""Text recognised on images, from a table of words with confidences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: words must be recognised with more than this confidence.
MIN_WORD_CONFIDENCE = 60


# A page's words are joined in runs of this many, and the runs are joined then.
RUN_BITS = 12

# No text of Spark's is longer.
MOST_CHARS = (1 << 31) - 1


def ocr_page_text(words: DataFrame, min_confidence: float = MIN_WORD_CONFIDENCE) -> DataFrame:
    """Text and mean confidence of each page; empty and zero for a page with no word kept.

    A page with very many words is spread over tasks by runs of words, so that only its text,
    not its words, comes together in one place.
    """
    kept = (F.col("conf") > min_confidence) & (F.trim("text") != "")
    # A word goes with its number within the run as three digits before it, half the size of a struct of both in the shuffle.
    number = F.lpad(F.hex(F.coalesce("word_no", F.lit(0)).bitwiseAND(F.lit((1 << RUN_BITS) - 1))), 3, "0")
    word = F.when(kept, F.concat(number, F.trim("text")))
    runs = words.groupBy("doc_id", "page_no", F.shiftright("word_no", RUN_BITS).alias("run")).agg(
        _in_order(word, lambda w: F.substring(w, 4, MOST_CHARS)).alias("text"),
        F.sum(F.when(kept, F.col("conf"))).alias("total"),
        F.count_if(kept).alias("n"),
    )
    piece = F.when(F.col("n") > 0, F.struct("run", "text"))
    return runs.groupBy("doc_id", "page_no").agg(
        _in_order(piece, lambda p: p["text"]).alias("page_text"),
        F.coalesce(F.try_divide(F.sum("total"), F.sum("n")), F.lit(0.0)).alias("mean_conf"),
    )


def _in_order(numbered: Column, text: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(numbered)), text), " ")
