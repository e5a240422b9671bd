"""Text blocks: the table every operator works on, and ways to obtain it.

A *block* is a piece of text with its box on a page. A *page row* holds all blocks of one page
as an array in reading order. Adapters for plain text and for records build page rows straight
from the source row, so no shuffle is needed to bring a page together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from inkveil.functions.arrays import let

PAGE_KEYS = ("doc_id", "page_no")

_BOX = [T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")]
BLOCK_STRUCT = T.StructType(
    [T.StructField("block_no", T.LongType()), *_BOX, T.StructField("text", T.StringType())]
)
BLOCK_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page_no", T.LongType()),
        *BLOCK_STRUCT.fields,
    ]
)

# Geometry given to plain text: one line of text per block, 40 lines to a page.
LINES_PER_PAGE = 40
LINE_PITCH = 12
LINE_HEIGHT = 10
CHAR_WIDTH = 6

# Geometry given to records: one row per field, the label on the left, values to its right.
ROW_PITCH = 40
LABEL_RIGHT = 60
VALUE_LEFT = 80
VALUE_GAP = 10


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """A stored block table."""
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def read_table(spark: SparkSession, path: str, spread: int | None = None) -> DataFrame:
    """A stored table; with ``spread``, its rows are dealt out evenly to so many tasks.

    Matching costs far more than moving text, so a table of a few files is worth spreading. One of many
    splits is not.
    """
    df = spark.read.parquet(path)
    return df.repartition(spread) if spread and df.rdd.getNumPartitions() < spread else df


def _block(block_no, x0, y0, x1, y1, text) -> Column:
    return F.struct(
        block_no.cast("long").alias("block_no"),
        x0.cast("double").alias("x0"),
        y0.cast("double").alias("y0"),
        x1.cast("double").alias("x1"),
        y1.cast("double").alias("y1"),
        text.alias("text"),
    )


def pages_from_text(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str | None = None
) -> DataFrame:
    """Page rows of a text table; a document is cut into pages of 40 lines.

    Line ``i`` is block ``i``. Empty lines count but give no block. With ``part`` (a turn of a
    conversation, say) a document has several rows, and the page number holds the part in its
    upper 32 bits.
    """
    lines = F.split(F.col(text), "\n", -1)
    local_page = F.col("page_no").bitwiseAND(F.lit(0xFFFFFFFF)) if part else F.col("page_no")
    first = F.shiftleft(F.col(part).cast("long"), 32) if part else F.lit(0).cast("long")
    numbered = df.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        first.alias("first_page"),
        F.posexplode(in_pages(lines)).alias("pos", "page_lines"),
    ).select("doc_id", (F.col("first_page") + F.col("pos")).alias("page_no"), "page_lines")

    def line(text: Column, row: Column) -> Column:
        return line_block(local_page * LINES_PER_PAGE + row, text, row)

    blocks = F.filter(F.transform("page_lines", line), lambda b: b["text"] != "")
    return numbered.select("doc_id", "page_no", blocks.alias("blocks"))


def line_block(block_no: Column, text: Column, row: Column) -> Column:
    """The block of a line of plain text, in a row of its page."""
    y0 = row * LINE_PITCH
    return _block(block_no, F.lit(0), y0, F.length(text) * CHAR_WIDTH, y0 + LINE_HEIGHT, text)


def in_pages(lines: Column) -> Column:
    """Lines as an array of pages."""
    return let(
        lines,
        lambda ls: F.transform(
            F.sequence(F.lit(1), F.size(ls), F.lit(LINES_PER_PAGE)),
            lambda s: F.slice(ls, s, F.lit(LINES_PER_PAGE)),
        ),
    )


def blocks_from_text(df: DataFrame, **kwargs) -> DataFrame:
    return blocks_of(pages_from_text(df, **kwargs))


def pages_from_records(
    df: DataFrame, doc_id: Column, fields: Sequence[tuple[str, Sequence[Column]]]
) -> DataFrame:
    """One form page per record.

    ``fields`` lists the label and the value columns of each row. A second value stands ten
    units right of the first, near enough to be merged with it.
    """
    blocks: list[Column] = []
    for row, (label, values) in enumerate(fields):
        y0, y1 = F.lit(ROW_PITCH * row), F.lit(ROW_PITCH * row + LINE_HEIGHT)
        blocks.append(_block(F.lit(len(blocks)), F.lit(0), y0, F.lit(LABEL_RIGHT), y1, F.lit(label)))
        left = F.lit(VALUE_LEFT)
        for value in values:
            right = left + F.length(value) * CHAR_WIDTH
            blocks.append(_block(F.lit(len(blocks)), left, y0, right, y1, value))
            left = right + VALUE_GAP
    return df.select(
        doc_id.cast("long").alias("doc_id"),
        F.lit(0).cast("long").alias("page_no"),
        F.filter(F.array(*blocks), lambda b: b["text"].isNotNull()).alias("blocks"),
    )


def blocks_of(pages: DataFrame) -> DataFrame:
    """Block rows of page rows."""
    return pages.select("doc_id", "page_no", F.inline("blocks"))


def split_rejects(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks fit for use, and the others with the reason they are not.

    Nothing is dropped in silence: the two parts together hold every input row.
    """
    missing_box = F.lit(False)
    for c in ("x0", "y0", "x1", "y1"):
        missing_box = missing_box | F.col(c).isNull() | F.isnan(c)
    reason = (
        F.when(
            F.col("doc_id").isNull() | F.col("page_no").isNull() | F.col("block_no").isNull(),
            "missing_key",
        )
        .when(F.col("text").isNull(), "missing_text")
        .when(missing_box, "missing_box")
        .when((F.col("x1") < F.col("x0")) | (F.col("y1") < F.col("y0")), "inverted_box")
    )
    checked = blocks.withColumn("reason", reason)
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def split_text_rejects(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Rows of a text table fit for use, and the others with the reason."""
    reason = F.when(F.col(doc_id).isNull(), "missing_key").when(F.col(text).isNull(), "missing_text")
    bad = F.col(doc_id).isNull() | F.col(text).isNull()
    return df.where(~bad), df.where(bad).withColumn("reason", reason)


def words_from_text(
    df: DataFrame, confidence, doc_id: str = "doc_id", text: str = "text", words_per_page: int = 400
) -> DataFrame:
    """A word table, as text recognition yields it: (doc_id, page_no, word_no, text, conf).

    ``confidence`` is a function from the document id and word number to a confidence.
    """
    words = df.select(
        F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), " ", -1)).alias("word_no", "text")
    )
    return words.select(
        "doc_id",
        F.floor(F.col("word_no") / words_per_page).cast("long").alias("page_no"),
        F.col("word_no").cast("long").alias("word_no"),
        "text",
        confidence(F.col("doc_id"), F.col("word_no")).cast("double").alias("conf"),
    )
