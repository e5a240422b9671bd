"""What several operators share: staged tables, word splitting, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.sources.store import dealt, discard, shared_folder, write_released  # noqa: F401

#: Bytes that separate words: space and the five controls from tab to carriage return.
SPACES = b" \t\n\x0b\x0c\r"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a table that is read again; shuffle files of the step go with it.

    The table lies in the shared folder, so losing an executor costs no earlier step.
    """
    spark = df.sparkSession
    path = new_path(spark, "stage")
    write_released(df.write.option("compression", "zstd").partitionBy(*partition_by), spark, path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def map_batches(df: DataFrame, schema: str, run: Callable[[pa.RecordBatch], dict | None]) -> DataFrame:
    """Apply ``run`` to each Arrow batch; it returns columns by name, in the order of ``schema``."""
    return df.mapInArrow(lambda batches: each_batch(batches, run), schema)


def each_batch(batches: Iterator[pa.RecordBatch], run) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = run(batch)
        if columns:
            yield pa.RecordBatch.from_pydict(columns)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(column: pa.Array, most: int = 256) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch in short runs, with the number of the first, to bound memory."""
    for first in range(0, len(column), most):
        yield first, texts_of(column.slice(first, most))


def row_ids(df: DataFrame, name: str) -> DataFrame:
    """Give each row a number of its own, fixed by staging the table."""
    return stage(df.withColumn(name, F.monotonically_increasing_id()))
