"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets that fit in memory, by a seeded hash of the
record. Records that are repeated so often that they would crowd a bucket (``CROWD`` of its bytes) are counted first and
scattered by their place in the input instead. Pass two shuffles each bucket (Fisher-Yates, seeded by bucket) and writes it. A record's place in
the whole order is the number of records in earlier buckets, counted from what was written, plus its place
in the bucket. The order is then cut into shards whose row counts differ by one at most.

Only the row counts of buckets (one row for about ``bucket_bytes`` of text) meet in one task. They are
broadcast to the shuffled records as long as there are at most ``MOST_BROADCAST`` (24 bytes each), so
that the texts are shuffled once; beyond that they are joined by shuffle.

Defined results: a null text has size 1 and checksum 0; a null ``doc_id`` is scattered by its text
and its place in the input, so many such rows do not share a bucket; repeated rows are separate
records; an empty table gives an empty result. Extra columns are kept, whatever they are called, but for columns
``shard`` and ``slot``, which are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.llm.common import new_path, stage
from inkveil.sources.store import write_released

MOST_BROADCAST = 1 << 20
#: Share of a bucket's bytes from which repeats of one record are scattered by their places.
CROWD = 0.25
#: Names of helper columns that no table has.
_RECORD, _CROWDED, _BUCKET, _PLACE, _BEFORE, _ROWS = (f"_inkveil_{c}" for c in ("record", "crowded", "bucket", "place", "before", "rows"))


def text_size(text="text"):
    """UTF-8 bytes of the text and one more."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def scatter(docs: DataFrame, buckets: int, bucket_bytes: int, seed: int) -> DataFrame:
    """Pass one: a bucket for every record."""
    hashed = docs.withColumn(_RECORD, F.xxhash64("doc_id", "text"))
    crowds = hashed.groupBy(_RECORD).agg(F.sum(text_size()).alias("bytes")).where(F.col("bytes") > CROWD * bucket_bytes)
    crowds = crowds.select(_RECORD, F.lit(True).alias(_CROWDED))
    # there are fewer than buckets / CROWD of them
    marked = hashed.join(F.broadcast(crowds) if buckets / CROWD <= MOST_BROADCAST else crowds, _RECORD, "left")
    salt = F.when(F.col("doc_id").isNull() | F.col(_CROWDED).isNotNull(), F.monotonically_increasing_id())
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"), F.coalesce(salt, F.lit(-1)))
    return marked.withColumn(_BUCKET, F.pmod(key, F.lit(buckets))).drop(_RECORD, _CROWDED)


def shuffle_buckets(scattered: DataFrame, seed: int) -> DataFrame:
    """Pass two: the records of each bucket in random order, numbered from 0."""
    schema = T.StructType([*scattered.schema.fields, T.StructField(_PLACE, T.LongType())])

    def shuffled(table: pa.Table) -> pa.Table:
        # The order of arrival depends on the cluster; sorted first, it depends on the seed alone.
        table = table.take(pa.compute.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")]))
        order = fisher_yates(len(table), np.random.default_rng([seed, table[_BUCKET][0].as_py()]))
        return table.take(pa.array(order)).append_column(_PLACE, pa.array(np.arange(len(table))))

    return scattered.groupBy(_BUCKET).applyInArrow(shuffled, schema)


def fisher_yates(n: int, random: np.random.Generator) -> np.ndarray:
    """A random order of ``n`` places: each is exchanged with one of those not yet settled."""
    order = np.arange(n)
    for i, j in zip(range(n - 1, 0, -1), random.integers(0, np.arange(n, 1, -1)).tolist()):
        order[i], order[j] = order[j], order[i]
    return order


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 17, bucket_bytes: int = 24 << 20) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... in each shard)."""
    docs = docs.drop("shard", "slot")
    total = docs.agg(F.sum(text_size())).head()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    placed = stage(shuffle_buckets(scatter(docs, buckets, bucket_bytes, seed), seed))
    counts = placed.groupBy(_BUCKET).count()
    earlier = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        _BUCKET,
        F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias(_BEFORE),
        F.sum("count").over(Window.partitionBy()).alias(_ROWS),
    )
    at = F.col(_BEFORE) + F.col(_PLACE)
    return (
        placed.join(F.broadcast(offsets) if buckets <= MOST_BROADCAST else offsets, _BUCKET)
        .withColumn("shard", F.expr(f"int(({_BEFORE} + {_PLACE}) * {shards}L div {_ROWS})"))
        .withColumn("slot", at - F.expr(f"(shard * {_ROWS} + {shards - 1}) div {shards}L"))
        .select(*docs.columns, "shard", "slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; rows carry their slot."""
    write_released(sharded.write.option("compression", "zstd").partitionBy("shard"), sharded.sparkSession, path)


def shard_digest(spark: SparkSession, sharded: DataFrame) -> DataFrame:
    """Write the shards and report, from what was written, where each document lies."""
    path = new_path(spark, "shards")
    write_shards(sharded, path)
    return spark.read.schema(sharded.schema).parquet(path).select(
        "doc_id",
        text_size().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
