"""Stored tables: intermediate ones that cut a lineage, and redacted output."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of a finished query when this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session may do without the setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="inkveil-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Write a table that is read several times, and go on from what was written.

    It survives the loss of executors, and each reader takes only the columns it needs. The shuffle files of the step
    go with it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    write_released(df.write.option("compression", "zstd"), spark, path)
    staged = spark.read.parquet(path)
    staged.staged_at = path
    return staged


def write_released(writer, spark: SparkSession, path: str) -> None:
    """Write, and let Spark remove the shuffle files of this query afterwards."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def discard(*staged: DataFrame) -> None:
    """Remove staged tables that no later step reads."""
    for df in staged:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast: Spark sizes staged tables by their compressed files, and what a function or an
    explode makes of a row by that row, so it may take a large table for a small one."""
    return df.hint("merge")


def anonymized_path(path: str) -> str:
    """Name of the redacted copy: the stem, ``-anonymized``, the extension."""
    folder, slash, name = path.rstrip("/").rpartition("/")
    stem, dot, extension = name.rpartition(".")
    if not stem:
        stem, dot, extension = name, "", ""
    return f"{folder}{slash}{stem}-anonymized{dot}{extension}"


def write_redacted(redacted: DataFrame, input_path: str, output_path: str | None = None) -> str:
    """Write a new table beside the input; an existing one is never overwritten."""
    target = output_path or anonymized_path(input_path)
    redacted.write.mode("errorifexists").parquet(target)
    return target
