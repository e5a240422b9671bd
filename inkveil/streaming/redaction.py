"""Redaction of a stream of documents.

A text is redacted in its own row, so the batch expression takes a stream as it is: no state, no watermark,
append mode, each row may come late, and every row and column comes out again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from inkveil.operators.in_place import redact_in_place
from inkveil.operators.redact import MIN_CONFIDENCE
from inkveil.rules import DEFAULT_RULES, RuleSet
from inkveil.sources.blocks import split_text_rejects


def redact_stream(
    documents: DataFrame,
    rules: RuleSet = DEFAULT_RULES,
    min_confidence: float = MIN_CONFIDENCE,
    spans: bool = False,
) -> DataFrame:
    """Every row of the stream, its text redacted; a null text stays null."""
    return redact_in_place(documents, rules, min_confidence, spans=spans)


def write_stream(redacted: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a redacted stream to files, exactly once, up to what is there now."""
    return (
        redacted.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def write_apart(
    documents: DataFrame,
    path: str,
    rejects_path: str,
    checkpoint: str,
    rules: RuleSet = DEFAULT_RULES,
    min_confidence: float = MIN_CONFIDENCE,
    spans: bool = False,
) -> StreamingQuery:
    """Write usable rows, redacted, to ``path`` and the others, with the reason, to ``rejects_path``.

    Each micro-batch fills a folder of its own number in both. A batch that is run again, after a failure between the two
    or before the checkpoint took note of it, replaces its own folders, so each row is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        usable, rejects = split_text_rejects(batch)
        for rows, to in ((rejects, rejects_path), (redact_in_place(usable, rules, min_confidence, spans=spans), path)):
            rows.write.mode("overwrite").parquet(f"{to}/batch={number}")

    return (
        documents.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
