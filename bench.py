"""Times the headline queries: one JSON line on standard output.

Every query is written whole to the no-op sink, so nothing is saved by projecting or counting.
The session is warmed up with one small query first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pii_counts",
    "redact_blocks",
    "detect_pii",
    "redact_spans_text",
    "dedupe_spans",
    "table_cells",
    "pattern_distribution",
    "batch_summary",
    "top_pii_docs",
    "replacement_index",
    "consistent_pseudonyms",
    "ocr_page_text",
    "block_context",
    "wide_page_context",
    "detection_quality",
    "redact_documents_in_place",
    "redact_document_spans_in_place",
    "pseudonymized_text",
    "hit_quantiles",
    "many_rules",
    "merge_long_runs",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from inkveil.plans.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("rejects")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
