"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local cores.  Each query runs to a sink that
takes every row and keeps none; the time is the better of two runs after the session has started.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork import mask
from cloakwork.plans.queries import QUERIES
from cloakwork.session import local_session, scratch_dir

HEADLINE = (
    "findings_by_category",
    "masked_documents",
    "detection_per_document",
    "masked_wrapped_documents",
    "token_roundtrip",
    "inline_roundtrip",
    "report_summary",
    "confusion_matrix",
    "planted_openai",
    "overlap_resolved",
    "many_custom_rules",
    "csv_report_rows",
    "page_findings",
    "stream_masked_messages",
)

RUNS = 2


def large_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of 20,000 short lines and a key."""
    global _large
    if _large is None:
        _large = scratch_dir(spark, "large-document")
        text = "const x = 1;\n" * 20000 + "OPENAI_API_KEY=sk-live-a8f9d7e6b5c4d3e2f1a0"
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(_large)
    return mask(spark.read.text(_large, wholetext=True).withColumnRenamed("value", "text"))


_large: str | None = None


def timed(spark: SparkSession, query, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: QUERIES[name] for name in HEADLINE} | {"large_document": large_document}
    seconds = {
        name: round(min(timed(spark, query, sf_dir) for _ in range(RUNS)), 3) for name, query in queries.items()
    }
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
