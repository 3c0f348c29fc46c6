"""Times headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list, or
"all"). Every query runs once cold over the whole tables; results are written to the noop sink, so
all columns are worked out and nothing is gathered on the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from ledgerlake.plans import catalog  # noqa: E402

HEADLINE = [
    "ledger_facts", "protected_sum", "protected_avg", "calculate_scopes", "achievement",
    "historical_trend", "reconciliation", "exclusion_ledger", "answer_conflicts", "contradictions",
    "validation_issues", "upsert_facts", "apply_decisions", "document_rollup", "kpi_row",
    "multi_year_trend", "target_vs_actual", "entity_rollup", "norm_metric", "norm_period",
    "resolve_entities", "tag_intent", "facts_from_wide", "facts_from_long", "facts_from_text",
    "chunk_documents", "rank_chunks", "topic_mentions", "graph_edges", "verify_claims",
    "related_facts", "report_gate", "session_context", "attempt_alerts", "duplicate_documents",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = (list(catalog.QUERIES) if wanted == "all"
             else wanted.split(",") if wanted else HEADLINE)
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("ledgerlake-bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.sql.session.timeZone", "UTC")
             # test data is small: without this, adaptive execution packs CPU-heavy steps into one task
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # session start is not part of a query
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
