"""Headline benchmark: one JSON line with seconds per query.

Staging of the evidence tables (the ingest stand-in) is timed on its own, as
``stage_*``; the other queries then read those tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

STAGES = ("sessions", "session_events", "findings", "hits", "index_entries")
HEADLINE = (
    "evaluate_all_rules", "posture_snapshot", "posture_priorities", "report_tls_summary", "session_features", "stream_coverage",
    "event_numbering", "observation_build", "finding_lifecycle", "verify_rule", "graph_nodes", "correlate_case",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from postern.plans.registry import QUERIES
    from postern.plans.workspace import Workspace
    from postern.session import apply_conf

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("postern-bench").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    apply_conf(spark)
    seconds: dict[str, float] = {}
    workspace = Workspace(spark, sf_dir)
    for stage in STAGES:
        started = time.perf_counter()
        getattr(workspace, stage)
        seconds[f"stage_{stage}"] = round(time.perf_counter() - started, 3)
        print(stage, seconds[f"stage_{stage}"], file=sys.stderr, flush=True)
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
