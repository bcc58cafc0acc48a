"""Time the headline queries and print one JSON line.

Each query is built and run once as a warm-up, then ``BENCH_RUNS`` times; the median counts. Results
go to a no-op sink, so every row and column is computed but nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from judgespark.plans.catalog import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))

HEADLINE = [
    "j2_scored_items",
    "j3_join_accounting",
    "m0_crosstab",
    "a2_agreement_overall",
    "l6_all_dimensions",
    "r2_reviewer_report",
    "r4_reviewer_pairs",
    "g1_gate_status",
    "d6_pillar_diagnostics",
    "v10_disagreement_table",
    "i1_normalized_rows",
    "i12_failure_rollup",
    "i18_dataset_fingerprint",
    "t3_cache_keys",
    "t11_assembled_outcomes",
    "t13_run_summary",
    "k6_kb_match",
    "k4_candidate_signals_large_kb",
    "w2_live_agreement",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("judgespark-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        # The JIT leaves larger methods interpreted; beyond this size Spark splits the code instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SCRATCH", "/tmp/judgespark-bench"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:]
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")),
            }
        )
    )


if __name__ == "__main__":
    main()
