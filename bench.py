"""Time the headline queries at BENCH_SF_DIR on local[BENCH_CPUS].

Prints one JSON line. Each query's result is written to the no-op sink, so
every column of every row is computed and nothing is collected. One run per
query, so code generation and JIT compilation are in the times.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "A9_snapshot_store",          # load and store snapshots
    "C_all_rules",                # feed checks
    "D1_loan_grain",
    "D4_portfolio_features",
    "E4_split_rows",
    "F7_preprocess_pipeline",     # fit on train, transform all
    "H3_stratified_calibration",  # fit on all rows, transform all
    "J3_full_scoring",            # ranked queue
    "K2_ranking_at_k",
    "K7_exposure_deciles",
    "L2_L5_class_metrics",
    "L7_full_evaluation",         # all blocks, slices and categories
    "L8_bootstrap_intervals",
    "M4_outcomes",                # range join
    "M10_matured_metrics",
    "M18_drift",
    "N4_N5_numeric_separation",
    "O3_information_values",
    "P4_skim",
    "Q6_clip_verdicts",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from loanwatch.plans import load_queries
    from loanwatch.session import configure

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (configure(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("count(*)").collect()   # JVM warm-up
    queries, times = load_queries(), {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name:32s} {times[name]:8.2f}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
