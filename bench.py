"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
cores of local mode, BENCH_QUERIES a comma list that replaces the headline set
(``all`` for every query), BENCH_RUNS the number of timed runs (the best counts).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from mediaops.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "probe_attrs", "rule_program", "rule_program_stored", "program_assign", "plan_alongside", "plan_inplace",
    "settings_resolve", "encoder_pick", "decode_route", "command_manifest", "progress_parse", "job_latest",
    "run_reconcile", "run_detail", "run_documents", "attempts_final", "recent_history", "space_saved", "savings_rollup", "library_run",
]


def session(cpus: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        # The JVM never compiles methods beyond 8000 bytes: rather split a stage than interpret it.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = session(cpus)
    spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("count(*)").collect()

    seconds = {}
    for name in names:
        timed = []
        for _ in range(runs):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timed.append(time.perf_counter() - started)
        seconds[name] = round(min(timed), 3)
    print(json.dumps({
        "metric": "headline_queries_total" if names == HEADLINE else "queries_total",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
