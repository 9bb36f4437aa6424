"""Time the registered queries and print one JSON line.

BENCH_SF_DIR: folder of tables; BENCH_CPUS: cores; BENCH_RUNS: timed runs per
query (3; the median counts); BENCH_QUERIES: comma-separated names. One query
runs beforehand to warm the session up; with several runs, each query's first
is its own warm-up and not counted. Rows out are counted beside the seconds.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gradeweave.registry.queries import QUERIES  # noqa: E402
from gradeweave.session import local_session  # noqa: E402

HEADLINE = [
    "numeric_scores", "student_score_averages", "cohort_average", "report_cells", "flipped_names",
    "multiple_standings", "maximal_name_sets", "name_clusters", "validation_messages", "full_report",
]


def timed(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def rows_in(spark, sf_dir: str) -> dict[str, int]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("orders", "customer", "lineitem")}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    timed(spark, sf_dir, names[0])
    seconds, rows_out = {}, {}
    for name in names:
        if runs > 1:
            rows_out[name] = QUERIES[name](spark, sf_dir).count()
        seconds[name] = round(statistics.median(timed(spark, sf_dir, name) for _ in range(runs)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus, "runs": runs,
        "rows_in": rows_in(spark, sf_dir), "rows_out": rows_out,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
