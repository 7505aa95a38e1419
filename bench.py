"""Time headline queries on the test tables and print one JSON line.

Each query is run to completion into Spark's ``noop`` sink after one short
warm-up. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "album_overview", "album_status", "album_work_left", "shots_in_order", "upload_outcomes_by_id", "idle_islands", "integrity_report", "album_run_decisions",
    "coverage_counts", "low_percentiles", "leave_one_out_reference", "fused_page", "mask_closed", "connected_components", "shot_pair_shares", "replay_summary",
]


def main() -> None:
    from pagequarry.mappings import Tables
    from pagequarry.registry import load
    from pagequarry.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="pagequarry-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, tables = load(), Tables(spark, sf_dir)
    for name in ("region", "orders"):
        tables.raw(name).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name].run(tables).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
