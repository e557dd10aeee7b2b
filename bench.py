"""Time the headline reports and print one line of JSON.

Reads ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.  The cube of the additive reports is made first, in a line of
its own; the other reports join the tables that hold their columns.  Each query then runs once to warm up and ``$BENCH_RUNS`` times, of which the median counts; every run
computes all that is derived from the facts anew and writes all rows to the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from tillwise.plans import workspace
from tillwise.plans.catalogue import QUERIES
from tillwise.session import session

HEADLINE = [
    "r01_executive_kpis",
    "r03_monthly_revenue",
    "r08_rfm_base",
    "r09_rfm_scores",
    "r10_segments",
    "r28_category_behaviour",
    "r37_pnl_by_category",
    "r42_new_vs_returning_orders",
    "r44_geo_table",
    "r47_churn_scores",
    "r55_behaviour_features",
]
ONCE = {"r10_segments", "r47_churn_scores"}  # model fitting: long enough to need no repeats


def run(spark, name: str, directory: str) -> float:
    space = workspace.workspace(spark, directory)
    cube = space.cube
    space.renew()
    space.__dict__["cube"] = cube
    start = time.perf_counter()
    QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="bench-"),
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    workspace.workspace(spark, directory).cube
    times = {"store_cube": round(time.perf_counter() - start, 3)}
    for name in HEADLINE:
        if name not in ONCE:
            run(spark, name, directory)
        repeats = 1 if name in ONCE else runs
        times[name] = round(statistics.median(run(spark, name, directory) for _ in range(repeats)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline report time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
