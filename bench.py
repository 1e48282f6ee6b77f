"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and threads.
Every query runs twice after a warm-up and counts with its faster run; results go to the noop
sink, so all rows are computed and none reaches the driver.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from pyspark.sql import SparkSession

from paneldrift.operators.scale import release_tables
from paneldrift.plans import QUERIES

HEADLINE = [
    "growth_decompose",
    "pairwise_change",
    "pairwise_presence",
    "jaccard_pairs",
    "consecutive_pairs",
    "cohort_index",
    "counterfactual_curve",
    "growth_like_for_like",
    "grouping_sets_net",
    "change_class_area",
    "net_by_area_period",
    "share_of_total",
    "complete_grid",
    "mode_per_unit",
    "dictionary_build",
    "profile_pivot",
    "quantile_iqr",
    "spatial_intersects",
    "rollup_area",
    "weighted_mean",
    "model_table",
    "ols_coefficients",
]
RUNS = 2


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = session(os.environ.get("BENCH_CPUS", "8"))

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in ("growth_decompose", "pairwise_presence", "spatial_intersects"):
        run(name)
    times = {name: round(min(run(name) for _ in range(RUNS)), 3) for name in HEADLINE}
    found = re.search(r"sf([0-9.]+)$", folder)
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else folder,
            }
        )
    )
    release_tables(spark)
    spark.stop()


if __name__ == "__main__":
    main()
