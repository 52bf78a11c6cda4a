"""Benchmark: headline queries of the rates study on the driver's tables.

Prints one JSON line. ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and
``BENCH_CPUS`` (default 8) select data and parallelism. The ``base`` entry
computes the death cube, the report counts and the population strata from the row-level tables
(cached, never written); every other entry is a query, collected to the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "count_strata",
    "std_rate_year_sex",
    "std_rate_region",
    "std_rate_department",
    "life_expectancy_year_sex",
    "yll_rate_year_sex",
    "mask_interpolate_anchor",
    "table_rate_contrasts_regime",
    "table_rate_contrasts_age",
    "table_excess",
    "figure_s4",
    "unmatched_codes",
    "map_cause_range",
    "population_long",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    ckpt = tempfile.mkdtemp(prefix="vitalrates-bench-")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("vitalrates-bench")
             .config("spark.sql.shuffle.partitions", str(int(cpus) * 2))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "16g")
             .config("spark.checkpoint.dir", ckpt)
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    from vitalrates.plans import registry

    times = {}
    t0 = time.time()
    st = registry.study(spark, sf_dir)
    for name in ("cube", "tally", "popnac", "popmpio", "popbdua"):
        getattr(st, name).count()
    times["base"] = round(time.time() - t0, 3)
    qs = registry.REGISTRY
    for name in HEADLINE:
        fn = registry.spark_query(name)
        t = time.time()
        fn(spark, sf_dir).collect()
        times[name] = round(time.time() - t, 3)
    total = round(sum(times.values()), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "rates_study_headline_total", "value": total, "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "registered_queries": len(qs)}))
    spark.stop()


if __name__ == "__main__":
    main()
