"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]

Each query runs once to warm up and then three times, from building its plan to its last row; the
median counts. Results go to the ``noop`` sink, so every row is computed and none is kept.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from stratalog.registry import entries
from stratalog.session import build_session

HEADLINE = [
    "m1_silver_catalogue",
    "k1_content_overview",
    "k2_genre_analysis",
    "k3_geographic_distribution",
    "k4_temporal_trends",
    "k5_rating_distribution",
    "k6_quality_scorecard",
    "k7_top_producers",
    "l09_top_genres_over_types",
    "l13_country_type_split",
    "l28_temporal_kpis",
    "l34_month_year_matrix",
    "l42_field_matrix",
    "l46_producer_kpis",
    "c02_latest_event_per_user",
    "c22_quality_report",
    "c23_strict_profile",
    "d3_items_of_top_suppliers",
    "e15_peak_event_hour",
    "e18_orders_month_year_pivot",
    "e20_region_nation_rollup",
    "f1_type_share_in_brand",
    "f2_running_order_value",
    "f3_top_customers_per_nation",
    "h1_difference",
    "m4_all_layers",
]
REPEATS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    registry = entries()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(REPEATS + 1):
            start = time.perf_counter()
            result = registry[name].run(spark, sf_dir)
            result.write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
        print(f"{name}: {[round(r, 2) for r in runs]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
