"""Times the headline results and prints one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local cores. Shared tables are built once, as in a real
run, and timed by name (``build_...``); each report then reads them.
"""

from __future__ import annotations

import json
import os
import sys
import time

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

BUILDS = (
    "confirmed", "users", "detail", "sides", "wide", "tx_level", "user_level", "modeling_view", "user_grain", "knn_users",
)
REPORTS = (
    "first_second_trip", "trip_detail", "media_path_totals", "payment_methods", "app_behaviour", "horizon_targets",
    "kpi_by_horizon", "categorical_breakdown", "continuous_bins", "cohort_cube", "transition_top", "group_kaplan_meier",
    "multivariate_logrank", "roc_auc", "decile_lift", "audience_table", "knn_join", "knn_table",
    "recommendation_mart", "money_profile",
)
FITS = ("design_matrix", "logistic_l2", "permutation_importance", "partial_dependence")


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from encore.plans import registry
    from encore.plans.catalog import forget, stages_for
    from encore.session import build_session

    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(CPUS)),
            "spark.driver.memory": "20g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    stages = stages_for(spark, FOLDER)
    for name in BUILDS:
        start = time.perf_counter()
        stages.build_sides() if name == "sides" else getattr(stages, name)
        times[f"build_{name}"] = round(time.perf_counter() - start, 3)
    queries = registry.queries()
    for name in (*REPORTS, *FITS):
        start = time.perf_counter()
        queries[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(FOLDER.rstrip("/"))
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": scale}))
    forget(spark)
    spark.stop()


if __name__ == "__main__":
    main()
