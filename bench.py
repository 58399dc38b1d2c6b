"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The stages (written intermediate tables) are built first and timed as ``stages``; each query is then timed
through a full evaluation of its result.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gapgrid.plans.registry import QUERIES  # noqa: E402
from gapgrid.plans.stages import stages_for  # noqa: E402
from gapgrid.session import get_session  # noqa: E402

HEADLINE = ["priority_zones", "point_to_cell", "user_stats", "user_signals", "first_distinct", "filter_flow", "clean_trips",
            "duplicate_profile", "null_profile", "weekly_coverage", "temporal_profile", "distance_percentiles", "largest_component",
            "study_area", "zone_table", "zone_features", "densify_polyline", "nearest_distance", "network_contrast",
            "share_near_network", "zone_municipality", "distance_rings", "holdout_split", "modelling_table", "spearman_matrix",
            "moran_correlogram", "local_moran", "lisa_clusters", "cross_validate", "cv_summary", "one_se_rule", "poisson_glm",
            "negbin2_glm", "gap_table", "sensitivity_table", "zone_predictions", "field_list"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    t0 = time.perf_counter()
    stages_for(spark, sf_dir).predictions.count()
    times["stages"] = round(time.perf_counter() - t0, 3)
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
