"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from risklattice.queries import QUERIES, load_all
from risklattice.session import get_session

HEADLINE = (
    "slice_zero", "j01_build_lattice", "j02_attach_measure", "j07_locate_section", "j10_neighbour_context",
    "j14_assign_incident", "i02_interpolate", "c03_propagate_flow", "a05_baseline_stats", "a07_free_flow",
    "w03_rolling_std", "w06_spatial_gradient", "w12_dedup_prefer", "w14_history", "w21_build_features",
    "l07_tag_precursors", "l09_build_incidents", "l10_alarm_episodes", "e05_average_precision",
    "e09_sweep_threshold", "e12_tiers", "e17_bootstrap_ci", "e20_contrast_table", "e23_segment_map", "x04_ks_stat",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q] or HEADLINE
    load_all()
    spark = get_session(cores, "bench", spark__sql__shuffle__partitions=cores if cores.isdigit() else "8")
    QUERIES["e05_average_precision"](spark, folder).collect()  # start the JVM's workers once
    took = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cores,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
