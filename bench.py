"""Time the headline queries: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from crowdtide.catalog import load  # noqa: E402
from crowdtide.session import build_session  # noqa: E402

HEADLINE = (
    "resample_mean", "seasonal_profiles", "latest_per_location", "actual_hours", "section_metrics", "evaluate_rules",
    "lag_join", "asof_strict", "rolling_mean", "flatline_steps", "drop_impossible_jumps", "thin_flatlines",
    "crowd_baseline", "crowd_bands", "quiet_windows", "display_slots", "schedule_resolve", "weighted_quantile",
    "point_bias_profile", "horizon_regression", "adjust_prediction", "forecast_document",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores=cores, partitions=max(8, int(cores) if cores.isdigit() else 8))
    queries, _ = load()
    spark.read.parquet(f"{folder}/events.parquet").count()  # start the session before the clock
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # noop writes every column of every row and keeps nothing
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
