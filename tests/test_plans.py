"""Joins of a history with a small table must not shuffle the history."""

import pytest

from crowdtide.catalog import load

FOLDER = "/root/testdata/sf0.01"
QUERIES, _ = load()


@pytest.mark.parametrize("name", ["resample_mean", "schedule_resolve", "filter_targets_by_schedule", "facility_status", "evaluate_rules", "quantile_bounds", "horizon_regression", "horizon_adjust", "capacity_targets_cross", "zone_point_join"])
def test_small_sides_are_sent_to_the_history(spark, name):
    # above the small sides here, far below the events; a side of unknown size is not sent
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "24k")
    try:
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
