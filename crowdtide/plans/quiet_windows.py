"""When is each facility quiet or crowded?  Readings -> thresholds -> bands -> windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdtide.functions.levels import whole_count
from crowdtide.operators.bands import crowd_bands, windows_from_bands
from crowdtide.operators.crowd import GROUP, crowd_baseline, location_groups, occupancy_thresholds
from crowdtide.session import cut_lineage

SERIES = ["group_kind", "group_key", "day"]


def observed_points(ratio: DataFrame, capacity: DataFrame, groups: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Observed totals per group and step as points with thresholds."""
    totals = (
        ratio.select("location_id", "bucket_ts", "ratio", "mean_count").join(groups, "location_id")
        .groupBy(*GROUP, F.col("bucket_ts").alias("target_ts"))
        .agg(whole_count(F.sum("mean_count")).alias("expected"), F.count("*").alias("sample_count"))
    )
    return totals.join(thresholds.select(*GROUP, "capacity", "low_max", "peak_min"), GROUP).withColumn("day", F.to_date("target_ts"))


def quiet_windows(ratio: DataFrame, capacity: DataFrame, dimension: DataFrame, *, min_points: int = 120, kinds=("facility",)) -> DataFrame:
    # Both tables are read several times below and are small next to the readings.
    ratio, capacity = cut_lineage(ratio), cut_lineage(capacity)
    groups = location_groups(dimension).filter(F.col("group_kind").isin(*kinds))
    thresholds = occupancy_thresholds(crowd_baseline(ratio, capacity, groups, min_points=min_points))
    points = cut_lineage(observed_points(ratio, capacity, groups, thresholds))
    bands = crowd_bands(points, SERIES)
    quiet = windows_from_bands(bands, points, SERIES, "low").withColumn("advice", F.lit("best"))
    crowded = windows_from_bands(bands, points, SERIES, "peak").withColumn("advice", F.lit("avoid"))
    return quiet.unionByName(crowded).select(
        F.col("group_key").alias("facility"), "advice", "start", "end", "window_hours", "expected_total", "expected_avg", "sample_count_min", "window_points"
    )


def quiet_windows_of(spark: SparkSession, folder: str, *, minutes: int = 60, min_points: int = 120) -> DataFrame:
    from crowdtide.catalog import base

    ratio = base.ratio(spark, folder, minutes)
    return quiet_windows(ratio, base.capacity(spark, folder), base.locations(spark, folder), min_points=min_points)
