"""Observed hours against the forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdtide.functions.levels import round_half_even, whole_count
from crowdtide.functions.text import underscored_key
from crowdtide.functions.timeparts import grid_start


def hourly_means(readings: DataFrame) -> DataFrame:
    """Mean count and number of readings per location and hour; negative counts skipped."""
    return readings.filter("current_capacity >= 0").groupBy("location_id", grid_start(F.col("observed_at"), 60).alias("hour_start")).agg(
        F.avg("current_capacity").alias("mean_count"), F.count("*").alias("samples")
    )


def actual_hours(readings: DataFrame, sections: DataFrame, capacity: DataFrame, *, with_total: bool = True) -> DataFrame:
    """Observed count of each category and hour, scaled to its whole capacity.

    ``sections`` has (facility_id, section_key, location_id).  With ``with_total`` a
    facility's locations also form the category ``total``.
    """
    placed = sections.select("facility_id", "section_key", "location_id")
    if with_total:
        placed = placed.unionByName(placed.select("facility_id", F.lit("total").alias("section_key"), "location_id")).distinct()
    placed = placed.join(capacity.select("location_id", "max_capacity"), "location_id", "left").withColumn(
        "max_capacity", F.greatest(F.lit(0), F.coalesce("max_capacity", F.lit(0)))
    )
    keys = ["facility_id", "section_key"]
    whole = placed.groupBy(*keys).agg(F.sum("max_capacity").alias("category_max"))
    observed = hourly_means(readings).join(placed, "location_id").groupBy(*keys, "hour_start").agg(
        F.sum("mean_count").alias("observed"), F.sum("max_capacity").alias("observed_cap"), F.sum("samples").alias("actual_samples")
    ).filter("observed_cap > 0").join(whole, keys)
    scaled = F.when(
        (F.col("category_max") > 0) & (F.col("observed_cap") < F.col("category_max")),
        F.col("observed") * (F.col("category_max") / F.col("observed_cap")),
    ).otherwise(F.col("observed"))
    return observed.withColumn("actual_count", whole_count(scaled)).select(
        *keys, "hour_start", "actual_count",
        F.when(F.col("category_max") > 0, round_half_even(F.least(F.col("actual_count") / F.col("category_max"), F.lit(1.0)), 4)).alias("actual_pct"),
        "actual_samples",
        F.when(F.col("category_max") > 0, round_half_even(F.least(F.col("observed_cap") / F.col("category_max"), F.lit(1.0)), 4)).alias("actual_coverage"),
    )


ACTUAL_COLUMNS = ("actual_count", "actual_pct", "actual_samples", "actual_coverage")


def overlay_actuals(forecast: DataFrame, actuals: DataFrame) -> DataFrame:
    """Forecast hours with the observed values of the same category and hour, if any."""
    right = actuals.select(
        F.col("facility_id").alias("_f"), underscored_key(F.col("section_key")).alias("_key"), F.col("hour_start").alias("_hour"), *ACTUAL_COLUMNS
    )
    match = (
        (F.col("facility_id") == F.col("_f")) & (underscored_key(F.col("category_key")) == F.col("_key")) & (F.col("hour_start") == F.col("_hour"))
    )
    return forecast.join(right, match, "left").drop("_f", "_key", "_hour")
