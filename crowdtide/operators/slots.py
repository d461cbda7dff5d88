"""Display slots: actual counts up to now, forecast after, half-hour by half-hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdtide import config
from crowdtide.functions.levels import occupancy_tone, round_half_up
from crowdtide.functions.timeparts import at_minute, grid_start, minute_of_day
from crowdtide.operators.quantiles import quantiles

SLOT = config.WINDOW_MINUTES


def display_slots(points: DataFrame, keys: list[str], now, ts: str = "target_ts") -> DataFrame:
    """Half-hour means; a point before the current hour uses its actual count if known.

    ``keys`` name one day of one series and hold a ``day``; thresholds ``low_max`` and
    ``peak_min`` may be NULL.
    """
    now = now if isinstance(now, Column) else F.lit(now)
    actual = (F.col(ts) < grid_start(now, 60)) & F.col("actual_count").isNotNull()
    count = F.greatest(F.lit(0), F.when(actual, F.col("actual_count")).otherwise(F.coalesce("expected", F.lit(0))))
    share = F.when(actual, F.col("actual_pct")).otherwise(F.col("pct"))
    start = F.floor(minute_of_day(F.col(ts)) / SLOT).cast("int") * SLOT
    return (
        points.select(*keys, start.alias("start_min"), actual.alias("_actual"), count.alias("_count"), share.alias("_share"), "low_max", "peak_min")
        .groupBy(*keys, "start_min")
        .agg(
            round_half_up(F.avg("_count")).cast("long").alias("count"), F.avg("_share").alias("percent"),
            F.count("*").alias("points"), F.count_if("_actual").alias("_n_actual"),
            F.max("low_max").alias("low_max"), F.max("peak_min").alias("peak_min"),
        )
        .withColumn("source", F.when(F.col("_n_actual") == 0, "predicted").when(F.col("_n_actual") == F.col("points"), "actual").otherwise("mixed"))
        .withColumn("level", F.coalesce(occupancy_tone(F.col("percent") * 100, F.col("low_max"), F.col("peak_min")), F.lit("unknown")))
        .withColumn("end_min", F.col("start_min") + SLOT)
        .withColumn("start", at_minute(F.col("day"), F.col("start_min")))
        .withColumn("end", at_minute(F.col("day"), F.col("end_min")))
        .drop("_n_actual", "points", "low_max", "peak_min")
    )


def hourly_histogram(slots: DataFrame, keys: list[str]) -> DataFrame:
    """Two half-hour segments an hour, their mean, and where they came from."""
    hour = (F.col("start_min") / 60).cast("int")
    first = F.col("start_min") % 60 < SLOT
    pick = lambda c, want: F.max(F.when(want, F.col(c)))
    bars = slots.withColumn("hour", hour).groupBy(*keys, "hour").agg(
        pick("count", first).alias("_c0"), pick("count", ~first).alias("_c1"),
        pick("level", first).alias("_l0"), pick("level", ~first).alias("_l1"),
        round_half_up(F.avg("count")).cast("long").alias("count"),
        F.every(F.col("source") == "actual").alias("_all_actual"), F.every(F.col("source") == "predicted").alias("_all_predicted"),
    )
    return bars.select(
        *keys, "hour", "count",
        F.coalesce("_c0", "_c1").alias("left_count"), F.coalesce("_c1", "_c0").alias("right_count"),
        F.coalesce("_l0", "_l1").alias("left_level"), F.coalesce("_l1", "_l0").alias("right_level"),
        F.when(F.col("_all_actual"), "actual").when(F.col("_all_predicted"), "predicted").otherwise("mixed").alias("source"),
    )


def infer_capacity(slots: DataFrame, keys: list[str]) -> DataFrame:
    """Median of count / share over slots where both are positive."""
    usable = slots.filter((F.col("percent") > 0) & (F.col("count") > 0)).withColumn("_cap", F.col("count") / F.col("percent"))
    return quantiles(usable, keys, "_cap", {"capacity": 0.5}).drop("n")


def next_hours_by_section(points: DataFrame, windows: DataFrame, now, k: int = 3) -> DataFrame:
    """Mean expected count of the hours after this one, today, in open hours, k per section."""
    now = now if isinstance(now, Column) else F.lit(now)
    today = points.filter(
        (F.to_date("target_ts") == F.to_date(now)) & (F.hour("target_ts") > F.hour(now))
    ).withColumn("hour", F.hour("target_ts"))
    opened = windows.filter(F.col("day") == F.to_date(now)).select(
        F.col("facility_id").alias("_f"), F.col("start_min").alias("_ws"), F.col("end_min").alias("_we")
    )
    minute = minute_of_day(F.col("target_ts"))
    inside = today.join(
        opened, (F.col("facility_id") == F.col("_f")) & (minute >= F.col("_ws")) & (minute < F.col("_we")), "left_semi"
    )
    hours = inside.groupBy("facility_id", "section_key", "hour").agg(F.avg(F.greatest(F.lit(0), F.col("expected"))).alias("_mean")).withColumn(
        "expected", round_half_up(F.col("_mean")).cast("long")
    )
    rank = F.row_number().over(Window.partitionBy("facility_id", "section_key").orderBy("hour"))
    return hours.withColumn("rank", rank).filter(F.col("rank") <= k).drop("_mean")


def step_direction(ranked: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """up / down / flat of each displayed value against the one before it.

    The first is compared with the live total.
    """
    before = F.lag("expected").over(Window.partitionBy(*keys).orderBy("rank"))
    change = F.col("expected") - F.coalesce(before, F.col("live_total"))
    return ranked.join(totals, keys, "left").withColumn(
        "direction", F.when(change > 0, "up").when(change < 0, "down").otherwise("flat")
    )


def forecast_hour_bounds(points: DataFrame, ts: str = "target_ts") -> DataFrame:
    return points.agg(F.min(F.hour(ts)).alias("min_hour"), F.max(F.hour(ts)).alias("max_hour"))
