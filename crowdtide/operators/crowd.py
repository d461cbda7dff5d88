"""Crowd baselines, thresholds and sums over sets of locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdtide import config
from crowdtide.functions.levels import clamp, round_half_even, round_half_up, whole_count
from crowdtide.operators.quantiles import quantiles

GROUP = ["group_kind", "group_key"]


def location_groups(dimension: DataFrame) -> DataFrame:
    """(group_kind, group_key, location_id) for facilities, sections and locations."""
    facility = F.col("facility_id").cast("string")
    groups = F.array(
        F.struct(F.lit("facility").alias("group_kind"), facility.alias("group_key")),
        F.struct(
            F.lit("section").alias("group_kind"), F.concat_ws("/", facility, F.col("section_key")).alias("group_key")
        ),
        F.struct(F.lit("location").alias("group_kind"), F.col("location_id").cast("string").alias("group_key")),
    )
    return dimension.select(F.explode(groups).alias("_g"), "location_id").select("_g.*", "location_id").distinct()


def crowd_baseline(ratio: DataFrame, capacity: DataFrame, groups: DataFrame, *, min_points: int = config.BASELINE_MIN_POINTS) -> DataFrame:
    """Mean, deviation and two quantiles of the total count of each group.

    A grid step counts when enough of the group's capacity reported; its total is
    scaled to the whole capacity.
    """
    whole = groups.join(capacity, "location_id").groupBy(*GROUP).agg(F.sum("max_cap").alias("group_cap"))
    steps = (
        ratio.select("location_id", "bucket_ts", "ratio")
        .join(capacity, "location_id").join(groups, "location_id")
        .groupBy(*GROUP, "bucket_ts")
        .agg(F.sum(clamp(F.col("ratio"), 0.0, config.RATIO_MAX) * F.col("max_cap")).alias("total"),
             F.sum("max_cap").alias("observed_cap"))
        .join(whole, GROUP)
        .filter(F.col("observed_cap") / F.col("group_cap") >= config.BASELINE_MIN_COVERAGE)
        .withColumn("scaled", F.greatest(F.lit(0.0), F.when(
            F.col("observed_cap") < F.col("group_cap"), F.col("total") * (F.col("group_cap") / F.col("observed_cap"))
        ).otherwise(F.col("total"))))
    )
    moments = steps.groupBy(*GROUP).agg(
        F.avg("scaled").alias("mean"), F.stddev_pop("scaled").alias("std"), F.max("group_cap").alias("capacity")
    )
    marks = quantiles(steps, GROUP, "scaled", {
        "low_ceiling": config.BASELINE_LOW_Q, "peak_floor": config.BASELINE_PEAK_Q,
    })
    return moments.join(marks, GROUP).filter(F.col("n") >= min_points).withColumnRenamed("n", "points")


def occupancy_thresholds(baseline: DataFrame) -> DataFrame:
    """Whole-percent limits: low at or below ``low_max``, peak from ``peak_min`` on."""
    percent = lambda c: F.col(c) / F.col("capacity") * 100.0
    low = round_half_even(clamp(percent("low_ceiling"), 0.0, 99.0))
    with_low = baseline.filter("capacity > 0").withColumn("low_max", low.cast("int"))
    peak = round_half_even(F.greatest(F.col("low_max") + 1.0, F.least(F.lit(100.0), percent("peak_floor"))))
    return with_low.withColumn("peak_min", peak.cast("int"))


def combine_thresholds(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Capacity-weighted mean of thresholds, in whole percents."""
    usable = entries.filter((F.col("weight") > 0) & F.col("low_max").isNotNull() & F.col("peak_min").isNotNull())
    mean = lambda c: F.sum(F.col(c) * F.col("weight")) / F.sum("weight")
    return (
        usable.groupBy(*keys)
        .agg(round_half_up(mean("low_max")).alias("_low"), round_half_up(mean("peak_min")).alias("_peak"))
        .withColumn("low_max", clamp(F.col("_low"), 0, 99))
        .withColumn("peak_min", F.greatest(F.col("low_max") + 1, F.least(F.lit(100), F.col("_peak"))))
        .select(*keys, F.col("low_max").cast("int").alias("low_max"), F.col("peak_min").cast("int").alias("peak_min"))
    )


def fill_thresholds(own: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """A group's own thresholds, else the combination of those of its parts."""
    combined = combine_thresholds(parts, keys).select(
        *keys, F.col("low_max").alias("_low"), F.col("peak_min").alias("_peak")
    )
    return own.join(combined, keys, "full").select(
        *keys,
        F.coalesce("low_max", "_low").alias("low_max"), F.coalesce("peak_min", "_peak").alias("peak_min"),
        F.when(F.col("low_max").isNotNull(), "own").otherwise("combined").alias("origin"),
    )


def capped_share(count: Column, capacity: Column) -> Column:
    return F.when(capacity > 0, round_half_even(F.least(count / capacity, F.lit(1.0)), 4))


def group_series(estimates: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and target: rounded sums of the counts, shares of the capacity.

    ``estimates`` holds location_id, target_ts, count_p10/p50/p90, samples, max_cap.
    """
    whole = lambda c: whole_count(F.sum(c))
    summed = (
        estimates.join(groups, "location_id").groupBy(*keys, "target_ts")
        .agg(
            whole("count_p10").alias("expected_p10"), whole("count_p50").alias("expected"),
            whole("count_p90").alias("expected_p90"), F.sum("samples").alias("sample_count"),
            F.sum("max_cap").alias("capacity"),
        )
    )
    return summed.withColumns({
        "pct": capped_share(F.col("expected"), F.col("capacity")),
        "pct_p10": capped_share(F.col("expected_p10"), F.col("capacity")),
        "pct_p90": capped_share(F.col("expected_p90"), F.col("capacity")),
    })


POINT_VALUES = ("expected", "expected_p10", "expected_p90", "pct", "pct_p10", "pct_p90")


def zero_at_boundary(points: DataFrame, flag: str = "is_boundary") -> DataFrame:
    """Counts and shares become 0 at opening and closing times; the change is marked."""
    edge = F.coalesce(F.col(flag), F.lit(False))
    present = [c for c in POINT_VALUES if c in points.columns]
    zeroed = {c: F.when(edge, F.lit(0).cast(points.schema[c].dataType)).otherwise(F.col(c)) for c in present}
    return points.withColumns({**zeroed, "boundary_zeroed": edge})


def spike_adjust(points: DataFrame, live: DataFrame, keys: list[str], now) -> DataFrame:
    """Carry the gap between the live total and the current forecast into the next rows.

    ``keys`` name one day of one series (at most a day of targets), ``live`` has one
    ``live_total`` per series.  The gap fades from row to row.
    """
    from pyspark.sql import Window

    now = now if isinstance(now, Column) else F.lit(now)
    day = Window.partitionBy(*keys)
    in_time = day.orderBy("target_ts")
    live_keys = [k for k in live.columns if k != "live_total"]
    placed = (
        points.join(live, live_keys, "left")
        .withColumn("_row", F.row_number().over(in_time))
        .withColumn("_now_row", F.max(F.when(F.col("target_ts") <= now, F.col("_row"))).over(day))
        .withColumn("_base", F.max(F.when(F.col("_row") == F.col("_now_row"), F.col("expected"))).over(day))
        .withColumn("_drift", F.col("live_total") - F.col("_base"))
        .withColumn("_ahead", F.col("_row") - F.col("_now_row"))
        .withColumn("_delta", F.col("_drift") * F.exp(-config.SPIKE_DECAY * F.greatest(F.lit(0), F.col("_ahead") - 1)))
    )
    hit = F.coalesce(
        (F.abs("_drift") >= 1.0) & F.col("_ahead").between(1, config.SPIKE_ROWS) & (F.abs("_delta") >= 0.5), F.lit(False)
    )
    top = F.when(
        F.col("capacity") > 0, F.greatest(F.col("capacity") * 1.0, F.col("capacity") * config.SPIKE_CAP_MULTIPLIER)
    ).otherwise(F.lit(float("inf")))
    moved = {c: F.greatest(F.lit(0.0), F.least(F.col(c) + F.col("_delta"), top)) for c in ("expected", "expected_p10", "expected_p90")}
    low = F.least(moved["expected_p10"], moved["expected_p90"])
    high = F.greatest(moved["expected_p10"], moved["expected_p90"])
    middle = F.least(F.greatest(moved["expected"], low), high)
    whole = whole_count
    out = placed.withColumns({
        "expected_raw": F.when(hit, F.col("expected")),
        "spike_adjusted": hit,
        "_mid": F.when(hit, whole(middle)).otherwise(F.col("expected")),
        "_low": F.when(hit, whole(low)).otherwise(F.col("expected_p10")),
        "_high": F.when(hit, whole(high)).otherwise(F.col("expected_p90")),
    })
    share = lambda c, old: F.when(F.col("spike_adjusted"), capped_share(F.col(c), F.col("capacity"))).otherwise(F.col(old))
    return out.withColumns({
        "pct": share("_mid", "pct"), "pct_p10": share("_low", "pct_p10"), "pct_p90": share("_high", "pct_p90"),
        "expected": F.col("_mid"), "expected_p10": F.col("_low"), "expected_p90": F.col("_high"),
    }).select(*points.columns, "expected_raw", "spike_adjusted")
