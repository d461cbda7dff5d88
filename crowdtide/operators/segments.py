"""Segment families and the error profiles built on them.

A segment is a (kind, key) pair; every scored row belongs to one of each kind.  The
rows are unrolled to their segments just before an aggregate, so partial sums
combine on the map side and only one row per model and segment is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdtide import config
from crowdtide.functions.levels import clamp, finite, occupancy_weight
from crowdtide.functions.timeparts import day_type, horizon_bucket, hour_block, occupancy_class
from crowdtide.operators.quantiles import weighted_mean, weighted_quantiles
from crowdtide.session import cut_lineage

ALL_KINDS = ("occupancy", "horizon", "hour", "block", "day_type", "global")
SEGMENT = ["seg_kind", "seg_key"]


def segment_keys(ts: str, point: str, hours_ahead: Column | None = None) -> dict[str, Column]:
    """Key per segment kind.  Profiles are built at horizon 0."""
    return {
        "global": F.lit("all"),
        "hour": F.hour(ts).cast("string"),
        "block": hour_block(F.hour(ts)),
        "day_type": day_type(F.col(ts)),
        "horizon": horizon_bucket(hours_ahead if hours_ahead is not None else F.lit(0)),
        "occupancy": occupancy_class(clamp(F.col(point), 0.0, config.RATIO_MAX)),
    }


def explode_segments(rows: DataFrame, ts: str = "ts", point: str = "p50", kinds: tuple[str, ...] = ALL_KINDS) -> DataFrame:
    keys = segment_keys(ts, point)
    pairs = F.array(*[F.struct(F.lit(k).alias("seg_kind"), keys[k].alias("seg_key")) for k in kinds])
    return rows.withColumn("_seg", F.explode(pairs)).select(*rows.columns, "_seg.*")


def _usable(rows: DataFrame) -> DataFrame:
    return rows.filter(
        finite(F.col("y_true")).isNotNull() & finite(F.col("p50")).isNotNull()
        & finite(F.col("weight")).isNotNull() & (F.col("weight") > 0)
    )


def _enough(count: Column, points: int, points_occupancy: int | None = None) -> Column:
    """Global profiles always hold; segments need a minimum of rows."""
    least = F.when(F.col("seg_kind") == "occupancy", points_occupancy or points).otherwise(points)
    return (F.col("seg_kind") == "global") | (count >= least)


def residual_interval_profile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """10 % and 90 % weighted quantiles of the residual per segment."""
    residuals = explode_segments(
        _usable(rows).withColumn("_res", F.col("y_true") - F.col("p50")), kinds=("occupancy", "hour", "block", "day_type", "global")
    )
    out = weighted_quantiles(residuals, [*keys, *SEGMENT], "_res", "weight", {"q10": config.INTERVAL_LOW_Q, "q90": config.INTERVAL_HIGH_Q})
    return out.filter(_enough(F.col("n"), config.INTERVAL_MIN_POINTS)).drop("total_weight")


def point_bias_profile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean residual per segment, bounded."""
    out = explode_segments(_usable(rows)).groupBy(*keys, *SEGMENT).agg(
        clamp(weighted_mean(F.col("y_true") - F.col("p50"), F.col("weight")), -config.BIAS_MAX_ABS, config.BIAS_MAX_ABS).alias("bias"),
        F.count("*").alias("n"),
    )
    return out.filter(_enough(F.col("n"), config.BIAS_MIN_POINTS, config.BIAS_MIN_POINTS_OCCUPANCY))


def regime_mae_profile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean absolute error by hour block, horizon, day type and overall."""
    out = explode_segments(_usable(rows), kinds=("block", "horizon", "day_type", "global")).groupBy(*keys, *SEGMENT).agg(
        weighted_mean(F.abs(F.col("y_true") - F.col("p50")), F.col("weight")).alias("mae"), F.count("*").alias("n")
    )
    return out.filter(_enough(F.col("n"), config.BIAS_MIN_POINTS))


def recent_days(rows: DataFrame, keys: list[str], days: int, ts: str = "ts") -> DataFrame:
    """Rows of the last ``days`` days before each model's newest row; rows without a time go."""
    newest = cut_lineage(rows.groupBy(*keys).agg(F.max(ts).alias("_newest")))      # one row per model, of known size
    since = F.col("_newest") - F.make_dt_interval(F.lit(days))
    return rows.join(newest, keys).filter(F.col(ts) >= since).drop("_newest")


def conformal_margins(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted 80 % quantile of how far the truth lies outside the interval, bounded.

    Models with fewer than 120 scored rows get none.
    """
    scored = _usable(rows).withColumn("_score", F.greatest(F.lit(0.0), F.col("p10") - F.col("y_true"), F.col("y_true") - F.col("p90")))
    found = weighted_quantiles(explode_segments(scored), [*keys, *SEGMENT], "_score", "weight", {"_q": 1.0 - config.CONFORMAL_ALPHA})
    margins = found.select(*keys, *SEGMENT, clamp(F.col("_q"), 0.0, config.CONFORMAL_MAX_MARGIN).alias("margin"), "n")
    enough = margins.filter((F.col("seg_kind") == "global") & (F.col("n") >= config.CONFORMAL_MIN_POINTS)).select(*keys)
    return margins.join(enough, keys, "left_semi").filter(_enough(F.col("n"), config.CONFORMAL_MIN_SEGMENT))


def drift_summary(rows: DataFrame, keys: list[str], baseline: DataFrame, multiplier: float = config.DRIFT_MULTIPLIER) -> DataFrame:
    """Recent error and bias per model, and an alert against the model's own error."""
    recent = _usable(rows).groupBy(*keys).agg(
        F.count("*").alias("points"),
        weighted_mean(F.abs(F.col("p50") - F.col("y_true")), F.col("weight")).alias("recent_mae"),
        clamp(weighted_mean(F.col("y_true") - F.col("p50"), F.col("weight")), -config.DRIFT_BIAS_MAX_ABS, config.DRIFT_BIAS_MAX_ABS).alias("recent_bias"),
    ).filter(F.col("points") >= config.DRIFT_MIN_POINTS)
    limit = F.col("baseline_mae") * (1.0 + multiplier)
    return recent.join(baseline, keys, "left").withColumn("alert_threshold", limit).withColumn(
        "alert", F.coalesce(F.col("recent_mae") > limit, F.lit(False))
    )


def drift_bias_profile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Recent bias by hour, day type, occupancy class and overall."""
    out = explode_segments(_usable(rows), kinds=("hour", "day_type", "occupancy", "global")).groupBy(*keys, *SEGMENT).agg(
        clamp(weighted_mean(F.col("y_true") - F.col("p50"), F.col("weight")), -config.DRIFT_BIAS_MAX_ABS, config.DRIFT_BIAS_MAX_ABS).alias("bias"),
        F.count("*").alias("n"),
    )
    return out.filter(_enough(F.col("n"), config.DRIFT_BIAS_MIN_POINTS, config.DRIFT_BIAS_MIN_POINTS_OCCUPANCY))


def recent_evaluation(rows: DataFrame, keys: list[str], target_coverage: float = 0.8) -> DataFrame:
    """Weighted MAE, RMSE, interval coverage and its error."""
    w = F.sum("weight")
    mean = lambda c: F.sum(F.col("weight") * c) / w
    error = F.col("p50") - F.col("y_true")
    inside = ((F.col("y_true") >= F.col("p10")) & (F.col("y_true") <= F.col("p90"))).cast("double")
    return _usable(rows).groupBy(*keys).agg(
        F.count("*").alias("points"), mean(F.abs(error)).alias("mae"), F.sqrt(mean(error * error)).alias("rmse"),
        mean(inside).alias("coverage"),
    ).withColumn("coverage_err", F.abs(F.col("coverage") - target_coverage))


def drift_weight(recency: Column, ratio: Column, transition: Column, feature: Column, balance: Column) -> Column:
    return recency * occupancy_weight(ratio) * transition * feature * balance


# -- lookups ------------------------------------------------------------------

# Order in which segments are tried.
LOOKUP_ORDER = {
    "bias": ("occupancy", "horizon", "hour", "block", "day_type"),
    "margin": ("occupancy", "horizon", "hour", "block", "day_type"),
    "interval": ("occupancy", "hour", "block", "day_type"),
    "drift": ("occupancy", "hour", "day_type"),
    "regime": ("horizon", "block", "day_type"),
}


def profile_map(profile: DataFrame, keys: list[str], values: list[str], name: str) -> DataFrame:
    """One row per model with a map of its segments: at most 43 entries."""
    entry = F.struct(F.concat_ws(":", *SEGMENT).alias("key"), F.struct(*values, "n").alias("value"))
    return profile.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias(name))


def lookup(
    profile: Column, order: tuple[str, ...], segment: dict[str, Column], value: str, *,
    points: int, points_occupancy: int | None = None, shrink: bool = True, default: float | None = 0.0,
) -> Column:
    """Value of the first segment with enough rows, shrunk to the global one."""
    overall = F.try_element_at(profile, F.lit("global:all"))[value]
    tries = []
    for kind in order:
        least = points_occupancy if kind == "occupancy" and points_occupancy else points
        found = F.try_element_at(profile, F.concat(F.lit(f"{kind}:"), segment[kind]))
        support = F.least(F.lit(1.0), found["n"] / float(least * config.SUPPORT_MULT))
        base = F.coalesce(overall, F.lit(0.0))
        mixed = support * found[value] + (1.0 - support) * base if shrink else found[value]
        tries.append(F.when(found["n"] >= least, mixed))
    out = F.coalesce(*tries, overall)
    return out if default is None else F.coalesce(out, F.lit(default))


def segment_profile_lookup(
    rows: DataFrame, profile: DataFrame, keys: list[str], family: str, values: list[str], *,
    ts: str = "ts", point: str = "p50", hours_ahead: Column | None = None, points: int, points_occupancy: int | None = None,
) -> DataFrame:
    """Join a profile to rows by model and resolve each row's segment."""
    mapped = cut_lineage(profile_map(profile, keys, values, "_profile"))      # one row per model, of known size
    segment = segment_keys(ts, point, hours_ahead)
    joined = rows.join(mapped, keys, "left")
    found = {
        v: lookup(F.col("_profile"), LOOKUP_ORDER[family], segment, v, points=points, points_occupancy=points_occupancy, shrink=family != "regime")
        for v in values
    }
    return joined.withColumns({f"{family}_{v}" if len(values) > 1 else family: c for v, c in found.items()}).drop("_profile")


def drift_bias_lookup(rows: DataFrame, profile: DataFrame, keys: list[str], hours_ahead: Column, *, ts: str = "ts", point: str = "p50") -> DataFrame:
    """Recent bias of the first segment with enough rows, faded with the horizon."""
    mapped = cut_lineage(profile_map(profile, keys, ["bias"], "_drift"))
    segment = segment_keys(ts, point)
    choices = []
    for kind in LOOKUP_ORDER["drift"]:
        least = config.DRIFT_BIAS_MIN_POINTS_OCCUPANCY if kind == "occupancy" else config.DRIFT_BIAS_MIN_POINTS
        found = F.try_element_at(F.col("_drift"), F.concat(F.lit(f"{kind}:"), segment[kind]))
        choices.append(F.when(found["n"] >= least, found["bias"] * F.least(F.lit(1.0), found["n"] / (least * config.SUPPORT_MULT))))
    overall = F.try_element_at(F.col("_drift"), F.lit("global:all"))
    choices.append(overall["bias"] * F.least(F.lit(1.0), overall["n"] / (config.DRIFT_BIAS_MIN_POINTS * config.SUPPORT_MULT)))
    fade = F.exp(-F.greatest(F.lit(0.0), hours_ahead.cast("double")) / config.DRIFT_BIAS_DECAY_HOURS)
    return rows.join(mapped, keys, "left").withColumn(
        "drift_bias", F.coalesce(F.coalesce(*choices) * config.DRIFT_BIAS_BLEND * fade, F.lit(0.0))
    ).drop("_drift")
