"""The end-to-end week of forecasts: a run over tables, from readings to the document."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdtide import config
from crowdtide.functions.levels import occupancy_ratio
from crowdtide.functions.timeparts import epoch_seconds, targets_for_days
from crowdtide.operators import segments
from crowdtide.operators.bands import crowd_bands, windows_from_bands
from crowdtide.operators.clean import clean_history, flat_runs, location_stats, open_readings, quality_alert, resample_ratio, row_counters, seasonal_profiles, stuck_runs
from crowdtide.operators.crowd import crowd_baseline, group_series, location_groups, occupancy_thresholds, spike_adjust, zero_at_boundary
from crowdtide.operators.horizons import horizon_pairs, horizon_regression
from crowdtide.operators.live_metrics import category_live_total
from crowdtide.operators.profiles import profile_fallback_join
from crowdtide.operators.schedule import apply_schedule_to_readings, filter_targets
from crowdtide.plans import scoring
from crowdtide.plans.feature_table import feature_table
from crowdtide.plans.forecast_models import (
    ModelPlan, act_on_drift, controls_of, current_models, facility_units, labelled_scores, model_report, score_all, train_units, unit_sets,
)
from crowdtide.plans.run_manifest import WHOLE, RunManifest
from crowdtide.plans.training import TrainedModel
from crowdtide.session import cut_lineage
from crowdtide.sources.document import nest_document
from crowdtide.sources.live import latest_per_location

TARGET = ["facility_id", "day", "target_ts"]


def location_targets(capacity: DataFrame, targets: DataFrame) -> DataFrame:
    """Every location with every target time of its facility."""
    return capacity.join(targets, "facility_id")


def capacity_targets(capacity: DataFrame, first_day, *, days: int = config.FORECAST_DAYS, step: int = config.RESAMPLE_MINUTES) -> DataFrame:
    """Every location with every step of the days from ``first_day`` on; each row makes its own grid."""
    dated = capacity.withColumn("day", F.explode(F.sequence(first_day, F.date_add(first_day, days - 1))))
    return targets_for_days(dated, step_minutes=step)


def week_targets(dimension: DataFrame, now, rules: DataFrame | None, *, days: int = config.FORECAST_DAYS, step: int = config.RESAMPLE_MINUTES) -> DataFrame:
    """Targets of the coming days, per facility, that its schedule leaves."""
    facilities = dimension.select("facility_id").distinct()
    dated = facilities.select("facility_id", F.explode(F.sequence(F.to_date(now), F.date_add(F.to_date(now), days - 1))).alias("day"))
    both = targets_for_days(dated, step_minutes=step).unionByName(targets_for_days(dated, step_minutes=config.WINDOW_MINUTES if step < config.WINDOW_MINUTES else step)).distinct()
    if rules is None:
        return both.withColumn("is_boundary", F.lit(False))
    return filter_targets(both, rules).drop("window")


def category_key(section: str = "section_key"):
    return F.replace(F.col(section), F.lit(" "), F.lit("_"))


def calibrate(models: dict[str, TrainedModel], spark, pairs: DataFrame, recent: DataFrame, widen: DataFrame) -> dict[str, DataFrame]:
    """Profiles of all models: biases and errors from validation, drift and margins from the recent predictions."""
    key = ["model_key"]
    one = lambda name: functools.reduce(DataFrame.unionByName, [m.metrics[name] for m in models.values()])
    interval = cut_lineage(one("profile"))
    bounded = cut_lineage(scoring.quantile_bounds(one("validation"), interval))
    keys = ("holdout_rows", "holdout_mae", "holdout_coverage_err", "val_rows", "val_mae", "val_coverage_err")
    rows = [(k, *[m.metrics.get(c) for c in keys]) for k, m in models.items()]
    metrics = spark.createDataFrame(
        rows, "model_key STRING, holdout_rows BIGINT, holdout_mae DOUBLE, holdout_coverage_err DOUBLE, val_rows BIGINT, val_mae DOUBLE, val_coverage_err DOUBLE"
    )
    missing = recent.groupBy(*key).agg(F.avg("missing").alias("missing"))
    metrics = metrics.join(missing, key, "left").join(widen.select("model_key", "drift_streak", "force_retrain"), key, "left")
    owned = pairs.join(spark.createDataFrame([(k, int(i)) for k, m in models.items() for i in m.locations], "model_key STRING, location_id BIGINT"), [*key, "location_id"])
    tables = {
        "interval": interval, "regime": segments.regime_mae_profile(bounded, key), "bias": segments.point_bias_profile(bounded, key),
        "drift": segments.drift_bias_profile(segments.recent_days(recent, key, config.DRIFT_DAYS), key),
        "conformal": segments.conformal_margins(segments.recent_days(recent, key, config.CONFORMAL_DAYS), key),
        "scores": scoring.model_scores(metrics), "widen": widen, "horizon": horizon_regression(owned, key),
    }
    return {n: cut_lineage(t) for n, t in tables.items()}


def flat_estimates(targets: DataFrame, profiles: DataFrame) -> DataFrame:
    """Counts of every (location, target) by the seasonal profile, where there is no model at all."""
    flat = profile_fallback_join(targets, profiles, "target_ts")
    cap = F.greatest(F.lit(0), F.coalesce("max_cap", F.lit(0)))
    value = F.coalesce("profile_ratio", F.lit(0.0)) * cap
    return flat.select("location_id", "target_ts", *[value.alias(f"count_{p}") for p in ("p10", "p50", "p90")], F.coalesce("samples", F.lit(0)).alias("samples"), cap.alias("max_cap"))


def model_estimates(
    run: RunManifest, full: DataFrame, located: DataFrame, models: dict[str, TrainedModel], members: DataFrame, recent: DataFrame, widen: DataFrame, sets: DataFrame,
    readings: DataFrame, raw: DataFrame, ratio: DataFrame, profiles: DataFrame, stats: DataFrame, weather: DataFrame, ranges: DataFrame, days: DataFrame, rules, grid: int, now, plan: ModelPlan,
) -> DataFrame:
    """Counts of every (location, target): the category's and the facility's model blended, the profile where both are missing."""
    spark = run.spark
    keys = spark.createDataFrame([(k, True) for k in models], "model_key STRING, usable BOOLEAN")
    tagged = full.withColumns({
        "fallback_key": F.concat(F.col("facility_id").cast("string"), F.lit("__all")),
        "primary_key": F.concat_ws("__", F.col("facility_id").cast("string"), "category_key"),
    }).join(keys.withColumnRenamed("model_key", "primary_key"), "primary_key", "left")
    tagged = tagged.withColumn("primary_key", F.when(F.col("usable"), F.col("primary_key")).otherwise(F.col("fallback_key"))).drop("usable")
    live = latest_per_location(open_readings(readings), ["observed_at", "current_capacity", "max_capacity"]).select(
        "location_id", occupancy_ratio(F.col("current_capacity"), F.col("max_capacity")).alias("live_ratio"),
        F.greatest(F.lit(0.0), (epoch_seconds(now) - epoch_seconds(F.col("observed_at"))) / 60.0).alias("live_age"),
    ).filter(F.col("live_age") <= config.SPIKE_MAX_AGE_MIN)
    pair_rows = sets.select("model_key", "location_id", "bucket_ts", F.col("label").alias("ratio"), "row_weight", "recency")
    calibration = calibrate(models, spark, cut_lineage(horizon_pairs(pair_rows, ratio)), recent, widen)
    eligible = stats.filter((F.col("samples") >= config.MIN_SAMPLES_PER_LOCATION) & ~F.col("is_stale")).select("location_id")
    future = located.select("location_id", "facility_id", F.col("target_ts").alias("bucket_ts")).join(eligible, "location_id", "left_semi")
    ahead = run.table(WHOLE, "ahead", lambda: feature_table(future, ratio, raw, profiles, weather, ranges, days, rules, grid=grid).join(members, "location_id"), by=["model_key"])
    scored = score_all(run, "scored", models, lambda key, model: scoring.score(ahead.filter(F.col("model_key") == key).drop("model_key"), model, calibration["interval"]), plan.workers)
    return scoring.estimate_locations(tagged, scored, calibration, profiles, live, now)


def build_forecast(
    readings: DataFrame, dimension: DataFrame, weather: DataFrame, ranges: DataFrame, days: DataFrame, at: dt.datetime, *,
    store: str, run_name: str, rules: DataFrame | None = None, plan: ModelPlan = ModelPlan(), grid: int = config.RESAMPLE_MINUTES,
    forecast_days: int = config.FORECAST_DAYS, min_points: int = config.BASELINE_MIN_POINTS,
):
    """Readings -> points, bands, windows and the nested document of the coming week.

    ``readings`` are all of them, also invalid and closed ones, which the quality gate counts;
    ``dimension`` holds location, facility, section; ``at`` is the run's moment.  Models live in
    ``store`` from run to run.  The run is a state machine over tables: every decision (quality gate,
    adaptive controls, due, tuning, training, promotion, drift, rollback) is a row of its manifest, and a
    run started again under its name goes on after the last one.
    """
    spark, now = readings.sparkSession, F.lit(at).cast("timestamp_ntz")
    run = RunManifest(spark, store, run_name)
    table = functools.partial(run.table, WHOLE)
    controls = controls_of(run, store)

    # -- history and quality gate
    known = open_readings(readings).join(dimension.select("location_id", "facility_id"), "location_id")
    scheduled = apply_schedule_to_readings(known, rules) if rules is not None else known
    stages = clean_history(scheduled)
    raw, capacity = table("clean", lambda: stages["clean"]), table("capacity", lambda: stages["capacity"])
    ratio = table("ratio", lambda: resample_ratio(raw, grid))
    profiles = table("profiles", lambda: seasonal_profiles(ratio))
    stats = table("stats", lambda: location_stats(ratio, now))
    dim = table("dimension", lambda: dimension.withColumn("category_key", category_key()))
    if run.decided(WHOLE, "gate") is None:
        flat = stuck_runs(flat_runs(stages["steady"])).agg(F.countDistinct("location_id").alias("flat_locations"))
        gate = quality_alert(row_counters(open_readings(readings)).crossJoin(flat), stats).first()     # one row by one row
        run.record(WHOLE, "gate", "blocked" if gate["block_training"] else "open", ",".join(gate["critical"]) or None,
                   detail={k: gate[k] for k in ("severity", "rows_read", "rows_invalid", "invalid_rate", "stale_rate", "flatline_rate", "modeled_locations")})
    allowed = run.decided(WHOLE, "gate")["state"] == "open"

    # -- models
    members = table("members", lambda: facility_units(dim))
    units: dict[str, list[int]] = {}
    for r in members.groupBy("model_key").agg(F.sort_array(F.collect_set("location_id")).alias("places")).collect():
        units[r["model_key"]] = list(r["places"])
    history = ratio.join(dim, "location_id").select("location_id", "facility_id", "bucket_ts")
    models, recent = current_models(spark, store, units), None
    sets = None
    if allowed or models:
        # a folder per unit, so that a unit's fits read only its own
        sets = table("sets", lambda: unit_sets(
            feature_table(history, ratio, raw, profiles, weather, ranges, days, rules, grid=grid), ratio, stats, members), by=["model_key"])
    train_units(run, store, units, sets, at, plan, allowed=allowed, retrain_hours=controls["retrain_hours"])
    models = current_models(spark, store, units)
    if models:
        since = at - dt.timedelta(days=max(config.CONFORMAL_DAYS, controls["drift_days"]))
        lately = sets.filter(F.col("bucket_ts") >= F.lit(since).cast("timestamp_ntz"))
        of_unit = lambda key, model: labelled_scores(model, lately.filter(F.col("model_key") == key).drop("model_key"))
        recent = score_all(run, "recent", models, of_unit, plan.workers)
        act_on_drift(run, store, units, models, recent, at, controls)
        back = {k for k in models if (run.decided(k, "drift") or {}).get("state") == "rolled_back"}
        if back:
            models |= current_models(spark, store, {k: units[k] for k in back})
            again = score_all(run, "recent_restored", {k: models[k] for k in back}, of_unit, plan.workers)
            recent = recent.filter(~F.col("model_key").isin(*back)).unionByName(again)
    widen = spark.createDataFrame(
        [(k, *[run.detail(k, "drift").get(n) for n in ("interval_multiplier", "streak", "force_retrain")]) for k in models],
        "model_key STRING, interval_multiplier DOUBLE, drift_streak INT, force_retrain BOOLEAN")

    # -- estimates of the coming days
    targets = table("targets", lambda: week_targets(dim, now, rules, days=forecast_days, step=grid))
    located = location_targets(dim.select("location_id", "facility_id", "category_key").join(capacity, "location_id", "left"), targets)
    full = located.join(stats.select("location_id", "samples", "is_stale"), "location_id", "left")
    if recent is not None:
        estimates = table("estimates", lambda: model_estimates(
            run, full, located, models, members, recent, widen, sets, readings, raw, ratio, profiles, stats, weather, ranges, days, rules, grid, now, plan))
    else:
        estimates = table("estimates", lambda: flat_estimates(full, profiles))

    groups = dim.select("location_id", "facility_id", "category_key")
    boundary = targets.select("facility_id", "target_ts", "day", "is_boundary")
    categories = group_series(estimates, groups.filter(F.col("category_key").isin(*config.TRAINABLE_CATEGORIES)), ["facility_id", "category_key"])
    live_total = category_live_total(latest_per_location(readings, ["observed_at", "current_capacity"]), groups, now, ["facility_id", "category_key"]).drop("observed")
    points = categories.join(boundary, ["facility_id", "target_ts"])
    points = zero_at_boundary(spike_adjust(points, live_total, ["facility_id", "category_key", "day"], now))
    total = zero_at_boundary(group_series(estimates, groups.select("location_id", "facility_id"), ["facility_id"]).join(boundary, ["facility_id", "target_ts"]))

    limits = occupancy_thresholds(crowd_baseline(ratio, capacity, location_groups(dim), min_points=min_points))
    facility_limits = limits.filter("group_kind = 'facility'").select(F.col("group_key").cast("bigint").alias("facility_id"), "low_max", "peak_min")
    windowed = cut_lineage(total.filter(F.minute("target_ts") % config.WINDOW_MINUTES == 0).join(facility_limits, "facility_id"))
    bands = cut_lineage(crowd_bands(windowed, ["facility_id", "day"]))
    best = windows_from_bands(bands, windowed, ["facility_id", "day"], "low").withColumn("advice", F.lit("best"))
    avoid = windows_from_bands(bands, windowed, ["facility_id", "day"], "peak").withColumn("advice", F.lit("avoid"))
    points = cut_lineage(points.unionByName(total.withColumn("category_key", F.lit("total")), allowMissingColumns=True))
    document = nest_document(points.withColumn("hour_start", F.col("target_ts")))
    return {
        "points": points, "bands": bands, "windows": best.unionByName(avoid), "thresholds": limits, "document": document,
        "estimates": estimates, "models": models, "sets": sets, "report": model_report(run, store, units), "manifest": run.rows(),
    }
