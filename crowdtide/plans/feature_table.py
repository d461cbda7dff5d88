"""The feature table of targets, and preparing features for trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdtide import config
from crowdtide.functions.levels import clamp, missing_share, weather_derived, weather_family
from crowdtide.functions.text import PHASE_FEATURES, schedule_phase
from crowdtide.functions.timeparts import TIME_FEATURES, minute_of_day, shift, time_features
from crowdtide.operators.asof import LAGS, as_of, lag_join
from crowdtide.operators.calendar import CALENDAR_FEATURES, calendar_range_join
from crowdtide.operators.chunks import DAY
from crowdtide.operators.quantiles import quantiles
from crowdtide.operators.rolling_stats import (
    DELTAS, MEAN_HOURS, RANGE_HOURS, STD_HOURS, TRENDS, deltas_and_trends, flatline_steps, rolling_statistics, weather_rolling_mean,
)
from crowdtide.operators.schedule import schedule_resolve
from crowdtide.session import cut_lineage
from crowdtide.sources.weather import weather_as_of

KEYS = ["location_id"]
SENSOR = ("last_bucket", "minutes_since_bucket", "minutes_since_raw", "flat_steps", "missing_recent")
SHARES = ("lag_missing", "delta_missing", "trend_missing", "roll_missing", "dynamics_missing")
WEATHER_NOW = tuple(f"{k}{suffix}" for k in config.WEATHER_KEYS for suffix in ("_now", "_1h", "_delta_1h"))
WEATHER_ROLL = tuple(f"{k}_roll" for k in config.WEATHER_ROLLING_KEYS)
DERIVED = ("weather_precip", "weather_heavy", "weather_cold", "weather_hot", "weather_windy", "weather_humid",
           "weather_clear", "weather_cloudy", "weather_fog", "weather_rain", "weather_snow", "weather_storm")
QUALITY = ("missing_weather_now", "missing_weather_1h", "missing_weather_delta", "missing_weather_roll")

FEATURE_GROUPS = {
    "time_calendar": (*TIME_FEATURES, *CALENDAR_FEATURES),
    "lags_trends_sensor": (*LAGS, *DELTAS, *MEAN_HOURS, *TRENDS, *STD_HOURS, *RANGE_HOURS, *SENSOR, *SHARES, *PHASE_FEATURES),
    "weather": (*WEATHER_NOW, *WEATHER_ROLL, *DERIVED, *QUALITY),
}
FEATURES = tuple(name for group in FEATURE_GROUPS.values() for name in group)


def profile_arrays(profiles: DataFrame) -> DataFrame:
    """Per location the 168 hourly profile values of a week, with fallbacks filled in."""
    level = lambda name: profiles.filter(F.col("level") == name)
    overall = level("overall").select("location_id", F.col("mean_ratio").alias("_all"))
    hours = level("hour").select("location_id", "hour", F.col("mean_ratio").alias("_hour"))
    exact = level("dow_hour").select("location_id", "dow", "hour", F.col("mean_ratio").alias("_exact"))
    cells = overall.withColumn("dow", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    filled = cells.join(exact, ["location_id", "dow", "hour"], "left").join(hours, ["location_id", "hour"], "left").withColumn(
        "_m", F.coalesce("_exact", "_hour", "_all")
    )
    return filled.groupBy("location_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dow", "hour", "_m"))), lambda c: c["_m"]).alias("week_profile")
    )


def weather_features(times: DataFrame, weather: DataFrame, ts: str = "bucket_ts", grid: int = config.RESAMPLE_MINUTES) -> DataFrame:
    """Weather columns per distinct target time; one row per time, whatever the locations."""
    keys = config.WEATHER_KEYS
    full = weather.select("ts", *[F.col(k) if k in weather.columns else F.lit(None).cast("double").alias(k) for k in keys])
    distinct = times.select(ts).distinct()
    both = distinct.select(ts, F.explode(F.array(F.lit(0), F.lit(60))).alias("_back")).withColumn("_at", shift(F.col(ts), minutes=-F.col("_back")))
    found = weather_as_of(both, full, "_at", keys)
    pick = lambda k, back: F.max(F.when(F.col("_back") == back, F.col(k)))
    wide = found.groupBy(ts).agg(*[pick(k, 0).alias(f"{k}_now") for k in keys], *[pick(k, 60).alias(f"{k}_1h") for k in keys])
    wide = wide.withColumns({f"{k}_delta_1h": F.col(f"{k}_now") - F.col(f"{k}_1h") for k in keys})
    span = distinct.agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(grid))
    timeline = span.select(F.explode(F.sequence(shift(F.col("_a"), minutes=-12 * grid), F.col("_b"), step)).alias("_t"))
    rolled = weather_rolling_mean(
        weather_as_of(timeline, full.select("ts", *config.WEATHER_ROLLING_KEYS), "_t", config.WEATHER_ROLLING_KEYS), "_t", grid=grid
    ).select(F.col("_t").alias(ts), *WEATHER_ROLL)
    out = wide.join(rolled, ts, "left")
    flags = weather_derived()
    plain = out.withColumns({k: F.col(f"{k}_now") for k in keys}).withColumns({**flags, **weather_family(F.col("weather_code_now"))})
    return plain.withColumns({
        "missing_weather_now": missing_share([f"{k}_now" for k in keys]), "missing_weather_1h": missing_share([f"{k}_1h" for k in keys]),
        "missing_weather_delta": missing_share([f"{k}_delta_1h" for k in keys]), "missing_weather_roll": missing_share(list(WEATHER_ROLL)),
    }).select(ts, *WEATHER_NOW, *WEATHER_ROLL, *DERIVED, *QUALITY)


def feature_table(
    targets: DataFrame, ratio: DataFrame, raw: DataFrame, profiles: DataFrame, weather: DataFrame, ranges: DataFrame, days: DataFrame,
    rules: DataFrame | None = None, *, grid: int = config.RESAMPLE_MINUTES,
) -> DataFrame:
    """``location_id, facility_id, bucket_ts`` with all 119 features; NULL is missing.

    ``ratio`` is the grid series, ``raw`` the cleaned readings (location_id,
    observed_at, count).  Targets may lie inside the series or after it.
    """
    wanted = targets.select("location_id", "facility_id", "bucket_ts").withColumn("_is_target", F.lit(True))
    series = ratio.select("location_id", "bucket_ts", "ratio")
    grid_rows = series.join(wanted, ["location_id", "bucket_ts"], "full")
    rolled = rolling_statistics(grid_rows, KEYS, grid=grid)
    rolled = flatline_steps(rolled, KEYS, grid=grid).filter("_is_target").drop("_is_target", "ratio")
    lagged = lag_join(rolled, series, KEYS, lags={**LAGS, "lag_15m": grid})
    lagged = lagged.join(profile_arrays(profiles), "location_id", "left")

    def imputed(name, minutes):
        at = shift(F.col("bucket_ts"), minutes=-minutes)
        return F.coalesce(F.col(name), F.try_element_at(F.col("week_profile"), (F.weekday(at) * 24 + F.hour(at) + 1).cast("int")))

    lagged = lagged.withColumns({n: imputed(n, grid if n == "lag_15m" else m) for n, m in LAGS.items()}).drop("week_profile")
    rows = deltas_and_trends(lagged)
    rows = as_of(rows, series.withColumnRenamed("ratio", "last_bucket"), KEYS, "bucket_ts", "bucket_ts", ["last_bucket"], strict=True, ages=True, size=7 * DAY)
    rows = rows.withColumnRenamed("last_bucket_age_min", "minutes_since_bucket")
    rows = as_of(rows, raw.select("location_id", "observed_at", F.col("count").alias("_raw")), KEYS, "bucket_ts", "observed_at", ["_raw"], strict=True, ages=True)
    rows = rows.withColumnRenamed("_raw_age_min", "minutes_since_raw").drop("_raw")
    return rows.join(moment_features(targets, weather, ranges, days, rules, grid=grid), ["facility_id", "bucket_ts"]).select(
        "location_id", "facility_id", "bucket_ts", *[F.col(f).cast("double").alias(f) for f in FEATURES]
    )


def moment_features(targets, weather, ranges, days, rules=None, *, grid: int = config.RESAMPLE_MINUTES) -> DataFrame:
    """Features that depend on the facility and the time only, not on the location.

    Computed once per distinct moment, a table the size of the timeline, and written
    before it is joined to the locations.
    """
    moments = cut_lineage(targets.select("facility_id", "bucket_ts").distinct())
    dates = moments.select(F.to_date("bucket_ts").alias("cal_day")).distinct()
    calendar = calendar_range_join(dates, ranges, days, "cal_day")
    rows = moments.withColumns(time_features(F.col("bucket_ts"), grid)).withColumn("cal_day", F.to_date("bucket_ts"))
    rows = rows.join(calendar, "cal_day").drop("cal_day")
    if rules is None:
        rows = rows.withColumns({p: F.lit(0.0) for p in PHASE_FEATURES})
    else:
        phases = schedule_resolve(moments, rules, "bucket_ts").withColumns(schedule_phase(F.col("window"), minute_of_day(F.col("bucket_ts"))))
        rows = rows.join(phases.select("facility_id", "bucket_ts", *PHASE_FEATURES), ["facility_id", "bucket_ts"], "left")
    return cut_lineage(rows.join(weather_features(moments, cut_lineage(weather), grid=grid), "bucket_ts", "left"))


def sanitize_features(rows: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Non-finite and absurdly large values become missing."""
    sane = lambda c: F.when(~F.isnan(c) & (F.abs(c) <= config.FEATURE_ABS_MAX), F.col(c))
    return rows.withColumns({f: sane(f) for f in features})


def supervised_rows(rows: DataFrame, label: str, weight: str, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Rows with a finite label, positive weight and enough known features."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return rows.filter(finite(label) & finite(weight) & (F.col(weight) > 0) & (1.0 - missing_share(list(features)) >= config.FEATURE_MIN_FINITE))


def missingness_summary(
    rows: DataFrame, locations: int | Column = 0, groups: dict[str, tuple[str, ...]] = FEATURE_GROUPS, keys: list[str] | None = None,
) -> DataFrame:
    """Missing share overall and per group, all-missing rows, and why training is blocked.

    One row, or one per unit with ``keys``.  ``locations`` one-hot columns (a column: the same in
    all rows of a unit) are never missing and dilute the share.
    """
    places = F.max(locations) if isinstance(locations, Column) else F.lit(locations)
    nulls = {g: sum((F.col(c).isNull().cast("long") for c in names[1:]), F.col(names[0]).isNull().cast("long")) for g, names in groups.items()}
    width = sum(len(n) for n in groups.values())
    every = sum(list(nulls.values())[1:], list(nulls.values())[0])
    n = F.count("*")
    summary = rows.groupBy(*(keys or [])).agg(
        n.alias("rows"), F.coalesce(F.sum(every) / (n * (width + places)), F.lit(1.0)).alias("missing_all"),
        F.when(places > 0, 0.0).otherwise(F.coalesce(F.count_if(every == width) / n, F.lit(1.0))).alias("all_missing_rows"),
        *[F.coalesce(F.sum(c) / (n * len(groups[g])), F.lit(1.0)).alias(f"missing_{g}") for g, c in nulls.items()],
    )
    reason = F.when(F.col("rows") < config.MISSING_MIN_ROWS, None).when(F.col("missing_all") > config.MISSING_MAX_ALL, "global_missing_rate_high")
    if "lags_trends_sensor" in groups:
        reason = reason.when(F.col("missing_lags_trends_sensor") > config.MISSING_MAX_LAG, "lag_feature_missing_rate_high")
    if "weather" in groups:
        reason = reason.when(F.col("missing_weather") > config.MISSING_MAX_WEATHER, "weather_feature_missing_rate_high")
    return summary.withColumn("block_reason", reason)


def feature_limits(rows: DataFrame, features: tuple[str, ...] = FEATURES, keys: list[str] | None = None) -> DataFrame:
    """Median fill and clip bounds, one row per feature, or per unit and feature with ``keys``.

    The columns are unrolled to (feature, value) inside the scan stage, where counts per
    bin already combine; no column is ever collected.  Clip bounds hold for filled
    columns, as the fill comes first.
    """
    by = [*(keys or []), "feature"]
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features])
    melted = rows.select(*by[:-1], F.explode(pairs).alias("_p")).select(*by[:-1], "_p.*")
    medians = cut_lineage(quantiles(melted, by, "value", {"fill": 0.5}).drop("n"))
    filled = melted.join(F.broadcast(medians), by, "left").withColumn("value", F.coalesce("value", "fill")).drop("fill")  # one row per feature
    bounds = quantiles(filled, by, "value", {"low": config.CLIP_LOW_Q, "high": config.CLIP_HIGH_Q, "middle": 0.5}).drop("n")
    narrow = F.col("high") - F.col("low") < config.CLIP_MIN_SPREAD
    half = config.CLIP_MIN_SPREAD / 2
    return medians.join(bounds, by).select(
        *by, "fill", F.when(narrow, F.col("middle") - half).otherwise(F.col("low")).alias("low"),
        F.when(narrow, F.col("middle") + half).otherwise(F.col("high")).alias("high"),
    )


def apply_limits(rows: DataFrame, limits: dict[str, tuple[float, float | None, float | None]]) -> DataFrame:
    """Fill missing values and clip.  ``limits`` is small model metadata."""
    out = {}
    for f, (fill, low, high) in limits.items():
        filled = F.coalesce(F.col(f), F.lit(float(fill)))
        out[f] = filled if low is None else clamp(filled, float(low), float(high))
    return rows.withColumns(out)


def apply_unit_limits(rows: DataFrame, limits: DataFrame, keys: list[str], features: tuple[str, ...] = FEATURES) -> DataFrame:
    """``apply_limits`` for rows of many units, each by its own limits; ``limits`` is a written ``feature_limits`` with these keys."""
    entry = F.struct("feature", F.struct("fill", "low", "high"))
    listed = limits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_map"))     # an entry per feature
    in_order = F.transform(F.array(*[F.lit(f) for f in features]), lambda f: F.try_element_at("_map", f))
    of_unit = cut_lineage(listed.select(*keys, in_order.alias("_limits")))      # one row per unit, of known size
    out = {}
    for i, f in enumerate(features):
        own = F.col("_limits")[i]
        filled = F.coalesce(F.col(f), own["fill"], F.lit(0.0))
        out[f] = F.when(own["low"].isNull(), filled).otherwise(clamp(filled, own["low"], own["high"]))
    return rows.join(of_unit, keys, "left").withColumns(out).drop("_limits")


def collect_limits(rows: DataFrame, features: tuple[str, ...] = FEATURES) -> dict[str, tuple[float, float | None, float | None]]:
    """Limits as metadata: one entry per feature; never-seen features fill with 0."""
    found = {r["feature"]: (r["fill"], r["low"], r["high"]) for r in feature_limits(rows, features).collect()}
    return {f: found.get(f, (0.0, None, None)) for f in features}
