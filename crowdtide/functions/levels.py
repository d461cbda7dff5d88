"""Rounding, tones, weather flags, row weights and alert text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crowdtide import config


def clamp(value: Column, low: float | Column, high: float | Column) -> Column:
    """NULL stays NULL, unlike the bare greatest/least functions."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(value.isNotNull(), F.least(F.greatest(value, as_col(low)), as_col(high)))


def finite(value: Column) -> Column:
    """The value, or NULL for NaN and the infinities."""
    value = value.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def occupancy_ratio(count: Column, capacity: Column) -> Column:
    return clamp(finite(count / F.nullif(capacity.cast("double"), F.lit(0.0))), 0.0, config.RATIO_MAX)


def round_half_even(value: Column, scale: int = 0) -> Column:
    return F.bround(value, scale)


def whole_count(value: Column) -> Column:
    """Half-even count, never negative.

    Rounded to six decimals first, so that the order in which a distributed sum was
    added up cannot tip an exact half.
    """
    return F.greatest(F.lit(0), F.bround(F.round(value, 6)).cast("long"))


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def occupancy_tone(percent: Column, low_max: Column, peak_min: Column) -> Column:
    """low / medium / peak; NULL when the share or either threshold is unknown."""
    low = clamp(low_max.cast("double"), 0.0, 99.0)
    peak = F.greatest(low + 1.0, F.least(F.lit(100.0), peak_min.cast("double")))
    known = low_max.isNotNull() & peak_min.isNotNull() & percent.isNotNull()
    return F.when(known, F.when(percent <= low, "low").when(percent < peak, "medium").otherwise("peak"))


def crowd_level(percent: Column, low_max: Column, peak_min: Column) -> Column:
    """Band label; the peak test comes first."""
    return F.when(percent >= peak_min, "peak").when(percent <= low_max, "low").otherwise("medium")


def alert_message(facility: Column, section: Column, percent: Column, threshold: Column) -> Column:
    place = F.when(section == "overall", "entire facility").otherwise(
        F.coalesce(F.nullif(section, F.lit("")), F.lit("Selected area"))
    )
    return F.format_string(
        "%s %s is %d%% full (at or below your %d%% alert).",
        F.coalesce(facility, F.lit("Gym")), place, percent.cast("int"), threshold.cast("int"),
    )


def alert_link(facility_id: Column) -> Column:
    return F.concat(F.lit("/?facility="), facility_id.cast("string"))


def weather_family(code: Column) -> dict[str, Column]:
    """Six flags of the WMO weather code; all 0 when it is missing."""
    c = F.bround(code).cast("int")
    flags = {
        "weather_clear": c.isin(0, 1),
        "weather_cloudy": c.isin(2, 3),
        "weather_fog": c.isin(45, 48),
        "weather_rain": c.between(51, 67) | c.between(80, 82),
        "weather_snow": c.between(71, 77) | c.between(85, 86),
        "weather_storm": c.between(95, 99),
    }
    return {name: F.coalesce(flag, F.lit(False)).cast("double") for name, flag in flags.items()}


def weather_derived(prefix: str = "") -> dict[str, Column]:
    c = lambda name: F.col(prefix + name)
    flags = {
        "weather_precip": (c("precip_mm") > 0.05, c("rain_mm") > 0.05, c("snow_cm") > 0.05),
        "weather_heavy": (c("precip_mm") >= 1.5, c("rain_mm") >= 1.5, c("snow_cm") >= 0.8),
        "weather_cold": (c("temp_c") <= 2.0,),
        "weather_hot": (c("temp_c") >= 27.0,),
        "weather_windy": (c("wind_mps") >= 6.0, c("wind_gust_mps") >= 10.0),
        "weather_humid": (c("humidity_pct") >= 80.0,),
    }
    out = {}
    for name, tests in flags.items():
        known = [F.coalesce(test, F.lit(False)) for test in tests]
        combined = known[0]
        for test in known[1:]:
            combined = combined | test
        out[name] = combined.cast("double")
    return out


def missing_share(names: list[str]) -> Column:
    """Share of NULL columns among the named ones."""
    total = F.lit(0)
    for name in names:
        total = total + F.col(name).isNull().cast("int")
    return total / float(len(names))


def sensor_weight(steps: Column, missing: Column, age_minutes: Column) -> Column:
    flat = clamp(steps / 8.0 * 0.6, 0.0, 0.6)
    gaps = clamp(clamp(missing, 0.0, 1.0) * 0.5, 0.0, 0.5)
    old = clamp(F.greatest(F.lit(0.0), age_minutes - 120.0) / 360.0, 0.0, 0.4)
    # A first reading has no age and takes no age penalty.
    return clamp(1.0 - flat - gaps - F.coalesce(old, F.lit(0.0)), config.SENSOR_WEIGHT_MIN, 1.0)


def feature_quality_weight(missing: Column) -> Column:
    low = config.FEATURE_WEIGHT_MIN
    return clamp(low + (1.0 - low) * F.pow(1.0 - clamp(missing, 0.0, 1.0), config.FEATURE_WEIGHT_POWER), low, 1.0)


def occupancy_weight(ratio: Column) -> Column:
    level = clamp(F.coalesce(finite(ratio), F.lit(0.0)), 0.0, config.RATIO_MAX)
    return 1.0 + config.OCCUPANCY_ALPHA * F.pow(level, config.OCCUPANCY_GAMMA)


def recency_weight(ts: Column, newest: Column) -> Column:
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(newest) - F.unix_timestamp(ts)) / 86400.0)
    return F.greatest(F.lit(config.RECENCY_FLOOR), F.pow(F.lit(2.0), -age / config.RECENCY_HALFLIFE_DAYS))


def transition_weight(near_open: Column, near_close: Column) -> Column:
    edge = F.greatest(clamp(near_open, 0.0, 1.0), clamp(near_close, 0.0, 1.0))
    return 1.0 + (config.TRANSITION_MULTIPLIER - 1.0) * F.coalesce(edge, F.lit(0.0))
