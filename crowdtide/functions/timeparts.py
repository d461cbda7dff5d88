"""Time expressions on wall-clock timestamps (TIMESTAMP_NTZ)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdtide import config


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a wall-clock time; no session zone is involved."""
    return F.unix_timestamp(ts)


def epoch_micros(ts: Column) -> Column:
    fraction = F.date_part(F.lit("SECOND"), ts) % 1
    return F.unix_timestamp(ts) * 1_000_000 + (fraction * 1_000_000).cast("long")


def shift(ts: Column, *, minutes: int | Column = 0) -> Column:
    """Wall-clock shift by whole minutes."""
    amount = F.lit(minutes) if isinstance(minutes, int) else minutes
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), amount.cast("int"), F.lit(0).cast("decimal(18,6)"))


def grid_start(ts: Column, minutes: int = config.RESAMPLE_MINUTES) -> Column:
    """Floor to the sampling grid."""
    return F.window(ts, f"{minutes} minutes")["start"]


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def at_minute(day: Column, minute: Column) -> Column:
    """Wall-clock time of a date and a minute of day (1440 is the next midnight)."""
    return shift(day.cast("timestamp_ntz"), minutes=minute)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


TIME_FEATURES = (
    "hour", "minute", "quarter_slot", "dow", "month", "day_of_year", "is_weekend",
    "hour_sin", "hour_cos", "minute_sin", "minute_cos", "dow_sin", "dow_cos",
    "month_sin", "month_cos", "doy_sin", "doy_cos",
)


def time_features(ts: Column, minutes: int = config.RESAMPLE_MINUTES) -> dict[str, Column]:
    """The 17 calendar-cycle features of a target time; weeks start on Monday."""
    parts = {
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "quarter_slot": F.floor(F.minute(ts) / minutes),
        "dow": F.weekday(ts),
        "month": F.month(ts),
        "day_of_year": F.dayofyear(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
    }
    angles = {
        "hour": parts["hour"] / 24,
        "minute": minute_of_day(ts) / 1440.0,
        "dow": parts["dow"] / 7,
        "month": (parts["month"] - 1) / 12,
        "doy": parts["day_of_year"] / 365.25,
    }
    out = {name: column.cast("double") for name, column in parts.items()}
    for name, turn in angles.items():
        out[f"{name}_sin"] = F.sin(turn * (2 * math.pi))
        out[f"{name}_cos"] = F.cos(turn * (2 * math.pi))
    return out


# --- fixed values: labels and limits of hours, days, ratio classes and horizons ---
def hour_block(hour: Column) -> Column:
    return (
        F.when(hour < 6, "overnight").when(hour < 12, "morning").when(hour < 17, "midday")
        .when(hour < 21, "evening").otherwise("late")
    )


def union_targets(*targets: DataFrame, column: str = "target_ts") -> DataFrame:
    """Target times of several grids, each once."""
    first, *others = (t.select(column) for t in targets)
    for more in others:
        first = first.union(more)
    return first.distinct()


def day_type(ts: Column) -> Column:
    return F.when(F.weekday(ts) >= 5, "weekend").otherwise("weekday")


def occupancy_class(ratio: Column) -> Column:
    return F.when(ratio < 0.35, "low").when(ratio < 0.75, "mid").otherwise("high")


def horizon_hours(target: Column, now: Column) -> Column:
    """Whole hours ahead, never negative."""
    return F.greatest(F.lit(0), F.floor((epoch_seconds(target) - epoch_seconds(now)) / 3600.0))


def horizon_bucket(hours: Column) -> Column:
    return (
        F.when(hours <= 2, "0_2h").when(hours <= 6, "3_6h").when(hours <= 12, "7_12h")
        .when(hours <= 24, "13_24h").otherwise("25h_plus")
    )
# -----------------------------------------------------------------------------------


def targets_for_days(
    days: DataFrame,
    day: str = "day",
    *,
    step_minutes: int = config.RESAMPLE_MINUTES,
    start_hour: int = config.DAY_START_HOUR,
    end_hour: int = config.DAY_END_HOUR,
    elapsed: bool = False,
    zone: str = config.LOCAL_ZONE,
) -> DataFrame:
    """One row per target time of each date, from the first to past the last hour.

    By default steps are wall-clock steps.  ``elapsed=True`` steps through real
    time in ``zone``, so a day with a clock change gets more or fewer targets.
    """
    begin = at_minute(F.col(day), F.lit(start_hour * 60))
    last = at_minute(F.col(day), F.lit((end_hour + 1) * 60 - step_minutes))
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(step_minutes), F.lit(0).cast("decimal(18,6)"))
    if not elapsed:
        return days.withColumn("target_ts", F.explode(F.sequence(begin, last, step)))
    to_utc = lambda c: F.convert_timezone(F.lit(zone), F.lit("UTC"), c)
    return (
        days.withColumn("_utc", F.explode(F.sequence(to_utc(begin), to_utc(last), step)))
        .withColumn("target_ts", F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("_utc")))
        .drop("_utc")
    )


_ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def parse_local(
    text: Column,
    *,
    stored_zone: str = config.LOCAL_ZONE,
    local_zone: str = config.LOCAL_ZONE,
) -> Column:
    """ISO text with or without offset -> local wall-clock time, NULL if unreadable.

    Text without an offset is a wall-clock time of ``stored_zone``.  All steps stay
    in TIMESTAMP_NTZ, so the session zone never enters.
    """
    value = F.trim(text)
    readable = value.rlike(_ISO_SHAPE)
    wall_text = F.regexp_replace(F.regexp_replace(value, r"(Z|[+-]\d{2}:?\d{2})$", ""), "T", " ")
    # A bare date ends in something that looks like an offset ("-03"); keep it whole.
    wall_text = F.when(F.length(value) <= 10, value).otherwise(wall_text)
    wall = wall_text.try_cast("timestamp_ntz")
    offset = F.regexp_extract(value, r"[T ].*?(Z|[+-]\d{2}:?\d{2})$", 1)
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(offset, r"[^0-9]", "")
    minutes = sign * (
        F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    )
    utc = F.when(offset == "Z", wall).when(offset != "", shift(wall, minutes=-minutes))
    local = F.coalesce(
        F.convert_timezone(F.lit("UTC"), F.lit(local_zone), utc),
        wall if stored_zone == local_zone else F.convert_timezone(F.lit(stored_zone), F.lit(local_zone), wall),
    )
    return F.when(readable, local)


def resolve_observed_at(
    last_updated: Column,
    fetched_at: Column,
    *,
    stored_zone: str = config.LOCAL_ZONE,
    local_zone: str = config.LOCAL_ZONE,
) -> Column:
    """The reading's own stamp, or the time it was fetched when that is unreadable."""
    fetched = (
        fetched_at
        if stored_zone == local_zone
        else F.convert_timezone(F.lit(stored_zone), F.lit(local_zone), fetched_at)
    )
    return F.coalesce(parse_local(last_updated, stored_zone=stored_zone, local_zone=local_zone), fetched)


def local_to_utc(ts: Column, zone: str = config.LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def day_age(ts: Column, now: Column) -> Column:
    """Whole local days between a reading and now, never negative."""
    return F.greatest(F.lit(0), F.date_diff(F.to_date(now), F.to_date(ts)))
