"""From raw readings to a clean ratio series on the sampling grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdtide import config
from crowdtide.functions.levels import clamp, finite
from crowdtide.functions.timeparts import epoch_micros, grid_start
from crowdtide.operators.chunks import MINUTE, number_islands, previous_row
from crowdtide.operators.kept_rows import keep_chained, keep_spaced
from crowdtide.session import cut_lineage


def open_readings(readings: DataFrame, since=None) -> DataFrame:
    """Readings with a count from locations not reported closed; filters reach the scan."""
    kept = readings.filter(
        F.col("current_capacity").isNotNull() & (F.col("is_closed").isNull() | ~F.col("is_closed"))
    )
    return kept if since is None else kept.filter(F.col("fetched_at") >= since)


def valid_reading() -> Column:
    """The row's id and count are usable numbers and it has a time."""
    count = finite(F.col("current_capacity").try_cast("double"))
    return (
        F.col("location_id").try_cast("long").isNotNull()
        & count.isNotNull() & (count >= 0) & F.col("observed_at").isNotNull()
    )


def drop_invalid_rows(readings: DataFrame) -> DataFrame:
    """Typed, usable rows only."""
    return readings.filter(F.coalesce(valid_reading(), F.lit(False))).withColumns({
        "location_id": F.col("location_id").try_cast("long"),
        "current_capacity": F.col("current_capacity").try_cast("double"),
    })


def capacity_max(readings: DataFrame) -> DataFrame:
    """Largest positive capacity reported per location; locations without one drop out."""
    cap = F.max(F.when(F.col("max_capacity") > 0, F.col("max_capacity")))
    return readings.groupBy("location_id").agg(cap.cast("int").alias("max_cap")).filter("max_cap IS NOT NULL")


def dedupe_timestamps(readings: DataFrame) -> DataFrame:
    """One row per (location, time) with the mean count; ``removed`` counts the others."""
    return readings.groupBy("location_id", "observed_at").agg(
        F.avg("current_capacity").alias("count"), (F.count("*") - 1).alias("removed")
    )


def drop_impossible_jumps(series: DataFrame) -> DataFrame:
    """Drop a row that moves too far, too soon, from the last kept row of its location.

    Needs ``location_id, observed_at, count, max_cap`` with unique times.
    """
    gap = config.JUMP_MAX_GAP_MIN * MINUTE

    def accepts(last, row):
        return (row["us"] - last["us"] > gap) | (F.abs(row["count"] - last["count"]) <= last["max_cap"] * F.lit(config.JUMP_SHARE))

    return keep_chained(series, ["location_id"], "observed_at", ["count", "max_cap"], accepts, gap)


def flat_runs(series: DataFrame) -> DataFrame:
    """Rows with a run number; a run goes on while time and count hardly move."""
    gap = config.FLAT_MAX_GAP_MIN * MINUTE
    stepped = previous_row(series, ["location_id"], "observed_at", ["observed_at", "count"])
    goes_on = (
        (epoch_micros(F.col("observed_at")) - epoch_micros(F.col("prev_observed_at")) <= gap)
        & (F.abs(F.col("count") - F.col("prev_count")) <= F.col("max_cap") * config.FLAT_TOLERANCE)
    )
    flagged = stepped.withColumn("_starts", ~F.coalesce(goes_on, F.lit(False))).drop("prev_observed_at", "prev_count")
    return number_islands(flagged, ["location_id"], "observed_at", "_starts", "run").drop("_starts")


def stuck_runs(runs: DataFrame) -> DataFrame:
    """Runs that last long at a level that is neither empty nor full."""
    us = epoch_micros(F.col("observed_at"))
    return (
        runs.groupBy("location_id", "run")
        .agg(
            F.min(us).alias("_start"), F.max(us).alias("_end"), F.count("*").alias("rows"),
            F.max_by("count", us).alias("level"), F.max("max_cap").alias("_cap"),
        )
        .filter(
            (F.col("_end") - F.col("_start") >= config.FLAT_MIN_DURATION_MIN * MINUTE)
            & (F.col("level") > 1.0) & (F.col("level") < F.greatest(F.lit(1.0), F.col("_cap") - 1.0))
        )
        .select("location_id", "run", "rows", "level")
    )


def thin_flatlines(series: DataFrame) -> DataFrame:
    """Keep one reading an hour of a stuck run, and every other reading."""
    runs = cut_lineage(flat_runs(series))  # read for the stuck runs and again to be thinned
    marked = runs.join(
        stuck_runs(runs).select("location_id", "run", F.lit(True).alias("_stuck")), ["location_id", "run"], "left"
    )
    thinned = keep_spaced(
        marked.filter("_stuck").drop("_stuck"), ["location_id", "run"], "observed_at", config.FLAT_KEEP_MIN * MINUTE, config.FLAT_MAX_GAP_MIN * MINUTE
    )
    return marked.filter(F.col("_stuck").isNull()).select(*series.columns).unionByName(thinned.select(*series.columns))


def resample_ratio(series: DataFrame, minutes: int = config.RESAMPLE_MINUTES) -> DataFrame:
    """Mean count per grid step and its share of the capacity, in [0, 1.2]."""
    step = grid_start(F.col("observed_at"), minutes)
    grid = (
        series.groupBy("location_id", step.alias("bucket_ts"))
        .agg(F.avg("count").alias("mean_count"), F.max("max_cap").alias("max_cap"))
        .filter("max_cap > 0")
    )
    return grid.withColumn("ratio", clamp(F.col("mean_count") / F.col("max_cap"), 0.0, config.RATIO_MAX))


def seasonal_profiles(ratio: DataFrame) -> DataFrame:
    """Mean and count by (location, weekday, hour), (location, hour) and location."""
    parts = ratio.select(
        "location_id", F.weekday("bucket_ts").alias("dow"), F.hour("bucket_ts").alias("hour"), "ratio"
    )
    sets = [["location_id", "dow", "hour"], ["location_id", "hour"], ["location_id"]]
    return (
        parts.groupingSets([[F.col(c) for c in s] for s in sets], "location_id", "dow", "hour")
        .agg(
            F.avg("ratio").alias("mean_ratio"), F.count("*").alias("n"),
            F.when(F.grouping("hour") == 1, "overall").when(F.grouping("dow") == 1, "hour")
            .otherwise("dow_hour").alias("level"),
        )
    )


def location_stats(ratio: DataFrame, now) -> DataFrame:
    """Grid steps per location, its newest time, and whether it has gone quiet."""
    return ratio.groupBy("location_id").agg(
        F.count("*").alias("samples"), F.max("bucket_ts").alias("latest_ts")
    ).withColumn(
        "is_stale", F.unix_timestamp(F.lit(now)) - F.unix_timestamp("latest_ts") > config.STALE_HOURS * 3600
    )


def eligible_locations(stats: DataFrame, capacity: DataFrame) -> DataFrame:
    """Locations with enough fresh samples and a capacity."""
    return (
        stats.filter((F.col("samples") >= config.MIN_SAMPLES_PER_LOCATION) & ~F.col("is_stale"))
        .join(capacity, "location_id").filter("max_cap > 0")
    )


def clean_history(readings: DataFrame) -> dict[str, DataFrame]:
    """Valid rows -> one per time -> no jumps -> thinned flat runs, with capacity."""
    valid = drop_invalid_rows(readings)
    capacity = cut_lineage(capacity_max(valid))
    deduped = dedupe_timestamps(valid).join(capacity, "location_id").select(
        "location_id", "observed_at", "count", "max_cap"
    )
    steady = drop_impossible_jumps(deduped)
    return {"valid": valid, "capacity": capacity, "deduped": deduped, "steady": steady, "clean": thin_flatlines(steady)}


def row_counters(readings: DataFrame, schedule_state: str | None = None) -> DataFrame:
    """Rows read, invalid, closed, unknown and zeroed, in one pass over the readings."""
    ok = F.coalesce(valid_reading(), F.lit(False))
    aggregates = [F.count("*").alias("rows_read"), F.count_if(~ok).alias("rows_invalid")]
    if schedule_state is not None:
        state, edge, shut = F.col(schedule_state), F.col("is_boundary"), F.col("is_close_minute")
        closed = ok & (state == "closed")
        aggregates += [
            F.count_if(ok & state.isNotNull()).alias("rows_evaluated"),
            F.count_if(closed & ~shut).alias("rows_closed"),
            F.count_if(closed & shut).alias("rows_closed_kept"),
            F.count_if(ok & (state == "unknown")).alias("rows_unknown"),
            F.count_if(ok & edge).alias("rows_zeroed"),
        ]
    return readings.agg(*aggregates)


def series_counters(stages: dict[str, DataFrame]) -> DataFrame:
    """Duplicates, jumps and flat-run rows removed, and stuck runs, from stage sizes."""
    sizes = None
    for name in ("valid", "deduped", "steady", "clean"):
        part = stages[name]
        if name == "valid":
            part = part.join(stages["capacity"], "location_id", "left_semi")
        part = part.agg(F.count("*").alias(name))
        sizes = part if sizes is None else sizes.crossJoin(part)  # one row by one row
    stuck = stuck_runs(flat_runs(stages["steady"])).agg(
        F.count("*").alias("flat_runs"), F.countDistinct("location_id").alias("flat_locations")
    )
    return sizes.crossJoin(stuck).select(
        (F.col("valid") - F.col("deduped")).alias("duplicates_removed"),
        (F.col("deduped") - F.col("steady")).alias("jumps_removed"),
        (F.col("steady") - F.col("clean")).alias("flat_rows_removed"),
        "flat_runs", "flat_locations",
    )


def quality_alert(counters: DataFrame, stats: DataFrame) -> DataFrame:
    """Severity of the three rates and of the number of usable locations.

    ``counters`` is one row with ``rows_read, rows_invalid, flat_locations``.
    """
    located = stats.agg(
        F.count("*").alias("_locations"), F.count_if("is_stale").alias("_stale"),
        F.count_if((F.col("samples") >= config.MIN_SAMPLES_PER_LOCATION) & ~F.col("is_stale")).alias("modeled_locations"),
    )
    base = F.greatest(F.lit(1), F.col("_locations"))
    rated = counters.crossJoin(located).withColumns({  # one row by one row
        "invalid_rate": F.coalesce(F.try_divide(F.col("rows_invalid"), F.col("rows_read")), F.lit(0.0)),
        "stale_rate": F.col("_stale") / base,
        "flatline_rate": F.col("flat_locations") / base,
    })
    limits = {
        "invalid_rate": ("invalid_row_rate", config.MAX_INVALID_RATE),
        "stale_rate": ("stale_location_rate", config.MAX_STALE_RATE),
        "flatline_rate": ("flatline_location_rate", config.MAX_FLATLINE_RATE),
    }
    critical = [F.when(F.col(c) > top, F.lit(f"{label}_high")) for c, (label, top) in limits.items()]
    critical.append(F.when(F.col("modeled_locations") < config.MIN_LOCATIONS, F.lit("modeled_locations_too_low")))
    warnings = [
        F.when((F.col(c) > top * config.WARN_SHARE) & (F.col(c) <= top), F.lit(f"{label}_elevated"))
        for c, (label, top) in limits.items()
    ]
    return (
        rated.withColumn("critical", F.array_compact(F.array(*critical)))
        .withColumn("warnings", F.array_compact(F.array(*warnings)))
        .withColumn(
            "severity",
            F.when(F.size("critical") > 0, "critical").when(F.size("warnings") > 0, "warning").otherwise("ok"),
        )
        .select(
            "severity", (F.col("severity") == "critical").alias("block_training"), "rows_read", "rows_invalid",
            F.bround("invalid_rate", 4).alias("invalid_rate"), F.bround("stale_rate", 4).alias("stale_rate"),
            F.bround("flatline_rate", 4).alias("flatline_rate"), "modeled_locations", "warnings", "critical",
        )
    )
