"""Crowd bands: labels over one day of one series, joined into intervals.

``keys`` always name one day of one series, so every window below holds at most a
day of grid steps, however many days and series there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdtide import config
from crowdtide.functions.levels import clamp, crowd_level
from crowdtide.functions.timeparts import shift

MINUTE_S = 60


def _seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def infer_step_minutes(points: DataFrame, keys: list[str], ts: str = "target_ts") -> DataFrame:
    """Smallest positive distance of neighbouring points; the grid step if there is none."""
    gap = F.bround((_seconds(F.col(ts)) - F.lag(_seconds(F.col(ts))).over(Window.partitionBy(*keys).orderBy(ts))) / 60.0)
    return points.withColumn("_gap", gap).groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("_gap") > 0, F.col("_gap"))), F.lit(config.RESAMPLE_MINUTES)).cast("int").alias("step_min")
    )


def label_points(points: DataFrame) -> DataFrame:
    """Band label of each point from its share of the capacity and the thresholds."""
    percent = clamp(F.col("expected") / F.col("capacity") * 100.0, 0.0, 100.0)
    low = clamp(F.coalesce("low_max", "peak_min").cast("double"), 0.0, 99.0)
    peak = F.greatest(low + 1.0, F.least(F.lit(100.0), F.coalesce("peak_min", "low_max").cast("double")))
    return points.filter((F.col("capacity") > 0) & F.coalesce("low_max", "peak_min").isNotNull()).withColumn(
        "level", crowd_level(percent, low, peak)
    )


def label_runs(labelled: DataFrame, keys: list[str], ts: str = "target_ts", step: str = "step_min") -> DataFrame:
    """Maximal runs of one label without a gap larger than the step."""
    order = Window.partitionBy(*keys).orderBy(ts)
    same = (F.col("level") == F.lag("level").over(order)) & (
        _seconds(F.col(ts)) - F.lag(_seconds(F.col(ts))).over(order) <= F.col(step) * MINUTE_S
    )
    return (
        labelled.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int"))
        .withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "run")
        .agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.first("level").alias("level"), F.max(step).alias(step))
    )


def bridge_once(runs: DataFrame, keys: list[str], step: str = "step_min", bridge_minutes: int = config.BRIDGE_MINUTES) -> DataFrame:
    """A short run between two equal neighbours takes their label.

    Neighbours are judged by the labels the runs came with.
    """
    order = Window.partitionBy(*keys).orderBy("run")
    step_s = F.col(step) * MINUTE_S
    bridged = (
        (F.lag("level").over(order) == F.lead("level").over(order))
        & (_seconds(F.col("last")) + step_s - _seconds(F.col("start")) <= bridge_minutes * MINUTE_S)
        & (_seconds(F.col("start")) - F.lag(_seconds(F.col("last"))).over(order) <= step_s)
        & (F.lead(_seconds(F.col("start"))).over(order) - _seconds(F.col("last")) <= step_s)
    )
    return runs.withColumn(
        "level", F.when(F.coalesce(bridged, F.lit(False)), F.lag("level").over(order)).otherwise(F.col("level"))
    )


def runs_to_bands(runs: DataFrame, keys: list[str], step: str = "step_min") -> DataFrame:
    """Join touching runs of one label; a band ends one step after its last point."""
    order = Window.partitionBy(*keys).orderBy("start")
    same = (F.col("level") == F.lag("level").over(order)) & (
        _seconds(F.col("start")) - F.lag(_seconds(F.col("last"))).over(order) <= F.col(step) * MINUTE_S
    )
    return (
        runs.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int"))
        .withColumn("band", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "band")
        .agg(F.min("start").alias("start"), F.max("last").alias("_last"), F.first("level").alias("level"), F.max(step).alias("_step"))
        .withColumn("end", shift(F.col("_last"), minutes=F.col("_step")))
        .drop("_last", "_step")
    )


def crowd_bands(points: DataFrame, keys: list[str], *, bridge: bool = True) -> DataFrame:
    """Thresholded points -> bands (start, end, level) per day and series."""
    steps = infer_step_minutes(points, keys)
    runs = label_runs(label_points(points).join(steps, keys), keys)
    return runs_to_bands(bridge_once(runs, keys) if bridge else runs, keys)


def windows_from_bands(bands: DataFrame, points: DataFrame, keys: list[str], level: str, ts: str = "target_ts") -> DataFrame:
    """Bands of one level with the sum, mean, least samples and number of their points."""
    chosen = bands.filter(F.col("level") == level).filter(F.col("end") > F.col("start"))
    return window_metrics(chosen, points, keys, ts).withColumns({
        "start_hour": F.hour("start"), "end_hour": F.hour("end"),
        "window_hours": F.bround((_seconds(F.col("end")) - _seconds(F.col("start"))) / 3600.0, 2),
    })


def window_metrics(windows: DataFrame, points: DataFrame, keys: list[str], ts: str = "target_ts") -> DataFrame:
    """Sum, mean, least sample count and number of points in [start, end)."""
    inside = points.select(*keys, F.col(ts).alias("_ts"), "expected", "sample_count")
    joined = windows.select(*keys, "start", "end").join(inside, keys, "left").withColumn(
        "_in", (F.col("_ts") >= F.col("start")) & (F.col("_ts") < F.col("end"))
    )
    hours = F.greatest(F.lit(1), F.bround((_seconds(F.col("end")) - _seconds(F.col("start"))) / 3600.0).cast("long"))
    return (
        joined.groupBy(*keys, "start", "end")
        .agg(
            F.coalesce(F.sum(F.when(F.col("_in"), F.col("expected"))), F.lit(0)).cast("long").alias("expected_total"),
            F.coalesce(F.min(F.when(F.col("_in"), F.col("sample_count"))), F.lit(0)).cast("long").alias("sample_count_min"),
            F.count_if("_in").alias("_points"),
        )
        .withColumn("window_points", F.when(F.col("_points") > 0, F.col("_points")).otherwise(hours))
        .withColumn("expected_avg", F.bround(F.col("expected_total") / F.col("window_points"), 2))
        .drop("_points")
    )


def merge_adjacent_bands(bands: DataFrame, keys: list[str], tolerance_s: int = 60) -> DataFrame:
    """Join neighbouring bands of one level that touch within a minute."""
    order = Window.partitionBy(*keys).orderBy("start")
    same = (F.col("level") == F.lag("level").over(order)) & (
        F.abs(_seconds(F.col("start")) - F.lag(_seconds(F.col("end"))).over(order)) <= tolerance_s
    )
    return (
        bands.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int"))
        .withColumn("_band", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_band")
        .agg(F.min("start").alias("start"), F.max_by("end", "start").alias("end"), F.first("level").alias("level"))
        .drop("_band")
    )


def _merged(bands: Column, tolerance_s: int, kind: T.ArrayType) -> Column:
    """Touching bands of one level of a day joined; ``bands`` is in order of start."""
    def join(done, band):
        last = F.get(done, F.size(done) - 1)
        touches = (last["level"] == band["level"]) & (F.abs(_seconds(band["start"]) - _seconds(last["end"])) <= tolerance_s)
        longer = F.struct(last["start"].alias("start"), band["end"].alias("end"), last["level"].alias("level"))
        return F.when(F.coalesce(touches, F.lit(False)), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(band)))

    return F.aggregate(bands, F.array().cast(kind), join)


def _bridged(bands: Column, bridge_s: int, tolerance_s: int) -> Column:
    """Short bands between two equal neighbours that touch them take the neighbours' level, all at once."""
    def relabel(band, place):
        before, after = F.get(bands, place - 1), F.get(bands, place + 1)
        short = (
            (before["level"] == after["level"]) & (band["level"] != before["level"])
            & (F.abs(_seconds(band["start"]) - _seconds(before["end"])) <= tolerance_s)
            & (F.abs(_seconds(after["start"]) - _seconds(band["end"])) <= tolerance_s)
            & (_seconds(band["end"]) - _seconds(band["start"]) <= bridge_s)
        )
        level = F.when(F.coalesce(short, F.lit(False)), before["level"]).otherwise(band["level"])
        return F.struct(band["start"].alias("start"), band["end"].alias("end"), level.alias("level"))

    return F.transform(bands, relabel)


def bridge_bands_until_stable(
    bands: DataFrame, keys: list[str], *, bridge_minutes: int = config.BRIDGE_MINUTES, tolerance_s: int = 60
) -> DataFrame:
    """Bridge and merge until nothing changes.

    A day's bands are one short array.  A round that changes anything takes two bands away
    from it, so half as many rounds as bands reach the fixpoint, whatever the bands are;
    rounds after it change nothing.  Everything is one fold per day, and no job runs before
    the result is asked for.
    """
    day = bands.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "level"))).alias("_bands"))
    kind = day.schema["_bands"].dataType
    # a round per element: the merge before the first one, then bridging and merging
    rounds = F.sequence(F.lit(0), F.floor(F.size("_bands") / 2).cast("int"))
    step = lambda held, k: _merged(F.when(k > 0, _bridged(held, bridge_minutes * MINUTE_S, tolerance_s)).otherwise(held), tolerance_s, kind)
    return day.select(*keys, F.inline(F.aggregate(rounds, F.col("_bands"), step)))


def band_at_midpoint(slots: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """Level of the first band over the middle of a slot, else the slot's own level."""
    middle = (_seconds(F.col("start")) + _seconds(F.col("end"))) / 2
    ranges = bands.filter(F.col("end") > F.col("start")).select(
        *keys, _seconds(F.col("start")).alias("_bs"), _seconds(F.col("end")).alias("_be"), F.col("level").alias("_bl")
    )
    over = slots.withColumn("_mid", middle).select(*keys, "start", "_mid").join(ranges, keys).filter(
        (F.col("_mid") >= F.col("_bs")) & (F.col("_mid") < F.col("_be"))
    ).groupBy(*keys, "start").agg(F.min_by("_bl", "_bs").alias("_found"))
    return slots.join(over, [*keys, "start"], "left").withColumn("level", F.coalesce("_found", "level")).drop("_found")


def clip_to_open_windows(intervals: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of intervals inside the open windows of their day; none without windows.

    ``windows`` has minutes of day; the day is the ``day`` column of the keys.
    """
    from crowdtide.functions.timeparts import at_minute

    opened = windows.select(
        *keys, at_minute(F.col("day"), F.col("start_min")).alias("_ws"), at_minute(F.col("day"), F.col("end_min")).alias("_we")
    )
    return (
        intervals.join(opened, keys)
        .withColumn("_s", F.greatest("start", "_ws")).withColumn("_e", F.least("end", "_we"))
        .filter(F.col("_s") < F.col("_e"))
        .withColumns({"start": F.col("_s"), "end": F.col("_e")})
        .drop("_s", "_e", "_ws", "_we")
    )


def contained_in_open_window(slots: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Slots (minutes of day) that lie wholly in one open window of their day."""
    opened = windows.select(*[F.col(k).alias(f"_w_{k}") for k in keys], F.col("start_min").alias("_ws"), F.col("end_min").alias("_we"))
    same = (F.col("start_min") >= F.col("_ws")) & (F.col("end_min") <= F.col("_we"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_w_{k}"))
    return slots.join(opened, same, "left_semi")


def current_band(bands: DataFrame, now) -> DataFrame:
    now = now if isinstance(now, Column) else F.lit(now)
    return bands.filter((F.col("start") <= now) & (F.col("end") > now))


def smooth_isolated(hourly: DataFrame, keys: list[str], order_by: str = "hour", value: str = "count") -> DataFrame:
    """A lone dip or spike between agreeing neighbours becomes their mean.

    Neighbours are the values as they came, not smoothed ones.
    """
    order = Window.partitionBy(*keys).orderBy(order_by)
    before, here, after = F.lag(value).over(order), F.col(value), F.lead(value).over(order)
    mean = (before + after) / 2
    agree = F.abs(before - after) <= F.greatest(F.lit(18.0), mean * 0.18)
    lone = ((here < before) & (here < after)) | ((here > before) & (here > after))
    far = F.abs(here - mean) >= F.greatest(F.lit(32.0), mean * 0.3)
    smooth = F.coalesce(agree & lone & far, F.lit(False))
    return hourly.withColumn("was_smoothed", smooth).withColumn(
        "smoothed", F.when(smooth, F.greatest(F.lit(0), F.floor(mean + 0.5))).otherwise(here).cast("long")
    )
