"""Resolving schedule rules to open windows, per day and per moment.

Rules are texts.  They are parsed once per (rule, year), turned into one winning
window per (facility, day), and joined to the rows by day.  The tables up to the
winner grow with rules and days only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdtide.functions.text import (
    MINUTES_PER_DAY, closes_at, is_facility_wide, open_at, opens_at, parse_weekday_set, schedule_text, with_date_range,
    with_hours_window,
)
from crowdtide.functions.timeparts import at_minute, minute_of_day
from crowdtide.session import cut_lineage

RULE_KEYS = ["section_idx", "row_idx"]


def best_rule(candidates: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """First candidate by specificity (high), span (short), section and row order."""
    rank = F.struct(-F.col("specificity"), F.col("span_days"), F.col("section_idx"), F.col("row_idx"))
    return candidates.groupBy(*keys).agg(F.min_by(value, rank).alias("winner"))


def parsed_rules(rules: DataFrame, years: DataFrame, dialect: str = "wide") -> DataFrame:
    """Rules of whole facilities with parsed dates, weekdays and hours, per year."""
    wide = rules.filter(is_facility_wide(F.col("section_title")))
    if dialect == "wide":
        wide = wide.filter((F.trim("label") != "") & (F.trim("hours") != ""))
    parsed = wide.join(years, "facility_id").select("facility_id", "year", *RULE_KEYS, "section_title", "label", "hours")
    parsed = with_date_range(parsed, "label", "year", "row_range", dialect)
    parsed = with_date_range(parsed, "section_title", "year", "title_range", dialect)
    parsed = with_hours_window(parsed, "hours", "window", dialect).withColumn("_label", schedule_text(F.col("label")))
    # Written once: parsing is long-winded, and every reader would repeat it.
    yearly = cut_lineage(parsed.withColumn("weekdays", parse_weekday_set(F.col("_label"), dialect)))
    dated, titled = F.col("row_range").isNotNull(), F.col("title_range").isNotNull()
    return yearly.filter(F.col("window").isNotNull() & (dated | F.col("weekdays").isNotNull())).select(
        "facility_id", "year", *RULE_KEYS, "hours", "window",
        F.when(dated, F.col("row_range")).otherwise(F.col("title_range")).alias("valid"),
        F.when(~dated, F.col("weekdays")).alias("weekdays"),
        F.when(dated, 3).when(titled, 2).otherwise(1).alias("specificity"),
        F.when(dated, F.col("row_range.span")).when(titled, F.col("title_range.span")).otherwise(9998).alias("span_days"),
    )


def resolve_days(rules: DataFrame, days: DataFrame, dialect: str = "wide") -> DataFrame:
    """The winning window of each (facility_id, day); days without a rule drop out."""
    wanted = days.select("facility_id", "day").distinct().withColumn("year", F.year("day"))
    parsed = parsed_rules(rules, wanted.select("facility_id", "year").distinct(), dialect)
    applies = (
        (F.col("valid").isNull() | ((F.col("day") >= F.col("valid.start")) & (F.col("day") <= F.col("valid.end"))))
        & (F.col("weekdays").isNull() | F.array_contains("weekdays", F.weekday("day")))
    )
    candidates = wanted.join(parsed, ["facility_id", "year"]).filter(applies)
    won = best_rule(candidates, ["facility_id", "day"], F.struct("window", "specificity", "span_days", *RULE_KEYS, "hours"))
    return won.select("facility_id", "day", "winner.*")


def schedule_resolve(rows: DataFrame, rules: DataFrame, ts: str) -> DataFrame:
    """Open state, window and opening/closing minute flags of each row's moment.

    State is open, closed, or unknown without a rule; overnight windows wrap on the
    same day.
    """
    day = F.to_date(ts)
    days = rows.select("facility_id", day.alias("day"))
    # Written: facilities x days, whose size the planner then knows beside the rows' history.
    resolved = cut_lineage(resolve_days(rules, days).select("facility_id", F.col("day").alias("_day"), F.col("window").alias("_window")))
    minute = minute_of_day(F.col(ts))
    window = F.col("_window")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return (
        rows.withColumn("_day", day).join(resolved, ["facility_id", "_day"], "left")
        .withColumns({
            "schedule_state": F.when(window.isNull(), "unknown").when(open_at(window, minute), "open").otherwise("closed"),
            "window_start": window["start_min"], "window_end": window["end_min"],
            "is_open_minute": flag(opens_at(window, minute)), "is_close_minute": flag(closes_at(window, minute)),
        })
        .withColumn("is_boundary", F.col("is_open_minute") | F.col("is_close_minute"))
        .select(*rows.columns, "schedule_state", "window_start", "window_end", "is_open_minute", "is_close_minute", "is_boundary",
                F.col("_window").alias("window"))
    )


def apply_schedule_to_readings(readings: DataFrame, rules: DataFrame) -> DataFrame:
    """Boundary minutes count 0; closed readings go, but for the exact closing minute."""
    resolved = schedule_resolve(readings, rules, "observed_at")
    return resolved.filter((F.col("schedule_state") != "closed") | F.col("is_close_minute")).withColumn(
        "current_capacity", F.when(F.col("is_boundary"), 0.0).otherwise(F.col("current_capacity"))
    ).select(*readings.columns)


def filter_targets(targets: DataFrame, rules: DataFrame, ts: str = "target_ts") -> DataFrame:
    """Open targets and exact closing minutes; all targets of facilities without rules."""
    known = rules.select("facility_id").distinct().withColumn("_has_rules", F.lit(True))
    resolved = schedule_resolve(targets, rules, ts).join(known, "facility_id", "left")
    free = F.col("_has_rules").isNull()
    return resolved.filter(free | (F.col("schedule_state") == "open") | F.col("is_close_minute")).select(
        *targets.columns, (F.col("is_boundary") & ~free).alias("is_boundary"), "window"
    )


def _two_days(rules: DataFrame, days: DataFrame) -> DataFrame:
    """Winners of each day and of the day before, in the strict dialect."""
    wanted = days.select("facility_id", "day").distinct()
    both = wanted.select("facility_id", F.explode(F.array("day", F.date_sub("day", 1))).alias("day")).distinct()
    won = resolve_days(rules, both, "strict").select("facility_id", "day", F.struct("window", "specificity", "hours").alias("w"))
    today = won.withColumnRenamed("w", "today")
    before = won.select("facility_id", F.date_add("day", 1).alias("day"), F.col("w").alias("yesterday"))
    paired = wanted.join(today, ["facility_id", "day"], "left").join(before, ["facility_id", "day"], "left")
    late = ~F.col("yesterday.window.is_closed") & (F.col("yesterday.window.end_min") > MINUTES_PER_DAY)
    allowed = F.col("today").isNull() | (F.col("today.specificity") <= F.col("yesterday.specificity"))
    return paired.withColumn("spills", F.coalesce(late & allowed, F.lit(False)))


def schedule_status(moments: DataFrame, rules: DataFrame, ts: str) -> DataFrame:
    """Open state where yesterday's overnight window may still count today."""
    keyed = moments.withColumn("_day", F.to_date(ts))
    days = cut_lineage(_two_days(rules, keyed.select("facility_id", F.col("_day").alias("day"))).withColumnRenamed("day", "_day"))
    minute = minute_of_day(F.col(ts))
    now_open = F.coalesce(open_at(F.col("today.window"), minute), F.lit(False))
    still_open = F.col("spills") & F.coalesce(open_at(F.col("yesterday.window"), minute), F.lit(False))
    return (
        keyed.join(days, ["facility_id", "_day"], "left")
        .withColumn("state", F.when(now_open | still_open, "open").when(F.col("today").isNull(), "unknown").otherwise("closed"))
        .withColumn("rule_start", F.when(now_open | ~still_open, F.col("today.window.start_min")).otherwise(F.col("yesterday.window.start_min")))
        .select(*moments.columns, "state", "rule_start")
    )


def open_windows(rules: DataFrame, days: DataFrame) -> DataFrame:
    """Open windows of each day cut at midnight, with yesterday's overflow, merged."""
    both = _two_days(rules, days)
    segment = lambda s, e: F.struct(s.cast("int").alias("start_min"), e.cast("int").alias("end_min"))
    end_today = F.least(F.col("today.window.end_min"), F.lit(MINUTES_PER_DAY))
    own = F.when(
        ~F.col("today.window.is_closed") & (end_today > F.col("today.window.start_min")),
        segment(F.col("today.window.start_min"), end_today),
    )
    spill = F.when(
        F.col("spills"), segment(F.lit(0), F.least(F.lit(MINUTES_PER_DAY), F.col("yesterday.window.end_min") - MINUTES_PER_DAY))
    )
    pieces = both.select("facility_id", "day", F.explode(F.array_compact(F.array(spill, own))).alias("_w")).select(
        "facility_id", "day", "_w.*"
    ).filter("end_min > start_min")
    return merge_open_windows(pieces, ["facility_id", "day"])


def merge_open_windows(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Union of overlapping or touching intervals of each day."""
    order = Window.partitionBy(*keys).orderBy("start_min", "end_min")
    reach = F.max("end_min").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        windows.withColumn("_new", F.when(F.col("start_min") <= reach, 0).otherwise(1))
        .withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_island").agg(F.min("start_min").alias("start_min"), F.max("end_min").alias("end_min"))
        .drop("_island")
    )


def next_open(moments: DataFrame, rules: DataFrame, ts: str, search_days: int = 365) -> DataFrame:
    """Earliest window start after the moment, up to a year ahead; NULL if none.

    Days are resolved once per facility over the span its moments need, and each
    day then knows the first window start from it on, so a moment looks up at most
    two rows instead of a year of days.
    """
    keyed = moments.withColumn("_day", F.to_date(ts))
    spans = keyed.groupBy("facility_id").agg(F.min("_day").alias("a"), F.max("_day").alias("b"))
    days = spans.select("facility_id", F.explode(F.sequence("a", F.date_add("b", search_days))).alias("day"))
    opened = open_windows(rules, days)
    first = days.join(
        opened.groupBy("facility_id", "day").agg(F.sort_array(F.collect_list("start_min")).alias("starts")), ["facility_id", "day"], "left"
    )
    # Runs over the days of one facility: a table the size of the calendar.
    ahead = Window.partitionBy("facility_id").orderBy("day").rowsBetween(1, search_days)
    later = first.withColumn(
        "_later", F.first(F.when(F.col("starts").isNotNull(), F.struct("day", F.col("starts")[0].alias("m"))), ignorenulls=True).over(ahead)
    ).withColumnRenamed("day", "_day")
    later = cut_lineage(later)
    minute = minute_of_day(F.col(ts))
    same_day = F.array_min(F.filter("starts", lambda s: s > minute))
    return (
        keyed.join(later, ["facility_id", "_day"], "left")
        .withColumn("next_open", F.coalesce(
            at_minute(F.col("_day"), same_day), at_minute(F.col("_later.day"), F.col("_later.m"))
        ))
        .select(*moments.columns, "next_open")
    )


def open_but_not_live(state: Column, rule_start: Column, last_updated: Column, now: Column) -> Column:
    """Scheduled open, but the last reading is older than today's opening."""
    updated_day, today = F.to_date(last_updated), F.to_date(now)
    old = (
        F.when(last_updated.isNull() | (updated_day < today), True)
        .when(updated_day > today, False)
        .otherwise(minute_of_day(last_updated) < rule_start)
    )
    return (state == "open") & rule_start.isNotNull() & old


def facility_status(facilities: DataFrame) -> DataFrame:
    """closed -> open_not_live -> stale -> ok, and whether to hide the forecast.

    Needs ``state, rule_start, last_updated, now``.
    """
    not_live = F.coalesce(open_but_not_live(F.col("state"), F.col("rule_start"), F.col("last_updated"), F.col("now")), F.lit(False))
    age = F.greatest(F.lit(0), F.date_diff(F.to_date("now"), F.to_date("last_updated")))
    status = (
        F.when(F.col("state") == "closed", "closed").when(not_live, "open_not_live")
        .when(age >= 1, "stale").otherwise("ok")
    )
    return facilities.withColumn("status", status).withColumn("hide_forecast", F.col("status").isin("closed", "stale"))


def visible_days(days: DataFrame, windows: DataFrame, k: int = 4) -> DataFrame:
    """The first days of each facility that have an open window."""
    kept = days.join(windows.select("facility_id", "day").distinct(), ["facility_id", "day"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("facility_id").orderBy("day"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= k)
