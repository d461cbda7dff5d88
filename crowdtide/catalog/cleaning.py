"""Queries over scanning, cleaning and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdtide.catalog.base import OBS, RATIO, capacity, opened, query, r6, ratio, readings, series
from crowdtide.catalog.schedules import MOMENTS, moments, rule_table
from crowdtide.operators import clean
from crowdtide.operators.schedule import schedule_resolve


@query("scan_history", "WITH " + OBS + "SELECT id, location_id, current_capacity FROM observations WHERE NOT is_closed")
def scan_history(spark, d):
    return clean.open_readings(readings(spark, d)).select("id", "location_id", "current_capacity")


@query("drop_invalid_rows", "WITH " + OBS + """
SELECT id, location_id, current_capacity FROM
  (SELECT id, location_id, observed_at, CASE WHEN id % 7 = 0 THEN -1.0 WHEN id % 11 = 0 THEN NULL ELSE current_capacity END AS current_capacity FROM observations)
WHERE current_capacity >= 0 AND observed_at IS NOT NULL""")
def invalid_rows(spark, d):
    # every seventh count is negative and every eleventh missing
    broken = readings(spark, d).withColumn(
        "current_capacity", F.when(F.col("id") % 7 == 0, -1.0).when(F.col("id") % 11 == 0, None).otherwise(F.col("current_capacity"))
    )
    return clean.drop_invalid_rows(broken).select("id", "location_id", "current_capacity")


@query("capacity_max", "WITH " + OBS + "SELECT location_id, max_cap FROM caps")
def cap(spark, d):
    return capacity(spark, d)


@query("dedupe_timestamps", "WITH " + OBS + """
SELECT location_id, minute, R6(avg(current_capacity), 6) AS count, count(*) - 1 AS removed
FROM (SELECT location_id, time_bucket(INTERVAL '5 minutes', observed_at) AS minute, current_capacity FROM opened) GROUP BY 1, 2""")
def dedupe(spark, d):
    coarse = opened(spark, d).withColumn("observed_at", F.window("observed_at", "5 minutes")["start"])
    return clean.dedupe_timestamps(coarse).select(
        "location_id", F.col("observed_at").alias("minute"), r6(F.col("count")).alias("count"), "removed"
    )


@query("drop_impossible_jumps", "WITH RECURSIVE " + OBS + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY observed_at) AS rn FROM series),
fold AS (
  SELECT location_id, rn, observed_at, count, max_cap, observed_at AS kept_at, count AS kept, true AS keep FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.location_id, n.rn, n.observed_at, n.count, n.max_cap,
         CASE WHEN n.observed_at - f.kept_at <= INTERVAL '120 minutes' AND abs(n.count - f.kept) > n.max_cap * 0.6 THEN f.kept_at ELSE n.observed_at END,
         CASE WHEN n.observed_at - f.kept_at <= INTERVAL '120 minutes' AND abs(n.count - f.kept) > n.max_cap * 0.6 THEN f.kept ELSE n.count END,
         NOT (n.observed_at - f.kept_at <= INTERVAL '120 minutes' AND abs(n.count - f.kept) > n.max_cap * 0.6)
  FROM fold f JOIN numbered n ON n.location_id = f.location_id AND n.rn = f.rn + 1)
SELECT location_id, observed_at, R6(count, 6) AS count FROM fold WHERE keep""")
def jumps(spark, d):
    return clean.drop_impossible_jumps(series(spark, d)).select("location_id", "observed_at", r6(F.col("count")).alias("count"))


def level_series(spark, d):
    """Counts that hold for half a day at a time, every 15 minutes, so runs are long."""
    r = ratio(spark, d, 15)
    held = F.floor(F.dayofyear("bucket_ts") * 7 + F.hour("bucket_ts") / 12 + F.col("location_id")) % 40 + 5
    return r.select("location_id", F.col("bucket_ts").alias("observed_at"), held.cast("double").alias("count"), "max_cap")


LEVELS = """,
ratio15 AS (SELECT location_id, time_bucket(INTERVAL '15 minutes', observed_at) AS b, max(max_cap) AS max_cap FROM series GROUP BY 1, 2),
levels AS (SELECT location_id, b AS observed_at, CAST(CAST(floor(dayofyear(b) * 7 + hour(b) / 12.0 + location_id) AS BIGINT) % 40 + 5 AS DOUBLE) AS count, max_cap FROM ratio15),
stepped AS (SELECT *, lag(observed_at) OVER w AS pt, lag(count) OVER w AS pc FROM levels WINDOW w AS (PARTITION BY location_id ORDER BY observed_at)),
runs AS (SELECT location_id, observed_at, count, max_cap,
         CAST(sum(CASE WHEN observed_at - pt <= INTERVAL '20 minutes' AND abs(count - pc) <= max_cap * 0.01 THEN 0 ELSE 1 END)
         OVER (PARTITION BY location_id ORDER BY observed_at) AS BIGINT) AS run FROM stepped),
stuck AS (SELECT location_id, run, count(*) AS rows, arg_max(count, observed_at) AS level FROM runs GROUP BY 1, 2
          HAVING max(observed_at) - min(observed_at) >= INTERVAL '360 minutes'
             AND arg_max(count, observed_at) > 1 AND arg_max(count, observed_at) < greatest(1, max(max_cap) - 1))
"""


@query("flat_runs", "WITH " + OBS + LEVELS + "SELECT location_id, run, count(*) AS rows, min(observed_at) AS first_at FROM runs GROUP BY 1, 2")
def flat_runs(spark, d):
    return clean.flat_runs(level_series(spark, d)).groupBy("location_id", "run").agg(
        F.count("*").alias("rows"), F.min("observed_at").alias("first_at")
    )


@query("thin_flatlines", "WITH RECURSIVE " + OBS + LEVELS + """,
numbered AS (SELECT r.*, row_number() OVER (PARTITION BY r.location_id, r.run ORDER BY observed_at) AS rn FROM runs r JOIN stuck USING (location_id, run)),
fold AS (
  SELECT location_id, run, rn, observed_at, count, observed_at AS kept_at FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.location_id, n.run, n.rn, n.observed_at, n.count,
         CASE WHEN n.observed_at - f.kept_at >= INTERVAL '60 minutes' THEN n.observed_at ELSE f.kept_at END
  FROM fold f JOIN numbered n ON n.location_id = f.location_id AND n.run = f.run AND n.rn = f.rn + 1)
SELECT location_id, observed_at, count FROM fold WHERE kept_at = observed_at
UNION ALL SELECT location_id, observed_at, count FROM runs r WHERE NOT EXISTS (SELECT 1 FROM stuck s WHERE s.location_id = r.location_id AND s.run = r.run)""")
def thin(spark, d):
    return clean.thin_flatlines(level_series(spark, d)).select("location_id", "observed_at", "count")


@query("resample_mean", "WITH " + RATIO + "SELECT location_id, bucket_ts, R6(mean_count, 6) AS mean_count, R6(ratio, 6) AS ratio FROM ratio")
def resample(spark, d):
    return ratio(spark, d).select("location_id", "bucket_ts", r6(F.col("mean_count")).alias("mean_count"), r6(F.col("ratio")).alias("ratio"))


@query("seasonal_profiles", "WITH " + RATIO + """
SELECT location_id, CAST(isodow(bucket_ts) - 1 AS INTEGER) AS dow, CAST(hour(bucket_ts) AS INTEGER) AS hour, 'dow_hour' AS level,
       R6(avg(ratio), 6) AS mean_ratio, count(*) AS n FROM ratio GROUP BY 1, 2, 3
UNION ALL SELECT location_id, NULL, CAST(hour(bucket_ts) AS INTEGER), 'hour', R6(avg(ratio), 6), count(*) FROM ratio GROUP BY 1, 3
UNION ALL SELECT location_id, NULL, NULL, 'overall', R6(avg(ratio), 6), count(*) FROM ratio GROUP BY 1""")
def profiles(spark, d):
    return clean.seasonal_profiles(ratio(spark, d)).select(
        "location_id", "dow", "hour", "level", r6(F.col("mean_ratio")).alias("mean_ratio"), "n"
    )


STATS = """,
stats AS (SELECT location_id, count(*) AS samples, max(bucket_ts) AS latest_ts,
          TIMESTAMP '2024-01-30 20:00:00' - max(bucket_ts) > INTERVAL '24 hours' AS is_stale FROM ratio GROUP BY 1)
"""


def stats(spark, d):
    return clean.location_stats(ratio(spark, d), F.lit("2024-01-30 20:00:00").cast("timestamp_ntz"))


@query("location_stats", "WITH " + RATIO + STATS + "SELECT * FROM stats")
def location_stats(spark, d):
    return stats(spark, d)


@query("eligible_locations", "WITH " + RATIO + STATS + "SELECT location_id, samples, max_cap FROM stats JOIN caps USING (location_id) WHERE samples >= 80 AND NOT is_stale")
def eligible(spark, d):
    return clean.eligible_locations(stats(spark, d), capacity(spark, d)).select("location_id", "samples", "max_cap")


@query("quality_counters", "WITH " + MOMENTS + """, v AS (SELECT r.*, value >= 5 AS ok FROM r JOIN events USING (event_id))
SELECT count(*) AS rows_read, count(*) FILTER (NOT ok) AS rows_invalid, count(*) FILTER (ok) AS rows_evaluated, count(*) FILTER (ok AND state = 'closed' AND NOT cm) AS rows_closed,
  count(*) FILTER (ok AND state = 'closed' AND cm) AS rows_closed_kept, count(*) FILTER (ok AND state = 'unknown') AS rows_unknown, count(*) FILTER (ok AND (om OR cm)) AS rows_zeroed FROM v""")
def counters(spark, d):
    """Rows with less than five people count as invalid; facilities and their schedules as in the schedule queries."""
    low = readings(spark, d).withColumn("current_capacity", F.when(F.col("current_capacity") >= 5, F.col("current_capacity")))
    placed = low.join(moments(spark, d).select(F.col("event_id").alias("id"), "facility_id"), "id")
    return clean.row_counters(schedule_resolve(placed, rule_table(spark), "observed_at"), "schedule_state")


@query("quality_alert", "WITH " + RATIO + STATS.rstrip() + LEVELS.rstrip() + """,
c AS (SELECT count(*) AS rows_read, count(*) FILTER (value < 12) AS rows_invalid FROM events),
s AS (SELECT count(*) AS locs, count(*) FILTER (is_stale) AS stale, count(*) FILTER (samples >= 80 AND NOT is_stale) AS modeled_locations FROM stats),
f AS (SELECT count(DISTINCT location_id) AS flat FROM stuck WHERE location_id % 3 = 1),
r AS (SELECT *, rows_invalid / rows_read AS ir, stale / greatest(1, locs) AS sr, flat / greatest(1, locs) AS fr FROM c, s, f)
SELECT rows_read, rows_invalid, round_even(ir, 4) AS invalid_rate, round_even(sr, 4) AS stale_rate, round_even(fr, 4) AS flatline_rate, modeled_locations,
       concat_ws(',', CASE WHEN ir > 0.35 THEN 'invalid_row_rate_high' END, CASE WHEN sr > 0.6 THEN 'stale_location_rate_high' END, CASE WHEN fr > 0.4 THEN 'flatline_location_rate_high' END,
                 CASE WHEN modeled_locations < 6 THEN 'modeled_locations_too_low' END) AS critical,
       concat_ws(',', CASE WHEN ir > 0.35 * 0.75 AND ir <= 0.35 THEN 'invalid_row_rate_elevated' END, CASE WHEN sr > 0.6 * 0.75 AND sr <= 0.6 THEN 'stale_location_rate_elevated' END,
                 CASE WHEN fr > 0.4 * 0.75 AND fr <= 0.4 THEN 'flatline_location_rate_elevated' END) AS warnings,
       CASE WHEN ir > 0.35 OR sr > 0.6 OR fr > 0.4 OR modeled_locations < 6 THEN 'critical'
            WHEN ir > 0.35 * 0.75 OR sr > 0.6 * 0.75 OR fr > 0.4 * 0.75 THEN 'warning' ELSE 'ok' END AS severity FROM r""")
def alert(spark, d):
    """Flat locations are those of every third location whose levels hold long enough."""
    low = readings(spark, d).withColumn("current_capacity", F.when(F.col("current_capacity") >= 12, F.col("current_capacity")))
    flat = clean.stuck_runs(clean.flat_runs(level_series(spark, d))).filter("location_id % 3 = 1").agg(F.countDistinct("location_id").alias("flat_locations"))
    return clean.quality_alert(clean.row_counters(low).crossJoin(flat), stats(spark, d)).select(  # one row by one row
        "rows_read", "rows_invalid", "invalid_rate", "stale_rate", "flatline_rate", "modeled_locations",
        F.array_join("critical", ",").alias("critical"), F.array_join("warnings", ",").alias("warnings"), "severity",
    )
