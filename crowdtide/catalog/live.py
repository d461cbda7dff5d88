"""Queries over the live feed, alerts, zones, actual hours and the document."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdtide.catalog.base import DIM, NOW, OBS, RATIO, locations, now, opened, query, r6, ratio, readings, table
from crowdtide.functions import levels, text, timeparts
from crowdtide.operators import actuals, clean, live_metrics
from crowdtide.sources import dimensions, document, live, rules


@query("latest_per_location", "WITH " + OBS + "SELECT location_id, id, is_closed, current_capacity, observed_at FROM observations QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY id DESC) = 1")
def latest(spark, d):
    return live.latest_per_location(readings(spark, d), ["id", "is_closed", "current_capacity", "observed_at"])


def latest_rows(spark, d):
    return live.latest_per_location(readings(spark, d), ["is_closed", "current_capacity", "max_capacity", "observed_at"])


LATEST = OBS + "," + DIM + """,
latest AS (SELECT * FROM observations QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY id DESC) = 1)
"""


@query("enrich_dimensions", "WITH " + OBS + "," + DIM + "SELECT id, o.location_id, facility_id, section_key, max_capacity FROM observations o JOIN dim d USING (location_id)")
def enrich(spark, d):
    return live.enrich_dimensions(readings(spark, d), locations(spark, d)).select("id", "location_id", "facility_id", "section_key", "max_capacity")


@query("explode_live_feed", "SELECT event_id AS id, user_id % 12 AS location_id, event_type = 'error' AS is_closed, floor(value) AS current_capacity FROM events WHERE event_id % 3 <> 2")
def feed(spark, d):
    # a third of the rows comes as arrays, a third wrapped, a third in an unknown shape
    row = F.concat(F.lit('[{"LocationId": "'), (F.col("user_id") % 12).cast("string"), F.lit('", "IsClosed": '), (F.col("event_type") == "error").cast("string"),
                   F.lit(', "LastCount": '), F.floor("value").cast("string"), F.lit("}]"))
    kind = F.col("event_id") % 3
    payload = F.when(kind == 0, row).when(kind == 1, F.concat(F.lit('{"rows": '), row, F.lit("}"))).otherwise(F.concat(F.lit('{"other": '), row, F.lit("}")))
    feed_rows = table(spark, d, "events").select(F.col("event_id").alias("id"), payload.alias("payload"))
    return live.explode_live_feed(feed_rows).select("id", "location_id", "is_closed", "current_capacity")


STAMPS = """,
st AS (SELECT location_id, strftime(observed_at, '%Y-%m-%d %H:%M') AS stored FROM latest),
lv AS (SELECT location_id, observed_at, CASE WHEN location_id % 4 = 0 THEN strftime(observed_at, '%Y-%m-%d %H:%M') WHEN location_id % 4 = 1 THEN '' ELSE 'x' END AS stamp FROM latest)
"""


def changed(spark, d):
    rows = latest_rows(spark, d)
    text_of = F.date_format("observed_at", "yyyy-MM-dd HH:mm")
    stored = rows.select("location_id", F.when(F.col("location_id") != 1, text_of).alias("last_updated"))
    fresh = rows.select("location_id", "is_closed", "current_capacity", F.when(F.col("location_id") % 4 == 0, text_of).when(F.col("location_id") % 4 == 1, F.lit(" ")).otherwise(F.lit("x")).alias("last_updated"))
    caps = rows.select("location_id", "max_capacity")
    return live.append_if_changed(fresh, stored, caps, now())


@query("append_if_changed", "WITH " + LATEST + STAMPS + "SELECT lv.location_id, lv.stamp AS last_updated FROM lv JOIN st USING (location_id) WHERE CASE WHEN lv.location_id = 1 THEN '' ELSE stored END <> stamp")
def append_changed(spark, d):
    return changed(spark, d)[0].select("location_id", "last_updated")


@query("append_counts", "WITH " + LATEST + STAMPS + "SELECT count(*) FILTER (CASE WHEN lv.location_id = 1 THEN '' ELSE stored END <> stamp) AS inserted, count(*) FILTER (CASE WHEN lv.location_id = 1 THEN '' ELSE stored END = stamp) AS skipped FROM lv JOIN st USING (location_id)")
def append_counts(spark, d):
    return changed(spark, d)[1]


@query("overlay_live_on_layout", "WITH " + LATEST + """, lay AS (SELECT DISTINCT user_id % 15 AS location_id, user_id % 15 % 2 AS facility_id, user_id % 15 % 4 AS floor FROM events)
SELECT lay.location_id, lay.floor, l.current_capacity FROM lay LEFT JOIN (SELECT * FROM latest WHERE location_id <> 3) l USING (location_id)""")
def overlay(spark, d):
    layout = table(spark, d, "events").select((F.col("user_id") % 15).alias("location_id"), (F.col("user_id") % 15 % 2).alias("facility_id"), (F.col("user_id") % 15 % 4).alias("floor")).distinct().withColumn("name", F.col("location_id").cast("string"))
    rows = latest_rows(spark, d).filter("location_id <> 3").withColumn("last_updated", F.col("observed_at"))
    return live.overlay_live_on_layout(layout, rows).select("location_id", "floor", "current_capacity")


@query("unassigned_locations", "WITH " + LATEST + "SELECT location_id FROM latest WHERE location_id NOT IN (SELECT location_id FROM dim WHERE section_key <> 'running track')")
def unassigned(spark, d):
    return live.unassigned_locations(latest_rows(spark, d).select("location_id"), locations(spark, d).filter("section_key <> 'running track'"))


SECTIONS = LATEST + """,
sec AS (SELECT facility_id, section_key, location_id FROM dim UNION ALL SELECT facility_id, 'overall', location_id FROM dim),
met AS (SELECT facility_id, section_key, CAST(sum(greatest(0, coalesce(current_capacity, 0))) AS BIGINT) AS total, CAST(sum(max_capacity) AS BIGINT) AS max,
  CAST(round_even(sum(greatest(0, coalesce(current_capacity, 0))) / sum(max_capacity) * 100, 0) AS INTEGER) AS percent FROM sec LEFT JOIN latest USING (location_id) GROUP BY 1, 2)
"""


def metrics(spark, d):
    dim = locations(spark, d)
    sections = dim.unionByName(dim.withColumn("section_key", F.lit("overall")))
    rows = latest_rows(spark, d)
    return live_metrics.section_metrics(rows, sections, rows.select("location_id", "max_capacity"))


@query("section_metrics", "WITH " + SECTIONS + "SELECT * FROM met")
def section_metrics(spark, d):
    return metrics(spark, d)


RULES = SECTIONS + """,
rules AS (SELECT event_id AS id, user_id % 2 AS facility_id, CASE event_id % 5 WHEN 0 THEN 'Entire  Facility' WHEN 1 THEN ' Fitness Floors' WHEN 2 THEN 'basketball courts' WHEN 3 THEN 'whole gym' ELSE 'sauna' END AS raw,
  20 + event_id % 71 AS threshold FROM events),
ev AS (SELECT r.id, r.facility_id, k AS section_key, threshold, percent, CASE WHEN percent IS NULL THEN 'missing_section' WHEN percent > threshold THEN 'above_threshold' ELSE 'fire' END AS outcome
  FROM (SELECT *, CASE WHEN raw IN ('Entire  Facility', 'whole gym') THEN 'overall' ELSE lower(trim(raw)) END AS k FROM rules) r LEFT JOIN met ON met.facility_id = r.facility_id AND met.section_key = k)
"""


def alert_rules(spark, d):
    e = F.col("event_id") % 5
    raw = F.when(e == 0, "Entire  Facility").when(e == 1, " Fitness Floors").when(e == 2, "basketball courts").when(e == 3, "whole gym").otherwise("sauna")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 2).alias("facility_id"), raw.alias("section_key"), (20 + F.col("event_id") % 71).alias("threshold"),
        F.concat(F.lit("e"), (F.col("user_id") % 40).cast("string")).alias("endpoint"), F.lit("{}").alias("subscription_json"), F.col("ts").alias("created_at"),
    )


@query("evaluate_rules", "WITH " + RULES + "SELECT id, facility_id, section_key, threshold, percent, outcome FROM ev")
def evaluate(spark, d):
    return live_metrics.evaluate_rules(alert_rules(spark, d), metrics(spark, d)).select("id", "facility_id", "section_key", "threshold", "percent", "outcome")


@query("alert_messages", "WITH " + RULES + """SELECT id, 'Hall ' || facility_id || ' ' || CASE section_key WHEN 'overall' THEN 'entire facility' ELSE section_key END || ' is ' || percent || '% full (at or below your ' || threshold || '% alert).' AS message,
'/?facility=' || facility_id AS link FROM ev WHERE outcome = 'fire'""")
def messages(spark, d):
    names = locations(spark, d).select("facility_id").distinct().withColumn("facility_name", F.concat(F.lit("Hall "), F.col("facility_id").cast("string")))
    evaluated = live_metrics.evaluate_rules(alert_rules(spark, d), metrics(spark, d))
    return live_metrics.alert_messages(evaluated, names).select("id", "message", "link")


@query("upsert_rules", """WITH r AS (SELECT event_id AS id, 'e' || (user_id % 40) AS endpoint, 20 + event_id % 71 AS threshold, ts, day(ts) > 15 AS fresh FROM events)
SELECT endpoint, id, threshold FROM r QUALIFY row_number() OVER (PARTITION BY endpoint ORDER BY fresh DESC, ts DESC) = 1""")
def upsert(spark, d):
    base = alert_rules(spark, d)
    return rules.upsert_rules(base.filter(F.dayofmonth("created_at") <= 15), base.filter(F.dayofmonth("created_at") > 15)).select("endpoint", "id", "threshold")


@query("delete_rules", "SELECT event_id AS id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 300)")
def delete(spark, d):
    base, e = alert_rules(spark, d), table(spark, d, "events")
    owned = base.join(e.select(F.col("event_id").alias("id"), "user_id"), "id")
    return rules.delete_rules(owned, e.filter("value > 300").select("user_id"), "user_id").select("id")


@query("dispatch_filter", "SELECT event_id AS id FROM events WHERE user_id % 2 = 1 AND event_id % 5 IN (0, 3)")
def dispatch(spark, d):
    return alert_rules(spark, d).filter(rules.dispatch_filter(1, "all")).select("id")


@query("category_live_total", "WITH " + LATEST + """SELECT facility_id, section_key, sum(current_capacity) AS live_total, count(*) AS observed FROM latest JOIN dim USING (location_id)
WHERE greatest(0, epoch(TIMESTAMP '2024-01-31 00:30:00') - epoch(observed_at)) / 60 <= 90 GROUP BY 1, 2""")
def category_live(spark, d):
    at = F.lit("2024-01-31 00:30:00").cast("timestamp_ntz")
    return live_metrics.category_live_total(latest_rows(spark, d), locations(spark, d), at, ["facility_id", "section_key"])


@query("facility_snapshot", "WITH " + LATEST + """SELECT facility_id, sum(current_capacity) AS total, CAST(sum(max_capacity) AS BIGINT) AS max, count(*) FILTER (is_closed) AS closed, bool_and(is_closed) AS all_closed,
max(observed_at) AS last_updated, date_diff('day', CAST(max(observed_at) AS DATE), DATE '2024-02-02') AS age_days FROM dim JOIN latest USING (location_id) GROUP BY 1""")
def snapshot(spark, d):
    dim = locations(spark, d).join(latest_rows(spark, d).select("location_id", "max_capacity"), "location_id")
    rows = latest_rows(spark, d).drop("max_capacity")
    return live_metrics.facility_snapshot(rows, dim, F.lit("2024-02-02 09:00:00").cast("timestamp_ntz"))


@query("zone_metrics", "WITH " + LATEST + """, z AS (SELECT DISTINCT 'z' || (user_id % 6) AS zone_id, user_id % 12 AS location_id FROM events)
SELECT zone_id, R6(sum(current_capacity) / sum(max_capacity), 6) AS ratio, bool_and(is_closed) AS closed FROM z JOIN latest USING (location_id) GROUP BY 1""")
def zone_metrics(spark, d):
    zones = table(spark, d, "events").select((F.col("user_id") % 6).alias("z"), (F.col("user_id") % 12).alias("l")).groupBy(
        F.concat(F.lit("z"), F.col("z").cast("string")).alias("zone_id"), F.col("z").alias("zone_order")
    ).agg(F.collect_set("l").alias("location_ids"))
    return live_metrics.zone_metrics(zones, latest_rows(spark, d)).select("zone_id", r6(F.col("ratio")).alias("ratio"), "closed")


@query("zone_point_join", """WITH e AS (SELECT row_number() OVER () AS n, * FROM (SELECT value / 6 AS x, (event_id * 37 % 100) + 0.25 AS y FROM events UNION ALL SELECT value / 6, (event_id * 37 % 100) + 0.25 FROM events)), p AS (SELECT n, x, y FROM e),
z AS (SELECT * FROM (VALUES ('square', 0, 0.4, 10.0, 60.0, 10.0, 60.0), ('wide', 1, 0.7, 40.0, 90.0, 20.0, 50.0), ('tied', 2, 0.7, 50.0, 95.0, 30.0, 80.0)) t(zone_id, o, ratio, x0, x1, y0, y1))
SELECT R6(x, 6) AS x, y, zone_id, ratio FROM (SELECT p.x, CAST(p.y AS DOUBLE) AS y, z.zone_id, CAST(z.ratio AS DOUBLE) AS ratio, row_number() OVER (PARTITION BY n ORDER BY z.ratio DESC, o DESC) AS rn FROM p JOIN z ON x > x0 AND x < x1 AND y > y0 AND y < y1) WHERE rn = 1""")
def zone_points(spark, d):
    corner = lambda x, y: f"named_struct('x', {x}D, 'y', {y}D)"
    box = lambda x0, x1, y0, y1: f"array({corner(x0, y0)}, {corner(x1, y0)}, {corner(x1, y1)}, {corner(x0, y1)})"
    zones = spark.sql(f"""SELECT zone_id, zone_order, CAST(ratio AS DOUBLE) AS ratio, closed, corners FROM VALUES ('square', 0, 0.4, false, {box(10, 60, 10, 60)}), ('wide', 1, 0.7, false, {box(40, 90, 20, 50)}),
        ('tied', 2, 0.7, false, {box(50, 95, 30, 80)}), ('shut', 3, 0.9, true, {box(0, 100, 0, 100)}) AS t(zone_id, zone_order, ratio, closed, corners)""")
    # no id, and every point twice: each of them stays a row
    points = table(spark, d, "events").select((F.col("value") / 6).alias("x"), (F.col("event_id") * 37 % 100 + 0.25).cast("double").alias("y"))
    return live_metrics.zone_point_join(points.unionAll(points), zones).select(r6(F.col("x")).alias("x"), "y", "zone_id", "ratio")


ACTUAL = OBS + "," + DIM + """,
hm AS (SELECT location_id, time_bucket(INTERVAL '60 minutes', observed_at) AS h, avg(current_capacity) AS m, count(*) AS n FROM opened GROUP BY 1, 2),
pl AS (SELECT facility_id, section_key, location_id FROM dim UNION ALL SELECT facility_id, 'total', location_id FROM dim),
wh AS (SELECT facility_id, section_key, sum(max_cap) AS cm FROM pl JOIN caps USING (location_id) GROUP BY 1, 2),
ob AS (SELECT facility_id, section_key, h, sum(m) AS o, sum(max_cap) AS oc, sum(n) AS n FROM hm JOIN pl USING (location_id) JOIN caps USING (location_id) GROUP BY 1, 2, 3),
act AS (SELECT facility_id, section_key, h AS hour_start, CAST(round_even(round(CASE WHEN oc < cm THEN o * (cm / oc) ELSE o END, 6), 0) AS BIGINT) AS actual_count, CAST(n AS BIGINT) AS actual_samples, cm, oc FROM ob JOIN wh USING (facility_id, section_key))
"""


def actual(spark, d):
    caps = clean.capacity_max(opened(spark, d)).withColumnRenamed("max_cap", "max_capacity")
    return actuals.actual_hours(opened(spark, d), locations(spark, d), caps)


@query("actual_hours", "WITH " + ACTUAL + "SELECT facility_id, section_key, hour_start, actual_count, round_even(least(actual_count / cm, 1.0), 4) AS actual_pct, actual_samples, round_even(least(oc / cm, 1.0), 4) AS actual_coverage FROM act")
def actual_hours(spark, d):
    return actual(spark, d)


@query("overlay_actuals", "WITH " + ACTUAL + """, f AS (SELECT facility_id, replace(section_key, ' ', '_') AS category_key, hour_start FROM act WHERE section_key <> 'total' AND hour(hour_start) BETWEEN 6 AND 22)
SELECT f.facility_id, f.category_key, f.hour_start, a.actual_count FROM f LEFT JOIN act a ON a.facility_id = f.facility_id AND replace(a.section_key, ' ', '_') = f.category_key AND a.hour_start = f.hour_start AND day(a.hour_start) <= 20""")
def overlay_actuals(spark, d):
    a = actual(spark, d)
    forecast = a.filter((F.col("section_key") != "total") & F.hour("hour_start").between(6, 22)).select("facility_id", F.replace("section_key", F.lit(" "), F.lit("_")).alias("category_key"), "hour_start")
    return actuals.overlay_actuals(forecast, a.filter(F.dayofmonth("hour_start") <= 20)).select("facility_id", "category_key", "hour_start", "actual_count")


@query("resolve_observed_at", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN ts WHEN 2 THEN date_trunc('second', ts) - INTERVAL '6 hours' WHEN 3 THEN date_trunc('second', ts) - INTERVAL '8 hours 30 minutes' ELSE ts + INTERVAL '1 hour' END AS observed_at FROM events""")
def observed(spark, d):
    e = F.col("event_id") % 5
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    stamp = (F.when(e == 0, plain).when(e == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).when(e == 2, F.concat(plain, F.lit("Z")))
             .when(e == 3, F.concat(plain, F.lit("+02:30"))).otherwise(F.lit("bad")))
    return table(spark, d, "events").select("event_id", timeparts.resolve_observed_at(stamp, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("observed_at"))


@query("occupancy_tone", """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL WHEN value <= event_id % 99 THEN 'low' WHEN value < greatest(event_id % 99 + 1, least(100, event_id % 50)) THEN 'medium' ELSE 'peak' END AS tone,
round_even(event_id / 2.0, 0) AS half_even, floor(event_id / 2.0 + 0.5) AS half_up FROM events""")
def tone(spark, d):
    return table(spark, d, "events").select(
        "event_id", levels.occupancy_tone(F.col("value"), F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 99), F.col("event_id") % 50).alias("tone"),
        levels.round_half_even(F.col("event_id") / 2.0).alias("half_even"), levels.round_half_up(F.col("event_id") / 2.0).alias("half_up"),
    )


def doc(spark, d):
    p = ratio(spark, d).join(locations(spark, d), "location_id").groupBy("facility_id", F.to_date("bucket_ts").alias("day"), F.col("section_key").alias("category_key"), F.col("bucket_ts").alias("hour_start")).agg(
        levels.whole_count(F.sum("mean_count")).alias("expected"), F.sum("max_cap").alias("capacity"), F.count("*").alias("sample_count")
    )
    return p.withColumns({"pct": F.round(F.col("expected") / F.col("capacity"), 4), "expected_p10": F.col("expected"), "expected_p90": F.col("expected")})


FLAT = RATIO + "," + DIM + """, pts AS (SELECT facility_id, CAST(bucket_ts AS DATE) AS day, section_key, bucket_ts AS hour_start, CAST(round_even(round(sum(mean_count), 6), 0) AS BIGINT) AS expected, sum(max_cap) AS cap
  FROM ratio JOIN dim USING (location_id) GROUP BY 1, 2, 3, 4)
"""


@query("forecast_document", "WITH " + FLAT + "SELECT facility_id, day, section_key AS key, hour_start, expected, round(expected / cap, 4) AS pct FROM pts")
def forecast_document(spark, d):
    nested = document.compact_document(document.nest_document(doc(spark, d)))
    flat = nested.select("facility_id", F.explode("days").alias("a")).select("facility_id", "a.day", F.explode("a.categories").alias("c"))
    return flat.select("facility_id", "day", "c.key", F.explode("c.hours").alias("h")).select("facility_id", "day", "key", "h.*")


@query("facility_lookup", "WITH " + FLAT + "SELECT facility_id, day, count(DISTINCT section_key) AS categories FROM pts WHERE facility_id = 1 AND day = DATE '2024-01-10' GROUP BY 1, 2")
def lookup(spark, d):
    return document.facility_lookup(document.nest_document(doc(spark, d)), 1, "2024-01-10").select("facility_id", "day", F.size("categories").cast("long").alias("categories"))


@query("facilities_summary", "WITH " + FLAT + "SELECT facility_id, 'Hall ' || facility_id AS facility_name, count(DISTINCT day) AS days FROM pts GROUP BY 1")
def summary(spark, d):
    names = locations(spark, d).select("facility_id").distinct().withColumn("facility_name", F.concat(F.lit("Hall "), F.col("facility_id").cast("string")))
    return document.facilities_summary(document.nest_document(doc(spark, d)), names).withColumn("days", F.col("days").cast("long"))


@query("upcoming_days", "WITH " + FLAT + "SELECT DISTINCT facility_id, day FROM pts WHERE day >= DATE '2024-01-25'")
def upcoming(spark, d):
    return document.upcoming_days(doc(spark, d).select("facility_id", "day").distinct(), F.to_date(now()))


@query("distinct_locations", "SELECT DISTINCT user_id % 12 AS location_id FROM events")
def distinct_locations(spark, d):
    return live.distinct_locations(readings(spark, d))


@query("union_targets", """SELECT DISTINCT t AS target_ts FROM (SELECT time_bucket(INTERVAL '15 minutes', ts) AS t FROM events UNION ALL SELECT time_bucket(INTERVAL '30 minutes', ts) FROM events)""")
def union_targets(spark, d):
    e = table(spark, d, "events")
    return timeparts.union_targets(*[e.select(timeparts.grid_start(F.col("ts"), m).alias("target_ts")) for m in (15, 30)])


@query("targets_for_days", """SELECT day, t AS target_ts FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)
  CROSS JOIN LATERAL (SELECT unnest(generate_series(day + INTERVAL '6 hours', day + INTERVAL '23 hours 45 minutes', INTERVAL '15 minutes')) AS t) s""")
def targets(spark, d):
    days = table(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    return timeparts.targets_for_days(days)


@query("capacity_targets_cross", "WITH " + OBS + """, t AS (
  SELECT CAST(d AS DATE) AS day, d + s * INTERVAL '15 minutes' AS target_ts
  FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-25', TIMESTAMP '2024-01-31', INTERVAL '1 day')) AS d), (SELECT unnest(range(24, 96)) AS s))
SELECT location_id, max_cap, day, target_ts FROM caps, t""")
def cross(spark, d):
    """The week from today on, in quarter hours from six to midnight, for every location."""
    from crowdtide.plans.forecast_week import capacity_targets

    return capacity_targets(clean.capacity_max(opened(spark, d)), F.to_date(now()))
