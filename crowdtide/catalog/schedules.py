"""Queries over schedule rules, resolved at the times of the event feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdtide.catalog.base import query, r6, table
from crowdtide.functions import text
from crowdtide.operators import schedule
from crowdtide.sources.schedule import extract_schedule

RULE_ROWS = (
    (0, 0, "Building Hours", 0, "Monday - Friday", "6am - 11pm"),
    (0, 0, "Building Hours", 1, "Saturday", "8:00 a.m. – 8 p.m."),
    (0, 0, "Building Hours", 2, "Sunday", "10am - midnight"),
    (0, 0, "Building Hours", 3, "Daily", "1am - 2am"),
    (0, 1, "Jan 8 - Jan 12", 0, "Monday - Thursday", "9am - 5pm"),
    (0, 2, "Exceptions", 0, "Jan 15", "CLOSED"),
    (0, 3, "Pool Hours", 0, "Daily", "24 hours"),
    (0, 4, "Exceptions", 0, "Jan 16", "by appointment"),
    (1, 0, "Hours", 0, "Daily", "8pm - 2am"),
    (1, 1, "Special", 0, "Jan 20 - 22", "24 hours"),
)


def rule_table(spark):
    values = ", ".join(f"({f}, {s}, '{t}', {r}, '{label}', '{h}')" for f, s, t, r, label, h in RULE_ROWS)
    return spark.sql(f"SELECT CAST(facility_id AS BIGINT) AS facility_id, section_idx, section_title, row_idx, label, hours FROM VALUES {values} AS t(facility_id, section_idx, section_title, row_idx, label, hours)")


def moments(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("user_id") % 3).alias("facility_id"), "ts")


MOMENTS = """m AS (SELECT event_id, user_id % 3 AS facility_id, ts, CAST(ts AS DATE) AS day, hour(ts) * 60 + minute(ts) AS mi FROM events),
days AS (SELECT f AS facility_id, CAST(g AS DATE) AS day FROM (VALUES (0), (1)) v(f), (SELECT unnest(generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-03-01', INTERVAL '1 day')) AS g)),
w AS (SELECT facility_id, day, CASE
    WHEN facility_id = 0 AND day = DATE '2024-01-15' THEN 0
    WHEN facility_id = 0 AND day BETWEEN DATE '2024-01-08' AND DATE '2024-01-12' AND isodow(day) <= 4 THEN 540
    WHEN facility_id = 0 AND isodow(day) <= 5 THEN 360 WHEN facility_id = 0 AND isodow(day) = 6 THEN 480 WHEN facility_id = 0 THEN 600
    WHEN day BETWEEN DATE '2024-01-20' AND DATE '2024-01-22' THEN 0 ELSE 1200 END AS s,
  CASE WHEN facility_id = 0 AND day = DATE '2024-01-15' THEN 0
    WHEN facility_id = 0 AND day BETWEEN DATE '2024-01-08' AND DATE '2024-01-12' AND isodow(day) <= 4 THEN 1020
    WHEN facility_id = 0 AND isodow(day) <= 5 THEN 1380 WHEN facility_id = 0 AND isodow(day) = 6 THEN 1200 WHEN facility_id = 0 THEN 1440
    WHEN day BETWEEN DATE '2024-01-20' AND DATE '2024-01-22' THEN 1440 ELSE 1560 END AS e,
  facility_id = 0 AND day = DATE '2024-01-15' AS shut FROM days),
r AS (SELECT m.*, s, e, coalesce(shut, false) AS shut, CASE WHEN s IS NULL THEN 'unknown' WHEN shut THEN 'closed'
    WHEN (e > 1440 AND (mi >= s OR mi < e - 1440)) OR (e <= 1440 AND mi >= s AND mi < e) THEN 'open' ELSE 'closed' END AS state,
  coalesce(NOT shut AND mi = s, false) AS om, coalesce(NOT shut AND mi = e % 1440, false) AS cm FROM m LEFT JOIN w USING (facility_id, day)),
pieces AS (SELECT facility_id, day, s AS a, least(e, 1440) AS b FROM w WHERE NOT shut
  UNION ALL SELECT w.facility_id, w.day, 0, p.e - 1440 FROM w JOIN w p ON p.facility_id = w.facility_id AND p.day = w.day - 1 WHERE p.e > 1440 AND NOT (w.facility_id = 1 AND w.day = DATE '2024-01-20'))
"""


@query("schedule_resolve", "WITH " + MOMENTS + "SELECT event_id, state AS schedule_state, s AS window_start, e AS window_end, om AS is_open_minute, cm AS is_close_minute FROM r")
def resolve(spark, d):
    return schedule.schedule_resolve(moments(spark, d), rule_table(spark), "ts").select(
        "event_id", "schedule_state", "window_start", "window_end", "is_open_minute", "is_close_minute"
    )


@query("schedule_resolve_spillover", "WITH " + MOMENTS + "SELECT event_id, state FROM r")
def spillover(spark, d):
    return schedule.schedule_status(moments(spark, d), rule_table(spark), "ts").select("event_id", "state")


def event_days(spark, d):
    return moments(spark, d).select("facility_id", F.to_date("ts").alias("day")).distinct()


@query("open_windows", "WITH " + MOMENTS + "SELECT p.facility_id, p.day, a AS start_min, b AS end_min FROM pieces p JOIN (SELECT DISTINCT facility_id, day FROM m) USING (facility_id, day)")
def open_windows(spark, d):
    return schedule.open_windows(rule_table(spark), event_days(spark, d)).select("facility_id", "day", "start_min", "end_min")


@query("merge_open_windows", """WITH w AS (SELECT user_id % 3 AS facility_id, CAST(ts AS DATE) AS day, CAST(event_id * 37 % 1300 AS INTEGER) AS a, CAST(event_id * 37 % 1300 + 10 + event_id % 90 AS INTEGER) AS b FROM events),
o AS (SELECT *, max(b) OVER (PARTITION BY facility_id, day ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM w),
i AS (SELECT *, sum(CASE WHEN a <= r THEN 0 ELSE 1 END) OVER (PARTITION BY facility_id, day ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT facility_id, day, min(a) AS start_min, max(b) AS end_min FROM i GROUP BY facility_id, day, g""")
def merge(spark, d):
    e = table(spark, d, "events")
    start = (F.col("event_id") * 37 % 1300).cast("int")
    w = e.select((F.col("user_id") % 3).alias("facility_id"), F.to_date("ts").alias("day"), start.alias("start_min"), (start + 10 + F.col("event_id") % 90).cast("int").alias("end_min"))
    return schedule.merge_open_windows(w, ["facility_id", "day"]).select("facility_id", "day", "start_min", "end_min")


@query("next_open", "WITH " + MOMENTS + "SELECT event_id, (SELECT min(p.day + p.a * INTERVAL '1 minute') FROM pieces p WHERE p.facility_id = m.facility_id AND p.day BETWEEN m.day AND m.day + 20 AND (p.day > m.day OR p.a > m.mi)) AS next_open FROM m")
def next_open(spark, d):
    return schedule.next_open(moments(spark, d), rule_table(spark), "ts").select("event_id", "next_open")


@query("filter_targets_by_schedule", "WITH " + MOMENTS + "SELECT event_id, (om OR cm) AND facility_id <> 2 AS is_boundary FROM r WHERE facility_id = 2 OR state = 'open' OR cm")
def filtered(spark, d):
    return schedule.filter_targets(moments(spark, d), rule_table(spark), "ts").select("event_id", "is_boundary")


@query("apply_schedule_to_readings", "WITH " + MOMENTS + "SELECT event_id AS id, CASE WHEN om OR cm THEN 0 ELSE round(v, 2) END AS current_capacity FROM r JOIN (SELECT event_id, value AS v FROM events) USING (event_id) WHERE state <> 'closed' OR cm")
def applied(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("facility_id"), F.col("ts").alias("observed_at"), F.round("value", 2).alias("current_capacity"))
    return schedule.apply_schedule_to_readings(rows, rule_table(spark)).select("id", "current_capacity")


@query("schedule_phase", "WITH " + MOMENTS + """, p AS (SELECT *, CASE WHEN e > 1440 AND mi < s THEN mi + 1440 ELSE mi END AS ab FROM r),
q AS (SELECT *, coalesce(NOT shut AND ab >= s AND ab < e, false) AS ins FROM p)
SELECT event_id, CASE WHEN ins THEN 1 ELSE 0 END AS phase_open, R6(CASE WHEN ins THEN (ab - s) / greatest(1, e - s) WHEN cm THEN 1.0 ELSE 0.0 END, 6) AS phase_progress,
  R6(CASE WHEN ins THEN least(1.0, (e - ab) / 720.0) ELSE 0.0 END, 6) AS phase_until_close, CASE WHEN ins AND ab - s <= 60 THEN 1 ELSE 0 END AS phase_near_open,
  CASE WHEN (ins AND e - ab <= 60) OR (NOT ins AND cm) THEN 1 ELSE 0 END AS phase_near_close,
  R6(CASE WHEN (ins AND (ab - s <= 60 OR e - ab <= 60)) OR (NOT ins AND cm) THEN 1.35 ELSE 1.0 END, 6) AS weight FROM q""")
def phase(spark, d):
    from crowdtide.functions.levels import transition_weight
    from crowdtide.functions.timeparts import minute_of_day

    rows = schedule.schedule_resolve(moments(spark, d), rule_table(spark), "ts")
    rows = rows.withColumns(text.schedule_phase(F.col("window"), minute_of_day(F.col("ts"))))
    return rows.select(
        "event_id", F.col("phase_open").cast("int").alias("phase_open"), r6(F.col("phase_progress")).alias("phase_progress"), r6(F.col("phase_until_close")).alias("phase_until_close"),
        F.col("phase_near_open").cast("int").alias("phase_near_open"), F.col("phase_near_close").cast("int").alias("phase_near_close"),
        r6(transition_weight(F.col("phase_near_open"), F.col("phase_near_close"))).alias("weight"),
    )


@query("facility_status", "WITH " + MOMENTS + """, u AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts - (event_id % 60) * INTERVAL '40 minutes' END AS lu FROM r),
v AS (SELECT *, state = 'open' AND (lu IS NULL OR CAST(lu AS DATE) < day OR (CAST(lu AS DATE) = day AND hour(lu) * 60 + minute(lu) < s)) AS nl FROM u)
SELECT event_id, CASE WHEN state = 'closed' THEN 'closed' WHEN coalesce(nl, false) THEN 'open_not_live' WHEN lu IS NOT NULL AND CAST(lu AS DATE) < day THEN 'stale' ELSE 'ok' END AS status,
  state = 'closed' OR (NOT coalesce(nl, false) AND lu IS NOT NULL AND CAST(lu AS DATE) < day) AS hide_forecast FROM v""")
def status(spark, d):
    s = schedule.schedule_status(moments(spark, d), rule_table(spark), "ts")
    back = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("event_id") % 60 * 40).cast("int"))
    s = s.withColumn("now", F.col("ts")).withColumn("last_updated", F.when(F.col("event_id") % 4 != 0, F.col("ts") - back))
    return schedule.facility_status(s).select("event_id", "status", "hide_forecast")


@query("visible_days", "WITH " + MOMENTS + """, v AS (SELECT DISTINCT facility_id, day FROM m JOIN pieces USING (facility_id, day))
SELECT facility_id, day FROM v QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY day) <= 4""")
def visible(spark, d):
    days = event_days(spark, d)
    return schedule.visible_days(days, schedule.open_windows(rule_table(spark), days)).select("facility_id", "day")


@query("best_rule", """SELECT facility_id, day, event_id FROM (SELECT user_id % 3 AS facility_id, CAST(ts AS DATE) AS day, event_id,
  row_number() OVER (PARTITION BY user_id % 3, CAST(ts AS DATE) ORDER BY event_id % 3 DESC, event_id % 7, user_id, event_id) AS rn FROM events) WHERE rn = 1""")
def best(spark, d):
    c = table(spark, d, "events").select(
        (F.col("user_id") % 3).alias("facility_id"), F.to_date("ts").alias("day"), "event_id", (F.col("event_id") % 3).alias("specificity"),
        (F.col("event_id") % 7).alias("span_days"), F.col("user_id").alias("section_idx"), F.col("event_id").alias("row_idx"),
    )
    return schedule.best_rule(c, ["facility_id", "day"], F.col("event_id")).select("facility_id", "day", F.col("winner").alias("event_id"))


FIXTURE_PAGES = {
    -1: "<h1>Site</h1><h2>About &amp; us</h2><h3>Pool&nbsp;Hours</h3><table class='x'><tr><th>Day</th><th>Hours</th></tr><tr><td>Mon&#8211;Fri</td><td>6am &#x2013; 10pm</td></tr>"
        "<tr><td>Saturday</td><td><b>8am</b><br>- 8pm</td></tr><tr><td>Note</td><td>bring a towel</td></tr></table>",
    -2: "<p>Check back <b>later</b> for summer<br>hours.</p><p>No scheduled maintenance closures&#32;at this time.</p>",
    -3: "<h2>Building Hours</h2><table><tr><td>Date</td><td>Hours</td></tr></table>",
    -4: "<html>Just a moment... Checking your browser</html>",
    -5: "<h2>Courts</h2><table><tr><td>Sunday</td><td>Closed</td></tr></table><h2>Track</h2><TABLE><TR><TD>Jan 5</TD><TD>noon - 4pm</TD></TR></TABLE><h4>Ice schedule</h4>"
        "<table><tr><td>Daily</td><td>24&nbsp;hours</td></tr></table><table><tr><td> daily </td><td>24 hours</td></tr></table>",
    -6: "",
}
EXTRACTED = """VALUES (-1, 'ok', NULL, '[{"title":"Pool Hours","rows":[{"label":"Mon–Fri","hours":"6am – 10pm"},{"label":"Saturday","hours":"8am - 8pm"}]}]'),
  (-2, 'ok', NULL, '[{"title":"Seasonal Notice","rows":[],"note":"Check back later for summer hours."},{"title":"Maintenance Closures","rows":[],"note":"No scheduled maintenance closures at this time."}]'),
  (-3, 'error', 'parsed 0 schedule sections', '[]'), (-4, 'error', 'bot challenge', '[]'),
  (-5, 'ok', NULL, '[{"title":"Courts","rows":[{"label":"Sunday","hours":"Closed"}]},{"title":"Track","rows":[{"label":"Jan 5","hours":"noon - 4pm"}]},{"title":"Ice schedule","rows":[{"label":"Daily","hours":"24 hours"}]},{"title":"Ice schedule","rows":[{"label":"daily","hours":"24 hours"}]}]'),
  (-6, 'error', 'parsed 0 schedule sections', '[]')"""


@query("extract_schedule_from_pages", "SELECT page_id, 'error' AS status, 'parsed 0 schedule sections' AS error, '[]' AS sections FROM pages UNION ALL " + EXTRACTED)
def extract(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    fixtures = spark.createDataFrame([(k, "https://example.com", html) for k, html in FIXTURE_PAGES.items()], pages.schema)
    return extract_schedule(pages.unionByName(fixtures)).select("page_id", "status", "error", F.to_json("sections").alias("sections"))


@query("canonical_section", """SELECT event_id, CASE WHEN k IN ('overall', 'entire facility', 'facility', 'all', 'all sections', 'whole gym') THEN 'overall' ELSE k END AS section_key
FROM (SELECT event_id, lower(trim(CASE event_id % 4 WHEN 0 THEN ' Entire Facility' WHEN 1 THEN 'ALL' WHEN 2 THEN event_type ELSE upper(event_type) || ' ' END)) AS k FROM events)""")
def canonical(spark, d):
    e = F.col("event_id") % 4
    raw = F.when(e == 0, " Entire  Facility").when(e == 1, "ALL").when(e == 2, F.col("event_type")).otherwise(F.concat(F.upper("event_type"), F.lit(" ")))
    return table(spark, d, "events").select("event_id", text.canonical_section(raw).alias("section_key"))
