"""Queries over crowd baselines, thresholds, bands, windows and display slots."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdtide.catalog.base import DIM, NOW, OBS, RATIO, capacity, locations, now, opened, query, r6, ratio
from crowdtide.functions import levels
from crowdtide.operators import bands, crowd, slots
from crowdtide.session import cut_lineage
from crowdtide.sources.document import compact_window
from crowdtide.plans.quiet_windows import SERIES, observed_points, quiet_windows_of

BASELINE = RATIO + "," + DIM + """,
grp AS (SELECT 'facility' AS group_kind, CAST(facility_id AS VARCHAR) AS group_key, location_id FROM dim
  UNION ALL SELECT 'section', facility_id || '/' || section_key, location_id FROM dim
  UNION ALL SELECT 'location', CAST(location_id AS VARCHAR), location_id FROM dim),
whole AS (SELECT group_kind, group_key, sum(max_cap) AS gc FROM grp JOIN caps USING (location_id) GROUP BY 1, 2),
steps AS (SELECT group_kind, group_key, bucket_ts, sum(ratio * c.max_cap) AS total, sum(c.max_cap) AS oc
  FROM ratio r JOIN caps c USING (location_id) JOIN grp USING (location_id) GROUP BY 1, 2, 3),
scaled AS (SELECT group_kind, group_key, CASE WHEN oc < gc THEN total * (gc / oc) ELSE total END AS v, gc
  FROM steps JOIN whole USING (group_kind, group_key) WHERE oc / gc >= 0.6),
baseline AS (SELECT group_kind, group_key, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.3) AS low_ceiling,
  quantile_cont(v, 0.7) AS peak_floor, CAST(max(gc) AS BIGINT) AS capacity, count(*) AS points FROM scaled GROUP BY 1, 2 HAVING count(*) >= 60),
lows AS (SELECT *, CAST(round_even(least(99.0, greatest(0.0, low_ceiling / capacity * 100)), 0) AS INTEGER) AS low_max FROM baseline),
thresholds AS (SELECT *, CAST(round_even(greatest(low_max + 1.0, least(100.0, peak_floor / capacity * 100)), 0) AS INTEGER) AS peak_min FROM lows)
"""


def baseline(spark, d):
    return crowd.crowd_baseline(ratio(spark, d), capacity(spark, d), crowd.location_groups(locations(spark, d)), min_points=60)


@query("crowd_baseline", "WITH " + BASELINE + """SELECT group_kind, group_key, R6(mean, 6) AS mean, R6(std, 5) AS std, R6(low_ceiling, 6) AS low_ceiling,
R6(peak_floor, 6) AS peak_floor, capacity, points FROM baseline""")
def crowd_baseline(spark, d):
    b = baseline(spark, d)
    return b.select("group_kind", "group_key", r6(F.col("mean")).alias("mean"), r6(F.col("std"), 5).alias("std"),
                    r6(F.col("low_ceiling")).alias("low_ceiling"), r6(F.col("peak_floor")).alias("peak_floor"), "capacity", "points")


@query("occupancy_thresholds", "WITH " + BASELINE + "SELECT group_kind, group_key, low_max, peak_min FROM thresholds")
def thresholds(spark, d):
    return crowd.occupancy_thresholds(baseline(spark, d)).select("group_kind", "group_key", "low_max", "peak_min")


@query("combine_thresholds", "WITH " + BASELINE + """,
p AS (SELECT d.facility_id, t.low_max, t.peak_min, t.capacity AS w FROM thresholds t JOIN dim d ON t.group_key = CAST(d.location_id AS VARCHAR) WHERE t.group_kind = 'location'),
c AS (SELECT facility_id, least(99, greatest(0, floor(sum(low_max * w) / sum(w) + 0.5))) AS lm, floor(sum(peak_min * w) / sum(w) + 0.5) AS pm FROM p GROUP BY 1)
SELECT facility_id, CAST(lm AS INTEGER) AS low_max, CAST(greatest(lm + 1, least(100, pm)) AS INTEGER) AS peak_min FROM c""")
def combined(spark, d):
    loc = locations(spark, d).withColumn("group_key", F.col("location_id").cast("string"))
    parts = crowd.occupancy_thresholds(baseline(spark, d)).filter("group_kind = 'location'").join(loc, "group_key").withColumn("weight", F.col("capacity"))
    return crowd.combine_thresholds(parts, ["facility_id"])


@query("fill_thresholds", "WITH " + BASELINE + """,
p AS (SELECT d.facility_id, t.low_max, t.peak_min, t.capacity AS w FROM thresholds t JOIN dim d ON t.group_key = CAST(d.location_id AS VARCHAR) WHERE t.group_kind = 'location'),
c AS (SELECT facility_id, least(99, greatest(0, floor(sum(low_max * w) / sum(w) + 0.5))) AS lm, floor(sum(peak_min * w) / sum(w) + 0.5) AS pm FROM p GROUP BY 1),
o AS (SELECT CAST(group_key AS BIGINT) AS facility_id, low_max, peak_min FROM thresholds WHERE group_kind = 'facility' AND group_key = '0')
SELECT coalesce(c.facility_id, o.facility_id) AS facility_id, CAST(coalesce(o.low_max, lm) AS INTEGER) AS low_max, CAST(coalesce(o.peak_min, greatest(lm + 1, least(100, pm))) AS INTEGER) AS peak_min,
  CASE WHEN o.low_max IS NOT NULL THEN 'own' ELSE 'combined' END AS origin FROM c FULL JOIN o ON o.facility_id = c.facility_id""")
def filled(spark, d):
    """Facility 0 has thresholds of its own; the others get those of their locations combined."""
    known = cut_lineage(crowd.occupancy_thresholds(baseline(spark, d)))
    own = known.filter("group_kind = 'facility' AND group_key = '0'").select(F.col("group_key").cast("bigint").alias("facility_id"), "low_max", "peak_min")
    loc = locations(spark, d).withColumn("group_key", F.col("location_id").cast("string"))
    parts = known.filter("group_kind = 'location'").join(loc, "group_key").withColumn("weight", F.col("capacity"))
    return crowd.fill_thresholds(own, parts, ["facility_id"])


POINTS = BASELINE + """,
points AS (SELECT g.group_key, CAST(r.bucket_ts AS DATE) AS day, r.bucket_ts AS ts, greatest(0, CAST(round_even(round(sum(r.mean_count), 6), 0) AS BIGINT)) AS expected,
  count(*) AS sample_count, max(t.capacity) AS capacity, max(t.low_max) AS low_max, max(t.peak_min) AS peak_min
  FROM ratio r JOIN grp g USING (location_id) JOIN thresholds t ON t.group_kind = g.group_kind AND t.group_key = g.group_key
  WHERE g.group_kind = 'facility' GROUP BY 1, 2, 3),
stp AS (SELECT group_key, day, coalesce(min(gap) FILTER (gap > 0), 15) AS step FROM (
  SELECT group_key, day, date_diff('minute', lag(ts) OVER (PARTITION BY group_key, day ORDER BY ts), ts) AS gap FROM points) GROUP BY 1, 2),
lab AS (SELECT p.*, s.step, CASE WHEN pct >= peak_min THEN 'peak' WHEN pct <= low_max THEN 'low' ELSE 'medium' END AS level
  FROM (SELECT *, least(100.0, greatest(0.0, expected / capacity * 100)) AS pct FROM points) p JOIN stp s USING (group_key, day)),
flg AS (SELECT *, CASE WHEN level = lag(level) OVER w AND date_diff('minute', lag(ts) OVER w, ts) <= step THEN 0 ELSE 1 END AS st FROM lab WINDOW w AS (PARTITION BY group_key, day ORDER BY ts)),
run0 AS (SELECT *, sum(st) OVER (PARTITION BY group_key, day ORDER BY ts) AS run FROM flg),
runs AS (SELECT group_key, day, CAST(run AS BIGINT) AS run, min(ts) AS s, max(ts) AS l, max(level) AS level, max(step) AS step FROM run0 GROUP BY 1, 2, 3),
bridged AS (SELECT *, CASE WHEN lag(level) OVER w = lead(level) OVER w AND date_diff('minute', s, l) + step <= 90
    AND date_diff('minute', lag(l) OVER w, s) <= step AND date_diff('minute', l, lead(s) OVER w) <= step THEN lag(level) OVER w ELSE level END AS lv
  FROM runs WINDOW w AS (PARTITION BY group_key, day ORDER BY run)),
bflg AS (SELECT *, CASE WHEN lv = lag(lv) OVER w AND date_diff('minute', lag(l) OVER w, s) <= step THEN 0 ELSE 1 END AS st FROM bridged WINDOW w AS (PARTITION BY group_key, day ORDER BY s)),
bnum AS (SELECT *, sum(st) OVER (PARTITION BY group_key, day ORDER BY s) AS band FROM bflg),
bnds AS (SELECT group_key, day, CAST(band AS BIGINT) AS band, min(s) AS start, max(l) + max(step) * INTERVAL '1 minute' AS "end", max(lv) AS level FROM bnum GROUP BY 1, 2, 3)
"""


def points(spark, d):
    groups = crowd.location_groups(locations(spark, d)).filter("group_kind = 'facility'")
    grid, caps = cut_lineage(ratio(spark, d)), capacity(spark, d)
    limits = crowd.occupancy_thresholds(crowd.crowd_baseline(grid, caps, groups, min_points=60))
    return cut_lineage(observed_points(grid, caps, groups, limits))


@query("infer_step_minutes", "WITH " + POINTS + "SELECT group_key, day, CAST(step AS INTEGER) AS step_min FROM stp")
def step(spark, d):
    return bands.infer_step_minutes(points(spark, d), SERIES).select("group_key", "day", "step_min")


@query("label_runs", "WITH " + POINTS + "SELECT group_key, day, run, s AS start, l AS last, level FROM runs")
def runs(spark, d):
    p = points(spark, d)
    return bands.label_runs(bands.label_points(p).join(bands.infer_step_minutes(p, SERIES), SERIES), SERIES).select("group_key", "day", "run", "start", "last", "level")


@query("crowd_bands", "WITH " + POINTS + 'SELECT group_key, day, band, start, "end", level FROM bnds')
def crowd_bands(spark, d):
    return bands.crowd_bands(points(spark, d), SERIES).select("group_key", "day", "band", "start", "end", "level")


WINDOWS = """
SELECT b.group_key, b.start, b."end", CAST(sum(p.expected) AS BIGINT) AS expected_total, min(p.sample_count) AS sample_count_min, count(*) AS window_points,
  R6(sum(p.expected) / count(*), 2) AS expected_avg FROM bnds b JOIN points p ON p.group_key = b.group_key AND p.ts >= b.start AND p.ts < b."end"
WHERE b.level = 'low' GROUP BY 1, 2, 3"""


@query("windows_from_bands", "WITH " + POINTS + WINDOWS)
def windows(spark, d):
    p = points(spark, d)
    out = bands.windows_from_bands(bands.crowd_bands(p, SERIES), p, SERIES, "low")
    return out.select("group_key", "start", "end", "expected_total", "sample_count_min", "window_points",
                      r6(F.col("expected_total") / F.col("window_points"), 2).alias("expected_avg"))


@query("compact_windows", "WITH " + POINTS + """
SELECT b.group_key, b.start, b."end", CAST(hour(b.start) AS INTEGER) AS start_hour, CAST(hour(b."end") AS INTEGER) AS end_hour, round_even(date_diff('minute', b.start, b."end") / 60.0, 2) AS window_hours,
  CAST(sum(p.expected) AS BIGINT) AS expected_total, round_even(sum(p.expected) / count(*), 2) AS expected_avg FROM bnds b JOIN points p ON p.group_key = b.group_key AND p.ts >= b.start AND p.ts < b."end"
WHERE b.level = 'peak' GROUP BY 1, 2, 3""")
def compact(spark, d):
    p = points(spark, d)
    crowded = bands.windows_from_bands(bands.crowd_bands(p, SERIES), p, SERIES, "peak")
    return crowded.select("group_key", compact_window(F.struct(*crowded.columns)).alias("w")).select("group_key", "w.*")


@query("quiet_windows", "WITH " + POINTS.replace(">= 60", ">= 120") + """
SELECT b.group_key AS facility, CASE b.level WHEN 'low' THEN 'best' ELSE 'avoid' END AS advice, b.start, b."end",
  round(date_diff('minute', b.start, b."end") / 60.0, 2) AS window_hours, CAST(sum(p.expected) AS BIGINT) AS expected_total,
  round_even(sum(p.expected) / count(*), 2) AS expected_avg, min(p.sample_count) AS sample_count_min, count(*) AS window_points
FROM bnds b JOIN points p ON p.group_key = b.group_key AND p.ts >= b.start AND p.ts < b."end" WHERE b.level <> 'medium' GROUP BY 1, 2, 3, 4""")
def quiet(spark, d):
    return quiet_windows_of(spark, d)


def day_bands(spark, d):
    return bands.crowd_bands(points(spark, d), SERIES, bridge=False).drop("band")


@query("merge_adjacent_bands", "WITH " + POINTS + """,
nb AS (SELECT group_key, day, run, s, l + step * INTERVAL '1 minute' AS e, CASE WHEN level = 'medium' THEN 'low' ELSE level END AS level FROM runs),
mf AS (SELECT *, CASE WHEN level = lag(level) OVER w AND abs(date_diff('second', lag(e) OVER w, s)) <= 60 THEN 0 ELSE 1 END AS st FROM nb WINDOW w AS (PARTITION BY group_key, day ORDER BY s)),
mn AS (SELECT *, sum(st) OVER (PARTITION BY group_key, day ORDER BY s) AS g FROM mf)
SELECT group_key, day, min(s) AS start, max(e) AS "end", max(level) AS level FROM mn GROUP BY group_key, day, g""")
def merged(spark, d):
    two = day_bands(spark, d).withColumn("level", F.when(F.col("level") == "medium", "low").otherwise(F.col("level")))
    return bands.merge_adjacent_bands(two, SERIES).select("group_key", "day", "start", "end", "level")


BRIDGED = "[CASE WHEN i > 1 AND i < len(b) AND b[i - 1].l = b[i + 1].l AND b[i].l <> b[i - 1].l AND epoch(b[i].e) - epoch(b[i].s) <= 5400 AND abs(epoch(b[i].s) - epoch(b[i - 1].e)) <= 60 AND abs(epoch(b[i + 1].s) - epoch(b[i].e)) <= 60 THEN {'s': b[i].s, 'e': b[i].e, 'l': b[i - 1].l} ELSE b[i] END FOR i IN range(1, len(b) + 1)]"
MERGED = "list_reduce(list_transform({bands}, lambda x: [x]), lambda d, x: CASE WHEN d[-1].l = x[1].l AND abs(epoch(x[1].s) - epoch(d[-1].e)) <= 60 THEN list_concat(d[:-2], [{{'s': d[-1].s, 'e': x[1].e, 'l': x[1].l}}]) ELSE list_concat(d, x) END)"


@query("bridge_bands_until_stable", "WITH RECURSIVE " + POINTS.strip().removeprefix("WITH") + """,
db AS (SELECT group_key, day, list({'s': s, 'e': l + step * INTERVAL '1 minute', 'l': level} ORDER BY s) AS b FROM runs GROUP BY 1, 2),
walk AS (SELECT group_key, day, 0 AS step, """ + MERGED.format(bands="b") + """ AS b FROM db
  UNION ALL SELECT group_key, day, step, n FROM (SELECT group_key, day, step + 1 AS step, b, """ + MERGED.format(bands=BRIDGED) + """ AS n FROM walk) WHERE n <> b),
ends AS (SELECT group_key, day, unnest(arg_max(b, step)) AS x FROM walk GROUP BY 1, 2)
SELECT group_key, day, x.s AS start, x.e AS "end", x.l AS level FROM ends""")
def bridged(spark, d):
    return bands.bridge_bands_until_stable(day_bands(spark, d), SERIES).select("group_key", "day", "start", "end", "level")


@query("band_at_midpoint", "WITH " + POINTS + """,
sl AS (SELECT group_key, day, ts AS start, ts + INTERVAL '30 minutes' AS "end" FROM points)
SELECT sl.group_key, sl.start, coalesce((SELECT arg_min(b.level, b.start) FROM bnds b WHERE b.group_key = sl.group_key AND b.day = sl.day
  AND sl.start + INTERVAL '15 minutes' >= b.start AND sl.start + INTERVAL '15 minutes' < b."end"), 'unknown') AS level FROM sl""")
def midpoint(spark, d):
    p = points(spark, d)
    half = p.select(*SERIES, F.col("target_ts").alias("start"), (F.col("target_ts") + F.expr("INTERVAL 30 MINUTES")).alias("end"), F.lit("unknown").alias("level"))
    return bands.band_at_midpoint(half, bands.crowd_bands(p, SERIES), SERIES).select("group_key", "start", "level")


OPEN = "SELECT {key}, {day}, m.s AS start_min, m.e AS end_min"


@query("clip_to_open_windows", "WITH " + POINTS + """,
ow AS (SELECT DISTINCT group_key, day, s, e FROM points, (VALUES (390, 750), (800, 1320)) v(s, e) WHERE isodow(day) <> 7),
cl AS (SELECT b.group_key, b.day, b.level, greatest(b.start, b.day + ow.s * INTERVAL '1 minute') AS start, least(b."end", b.day + ow.e * INTERVAL '1 minute') AS "end"
  FROM bnds b JOIN ow USING (group_key, day))
SELECT * FROM cl WHERE start < "end" """)
def clipped(spark, d):
    p = points(spark, d)
    return bands.clip_to_open_windows(bands.crowd_bands(p, SERIES), open_hours(p), SERIES).select("group_key", "day", "level", "start", "end")


def open_hours(p):
    pair = lambda s, e: F.struct(F.lit(s).alias("start_min"), F.lit(e).alias("end_min"))
    return p.select(*SERIES).distinct().filter(F.weekday("day") != 6).withColumn("_w", F.explode(F.array(pair(390, 750), pair(800, 1320)))).select(*SERIES, "_w.*")


@query("contained_in_open_window", "WITH " + POINTS + """
SELECT group_key, ts FROM points WHERE isodow(day) <> 7 AND ((hour(ts) * 60 >= 390 AND hour(ts) * 60 + 30 <= 750) OR (hour(ts) * 60 >= 800 AND hour(ts) * 60 + 30 <= 1320))""")
def contained(spark, d):
    p = points(spark, d)
    slot = p.select(*SERIES, F.col("target_ts").alias("ts"), (F.hour("target_ts") * 60).alias("start_min"), (F.hour("target_ts") * 60 + 30).alias("end_min"))
    return bands.contained_in_open_window(slot, open_hours(p), SERIES).select("group_key", "ts")


@query("current_band", "WITH " + POINTS + f"""SELECT group_key, start, "end", level FROM bnds WHERE start <= TIMESTAMP '{NOW}' AND "end" > TIMESTAMP '{NOW}'""")
def current(spark, d):
    return bands.current_band(bands.crowd_bands(points(spark, d), SERIES), now()).select("group_key", "start", "end", "level")


HOURS = RATIO + "," + DIM + """, hourly AS (SELECT facility_id, CAST(bucket_ts AS DATE) AS day, hour(bucket_ts) AS hour, CAST(round_even(round(sum(mean_count), 6), 0) AS BIGINT) * 3 AS count
  FROM ratio JOIN dim USING (location_id) GROUP BY 1, 2, 3)
"""


def hourly(spark, d):
    return ratio(spark, d).join(locations(spark, d), "location_id").groupBy("facility_id", F.to_date("bucket_ts").alias("day"), F.hour("bucket_ts").alias("hour")).agg(
        (levels.whole_count(F.sum("mean_count")) * 3).alias("count")
    )


@query("smooth_isolated", "WITH " + HOURS + """, n AS (SELECT *, lag(count) OVER w AS a, lead(count) OVER w AS b FROM hourly WINDOW w AS (PARTITION BY facility_id, day ORDER BY hour))
SELECT facility_id, day, hour, count, CAST(CASE WHEN abs(a - b) <= greatest(18, (a + b) / 2 * 0.18) AND ((count < a AND count < b) OR (count > a AND count > b))
  AND abs(count - (a + b) / 2) >= greatest(32, (a + b) / 2 * 0.3) THEN greatest(0, floor((a + b) / 2 + 0.5)) ELSE count END AS BIGINT) AS smoothed FROM n""")
def smooth(spark, d):
    return bands.smooth_isolated(hourly(spark, d), ["facility_id", "day"]).select("facility_id", "day", "hour", "count", "smoothed")


def slot_points(spark, d):
    """Quarter-hour points of a facility with forecast and, partly, actual values."""
    r = ratio(spark, d, 15).join(locations(spark, d), "location_id")
    return r.groupBy("facility_id", F.to_date("bucket_ts").alias("day"), F.col("bucket_ts").alias("target_ts")).agg(
        levels.whole_count(F.sum("mean_count")).alias("expected"), F.sum("max_cap").alias("cap"), F.count("*").alias("n")
    ).withColumns({
        "pct": F.round(F.col("expected") / F.col("cap"), 4), "actual_count": F.when(F.col("n") % 2 == 1, F.col("expected") + 2),
        "actual_pct": F.when(F.col("n") % 2 == 1, F.round(F.col("expected") / F.col("cap") / 2, 4)), "low_max": F.lit(20), "peak_min": F.lit(40),
    })


SLOTS = RATIO.replace("60 minutes", "15 minutes") + "," + DIM + f""",
sp AS (SELECT facility_id, CAST(bucket_ts AS DATE) AS day, bucket_ts AS ts, CAST(round_even(round(sum(mean_count), 6), 0) AS BIGINT) AS expected, sum(max_cap) AS cap, count(*) AS n
  FROM ratio JOIN dim USING (location_id) GROUP BY 1, 2, 3),
rs AS (SELECT *, (ts < TIMESTAMP '2024-01-25 10:00:00' AND n % 2 = 1) AS act, CAST((hour(ts) * 60 + minute(ts)) // 30 * 30 AS INTEGER) AS start_min FROM sp),
slots AS (SELECT facility_id, day, start_min, CAST(floor(avg(CASE WHEN act THEN expected + 2 ELSE expected END) + 0.5) AS BIGINT) AS count,
  avg(CASE WHEN act THEN round(expected / cap / 2, 4) ELSE round(expected / cap, 4) END) AS percent,
  CASE WHEN count(*) FILTER (act) = 0 THEN 'predicted' WHEN count(*) FILTER (act) = count(*) THEN 'actual' ELSE 'mixed' END AS source FROM rs GROUP BY 1, 2, 3),
leveled AS (SELECT *, CASE WHEN percent * 100 <= 20 THEN 'low' WHEN percent * 100 < 40 THEN 'medium' ELSE 'peak' END AS level FROM slots)
"""


def display(spark, d):
    return slots.display_slots(slot_points(spark, d), ["facility_id", "day"], now())


@query("display_slots", "WITH " + SLOTS + "SELECT facility_id, day, start_min, count, R6(percent, 6) AS percent, source, level FROM leveled")
def display_slots(spark, d):
    return display(spark, d).select("facility_id", "day", "start_min", "count", r6(F.col("percent")).alias("percent"), "source", "level")


@query("hourly_histogram", "WITH " + SLOTS + """, h AS (SELECT facility_id, day, start_min // 60 AS hour, max(CASE WHEN start_min % 60 < 30 THEN count END) AS a, max(CASE WHEN start_min % 60 >= 30 THEN count END) AS b,
  CAST(floor(avg(count) + 0.5) AS BIGINT) AS count, CASE WHEN bool_and(source = 'actual') THEN 'actual' WHEN bool_and(source = 'predicted') THEN 'predicted' ELSE 'mixed' END AS source FROM leveled GROUP BY 1, 2, 3)
SELECT facility_id, day, CAST(hour AS INTEGER) AS hour, count, coalesce(a, b) AS left_count, coalesce(b, a) AS right_count, source FROM h""")
def histogram(spark, d):
    return slots.hourly_histogram(display(spark, d), ["facility_id", "day"]).select("facility_id", "day", "hour", "count", "left_count", "right_count", "source")


@query("infer_capacity", "WITH " + SLOTS + "SELECT facility_id, R6(median(count / percent), 4) AS capacity FROM leveled WHERE percent > 0 AND count > 0 GROUP BY 1")
def infer_cap(spark, d):
    return slots.infer_capacity(display(spark, d), ["facility_id"]).select("facility_id", r6(F.col("capacity"), 4).alias("capacity"))


NEXT = RATIO.replace("60 minutes", "15 minutes") + "," + DIM + f""",
np AS (SELECT facility_id, section_key, bucket_ts AS ts, CAST(round_even(round(sum(mean_count), 6), 0) AS BIGINT) AS expected FROM ratio JOIN dim USING (location_id) GROUP BY 1, 2, 3),
nh AS (SELECT facility_id, section_key, hour(ts) AS hour, CAST(floor(avg(greatest(0, expected)) + 0.5) AS BIGINT) AS expected FROM np
  WHERE CAST(ts AS DATE) = DATE '2024-01-25' AND hour(ts) > 10 AND hour(ts) * 60 + minute(ts) >= 390 AND hour(ts) * 60 + minute(ts) < 1320 GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY facility_id, section_key ORDER BY hour) AS rank FROM nh)
"""


def next_hours(spark, d):
    p = ratio(spark, d, 15).join(locations(spark, d), "location_id").groupBy("facility_id", "section_key", F.col("bucket_ts").alias("target_ts")).agg(
        levels.whole_count(F.sum("mean_count")).alias("expected")
    )
    windows = locations(spark, d).select("facility_id").distinct().select(
        "facility_id", F.to_date(now()).alias("day"), F.lit(390).alias("start_min"), F.lit(1320).alias("end_min")
    )
    return slots.next_hours_by_section(p, windows, now())


@query("next_hours_by_section", "WITH " + NEXT + "SELECT facility_id, section_key, CAST(hour AS INTEGER) AS hour, expected, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3")
def next_by_section(spark, d):
    return next_hours(spark, d).select("facility_id", "section_key", "hour", "expected", "rank")


@query("step_direction", "WITH " + NEXT + """SELECT facility_id, section_key, CAST(rank AS INTEGER) AS rank,
CASE WHEN expected > p THEN 'up' WHEN expected < p THEN 'down' ELSE 'flat' END AS direction FROM (SELECT *, coalesce(lag(expected) OVER (PARTITION BY facility_id, section_key ORDER BY rank), 40) AS p FROM ranked WHERE rank <= 3)""")
def direction(spark, d):
    totals = locations(spark, d).select("facility_id", "section_key").distinct().withColumn("live_total", F.lit(40))
    return slots.step_direction(next_hours(spark, d), totals, ["facility_id", "section_key"]).select("facility_id", "section_key", "rank", "direction")


@query("forecast_hour_bounds", "SELECT min(hour(ts)) AS min_hour, max(hour(ts)) AS max_hour FROM events")
def bounds(spark, d):
    return slots.forecast_hour_bounds(spark.read.parquet(f"{d}/events.parquet"), "ts")


ESTIMATES = RATIO + "," + DIM + """,
est AS (SELECT location_id, bucket_ts AS ts, mean_count * 0.8 AS c10, mean_count AS c50, mean_count * 1.2 AS c90, CAST(1 AS BIGINT) AS samples, max_cap FROM ratio),
gs AS (SELECT facility_id, ts, CAST(ts AS DATE) AS day, CAST(round_even(round(sum(c10), 6), 0) AS BIGINT) AS e10, CAST(round_even(round(sum(c50), 6), 0) AS BIGINT) AS e50,
  CAST(round_even(round(sum(c90), 6), 0) AS BIGINT) AS e90, CAST(sum(samples) AS BIGINT) AS sample_count, CAST(sum(max_cap) AS BIGINT) AS capacity FROM est JOIN dim USING (location_id) GROUP BY 1, 2, 3)
"""


def group_points(spark, d):
    est = ratio(spark, d).select(
        "location_id", F.col("bucket_ts").alias("target_ts"), (F.col("mean_count") * 0.8).alias("count_p10"), F.col("mean_count").alias("count_p50"),
        (F.col("mean_count") * 1.2).alias("count_p90"), F.lit(1).alias("samples"), "max_cap",
    )
    return crowd.group_series(est, locations(spark, d).select("location_id", "facility_id"), ["facility_id"]).withColumn("day", F.to_date("target_ts"))


@query("group_series", "WITH " + ESTIMATES + """SELECT facility_id, ts AS target_ts, e10 AS expected_p10, e50 AS expected, e90 AS expected_p90, sample_count, capacity,
round_even(least(e50 / capacity, 1.0), 4) AS pct FROM gs""")
def group_series(spark, d):
    return group_points(spark, d).select("facility_id", "target_ts", "expected_p10", "expected", "expected_p90", "sample_count", "capacity", "pct")


@query("zero_at_boundary", "WITH " + ESTIMATES + "SELECT facility_id, ts AS target_ts, CASE WHEN hour(ts) IN (6, 22) THEN 0 ELSE e50 END AS expected, hour(ts) IN (6, 22) AS boundary_zeroed FROM gs")
def zeroed(spark, d):
    flagged = group_points(spark, d).withColumn("is_boundary", F.hour("target_ts").isin(6, 22))
    return crowd.zero_at_boundary(flagged).select("facility_id", "target_ts", "expected", "boundary_zeroed")


@query("spike_adjust", "WITH " + ESTIMATES + f""",
ro AS (SELECT *, row_number() OVER (PARTITION BY facility_id, day ORDER BY ts) AS i FROM gs),
cu AS (SELECT facility_id, day, max(i) AS ci FROM ro WHERE ts <= TIMESTAMP '{NOW}' GROUP BY 1, 2),
dr AS (SELECT ro.*, ro.i - cu.ci AS k, 150 - b.e50 AS drift, (150 - b.e50) * exp(-0.55 * greatest(0, ro.i - cu.ci - 1)) AS dl
  FROM ro LEFT JOIN cu USING (facility_id, day) LEFT JOIN ro b ON b.facility_id = ro.facility_id AND b.day = ro.day AND b.i = cu.ci),
ad AS (SELECT *, coalesce(abs(drift) >= 1 AND k BETWEEN 1 AND 6 AND abs(dl) >= 0.5, false) AS hit FROM dr)
SELECT facility_id, ts AS target_ts, hit AS spike_adjusted, CASE WHEN hit THEN CAST(round_even(round(least(greatest(
  greatest(0, least(e50 + dl, capacity * 1.35)), greatest(0, least(e10 + dl, capacity * 1.35))), greatest(0, least(e90 + dl, capacity * 1.35))), 6), 0) AS BIGINT) ELSE e50 END AS expected FROM ad""")
def spike(spark, d):
    live = locations(spark, d).select("facility_id").distinct().withColumn("live_total", F.lit(150.0))
    return crowd.spike_adjust(group_points(spark, d), live, ["facility_id", "day"], now()).select("facility_id", "target_ts", "spike_adjusted", "expected")
