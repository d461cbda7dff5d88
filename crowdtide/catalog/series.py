"""Queries over lags, as-of joins, rolling statistics, weather, calendar and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdtide import config
from crowdtide.catalog.base import (
    RATIO, OBS, WEATHER, WEATHER_TYPES, PRED, opened, predictions, query, r6, ratio, ratio_sql, series, weather,
)
from crowdtide.functions import levels, timeparts
from crowdtide.operators import asof, calendar, quantiles, rolling_stats, row_weights
from crowdtide.operators.clean import seasonal_profiles
from crowdtide.sources import weather as wx

RATIO15 = ratio_sql(15)


@query("lag_join", "WITH " + RATIO15 + "SELECT a.location_id, a.bucket_ts" + "".join(
    f", (SELECT R6(max(b.ratio), 6) FROM ratio b WHERE b.location_id = a.location_id AND b.bucket_ts = a.bucket_ts - INTERVAL '{m} minutes') AS {n}"
    for n, m in asof.LAGS.items()) + " FROM ratio a")
def lag_join(spark, d):
    r = ratio(spark, d, 15)
    return asof.lag_join(r.select("location_id", "bucket_ts"), r, ["location_id"]).select(
        "location_id", "bucket_ts", *[r6(F.col(n)).alias(n) for n in asof.LAGS]
    )


@query("asof_strict", "WITH " + RATIO15 + """
SELECT r.location_id, r.bucket_ts, R6(s.count, 6) AS last_count, R6((epoch_us(r.bucket_ts) - epoch_us(s.observed_at)) / 60e6, 6) AS age_min
FROM ratio r ASOF LEFT JOIN series s ON s.location_id = r.location_id AND s.observed_at < r.bucket_ts""")
def asof_strict(spark, d):
    r = ratio(spark, d, 15).select("location_id", "bucket_ts")
    out = asof.as_of(r, series(spark, d), ["location_id"], "bucket_ts", "observed_at", ["count"], strict=True, ages=True)
    return out.select("location_id", "bucket_ts", r6(F.col("count")).alias("last_count"), r6(F.col("count_age_min")).alias("age_min"))


WX = tuple(WEATHER_TYPES)
ASOF_WX = WEATHER + ",\ntimes AS (SELECT DISTINCT time_bucket(INTERVAL '15 minutes', ts) AS hr FROM events),\n" + "wx AS (SELECT t.hr" + "".join(
    f", {k}.{k}" for k in WX) + " FROM times t" + "".join(
    f" ASOF LEFT JOIN (SELECT ts, {k} FROM weather WHERE {k} IS NOT NULL) {k} ON {k}.ts <= t.hr" for k in WX) + ")"


def times(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.window("ts", "15 minutes")["start"].alias("hr")).distinct()


@query("asof_weather", "WITH " + ASOF_WX + " SELECT hr, " + ", ".join(f"R6({k}, 6) AS {k}" for k in WX) + " FROM wx")
def asof_weather(spark, d):
    return wx.weather_as_of(times(spark, d), weather(spark, d), "hr", WX).select("hr", *[r6(F.col(k)).alias(k) for k in WX])


@query("weather_hours", "WITH " + ASOF_WX + " SELECT hr, " + ", ".join(f"R6({k}, 2) AS {k}" for k in WX) + " FROM wx")
def weather_hours(spark, d):
    # compared after rounding the same way on both sides; half-even has its own query
    found = wx.weather_hours(times(spark, d), weather(spark, d).select("ts", *[r6(F.col(k), 2).alias(k) for k in WX]), "hr", WX)
    return found.select("hr", *WX)


@query("weather_day_summary", "WITH " + WEATHER + """
SELECT CAST(ts AS DATE) AS day, round_even(avg(temp_c + 0.0013), 2) AS avg_temp_c, round_even(sum(precip_mm + 0.0013), 2) AS sum_precip_mm, round_even(max(wind_mps + 0.0013), 2) AS max_wind_mps,
       list_sort(list_distinct(list(CAST(floor(temp_c) AS INTEGER) % 9))) AS weather_codes FROM weather GROUP BY 1""")
def weather_summary(spark, d):
    w = weather(spark, d).withColumn("day", F.to_date("ts")).withColumn("weather_code", F.floor("temp_c").cast("int") % 9)
    w = w.withColumns({c: F.col(c) + 0.0013 for c in ("temp_c", "precip_mm", "wind_mps")})     # off the ties, which doubles cannot tell
    return wx.weather_day_summary(w, ["day"]).select("day", "avg_temp_c", "sum_precip_mm", "max_wind_mps", "weather_codes")


@query("merge_weather", "WITH " + WEATHER + """
SELECT coalesce(a.ts, b.ts) AS ts, R6(coalesce(b.temp_c, a.temp_c), 6) AS temp_c, R6(coalesce(b.precip_mm, a.precip_mm), 6) AS precip_mm
FROM (SELECT * FROM weather WHERE day(ts) <= 16) a FULL JOIN (SELECT ts, temp_c + 1 AS temp_c, precip_mm FROM weather WHERE day(ts) >= 15) b ON a.ts = b.ts""")
def merge(spark, d):
    w = weather(spark, d).select("ts", "temp_c", "precip_mm")
    old = w.filter(F.dayofmonth("ts") <= 16)
    new = w.filter(F.dayofmonth("ts") >= 15).withColumn("temp_c", F.col("temp_c") + 1)
    return wx.merge_weather(old, new, ("temp_c", "precip_mm")).select("ts", r6(F.col("temp_c")).alias("temp_c"), r6(F.col("precip_mm")).alias("precip_mm"))


@query("weather_payload_to_rows", """
SELECT time_bucket(INTERVAL '60 minutes', ts) AS ts, R6(avg(value), 3) AS temp_c FROM events
WHERE event_type <> 'error' GROUP BY 1""")
def payload(spark, d):
    # one payload a day, with a wind series that is too short and never finite
    hourly = spark.read.parquet(f"{d}/events.parquet").filter("event_type <> 'error'").groupBy(
        F.window("ts", "60 minutes")["start"].alias("ts")
    ).agg(F.avg("value").alias("v"))
    docs = hourly.groupBy(F.to_date("ts").alias("day")).agg(
        F.sort_array(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("t"), F.col("v").cast("string").alias("v")))).alias("a")
    ).select(F.to_json(F.struct(F.struct(
        F.col("a.t").alias("time"), F.col("a.v").alias("temperature_2m"), F.array(F.lit("NaN")).alias("wind_speed_10m")
    ).alias("hourly"))).alias("payload"))
    return wx.weather_payload_to_rows(docs).select("ts", r6(F.col("temp_c"), 3).alias("temp_c"))


STEP = {1: 4, 2: 8, 3: 12, 6: 24, 12: 48, 24: 96}


def _frame(hours: int) -> str:
    return f"OVER (PARTITION BY location_id ORDER BY bucket_ts RANGE BETWEEN INTERVAL '{hours * 60} minutes' PRECEDING AND INTERVAL '1 minute' PRECEDING)"


@query("rolling_mean", "WITH " + RATIO15 + "SELECT location_id, bucket_ts, " + ", ".join(
    f"R6(avg(ratio) {_frame(h)}, 6) AS {n}" for n, h in rolling_stats.MEAN_HOURS.items()) + " FROM ratio")
def rolling_mean(spark, d):
    return _rolled(spark, d, tuple(rolling_stats.MEAN_HOURS))


@query("rolling_std", "WITH " + RATIO15 + "SELECT location_id, bucket_ts, " + ", ".join(
    f"CASE WHEN count(ratio) {_frame(h)} >= 2 THEN R6(stddev_pop(ratio) {_frame(h)}, 5) END AS {n}" for n, h in rolling_stats.STD_HOURS.items()) + " FROM ratio")
def rolling_std(spark, d):
    return _rolled(spark, d, tuple(rolling_stats.STD_HOURS), 5)


@query("rolling_range", "WITH " + RATIO15 + "SELECT location_id, bucket_ts, " + ", ".join(
    f"R6(max(ratio) {_frame(h)} - min(ratio) {_frame(h)}, 6) AS {n}" for n, h in rolling_stats.RANGE_HOURS.items()) + " FROM ratio")
def rolling_range(spark, d):
    return _rolled(spark, d, tuple(rolling_stats.RANGE_HOURS))


@query("recent_missing_ratio", "WITH " + RATIO15 + f"SELECT location_id, bucket_ts, R6(1.0 - count(ratio) {_frame(2)} / 8.0, 6) AS missing_recent FROM ratio")
def recent_missing(spark, d):
    return _rolled(spark, d, ("missing_recent",))


def _rolled(spark, d, names, digits=6):
    r = ratio(spark, d, 15).select("location_id", "bucket_ts", "ratio")
    out = rolling_stats.rolling_statistics(r, ["location_id"], names=names)
    return out.select("location_id", "bucket_ts", *[r6(F.col(n), digits).alias(n) for n in names])


@query("flatline_steps", "WITH " + RATIO15 + ", v AS (SELECT location_id, bucket_ts, CAST(floor(ratio * 2) AS DOUBLE) AS ratio FROM ratio), s AS (SELECT a.location_id, a.bucket_ts" + "".join(
    f", v{i}.ratio AS v{i}" for i in range(1, 9)) + " FROM v a" + "".join(
    f" LEFT JOIN v v{i} ON v{i}.location_id = a.location_id AND v{i}.bucket_ts = a.bucket_ts - INTERVAL '{15 * i} minutes'" for i in range(1, 9))
    + ") SELECT location_id, bucket_ts, CAST(CASE WHEN v1 IS NULL THEN 0 "
    + " ".join(f"WHEN v{i} IS NULL OR abs(v{i} - v{i - 1}) > 0.002 THEN {i - 1}" for i in range(2, 9)) + " ELSE 8 END AS INTEGER) AS flat_steps FROM s")
def flat_steps(spark, d):
    coarse = ratio(spark, d, 15).select("location_id", "bucket_ts", F.floor(F.col("ratio") * 2).cast("double").alias("ratio"))
    return rolling_stats.flatline_steps(coarse, ["location_id"]).select("location_id", "bucket_ts", "flat_steps")


@query("deltas_trends", "WITH " + RATIO15 + """,
rolled AS (SELECT location_id, bucket_ts, """ + ", ".join(f"avg(ratio) {_frame(h)} AS {n}" for n, h in rolling_stats.MEAN_HOURS.items()) + """ FROM ratio),
lags AS (SELECT a.location_id, a.bucket_ts, b.ratio AS l15, c.ratio AS l24 FROM ratio a
  LEFT JOIN ratio b ON b.location_id = a.location_id AND b.bucket_ts = a.bucket_ts - INTERVAL '15 minutes'
  LEFT JOIN ratio c ON c.location_id = a.location_id AND c.bucket_ts = a.bucket_ts - INTERVAL '1440 minutes')
SELECT location_id, bucket_ts, R6(l15 - l24, 6) AS delta_24h, R6(roll_1h - roll_2h, 6) AS trend_short, R6(roll_2h - roll_6h, 6) AS trend_mid,
  R6(roll_2h - roll_24h, 6) AS trend_long, R6((roll_1h - roll_2h) - (roll_2h - roll_6h), 6) AS trend_accel_short
FROM rolled JOIN lags USING (location_id, bucket_ts)""")
def deltas_trends(spark, d):
    r = ratio(spark, d, 15).select("location_id", "bucket_ts", "ratio")
    lagged = asof.lag_join(r, r, ["location_id"])
    rolled = rolling_stats.rolling_statistics(lagged, ["location_id"])
    names = ("delta_24h", "trend_short", "trend_mid", "trend_long", "trend_accel_short")
    return rolling_stats.deltas_and_trends(rolled).select("location_id", "bucket_ts", *[r6(F.col(n)).alias(n) for n in names])


@query("weather_rolling_mean", "WITH " + WEATHER + """,
span AS (SELECT min(time_bucket(INTERVAL '15 minutes', ts)) AS a, max(time_bucket(INTERVAL '15 minutes', ts)) AS b FROM events),
grid AS (SELECT unnest(generate_series(a, b, INTERVAL '15 minutes')) AS hr FROM span),
wx AS (SELECT g.hr, t.temp_c FROM grid g ASOF LEFT JOIN (SELECT ts, temp_c FROM weather WHERE temp_c IS NOT NULL) t ON t.ts <= g.hr)
SELECT hr, R6(avg(temp_c) OVER (ORDER BY hr RANGE BETWEEN INTERVAL '180 minutes' PRECEDING AND INTERVAL '1 minute' PRECEDING), 6) AS temp_c_roll FROM wx""")
def weather_roll(spark, d):
    span = times(spark, d).agg(F.min("hr").alias("a"), F.max("hr").alias("b"))
    grid = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 15 MINUTES"))).alias("hr"))
    found = wx.weather_as_of(grid, weather(spark, d), "hr", ("temp_c",))
    return rolling_stats.weather_rolling_mean(found, "hr", ("temp_c",)).select("hr", r6(F.col("temp_c_roll")).alias("temp_c_roll"))


CAL_RANGES = "ranges AS (SELECT * FROM (VALUES ('fall', DATE '2024-01-02', DATE '2024-01-08'), ('spring', DATE '2024-01-10', DATE '2024-01-20'), ('exams', DATE '2024-01-22', DATE '2024-01-24')) t(kind, s, e))"


@query("calendar_range_join", "WITH " + CAL_RANGES + """, d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)
SELECT day, CAST(EXISTS (SELECT 1 FROM ranges WHERE kind = 'fall' AND day BETWEEN s AND e) AS INTEGER) AS in_fall,
  CAST(EXISTS (SELECT 1 FROM ranges WHERE kind = 'spring' AND day BETWEEN s AND e) AS INTEGER) AS in_spring,
  CAST(EXISTS (SELECT 1 FROM ranges WHERE kind = 'exams' AND day BETWEEN s AND e) AS INTEGER) AS in_exams,
  CAST(day = DATE '2024-01-15' AS INTEGER) AS in_holiday,
  CAST(EXISTS (SELECT 1 FROM ranges WHERE kind = 'exams' AND date_diff('day', day, s) BETWEEN 1 AND 7) AS INTEGER) AS pre_exam_week,
  R6(coalesce((SELECT max(date_diff('day', s, day) / greatest(1, date_diff('day', s, e))) FROM ranges WHERE kind <> 'exams' AND day BETWEEN s AND e),
     (SELECT CASE WHEN max(s) IS NOT NULL THEN least(1.0, date_diff('day', max(s), day) / 150.0) END FROM ranges WHERE kind <> 'exams' AND s <= day), -1.0), 6) AS term_progress
FROM d""")
def calendar_join(spark, d):
    ranges = spark.sql("SELECT * FROM VALUES ('fall', DATE'2024-01-02', DATE'2024-01-08'), ('spring', DATE'2024-01-10', DATE'2024-01-20'), ('exams', DATE'2024-01-22', DATE'2024-01-24') t(kind, start, end)")
    days = spark.sql("SELECT 'holiday' AS kind, DATE'2024-01-15' AS day")
    dates = spark.read.parquet(f"{d}/events.parquet").select(F.to_date("ts").alias("day")).distinct()
    out = calendar.calendar_range_join(dates, ranges, days)
    return out.select("day", *[F.col(c).cast("int").alias(c) for c in ("in_fall", "in_spring", "in_exams", "in_holiday", "pre_exam_week")], r6(F.col("term_progress")).alias("term_progress"))


@query("time_features", """
SELECT event_id, CAST(hour(ts) AS DOUBLE) AS hour, floor(minute(ts) / 15) AS quarter_slot, CAST(isodow(ts) - 1 AS DOUBLE) AS dow,
  CAST(dayofyear(ts) AS DOUBLE) AS day_of_year, CAST(isodow(ts) >= 6 AS DOUBLE) AS is_weekend,
  R6(sin(hour(ts) / 24.0 * 2 * pi()), 6) AS hour_sin, R6(cos((hour(ts) * 60 + minute(ts)) / 1440.0 * 2 * pi()), 6) AS minute_cos,
  R6(sin((isodow(ts) - 1) / 7.0 * 2 * pi()), 6) AS dow_sin, R6(cos(dayofyear(ts) / 365.25 * 2 * pi()), 6) AS doy_cos FROM events""")
def time_features(spark, d):
    f = timeparts.time_features(F.col("ts"))
    rounded = {n: (r6(f[n]) if n.endswith(("sin", "cos")) else f[n]) for n in ("hour", "quarter_slot", "dow", "day_of_year", "is_weekend", "hour_sin", "minute_cos", "dow_sin", "doy_cos")}
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", *[c.alias(n) for n, c in rounded.items()])


@query("segment_labels", "WITH " + RATIO + """
SELECT location_id, bucket_ts, CASE WHEN hour(bucket_ts) < 6 THEN 'overnight' WHEN hour(bucket_ts) < 12 THEN 'morning' WHEN hour(bucket_ts) < 17 THEN 'midday' WHEN hour(bucket_ts) < 21 THEN 'evening' ELSE 'late' END AS hour_block,
  CASE WHEN isodow(bucket_ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type,
  CASE WHEN ratio < 0.35 THEN 'low' WHEN ratio < 0.75 THEN 'mid' ELSE 'high' END AS occupancy_class,
  CASE WHEN hour(bucket_ts) <= 2 THEN '0_2h' WHEN hour(bucket_ts) <= 6 THEN '3_6h' WHEN hour(bucket_ts) <= 12 THEN '7_12h' WHEN hour(bucket_ts) <= 24 THEN '13_24h' ELSE '25h_plus' END AS horizon_bucket FROM ratio""")
def labels(spark, d):
    h = F.hour("bucket_ts")
    ahead = timeparts.horizon_hours(F.col("bucket_ts"), F.to_date("bucket_ts").cast("timestamp_ntz"))
    return ratio(spark, d).select(
        "location_id", "bucket_ts", timeparts.hour_block(h).alias("hour_block"), timeparts.day_type(F.col("bucket_ts")).alias("day_type"),
        timeparts.occupancy_class(F.col("ratio")).alias("occupancy_class"), timeparts.horizon_bucket(ahead).alias("horizon_bucket"),
    )


@query("weather_flags", """
SELECT event_id, CAST(c IN (0, 1) AS INTEGER) AS weather_clear, CAST(c BETWEEN 51 AND 67 OR c BETWEEN 80 AND 82 AS INTEGER) AS weather_rain,
  CAST(c BETWEEN 95 AND 99 AS INTEGER) AS weather_storm, CAST(value > 0.05 OR coalesce(v2 > 0.05, false) AS INTEGER) AS weather_precip,
  CAST(value >= 1.5 OR coalesce(v2 >= 1.5, false) AS INTEGER) AS weather_heavy, CAST(value >= 80 AS INTEGER) AS weather_humid
FROM (SELECT *, CAST(event_id % 100 AS INTEGER) AS c, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 10 END AS v2 FROM events)""")
def weather_flags(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(
        "event_id", F.col("value").alias("precip_mm"), F.when(F.col("event_id") % 3 != 0, F.col("value") / 10).alias("rain_mm"),
        F.lit(None).cast("double").alias("snow_cm"), F.lit(None).cast("double").alias("temp_c"), F.lit(None).cast("double").alias("wind_mps"),
        F.lit(None).cast("double").alias("wind_gust_mps"), F.col("value").alias("humidity_pct"), (F.col("event_id") % 100).alias("code"),
    )
    flags = {**levels.weather_family(F.col("code")), **levels.weather_derived()}
    return e.select("event_id", *[flags[n].cast("int").alias(n) for n in ("weather_clear", "weather_rain", "weather_storm", "weather_precip", "weather_heavy", "weather_humid")])


@query("row_weights", "WITH " + RATIO + """, n AS (SELECT max(bucket_ts) AS newest FROM ratio)
SELECT location_id, bucket_ts, R6(greatest(0.2, pow(2.0, -(epoch(newest) - epoch(bucket_ts)) / 86400.0 / 45.0)), 6) AS recency,
  R6(1 + 1.2 * pow(ratio, 1.4), 6) AS occupancy,
  R6(least(1.0, greatest(0.25, 1 - least(0.6, 3 / 8.0 * 0.6) - least(0.5, ratio / 1.2 * 0.5) - least(0.4, greatest(0, 200.0 - 120) / 360))), 6) AS sensor,
  R6(0.35 + 0.65 * pow(1 - ratio / 1.2, 1.25), 6) AS feature FROM ratio, n""")
def weights(spark, d):
    out = row_weights.with_recency(ratio(spark, d), "bucket_ts")
    missing = F.col("ratio") / 1.2
    return out.select(
        "location_id", "bucket_ts", r6(F.col("recency")).alias("recency"), r6(levels.occupancy_weight(F.col("ratio"))).alias("occupancy"),
        r6(levels.sensor_weight(F.lit(3), missing, F.lit(200.0))).alias("sensor"), r6(levels.feature_quality_weight(missing)).alias("feature"),
    )


@query("location_balance_weights", "WITH " + RATIO + """, c AS (SELECT location_id, count(*) AS samples FROM ratio GROUP BY 1)
SELECT location_id, samples, R6(least(1.8, greatest(0.55, sqrt((SELECT median(samples) FROM c) / samples))), 6) AS balance FROM c""")
def balance(spark, d):
    counts = ratio(spark, d).groupBy("location_id").agg(F.count("*").alias("samples"))
    return row_weights.location_balance_weights(counts).select("location_id", "samples", r6(F.col("balance")).alias("balance"))


@query("stabilize_weights", """WITH q AS (SELECT quantile_cont(value, 0.02) AS ql, quantile_cont(value, 0.98) AS qh FROM events),
l AS (SELECT greatest(0.08, ql) AS lo, least(6.0, greatest(greatest(0.08, ql), qh)) AS hi FROM q),
w AS (SELECT event_id, least(greatest(value, lo), hi) AS w FROM events, l)
SELECT event_id, R6(w / (SELECT avg(w) FROM w), 6) AS sample_weight FROM w""")
def stabilize(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "value")
    return row_weights.stabilize_weights(e, "value").select("event_id", r6(F.col("sample_weight")).alias("sample_weight"))


SPLIT = """, ordered AS (SELECT *, row_number() OVER (ORDER BY bucket_ts) - 1 AS i, count(*) OVER () AS n FROM ratio),
h AS (SELECT max(bucket_ts) AS ht FROM ordered WHERE i = n - greatest(120, CAST(round_even(n * 0.12, 0) AS BIGINT)) AND n >= 300 + greatest(120, CAST(round_even(n * 0.12, 0) AS BIGINT))),
m AS (SELECT *, row_number() OVER (ORDER BY bucket_ts) - 1 AS j, count(*) OVER () AS k FROM ratio WHERE (SELECT ht FROM h) IS NULL OR bucket_ts < (SELECT ht FROM h)),
v AS (SELECT max(bucket_ts) AS vt FROM m WHERE j = CAST(floor(k * 0.8) AS BIGINT))
"""


@query("time_split", "WITH " + RATIO + SPLIT + """
SELECT location_id, bucket_ts, CASE WHEN bucket_ts >= ht THEN 'holdout' WHEN bucket_ts >= vt THEN 'validation' ELSE 'train' END AS part FROM ratio, h, v""")
def time_split(spark, d):
    return row_weights.time_split(ratio(spark, d), "bucket_ts").select("location_id", "bucket_ts", "part")


@query("cv_folds", "WITH " + RATIO + """, o AS (SELECT *, row_number() OVER (ORDER BY bucket_ts) - 1 AS i, count(*) OVER () AS n FROM ratio),
c AS (SELECT f, max(bucket_ts) AS t FROM o, (VALUES (1), (2), (3)) x(f) WHERE i = greatest(20, least(CAST(round_even(n * (f / 4), 0) AS BIGINT), n - 20)) GROUP BY f)
SELECT c.f AS fold, CASE WHEN bucket_ts < c.t THEN 'train' ELSE 'validation' END AS fold_part, count(*) AS rows
FROM ratio, c LEFT JOIN c nx ON nx.f = c.f + 1 WHERE nx.t IS NULL OR bucket_ts < nx.t GROUP BY 1, 2""")
def folds(spark, d):
    return row_weights.cv_folds(ratio(spark, d), "bucket_ts").groupBy("fold", "fold_part").agg(F.count("*").alias("rows"))


@query("weighted_average", "WITH " + PRED + "SELECT model_key, R6(sum(weight * (y_true - p50)) / sum(weight), 6) AS mean_residual FROM preds GROUP BY 1")
def weighted_average(spark, d):
    return predictions(spark, d).groupBy("model_key").agg(r6(quantiles.weighted_mean(F.col("y_true") - F.col("p50"), F.col("weight"))).alias("mean_residual"))


WQ = """, x AS (SELECT model_key AS k, y_true AS v, weight AS w FROM preds),
o AS (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY v, w ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY k) AS t, lag(v) OVER (PARTITION BY k ORDER BY v, w) AS pv FROM x),
qs AS (SELECT * FROM (VALUES (0.1), (0.3), (0.9)) z(q)),
p AS (SELECT k, q, v, pv, c, w, t, row_number() OVER (PARTITION BY k, q ORDER BY c) AS rn FROM o, qs WHERE c >= CAST(q AS DOUBLE) * t)
"""


@query("weighted_quantile", "WITH " + PRED + WQ + """
SELECT k AS model_key, max(CASE WHEN q = 0.1 THEN r END) AS q10, max(CASE WHEN q = 0.3 THEN r END) AS q30, max(CASE WHEN q = 0.9 THEN r END) AS q90
FROM (SELECT k, q, R6(CASE WHEN pv IS NULL THEN v ELSE pv + (v - pv) * ((CAST(q AS DOUBLE) * t - (c - w)) / w) END, 6) AS r FROM p WHERE rn = 1) GROUP BY 1""")
def weighted_quantile(spark, d):
    out = quantiles.weighted_quantiles(predictions(spark, d), ["model_key"], "y_true", "weight", {"q10": 0.1, "q30": 0.3, "q90": 0.9})
    return out.select("model_key", *[r6(F.col(q)).alias(q) for q in ("q10", "q30", "q90")])


@query("profile_fallback_join", "WITH " + RATIO + """,
dh AS (SELECT location_id, isodow(bucket_ts) AS dw, hour(bucket_ts) AS h, avg(ratio) AS m, count(*) AS n FROM ratio WHERE day(bucket_ts) <= 10 GROUP BY 1, 2, 3),
hh AS (SELECT location_id, hour(bucket_ts) AS h, avg(ratio) AS m, count(*) AS n FROM ratio WHERE day(bucket_ts) <= 10 GROUP BY 1, 2),
al AS (SELECT location_id, avg(ratio) AS m, count(*) AS n FROM ratio WHERE day(bucket_ts) <= 10 GROUP BY 1)
SELECT r.location_id, r.bucket_ts, R6(coalesce(dh.m, hh.m, al.m, 0), 6) AS profile_ratio, coalesce(dh.n, hh.n, al.n, 0) AS profile_n
FROM ratio r LEFT JOIN dh ON dh.location_id = r.location_id AND dh.dw = isodow(r.bucket_ts) AND dh.h = hour(r.bucket_ts)
LEFT JOIN hh ON hh.location_id = r.location_id AND hh.h = hour(r.bucket_ts) LEFT JOIN al ON al.location_id = r.location_id""")
def fallback(spark, d):
    from crowdtide.operators.profiles import profile_fallback_join

    r = ratio(spark, d)
    out = profile_fallback_join(r.select("location_id", "bucket_ts"), seasonal_profiles(r.filter(F.dayofmonth("bucket_ts") <= 10)), "bucket_ts")
    return out.select("location_id", "bucket_ts", r6(F.coalesce("profile_ratio", F.lit(0.0))).alias("profile_ratio"), F.coalesce("profile_n", F.lit(0)).alias("profile_n"))
