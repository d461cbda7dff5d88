"""Queries over features, their preparation, and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdtide import config
from crowdtide.catalog.base import GRID, NOW, PRED, RATIO, WEATHER, locations, predictions, query, r6, ratio, series, table, weather
from crowdtide.catalog.calibration import BIAS, SEG, _wq, blend
from crowdtide.catalog.schedules import rule_table
from crowdtide.operators import calendar, row_weights, segments
from crowdtide.operators.asof import LAGS
from crowdtide.operators.clean import seasonal_profiles
from crowdtide.operators.rolling_stats import DELTAS, MEAN_HOURS, RANGE_HOURS, STD_HOURS, TRENDS
from crowdtide.plans import feature_table as ft
from crowdtide.plans import training
from crowdtide.session import cut_lineage

GRID_FRAME = "OVER (PARTITION BY location_id ORDER BY bucket_ts RANGE BETWEEN INTERVAL '{m} minutes' PRECEDING AND INTERVAL '1 minute' PRECEDING)"


def features(spark, d, targets=None):
    """Features of all grid steps, or of ``targets`` (location_id, facility_id, bucket_ts)."""
    grid = cut_lineage(ratio(spark, d))
    if targets is None:
        targets = grid.join(locations(spark, d), "location_id").select("location_id", "facility_id", "bucket_ts")
    return ft.feature_table(
        targets, grid, cut_lineage(series(spark, d)), cut_lineage(seasonal_profiles(grid)), weather(spark, d), calendar.default_ranges(spark),
        calendar.default_days(spark), rule_table(spark), grid=60,
    )


FEATURE_LAGS = {**LAGS, "lag_15m": 60}
LAG_ROWS = ", ".join(f"('{n}', {m})" for n, m in FEATURE_LAGS.items())
ROLLED = {
    **{n: f"avg(ratio) {GRID_FRAME.format(m=60 * h)}" for n, h in MEAN_HOURS.items()},
    **{n: f"CASE WHEN count(ratio) {GRID_FRAME.format(m=60 * h)} >= 2 THEN stddev_pop(ratio) {GRID_FRAME.format(m=60 * h)} END" for n, h in STD_HOURS.items()},
    **{n: f"max(ratio) {GRID_FRAME.format(m=60 * h)} - min(ratio) {GRID_FRAME.format(m=60 * h)}" for n, h in RANGE_HOURS.items()},
    "missing_recent": f"1.0 - count(ratio) {GRID_FRAME.format(m=120)} / 2.0",
}
WX_KEYS = ("temp_c", "wind_mps", "precip_mm")
MOMENT = {
    "hour": "hour(bucket_ts)", "minute": "0", "quarter_slot": "0", "dow": "isodow(bucket_ts) - 1", "month": "month(bucket_ts)", "day_of_year": "dayofyear(bucket_ts)",
    "is_weekend": "CAST(isodow(bucket_ts) >= 6 AS INTEGER)",
}
TURNS = {"hour": "hour(bucket_ts) / 24.0", "minute": "hour(bucket_ts) * 60 / 1440.0", "dow": "(isodow(bucket_ts) - 1) / 7.0", "month": "(month(bucket_ts) - 1) / 12.0", "doy": "dayofyear(bucket_ts) / 365.25"}
MOMENT |= {f"{n}_{f}": f"{f}({turn} * 2 * pi())" for n, turn in TURNS.items() for f in ("sin", "cos")}
FLAGS = {
    "weather_precip": "precip_mm_now > 0.05", "weather_heavy": "precip_mm_now >= 1.5", "weather_cold": "temp_c_now <= 2", "weather_hot": "temp_c_now >= 27", "weather_windy": "wind_mps_now >= 6", "weather_humid": "false",
}
COMPUTED = {
    **{n: n for n in FEATURE_LAGS}, **{n: f"lag_15m - {lag}" for n, lag in DELTAS.items()}, **{n: n for n in ROLLED}, **{n: f"{a} - {b}" for n, (a, b) in TRENDS.items() if "accel" not in n},
    **{n: f"({TRENDS[a][0]} - {TRENDS[a][1]}) - ({TRENDS[b][0]} - {TRENDS[b][1]})" for n, (a, b) in TRENDS.items() if "accel" in n},
    "last_bucket": "last_bucket", "minutes_since_bucket": "epoch(bucket_ts - last_at) / 60", "minutes_since_raw": "minutes_since_raw", "flat_steps": "flat_steps",
    **MOMENT, **{n: f"CAST(coalesce({test}, false) AS INTEGER)" for n, test in FLAGS.items()},
    **{f"{k}_{part}": f"{k}_{part}" for k in WX_KEYS for part in ("now", "1h", "roll")}, **{f"{k}_delta_1h": f"{k}_now - {k}_1h" for k in WX_KEYS}, "term_progress": "-1.0",
}


def _nulls(names, width: int) -> str:
    """Share of missing ones; columns beyond the named ones are never known here."""
    return "(" + " + ".join(f"CAST({n} IS NULL AS INTEGER)" for n in names) + f" + {width - len(list(names))}) / {float(width)}"


SHOWN_SHARES = {
    "lag_missing": _nulls(LAGS, 7), "delta_missing": _nulls(DELTAS, 5), "trend_missing": _nulls(TRENDS, 5), "roll_missing": _nulls([*MEAN_HOURS, *STD_HOURS, *RANGE_HOURS], 11),
    "missing_weather_now": _nulls([f"{k}_now" for k in WX_KEYS], 9), "missing_weather_1h": _nulls([f"{k}_1h" for k in WX_KEYS], 9),
    "missing_weather_delta": _nulls([f"{k}_delta_1h" for k in WX_KEYS], 9), "missing_weather_roll": _nulls([f"{k}_roll" for k in WX_KEYS], 3),
}
SHOWN = [*COMPUTED, *SHOWN_SHARES, "dynamics_missing"]


@query("feature_table", "WITH " + RATIO + "," + WEATHER + f""",
dh AS (SELECT location_id, isodow(bucket_ts) AS dw, hour(bucket_ts) AS h, avg(ratio) AS m FROM ratio GROUP BY 1, 2, 3),
hh AS (SELECT location_id, hour(bucket_ts) AS h, avg(ratio) AS m FROM ratio GROUP BY 1, 2),
al AS (SELECT location_id, avg(ratio) AS m FROM ratio GROUP BY 1),
sent AS (SELECT r.location_id, r.bucket_ts, v.name, r.bucket_ts - v.mi * INTERVAL '1 minute' AS back FROM ratio r CROSS JOIN (VALUES {LAG_ROWS}) v(name, mi)),
lagl AS (
  SELECT s.location_id, s.bucket_ts, s.name, coalesce(l.ratio, dh.m, hh.m, al.m) AS x FROM sent s LEFT JOIN ratio l ON l.location_id = s.location_id AND l.bucket_ts = s.back
  LEFT JOIN dh ON dh.location_id = s.location_id AND dh.dw = isodow(s.back) AND dh.h = hour(s.back) LEFT JOIN hh ON hh.location_id = s.location_id AND hh.h = hour(s.back) LEFT JOIN al ON al.location_id = s.location_id),
lags AS (SELECT location_id, bucket_ts, {", ".join(f"max(x) FILTER (name = '{n}') AS {n}" for n in FEATURE_LAGS)} FROM lagl GROUP BY 1, 2),
rl AS (
  SELECT location_id, bucket_ts, {", ".join(f"{e} AS {n}" for n, e in ROLLED.items())}, lag(ratio) OVER w AS last_bucket, lag(bucket_ts) OVER w AS last_at
  FROM ratio WINDOW w AS (PARTITION BY location_id ORDER BY bucket_ts)),
fl AS (
  SELECT a.location_id, a.bucket_ts, CASE WHEN b.ratio IS NULL THEN 0 WHEN c.ratio IS NULL OR abs(c.ratio - b.ratio) > 0.002 THEN 1 ELSE 2 END AS flat_steps FROM ratio a
  LEFT JOIN ratio b ON b.location_id = a.location_id AND b.bucket_ts = a.bucket_ts - INTERVAL '60 minutes' LEFT JOIN ratio c ON c.location_id = a.location_id AND c.bucket_ts = a.bucket_ts - INTERVAL '120 minutes'),
rw AS (SELECT r.location_id, r.bucket_ts, (epoch_us(r.bucket_ts) - epoch_us(s.observed_at)) / 60e6 AS minutes_since_raw FROM ratio r ASOF LEFT JOIN series s ON s.location_id = r.location_id AND s.observed_at < r.bucket_ts),
tl AS (SELECT unnest(generate_series(min(bucket_ts) - INTERVAL '12 hours', max(bucket_ts), INTERVAL '1 hour')) AS t FROM ratio),
wa AS (SELECT tl.t, {", ".join(f"{k}.{k}" for k in WX_KEYS)} FROM tl {" ".join(f"ASOF LEFT JOIN (SELECT ts, {k} FROM weather WHERE {k} IS NOT NULL) {k} ON {k}.ts <= tl.t" for k in WX_KEYS)}),
wx AS (
  SELECT t, {", ".join(f"{k} AS {k}_now, lag({k}) OVER (ORDER BY t) AS {k}_1h, avg({k}) OVER (ORDER BY t RANGE BETWEEN INTERVAL '12 hours' PRECEDING AND INTERVAL '1 minute' PRECEDING) AS {k}_roll" for k in WX_KEYS)} FROM wa),
al1 AS (SELECT location_id, bucket_ts, {", ".join(f"{e} AS {n}" for n, e in COMPUTED.items())}
  FROM lags JOIN rl USING (location_id, bucket_ts) JOIN fl USING (location_id, bucket_ts) JOIN rw USING (location_id, bucket_ts) JOIN wx ON wx.t = bucket_ts),
al2 AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in SHOWN_SHARES.items())} FROM al1),
al3 AS (SELECT *, (lag_missing + delta_missing + trend_missing + roll_missing) / 4 AS dynamics_missing FROM al2)
SELECT location_id, bucket_ts, {", ".join(f"R6({n}, 4) AS {n}" for n in SHOWN)} FROM al3""")
def feature_table(spark, d):
    return features(spark, d).select("location_id", "bucket_ts", *[r6(F.col(c), 4).alias(c) for c in SHOWN])


COLS = ("value", "a", "b")
GROUPS = {"lags_trends_sensor": ("value", "a"), "weather": ("b",)}
MESSY = """x AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL WHEN value > 500 THEN NULL ELSE value END AS value, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / 7 END AS a, CASE WHEN event_id % 3 <> 0 THEN NULL ELSE 2.5 END AS b FROM events)"""


def messy(spark, d):
    e = F.col("event_id")
    raw = table(spark, d, "events").select(
        "event_id", F.when(e % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"), F.when(e % 4 != 0, F.col("value") / 7).alias("a"), F.when(e % 3 == 0, F.lit(2.5)).alias("b")
    )
    return ft.sanitize_features(raw, COLS)


@query("sanitize_features", "WITH " + MESSY + "SELECT event_id, value, R6(a, 6) AS a FROM x")
def sanitize(spark, d):
    return messy(spark, d).select("event_id", "value", r6(F.col("a")).alias("a"))


@query("supervised_row_mask", "WITH " + MESSY + "SELECT event_id FROM x WHERE event_id % 5 <> 0 AND (CAST(value IS NOT NULL AS INTEGER) + CAST(a IS NOT NULL AS INTEGER) + CAST(b IS NOT NULL AS INTEGER)) / 3.0 >= 0.3")
def supervised(spark, d):
    rows = messy(spark, d).withColumn("label", F.lit(0.5)).withColumn("w", (F.col("event_id") % 5).cast("double"))
    return ft.supervised_rows(rows, "label", "w", COLS).select("event_id")


@query("missingness_summary", "WITH " + MESSY + """, s AS (SELECT count(*) AS rows, sum(CAST(value IS NULL AS INTEGER)) AS v, sum(CAST(a IS NULL AS INTEGER)) AS a, sum(CAST(b IS NULL AS INTEGER)) AS b, count(*) FILTER (value IS NULL AND a IS NULL AND b IS NULL) AS n FROM x)
SELECT rows, R6((v + a + b) / (rows * 3), 6) AS missing_all, R6((v + a) / (rows * 2), 6) AS missing_lags, R6(b / rows, 6) AS missing_weather, R6(n / rows, 6) AS all_missing_rows,
CASE WHEN rows < 240 THEN NULL WHEN (v + a + b) / (rows * 3) > 0.45 THEN 'global_missing_rate_high' WHEN (v + a) / (rows * 2) > 0.55 THEN 'lag_feature_missing_rate_high' WHEN b / rows > 0.65 THEN 'weather_feature_missing_rate_high' END AS block_reason FROM s""")
def missingness(spark, d):
    out = ft.missingness_summary(messy(spark, d), 0, GROUPS)
    return out.select("rows", r6(F.col("missing_all")).alias("missing_all"), r6(F.col("missing_lags_trends_sensor")).alias("missing_lags"), r6(F.col("missing_weather")).alias("missing_weather"), r6(F.col("all_missing_rows")).alias("all_missing_rows"), "block_reason")


@query("feature_limits", "WITH " + MESSY + """, m AS (UNPIVOT (SELECT value, a, CAST(b AS DOUBLE) AS b FROM x) ON value, a, b INTO NAME feature VALUE v),
f AS (SELECT feature, median(v) AS fill FROM m GROUP BY 1),
al AS (SELECT 'value' AS feature, value AS v FROM x UNION ALL SELECT 'a', a FROM x UNION ALL SELECT 'b', CAST(b AS DOUBLE) FROM x),
q AS (SELECT feature, quantile_cont(coalesce(v, fill), 0.002) AS lo, quantile_cont(coalesce(v, fill), 0.998) AS hi, median(coalesce(v, fill)) AS md FROM al JOIN f USING (feature) GROUP BY 1)
SELECT feature, R6(fill, 6) AS fill, R6(CASE WHEN hi - lo < 0.01 THEN md - 0.005 ELSE lo END, 6) AS low, R6(CASE WHEN hi - lo < 0.01 THEN md + 0.005 ELSE hi END, 6) AS high FROM f JOIN q USING (feature)""")
def limits(spark, d):
    return ft.feature_limits(messy(spark, d), COLS).select("feature", *[r6(F.col(c)).alias(c) for c in ("fill", "low", "high")])


@query("quantile_bounds", "WITH " + SEG + f""",
pr AS (SELECT a.model_key, a.seg_kind, a.seg_key, a.n, a.r AS q10, b.r AS q90 FROM {_wq('y_true - p50', 0.1)} a JOIN {_wq('y_true - p50', 0.9)} b USING (model_key, seg_kind, seg_key)
  WHERE a.seg_kind <> 'horizon' AND (a.n >= 30 OR a.seg_kind = 'global')),
gl AS (SELECT model_key, q10, q90 FROM pr WHERE seg_kind = 'global'),
tr AS (
  SELECT s.model_key, s.location_id, s.ts, s.p50, CASE WHEN s.seg_kind = 'global' THEN 0.0 ELSE least(1.0, p.n / 90.0) END AS sup, p.q10, p.q90, g.q10 AS g10, g.q90 AS g90,
    CASE s.seg_kind WHEN 'occupancy' THEN 1 WHEN 'hour' THEN 2 WHEN 'block' THEN 3 WHEN 'day_type' THEN 4 ELSE 5 END AS o
  FROM seg s JOIN pr p USING (model_key, seg_kind, seg_key) JOIN gl g USING (model_key)),
bd AS (
  SELECT location_id, ts, least(1.2, greatest(0.0, p50 + arg_min(sup * q10 + (1 - sup) * g10, o))) AS a, least(1.2, greatest(0.0, p50 + arg_min(sup * q90 + (1 - sup) * g90, o))) AS b
  FROM tr GROUP BY location_id, ts, p50, model_key)
SELECT location_id, ts, R6(least(a, b), 6) AS p10, R6(greatest(a, b), 6) AS p90 FROM bd""")
def bounds(spark, d):
    """Intervals from the residual quantiles of each row's own segment."""
    rows = cut_lineage(predictions(spark, d))
    out = training.quantile_bounds(rows.drop("p10", "p90"), segments.residual_interval_profile(rows, ["model_key"]))
    return out.select("location_id", "ts", r6(F.col("p10")).alias("p10"), r6(F.col("p90")).alias("p90"))


@query("trainable_category", "SELECT event_id FROM events WHERE event_type IN ('view', 'click')")
def trainable(spark, d):
    named = table(spark, d, "events").withColumn("category_key", F.when(F.col("event_type") == "view", "fitness_floors").when(F.col("event_type") == "click", "basketball_courts").otherwise("sauna"))
    return training.trainable_category(named).select("event_id")


_MODELS: dict[tuple[str, str], tuple] = {}


def facility_models(spark, d):
    """Features of all grid steps, the grid, and a model of every facility trained on all its rows.

    The loop is over facilities, a handful; every fit is distributed.
    """
    key = (spark.sparkContext.applicationId, d)
    if key in _MODELS:      # two queries use the same models
        return _MODELS[key]
    rows, grid = cut_lineage(features(spark, d)), cut_lineage(ratio(spark, d))
    balance = row_weights.location_balance_weights(grid.groupBy("location_id").agg(F.count("*").alias("samples")))
    models = {}
    for facility, places in sorted(rows.groupBy("facility_id").agg(F.count_distinct("location_id")).collect()):
        sets = cut_lineage(training.training_set(rows.filter(F.col("facility_id") == facility), grid, balance, places))
        models[facility] = training.train_p50(sets, f"{facility}__all", training.TreeParams())
    _MODELS[key] = rows, grid, models
    return _MODELS[key]


@query("train_and_score")
def train_and_score(spark, d):
    """A model of each facility, trained on all its rows, with its validation interval."""
    from crowdtide.plans.scoring import score

    rows, _, models = facility_models(spark, d)
    parts = [score(rows.filter(F.col("facility_id") == f), m, m.metrics["profile"]) for f, m in models.items()]
    return reduce(DataFrame.unionByName, parts).select("location_id", "ts", "p10", "p50", "p90")


@query("recursive_score")
def recursive(spark, d):
    """The week after the last grid step in dependent steps per location, by its facility's model."""
    from crowdtide.plans.forecast_week import location_targets, week_targets
    from crowdtide.plans.scoring import recursive_score

    _, grid, models = facility_models(spark, d)
    places = locations(spark, d).select("location_id", "facility_id")
    end = F.lit(grid.agg(F.max("bucket_ts")).first()[0]).cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(GRID))
    targets = location_targets(places, week_targets(places, end, None, step=GRID)).withColumnRenamed("target_ts", "bucket_ts").filter(F.col("bucket_ts") >= end)
    ahead = cut_lineage(features(spark, d, cut_lineage(targets.select("location_id", "facility_id", "bucket_ts"))))
    weeks = cut_lineage(ft.profile_arrays(seasonal_profiles(grid)))
    return reduce(DataFrame.unionByName, [recursive_score(ahead.filter(F.col("facility_id") == f), grid, weeks, m, grid=GRID) for f, m in models.items()])


def _found(table: str, alias: str, kind: str, key: str) -> str:
    return f"LEFT JOIN {table} {alias} ON {alias}.model_key = r.model_key AND {alias}.seg_kind = '{kind}' AND {alias}.seg_key = {key}"


def _tried(value: str, kinds: dict[str, int], prefix: str) -> str:
    """The first segment's value, shrunk to the global one by how many rows it has."""
    tries = ", ".join(
        f"least(1.0, {prefix}{k}.n / {3.0 * n}) * {prefix}{k}.{value} + (1 - least(1.0, {prefix}{k}.n / {3.0 * n})) * coalesce({prefix}global.{value}, 0)" for k, n in kinds.items())
    return f"coalesce({tries}, {prefix}global.{value}, 0.0)"


SEG_KEYS = {"occupancy": "occ", "horizon": "hb", "hour": "hk", "block": "bk", "day_type": "dt", "global": "'all'"}
ROW_KEYS = """CASE WHEN wh <= 2 THEN '0_2h' WHEN wh <= 6 THEN '3_6h' WHEN wh <= 12 THEN '7_12h' WHEN wh <= 24 THEN '13_24h' ELSE '25h_plus' END AS hb, CAST(hour(ts) AS VARCHAR) AS hk,
    CASE WHEN hour(ts) < 6 THEN 'overnight' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 17 THEN 'midday' WHEN hour(ts) < 21 THEN 'evening' ELSE 'late' END AS bk,
    CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS dt,
    CASE WHEN least(1.2, greatest(0.0, p50)) < 0.35 THEN 'low' WHEN least(1.2, greatest(0.0, p50)) < 0.75 THEN 'mid' ELSE 'high' END AS occ"""
BIAS_KINDS = {"occupancy": 24, "horizon": 30, "hour": 30, "block": 30, "day_type": 30}
MARGIN_KINDS = {k: 20 for k in BIAS_KINDS}
ESTIMATE = PRED + """,
bo AS (SELECT model_key, location_id, ts, y_true, p10, p50, p90, weight FROM preds UNION ALL SELECT 'all', location_id, ts, y_true, p10 * 0.9, p50 * 0.9, p90 * 0.9, weight FROM preds)""" + SEG[len(PRED):].replace("FROM preds p", "FROM bo p").rstrip() + f""",
rg AS (SELECT model_key, seg_kind, seg_key, sum(weight * abs(y_true - p50)) / sum(weight) AS mae FROM seg WHERE seg_kind IN ('block', 'horizon', 'day_type', 'global') GROUP BY 1, 2, 3 HAVING seg_kind = 'global' OR count(*) >= 30),
bi AS (SELECT model_key, seg_kind, seg_key, {BIAS} AS bias, count(*) AS n FROM seg GROUP BY 1, 2, 3 HAVING seg_kind = 'global' OR count(*) >= CASE WHEN seg_kind = 'occupancy' THEN 24 ELSE 30 END),
df AS (SELECT model_key, seg_kind, seg_key, least(0.12, greatest(-0.12, sum(weight * (y_true - p50)) / sum(weight))) AS bias, count(*) AS n FROM seg
  WHERE seg_kind IN ('hour', 'day_type', 'occupancy', 'global') GROUP BY 1, 2, 3 HAVING seg_kind = 'global' OR count(*) >= CASE WHEN seg_kind = 'occupancy' THEN 24 ELSE 20 END),
sc AS (SELECT *, greatest(0.0, p10 - y_true, y_true - p90) AS score FROM seg),
cf AS (SELECT model_key, seg_kind, seg_key, least(0.35, greatest(0.0, r)) AS margin, n FROM {_wq('score', 0.8, 'sc')}
  WHERE (seg_kind = 'global' OR n >= 20) AND model_key IN (SELECT model_key FROM bo GROUP BY 1 HAVING count(*) >= 120)),
hr AS (SELECT *, floor(h) AS wh FROM (SELECT *, greatest(0.0, (epoch(ts) - epoch(TIMESTAMP '{NOW}')) / 3600.0) AS h FROM bo)),
rw AS (SELECT *, {ROW_KEYS} FROM hr),
sd AS (
  SELECT r.model_key, r.location_id, r.ts, r.p10, r.p50, r.p90, r.h, r.wh, coalesce(r_horizon.mae, r_block.mae, r_day_type.mae, r_global.mae, 0.0) AS mae,
    {_tried('bias', BIAS_KINDS, 'b_')} + coalesce(coalesce(d_occupancy.bias * least(1.0, d_occupancy.n / 72.0), d_hour.bias * least(1.0, d_hour.n / 60.0), d_day_type.bias * least(1.0, d_day_type.n / 60.0),
      d_global.bias * least(1.0, d_global.n / 60.0)) * 0.6 * exp(-r.wh / 8.0), 0.0) AS bias
  FROM rw r """ + " ".join(
    [_found("rg", f"r_{k}", k, "r." + SEG_KEYS[k] if k != "global" else SEG_KEYS[k]) for k in ("horizon", "block", "day_type", "global")]
    + [_found("bi", f"b_{k}", k, "r." + SEG_KEYS[k] if k != "global" else SEG_KEYS[k]) for k in (*BIAS_KINDS, "global")]
    + [_found("df", f"d_{k}", k, "r." + SEG_KEYS[k] if k != "global" else SEG_KEYS[k]) for k in ("occupancy", "hour", "day_type", "global")]) + """),
dh AS (SELECT location_id, isodow(bucket_ts) AS dw, hour(bucket_ts) AS hh, avg(ratio) AS m FROM ratio GROUP BY 1, 2, 3),
nn AS (SELECT location_id, count(*) AS n FROM ratio GROUP BY 1),
w1 AS (
  SELECT p.model_key, p.location_id, p.ts, p.h, p.wh, dh.m AS pr, nn.n, max_cap, p.mae AS pm, f.mae AS fm, p.bias AS pb, f.bias AS fb, p.p10 AS a10, p.p50 AS a50, p.p90 AS a90, f.p10 AS f10, f.p50 AS f50, f.p90 AS f90, 0.66 AS w
  FROM sd p JOIN sd f ON f.model_key = 'all' AND f.location_id = p.location_id AND f.ts = p.ts JOIN nn ON nn.location_id = p.location_id JOIN caps ON caps.location_id = p.location_id
  JOIN dh ON dh.location_id = p.location_id AND dh.dw = isodow(p.ts) AND dh.hh = hour(p.ts) WHERE p.model_key <> 'all'),
w2 AS (SELECT * REPLACE (CASE WHEN pm > 0 AND fm > 0 THEN least(0.9, greatest(0.15, 0.6 * w + 0.4 * (1 / greatest(1e-4, pm)) / (1 / greatest(1e-4, pm) + 1 / greatest(1e-4, fm)))) ELSE w END AS w) FROM w1),
w3 AS (SELECT * REPLACE (least(0.9, greatest(0.15, 0.55 * w + 0.45 * 0.5)) AS w) FROM w2),
w4 AS (SELECT * REPLACE (CASE WHEN n < 80 THEN least(0.9, greatest(0.15, (1 - 0.22 * (1 - n / 80.0)) * w + 0.22 * (1 - n / 80.0) * 0.15)) ELSE w END AS w) FROM w3),
mx AS (SELECT model_key, location_id, ts, h, wh, pr, n, max_cap, w * a10 + (1 - w) * f10 AS p10, w * a50 + (1 - w) * f50 AS p50, w * a90 + (1 - w) * f90 AS p90, w * pb + (1 - w) * fb AS bias, abs(a50 - f50) AS apart FROM w4),
s1 AS (""" + blend("mx", "0.35 * (1 - least(1.0, n / 60.0))") + """),
s2 AS (SELECT * REPLACE (p10 + bias AS p10, p50 + bias AS p50, p90 + bias AS p90) FROM s1),
s4 AS (""" + blend("s2", "CASE WHEN h <= 4 THEN 0.55 * exp(-h / 1.6) * exp(-12 / 35.0) ELSE 0 END", "0.5") + """),
s5 AS (""" + blend("s4", "0.28 * least(1.0, greatest(0.0, (h - 4) / 8))") + f"""),
ce AS (SELECT *, {ROW_KEYS} FROM s5),
mg AS (SELECT r.*, {_tried('margin', MARGIN_KINDS, 'c_')} AS margin FROM ce r """ + " ".join(
    _found("cf", f"c_{k}", k, "r." + SEG_KEYS[k] if k != "global" else SEG_KEYS[k]) for k in (*MARGIN_KINDS, "global")) + """),
wd AS (SELECT *, p50 - p10 + greatest(0.0, margin) AS lo, p90 - p50 + greatest(0.0, margin) AS hi,
  1.15 * least(1.38, greatest(1.0, 1 + (apart - 0.03) * 0.75)) * (1 + 0.28 * (1 - least(1.0, n / 80.0))) AS mult FROM mg),
cl AS (SELECT *, least(1.2, greatest(0.0, p50 - greatest(0.0, lo) * mult)) AS q10, least(1.2, greatest(0.0, p50)) AS q50, least(1.2, greatest(0.0, p50 + greatest(0.0, hi) * mult)) AS q90 FROM wd)
SELECT location_id, ts AS target_ts, R6(least(q10, q90) * max_cap, 4) AS count_p10, R6(least(greatest(q50, least(q10, q90)), greatest(q10, q90)) * max_cap, 4) AS count_p50, R6(greatest(q10, q90) * max_cap, 4) AS count_p90, n AS samples FROM cl"""


@query("estimate_locations", "WITH " + ESTIMATE)
def estimate(spark, d):
    """Blend of a section model and an overall model, both hour-of-day means, at every grid step."""
    from crowdtide.catalog.base import capacity, now
    from crowdtide.operators.segments import conformal_margins, drift_bias_profile, point_bias_profile, regime_mae_profile
    from crowdtide.plans.scoring import estimate_locations

    own = predictions(spark, d)
    both = cut_lineage(own.unionByName(own.withColumns({"model_key": F.lit("all"), **{p: F.col(p) * 0.9 for p in ("p10", "p50", "p90")}})))
    keys = ["model_key"]
    calibration = {
        "regime": regime_mae_profile(both, keys), "bias": point_bias_profile(both, keys), "drift": drift_bias_profile(both, keys), "conformal": conformal_margins(both, keys),
        "scores": both.select("model_key").distinct().withColumn("score", F.when(F.col("model_key") == "all", 40.0).otherwise(60.0)),
        "widen": both.select("model_key").distinct().withColumn("interval_multiplier", F.lit(1.15)),
    }
    calibration = {n: cut_lineage(t) for n, t in calibration.items()}
    grid = cut_lineage(ratio(spark, d))
    targets = both.filter("model_key <> 'all'").select("location_id", F.col("ts").alias("target_ts"), F.col("model_key").alias("primary_key"), F.lit("all").alias("fallback_key"))
    counts = grid.groupBy("location_id").agg(F.count("*").alias("samples"))
    targets = cut_lineage(targets.join(capacity(spark, d), "location_id").join(counts, "location_id"))
    live = counts.select("location_id", F.lit(0.5).alias("live_ratio"), F.lit(12.0).alias("live_age"))
    scored = both.select("model_key", "location_id", "ts", "p10", "p50", "p90", F.lit(0.1).alias("missing"))
    out = estimate_locations(targets, scored, calibration, cut_lineage(seasonal_profiles(grid)), live, now())
    return out.select("location_id", "target_ts", *[r6(F.col(c), 4).alias(c) for c in ("count_p10", "count_p50", "count_p90")], "samples")
