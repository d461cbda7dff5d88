"""Queries over error profiles, horizon fits, adjustments and model governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdtide import config
from crowdtide.catalog.base import PRED, RATIO, now, predictions, query, r6, ratio, table
from crowdtide.operators import adjust, governance, horizons, segments
from crowdtide.session import cut_lineage

KEYS = ["model_key"]

SEG = PRED + """,
seg AS (SELECT p.*, k.seg_kind, k.seg_key FROM preds p, LATERAL (SELECT * FROM (VALUES ('global', 'all'), ('hour', CAST(hour(p.ts) AS VARCHAR)),
  ('block', CASE WHEN hour(p.ts) < 6 THEN 'overnight' WHEN hour(p.ts) < 12 THEN 'morning' WHEN hour(p.ts) < 17 THEN 'midday' WHEN hour(p.ts) < 21 THEN 'evening' ELSE 'late' END),
  ('day_type', CASE WHEN isodow(p.ts) >= 6 THEN 'weekend' ELSE 'weekday' END), ('horizon', '0_2h'),
  ('occupancy', CASE WHEN p.p50 < 0.35 THEN 'low' WHEN p.p50 < 0.75 THEN 'mid' ELSE 'high' END)) v(seg_kind, seg_key)) k)
"""


def _wq(value: str, q: float, source: str = "seg", keys: str = "model_key, seg_kind, seg_key") -> str:
    """Weighted quantile of ``value`` per segment as a table expression."""
    return f"""(SELECT {keys}, max(n) AS n, arg_min(CASE WHEN pv IS NULL THEN v ELSE pv + (v - pv) * ((CAST({q} AS DOUBLE) * t - (c - w)) / w) END, c) AS r FROM (
      SELECT {keys}, {value} AS v, weight AS w, lag({value}) OVER (PARTITION BY {keys} ORDER BY {value}, weight) AS pv, count(*) OVER (PARTITION BY {keys}) AS n,
        sum(weight) OVER (PARTITION BY {keys} ORDER BY {value}, weight ROWS UNBOUNDED PRECEDING) AS c, sum(weight) OVER (PARTITION BY {keys}) AS t FROM {source})
      WHERE c >= CAST({q} AS DOUBLE) * t GROUP BY {keys})"""


def scored(spark, d):
    return cut_lineage(predictions(spark, d))


@query("residual_interval_profile", "WITH " + SEG + f"""SELECT a.model_key, a.seg_kind, a.seg_key, a.n, R6(a.r, 6) AS q10, R6(b.r, 6) AS q90
FROM {_wq('y_true - p50', 0.1)} a JOIN {_wq('y_true - p50', 0.9)} b USING (model_key, seg_kind, seg_key) WHERE a.seg_kind <> 'horizon' AND (a.n >= 30 OR a.seg_kind = 'global')""")
def residual_profile(spark, d):
    return segments.residual_interval_profile(scored(spark, d), KEYS).select(*KEYS, "seg_kind", "seg_key", "n", r6(F.col("q10")).alias("q10"), r6(F.col("q90")).alias("q90"))


BIAS = "least(0.25, greatest(-0.25, sum(weight * (y_true - p50)) / sum(weight)))"


@query("point_bias_profile", "WITH " + SEG + f"SELECT model_key, seg_kind, seg_key, R6({BIAS}, 6) AS bias, count(*) AS n FROM seg GROUP BY 1, 2, 3 HAVING seg_kind = 'global' OR count(*) >= CASE WHEN seg_kind = 'occupancy' THEN 24 ELSE 30 END")
def bias_profile(spark, d):
    return segments.point_bias_profile(predictions(spark, d), KEYS).withColumn("bias", r6(F.col("bias")))


@query("regime_mae_profile", "WITH " + SEG + "SELECT model_key, seg_kind, seg_key, R6(sum(weight * abs(y_true - p50)) / sum(weight), 6) AS mae, count(*) AS n FROM seg WHERE seg_kind IN ('block', 'horizon', 'day_type', 'global') GROUP BY 1, 2, 3 HAVING seg_kind = 'global' OR count(*) >= 30")
def regime_profile(spark, d):
    return segments.regime_mae_profile(predictions(spark, d), KEYS).withColumn("mae", r6(F.col("mae")))


@query("recent_days", "WITH " + PRED + "SELECT model_key, location_id, ts, y_true FROM preds QUALIFY ts >= max(ts) OVER (PARTITION BY model_key) - INTERVAL '14 days'")
def recent_days(spark, d):
    return segments.recent_days(predictions(spark, d), KEYS, config.DRIFT_DAYS).select("model_key", "location_id", "ts", "y_true")


@query("conformal_margins", "WITH " + SEG + f""", sc AS (SELECT *, greatest(0.0, p10 - y_true, y_true - p90) AS score FROM seg)
SELECT model_key, seg_kind, seg_key, R6(least(0.35, greatest(0.0, r)), 6) AS margin, n FROM {_wq('score', 0.8, 'sc')}
WHERE (seg_kind = 'global' OR n >= 20) AND model_key IN (SELECT model_key FROM preds GROUP BY 1 HAVING count(*) >= 120)""")
def margins(spark, d):
    return segments.conformal_margins(scored(spark, d), KEYS).withColumn("margin", r6(F.col("margin")))


@query("recent_evaluation", "WITH " + PRED + """, e AS (SELECT model_key, count(*) AS points, sum(weight * abs(p50 - y_true)) / sum(weight) AS mae, sqrt(sum(weight * (p50 - y_true) * (p50 - y_true)) / sum(weight)) AS rmse,
sum(CASE WHEN y_true BETWEEN p10 AND p90 THEN weight ELSE 0 END) / sum(weight) AS coverage FROM (SELECT * FROM preds QUALIFY ts >= max(ts) OVER (PARTITION BY model_key) - INTERVAL '14 days') GROUP BY 1)
SELECT model_key, points, R6(mae, 6) AS mae, R6(rmse, 6) AS rmse, R6(coverage, 6) AS coverage, R6(abs(coverage - 0.8), 6) AS coverage_err FROM e""")
def evaluation(spark, d):
    """Errors and coverage of the last fourteen days of each model."""
    lately = segments.recent_days(predictions(spark, d), KEYS, config.CHAMPION_RECENT_DAYS)
    return segments.recent_evaluation(lately, KEYS).select(*KEYS, "points", *[r6(F.col(c)).alias(c) for c in ("mae", "rmse", "coverage", "coverage_err")])


DRIFT = PRED + """,
recent AS (SELECT * FROM preds WHERE ts >= TIMESTAMP '2024-01-16'),
basis AS (SELECT model_key, sum(weight * abs(p50 - y_true)) / sum(weight) * 0.8 AS baseline_mae FROM preds GROUP BY 1),
drift AS (SELECT r.model_key, count(*) AS points, sum(weight * abs(p50 - y_true)) / sum(weight) AS recent_mae, least(0.12, greatest(-0.12, sum(weight * (y_true - p50)) / sum(weight))) AS recent_bias, max(baseline_mae) AS baseline_mae
  FROM recent r JOIN basis USING (model_key) GROUP BY 1 HAVING count(*) >= 120)
"""


def drift(spark, d):
    rows = predictions(spark, d)
    base = segments.recent_evaluation(rows, KEYS).select(*KEYS, (F.col("mae") * 0.8).alias("baseline_mae"))
    return segments.drift_summary(rows.filter(F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")), KEYS, base)


@query("drift_summary", "WITH " + DRIFT + "SELECT model_key, points, R6(recent_mae, 6) AS recent_mae, R6(recent_bias, 6) AS recent_bias, recent_mae > baseline_mae * 1.2 AS alert FROM drift")
def drift_summary(spark, d):
    return drift(spark, d).select(*KEYS, "points", r6(F.col("recent_mae")).alias("recent_mae"), r6(F.col("recent_bias")).alias("recent_bias"), "alert")


LOOK = SEG + f""",
prof AS (SELECT model_key, seg_kind, seg_key, {BIAS} AS bias, count(*) AS n FROM seg GROUP BY 1, 2, 3 HAVING seg_kind = 'global' OR count(*) >= CASE WHEN seg_kind = 'occupancy' THEN 24 ELSE 30 END),
gl AS (SELECT model_key, bias FROM prof WHERE seg_kind = 'global'),
tried AS (SELECT s.model_key, s.location_id, s.ts, least(1.0, p.n / (CASE WHEN s.seg_kind = 'occupancy' THEN 24 ELSE 30 END * 3.0)) AS sup, p.bias, g.bias AS gb,
  CASE s.seg_kind WHEN 'occupancy' THEN 1 WHEN 'horizon' THEN 2 WHEN 'hour' THEN 3 WHEN 'block' THEN 4 WHEN 'day_type' THEN 5 ELSE 6 END AS o
  FROM seg s JOIN prof p USING (model_key, seg_kind, seg_key) JOIN gl g USING (model_key))
"""


@query("segment_profile_lookup", "WITH " + LOOK + "SELECT model_key, location_id, ts, R6(arg_min(sup * bias + (1 - sup) * gb, o), 6) AS bias FROM tried GROUP BY 1, 2, 3")
def segment_lookup(spark, d):
    rows = predictions(spark, d)
    out = segments.segment_profile_lookup(
        rows, segments.point_bias_profile(rows, KEYS), KEYS, "bias", ["bias"], points=config.BIAS_MIN_POINTS, points_occupancy=config.BIAS_MIN_POINTS_OCCUPANCY
    )
    return out.select("model_key", "location_id", "ts", r6(F.col("bias")).alias("bias"))


@query("drift_bias_lookup", "WITH " + SEG + """,
prof AS (SELECT model_key, seg_kind, seg_key, least(0.12, greatest(-0.12, sum(weight * (y_true - p50)) / sum(weight))) AS bias, count(*) AS n FROM seg WHERE seg_kind IN ('hour', 'day_type', 'occupancy', 'global') GROUP BY 1, 2, 3
  HAVING seg_kind = 'global' OR count(*) >= CASE WHEN seg_kind = 'occupancy' THEN 24 ELSE 20 END),
tried AS (SELECT s.model_key, s.location_id, s.ts, p.bias * least(1.0, p.n / (CASE WHEN s.seg_kind = 'occupancy' THEN 24 ELSE 20 END * 3.0)) AS b,
  CASE s.seg_kind WHEN 'occupancy' THEN 1 WHEN 'hour' THEN 2 WHEN 'day_type' THEN 3 ELSE 4 END AS o FROM seg s JOIN prof p USING (model_key, seg_kind, seg_key))
SELECT model_key, location_id, ts, R6(arg_min(b, o) * 0.6 * exp(-hour(ts) / 8.0), 6) AS drift_bias FROM tried GROUP BY 1, 2, 3""")
def drift_lookup(spark, d):
    rows = predictions(spark, d)
    out = segments.drift_bias_lookup(rows, segments.drift_bias_profile(rows, KEYS), KEYS, F.hour("ts"))
    return out.select("model_key", "location_id", "ts", r6(F.col("drift_bias")).alias("drift_bias"))


PAIRS = RATIO + """,
nw AS (SELECT max(bucket_ts) AS m FROM ratio),
pairs AS (SELECT a.location_id, a.bucket_ts, h.h AS horizon, a.ratio AS x, b.ratio AS y,
  greatest(0.25, 0.9 * (1 + 1.2 * pow(b.ratio, 1.4)) * greatest(0.2, pow(2.0, -(epoch(m) - epoch(a.bucket_ts)) / 86400.0 / 45.0))) AS w
  FROM ratio a, nw, (VALUES (1), (2), (3), (6), (12)) h(h) JOIN ratio b ON b.location_id = a.location_id AND b.bucket_ts = a.bucket_ts + h.h * INTERVAL '1 hour')
"""


def pairs(spark, d):
    from crowdtide.operators.row_weights import with_recency

    r = cut_lineage(ratio(spark, d).select("location_id", "bucket_ts", "ratio"))
    return horizons.horizon_pairs(with_recency(r, "bucket_ts").withColumn("row_weight", F.lit(0.9)), r)


@query("horizon_pairs", "WITH " + PAIRS + "SELECT location_id, bucket_ts, horizon, R6(x, 6) AS source_ratio, R6(y, 6) AS target_ratio, R6(w, 6) AS pair_weight FROM pairs")
def horizon_pairs(spark, d):
    return pairs(spark, d).select("location_id", "bucket_ts", "horizon", *[r6(F.col(c)).alias(c) for c in ("source_ratio", "target_ratio", "pair_weight")])


FIT = PAIRS + """,
ex AS (SELECT h.h AS horizon, o.o AS occupancy, x, y, w FROM pairs p, LATERAL (VALUES (p.horizon), (0)) h(h), LATERAL (VALUES ('all'), (CASE WHEN x < 0.35 THEN 'low' WHEN x < 0.75 THEN 'mid' ELSE 'high' END)) o(o)),
qb AS (SELECT horizon, occupancy, greatest(0.08, quantile_cont(w, 0.02)) AS lo, quantile_cont(w, 0.98) AS hi FROM ex GROUP BY 1, 2),
cl AS (SELECT e.*, least(greatest(w, lo), least(6.0, greatest(lo, hi))) AS cw FROM ex e JOIN qb USING (horizon, occupancy)),
mo AS (SELECT horizon, occupancy, count(*) AS n, sum(cw * x) / sum(cw) AS mx, sum(cw * y) / sum(cw) AS my, sum(cw * x * y) / sum(cw) AS mxy, sum(cw * x * x) / sum(cw) AS mxx FROM cl GROUP BY 1, 2),
sl AS (SELECT *, least(2.5, greatest(0.0, CASE WHEN mxx - mx * mx <= 1e-6 THEN 1.0 ELSE (mxy - mx * my) / (mxx - mx * mx) END)) AS slope FROM mo),
ic AS (SELECT *, least(0.5, greatest(-0.5, my - slope * mx)) AS intercept FROM sl),
er AS (SELECT i.horizon, i.occupancy, max(i.n) AS n, max(slope) AS slope, max(intercept) AS intercept, sum(cw * abs(least(1.2, greatest(0.0, x)) - y)) / sum(cw) AS m0,
  sum(cw * abs(least(1.2, greatest(0.0, slope * x + intercept)) - y)) / sum(cw) AS m1 FROM cl JOIN ic i USING (horizon, occupancy) GROUP BY 1, 2)
"""


@query("horizon_regression", "WITH " + FIT + """SELECT CAST(horizon AS INTEGER) AS horizon, occupancy, n, R6(slope, 5) AS slope, R6(intercept, 5) AS intercept, R6(m0, 5) AS baseline_mae, R6(m1, 5) AS mae,
R6(0.45 * least(1.0, n / 300.0) * CASE WHEN m0 > 1e-4 AND m0 > m1 THEN least(1.0, (m0 - m1) / m0) ELSE 0 END, 5) AS blend FROM er WHERE occupancy = 'all' OR n >= 18""")
def horizon_regression(spark, d):
    fits = horizons.horizon_regression(pairs(spark, d).withColumn("model_key", F.lit("m")), KEYS)
    return fits.select("horizon", "occupancy", "n", *[r6(F.col(c), 5).alias(c) for c in ("slope", "intercept", "baseline_mae", "mae", "blend")])


@query("horizon_adjust", "WITH " + FIT + "," + PRED[PRED.index("dim AS ("):] + """,
b AS (SELECT horizon, occupancy, n, slope, intercept, 0.45 * least(1.0, n / 300.0) * CASE WHEN m0 > 1e-4 AND m0 > m1 THEN least(1.0, (m0 - m1) / m0) ELSE 0 END AS blend
  FROM er WHERE occupancy = 'all' OR n >= 18),
ft AS (
  SELECT c.cls, b.horizon, {'h': b.horizon, 's': slope, 'i': intercept, 'b': blend} AS fit FROM (VALUES ('low'), ('mid'), ('high')) c(cls) JOIN b ON b.occupancy IN ('all', c.cls)
  WHERE n >= 30 AND (b.occupancy <> 'all' OR NOT EXISTS (SELECT 1 FROM b o WHERE o.horizon = b.horizon AND o.occupancy = c.cls))),
nb AS (
  SELECT cls, h, arg_max(fit, horizon) FILTER (horizon > 0 AND horizon <= h) AS below, arg_min(fit, horizon) FILTER (horizon > 0 AND horizon >= h) AS above, any_value(fit) FILTER (horizon = 0) AS total
  FROM ft, (SELECT unnest(range(24)) AS h) GROUP BY 1, 2),
lh AS (SELECT cls, h, coalesce(below, above, total) AS lo, coalesce(above, below, total) AS hi FROM nb),
ab AS (SELECT *, CASE WHEN hi.h > lo.h THEN (h - lo.h) / CAST(hi.h - lo.h AS DOUBLE) ELSE 0.0 END AS a FROM lh),
ip AS (SELECT cls, h, lo.s * (1 - a) + hi.s * a AS s, lo.i * (1 - a) + hi.i * a AS i, lo.b * (1 - a) + hi.b * a AS b FROM ab),
ends AS (SELECT min(horizon) AS first, max(horizon) AS last FROM b WHERE horizon > 0 AND occupancy = 'all'),
pl AS (
  SELECT p.*, coalesce(least(0.45, greatest(0.0, ip.b)) * CASE WHEN hour(ts) > last THEN greatest(0.15, least(1.0, last / CAST(hour(ts) AS DOUBLE)))
      WHEN hour(ts) < first THEN greatest(0.3, least(1.0, hour(ts) / CAST(first AS DOUBLE))) ELSE 1.0 END, 0.0) AS w,
    coalesce(least(1.2, greatest(0.0, ip.s * p50 + ip.i)), p50) AS line
  FROM preds p CROSS JOIN ends LEFT JOIN ip ON ip.h = hour(ts) AND ip.cls = CASE WHEN least(1.2, greatest(0.0, p50)) < 0.35 THEN 'low' WHEN least(1.2, greatest(0.0, p50)) < 0.75 THEN 'mid' ELSE 'high' END),
ce AS (SELECT *, (1 - w) * p50 + w * line AS c FROM pl)
SELECT location_id, ts, R6(c - greatest(0.0, p50 - p10), 5) AS p10, R6(c, 5) AS p50, R6(c + greatest(0.0, p90 - p50), 5) AS p90 FROM ce""")
def horizon_adjust(spark, d):
    whole = F.lit("all").alias("model_key")
    fits = horizons.horizon_regression(pairs(spark, d).withColumn("model_key", whole), KEYS)
    profile = cut_lineage(horizons.horizon_profile(fits, KEYS))      # one row per model, of known size
    joined = predictions(spark, d).withColumn("model_key", whole).join(profile, KEYS).withColumn("hours_ahead", F.hour("ts"))
    return horizons.horizon_adjust(joined).select("location_id", "ts", *[r6(F.col(c), 5).alias(c) for c in ("p10", "p50", "p90")])


@query("ensemble_weight", """WITH b AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE ln(1 + event_id + 1) / 0.05 END AS ps, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE 60.0 END AS fs,
  0.05 + event_id % 10 / 100.0 AS pm, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 0.1 END AS fm, event_id % 11 / 10.0 AS pq, 0.2 AS fq, event_id % 120 AS n FROM events),
s1 AS (SELECT *, least(0.9, greatest(0.15, CASE WHEN ps > 0 AND fs > 0 THEN 0.36 + 0.5 * ps / (ps + fs) WHEN ps > 0 THEN 0.9 WHEN fs > 0 THEN 0.54 ELSE 0.72 END)) AS w FROM b),
s2 AS (SELECT * REPLACE (CASE WHEN fm IS NULL THEN w ELSE least(0.9, greatest(0.15, 0.6 * w + 0.4 * (1 / pm) / (1 / pm + 1 / fm))) END AS w) FROM s1),
s3 AS (SELECT * REPLACE (least(0.9, greatest(0.15, 0.55 * w + 0.45 * pow(1 - pq, 1.6) / (pow(1 - pq, 1.6) + pow(0.8, 1.6)))) AS w) FROM s2)
SELECT event_id, R6(CASE WHEN n < 80 THEN least(0.9, greatest(0.15, (1 - 0.22 * (1 - n / 80)) * w + 0.22 * (1 - n / 80) * 0.15)) ELSE w END, 6) AS primary_weight FROM s3""")
def ensemble(spark, d):
    e = F.col("event_id")
    score = adjust.quality_score(e + 1, F.when(e % 5 != 0, F.lit(0.05)), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0), F.lit(False))
    rows = table(spark, d, "events").select(
        "event_id", score.alias("primary_score"), F.when(e % 7 == 0, 0.0).otherwise(60.0).alias("fallback_score"),
        (0.05 + e % 10 / 100.0).alias("primary_mae"), F.when(e % 3 != 0, F.lit(0.1)).alias("fallback_mae"),
        F.least(F.lit(1.0), e % 11 / 10.0).alias("primary_missing"), F.lit(0.2).alias("fallback_missing"), (e % 120).alias("samples"),
    )
    return adjust.with_primary_weight(rows).select("event_id", r6(F.col("primary_weight")).alias("primary_weight"))


def blend(a: str, weight: str, towards: str = "pr") -> str:
    return f"SELECT * REPLACE ((1 - ({weight})) * p50 + ({weight}) * {towards} - greatest(0, p50 - p10) AS p10, (1 - ({weight})) * p50 + ({weight}) * {towards} AS p50, (1 - ({weight})) * p50 + ({weight}) * {towards} + greatest(0, p90 - p50) AS p90) FROM {a}"


@query("adjust_prediction", "WITH " + PRED + """,
b AS (SELECT location_id, ts, p10, p50, p90, 0.4 AS pr, CAST(hour(ts) * 5 AS DOUBLE) AS n, 0.02 AS bias, hour(ts) / 24.0 AS mi, 0.8 AS lv, CAST(location_id * 6 AS DOUBLE) AS age, hour(ts) % 14 + 0.0 AS h FROM preds),
s1 AS (""" + blend("b", "0.35 * (1 - least(1.0, n / 60))") + """),
s2 AS (SELECT * REPLACE (p10 + bias AS p10, p50 + bias AS p50, p90 + bias AS p90) FROM s1),
s3 AS (""" + blend("s2", "0.45 * least(1.0, greatest(0.0, (mi - 0.25) / 0.35))") + """),
s4 AS (""" + blend("s3", "CASE WHEN age <= 45 AND h <= 4 THEN 0.55 * exp(-h / 1.6) * exp(-age / 35) ELSE 0 END", "lv") + """),
s5 AS (""" + blend("s4", "0.28 * least(1.0, greatest(0.0, (h - 4) / 8))") + """),
s6 AS (SELECT *, 1.15 * (1 + 0.55 * least(1.0, greatest(0.0, (mi - 0.2) / 0.4))) * least(1.38, greatest(1.0, 1 + 0.75 * (0.1 - 0.03))) * (1 + 0.28 * (1 - least(1.0, n / 80))) AS k FROM s5),
s7 AS (SELECT location_id, ts, p50 - (p50 - p10 + 0.03) * k AS a, p50 AS m, p50 + (p90 - p50 + 0.03) * k AS z FROM s6)
SELECT location_id, ts, R6(least(1.2, greatest(0.0, a)), 6) AS p10, R6(least(1.2, greatest(0.0, m)), 6) AS p50, R6(least(1.2, greatest(0.0, z)), 6) AS p90 FROM s7""")
def adjusted(spark, d):
    h = F.hour("ts")
    rows = predictions(spark, d).withColumns({
        "profile_ratio": F.lit(0.4), "samples": h * 5, "bias": F.lit(0.02), "missing": h / 24.0, "live_ratio": F.lit(0.8),
        "live_age": (F.col("location_id") * 6).cast("double"), "hours_ahead": (h % 14).cast("double"), "margin": F.lit(0.03),
        "drift_widen": F.lit(1.15), "disagreement": F.lit(0.1),
    })
    return adjust.adjust_prediction(rows).select("location_id", "ts", *[r6(F.col(p)).alias(p) for p in adjust.TRIPLE])


HIST = """hist AS (SELECT event_type AS model_key, ts AS t, value > 40 AS alert, value / 100 AS recent_mae, 0.4 AS baseline_mae FROM events)"""


def history(spark, d):
    return table(spark, d, "events").select(
        F.col("event_type").alias("model_key"), F.col("ts").alias("at"), (F.col("value") > 40).alias("alert"), (F.col("value") / 100).alias("recent_mae"), F.lit(0.4).alias("baseline_mae")
    )


@query("drift_streak", "WITH " + HIST + """, r AS (SELECT *, row_number() OVER (PARTITION BY model_key ORDER BY t DESC) AS n FROM hist QUALIFY n <= 60)
SELECT model_key, CAST(coalesce(min(n) FILTER (NOT alert), 61) - 1 AS INTEGER) AS streak, count(*) AS entries, max(t) AS latest_at FROM r GROUP BY 1""")
def streak(spark, d):
    return governance.drift_streak(history(spark, d), KEYS)


@query("adaptive_controls", "WITH " + HIST + """, r AS (SELECT * FROM hist ORDER BY t DESC LIMIT 60), a AS (SELECT count(*) AS samples, avg(CAST(alert AS INTEGER)) AS ar, median(recent_mae / baseline_mae) AS mr FROM r),
m AS (SELECT *, CASE WHEN ar <= 0.15 AND mr <= 1.03 THEN 'stable_relax' WHEN ar >= 0.4 OR mr >= 1.12 THEN 'unstable_tighten' ELSE 'default' END AS mode FROM a)
SELECT samples, round_even(ar, 4) AS alert_rate, mode, CASE mode WHEN 'stable_relax' THEN 36 WHEN 'unstable_tighten' THEN 14 ELSE 24 END AS retrain_hours,
CASE mode WHEN 'stable_relax' THEN 17 WHEN 'unstable_tighten' THEN 11 ELSE 14 END AS drift_days, CASE mode WHEN 'stable_relax' THEN 3 WHEN 'unstable_tighten' THEN 1 ELSE 2 END AS retrain_streak FROM m""")
def controls(spark, d):
    return governance.adaptive_controls(history(spark, d)).select("samples", "alert_rate", "mode", "retrain_hours", "drift_days", "retrain_streak")


@query("drift_actions", """WITH m AS (SELECT user_id AS model_key, user_id % 4 AS drift_streak, user_id % 3 = 0 AS force_retrain, CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2024-01-25 12:00:00' - (user_id % 5) * INTERVAL '1 hour' END AS fu, user_id % 2 = 0 AS has_previous FROM (SELECT DISTINCT user_id FROM events)),
g AS (SELECT user_id AS model_key, bool_or(value > 150) AS alert FROM events WHERE user_id % 5 <> 4 GROUP BY 1),
j AS (SELECT m.*, alert, CASE WHEN alert IS NULL THEN drift_streak WHEN alert THEN drift_streak + 1 ELSE 0 END AS streak FROM m LEFT JOIN g USING (model_key)),
k AS (SELECT *, coalesce(alert, false) AND streak >= 3 AND has_previous AS rolled_back FROM j)
SELECT model_key, streak, rolled_back, CASE WHEN rolled_back THEN true WHEN alert IS NOT NULL THEN streak >= 2 OR coalesce(force_retrain AND TIMESTAMP '2024-01-25 10:20:00' <= fu, false) ELSE force_retrain END AS force_retrain,
R6(CASE WHEN rolled_back THEN 1.0 WHEN alert IS NOT NULL OR force_retrain THEN least(1.7, 1 + 0.15 * streak) ELSE 1.0 END, 6) AS interval_multiplier FROM k""")
def actions(spark, d):
    e = table(spark, d, "events")
    u = F.col("user_id")
    back = F.make_dt_interval(F.lit(0), (u % 5).cast("int"))
    meta = e.select("user_id").distinct().select(
        u.alias("model_key"), (u % 4).alias("drift_streak"), (u % 3 == 0).alias("force_retrain"),
        F.when(u % 3 == 0, F.lit("2024-01-25 12:00:00").cast("timestamp_ntz") - back).alias("force_retrain_until"), (u % 2 == 0).alias("has_previous"),
    )
    checks = e.filter(u % 5 != 4).groupBy(u.alias("model_key")).agg(F.bool_or(F.col("value") > 150).alias("alert"))
    out = governance.drift_actions(meta, checks, KEYS, now())
    return out.select("model_key", "streak", "rolled_back", "force_retrain", r6(F.col("interval_multiplier")).alias("interval_multiplier"))


GATE = """o AS (SELECT user_id AS k, count(*) * 30 AS points, avg(value) / 100 AS mae, stddev_pop(value) / 100 AS rmse, 0.05 AS ce FROM events WHERE event_type <> 'view' AND user_id % 7 <> 0 GROUP BY 1),
n AS (SELECT user_id AS k, count(*) * 30 AS points, avg(value) / 100 AS mae, stddev_pop(value) / 100 AS rmse, 0.055 AS ce FROM events WHERE event_type <> 'click' AND user_id % 11 <> 0 GROUP BY 1)"""


def gate_sides(spark, d):
    def side(kind, skip, ce):
        e = table(spark, d, "events").filter((F.col("event_type") != kind) & (F.col("user_id") % skip != 0))
        return e.groupBy(F.col("user_id").alias("model_key")).agg(
            (F.count("*") * 30).alias("points"), (F.avg("value") / 100).alias("mae"), (F.stddev_pop("value") / 100).alias("rmse"), F.lit(ce).alias("coverage_err")
        )

    return side("view", 7, 0.05), side("click", 11, 0.055)


@query("champion_gate", "WITH " + GATE + """SELECT coalesce(o.k, n.k) AS model_key, CASE WHEN o.k IS NULL THEN 'no_champion_eval' WHEN n.k IS NULL THEN 'no_challenger_eval' WHEN o.points < 240 OR n.points < 240 THEN 'insufficient_eval_rows'
WHEN o.mae - n.mae >= 0.0015 AND n.rmse - o.rmse <= 0.01 AND n.ce - o.ce <= 0.01 THEN 'promote' ELSE 'champion_kept' END AS reason FROM o FULL JOIN n ON o.k = n.k""")
def gate(spark, d):
    old, new = gate_sides(spark, d)
    return governance.champion_gate(old, new, KEYS).select("model_key", "reason")


@query("guardrail", "WITH " + GATE + """SELECT n.k AS model_key, CASE WHEN o.points >= 120 AND n.points >= 120 AND n.mae > o.mae * 1.03 THEN 'holdout_mae' WHEN o.points >= 200 AND n.points >= 200 AND n.rmse > o.rmse * 1.05 THEN 'validation_mae' END AS reason FROM n LEFT JOIN o ON o.k = n.k""")
def guard(spark, d):
    as_meta = lambda s: s.select("model_key", F.col("points").alias("holdout_rows"), F.col("mae").alias("holdout_mae"), F.col("coverage_err").alias("holdout_coverage_err"), F.col("points").alias("val_rows"), F.col("rmse").alias("val_mae"), F.col("coverage_err").alias("val_coverage_err"))
    old, new = gate_sides(spark, d)
    return governance.guardrail(as_meta(old), as_meta(new), KEYS).select("model_key", "reason")


@query("retrain_due", """SELECT event_id AS model_key, CASE WHEN event_id % 6 = 0 THEN 'never_trained' WHEN event_id % 4 = 0 AND event_id % 5 = 0 THEN 'flagged' WHEN event_id % 5 <> 0 AND TIMESTAMP '2024-01-25 10:20:00' <= ts THEN 'force_window'
WHEN epoch(TIMESTAMP '2024-01-25 10:20:00') - floor(epoch(ts)) >= 86400 THEN 'age' END AS retrain_reason FROM events""")
def due(spark, d):
    e = F.col("event_id")
    meta = table(spark, d, "events").select(
        e.alias("model_key"), F.when(e % 6 != 0, F.col("ts")).alias("trained_at"), (e % 4 == 0).alias("force_retrain"), F.when(e % 5 != 0, F.col("ts")).alias("force_retrain_until")
    )
    return governance.retrain_due(meta, now()).select("model_key", "retrain_reason")


@query("model_summary", """WITH m AS (SELECT user_id % 3 AS facility_id, user_id, count(*) AS rows, count(*) FILTER (event_type = 'view') AS vr, avg(value) AS mae, max(value) AS rmse, max(ts) AS ta, CASE WHEN user_id % 3 = 0 THEN 'trained' WHEN user_id % 2 = 0 THEN 'trained' ELSE 'skipped' END AS status FROM events GROUP BY 1, 2)
SELECT facility_id, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(vr) AS BIGINT) AS val_rows, R6(sum(mae * vr) / sum(vr), 6) AS mae, max(ta) AS trained_at, count(*) AS models, CASE WHEN min(status) = max(status) THEN max(status) ELSE 'mixed' END AS status FROM m GROUP BY 1""")
def model_summary(spark, d):
    m = table(spark, d, "events").groupBy((F.col("user_id") % 3).alias("facility_id"), "user_id").agg(
        F.count("*").alias("rows"), F.count_if(F.col("event_type") == "view").alias("val_rows"), F.avg("value").alias("mae"), F.max("value").alias("rmse"), F.max("ts").alias("trained_at")
    ).withColumn("status", F.when((F.col("user_id") % 3 == 0) | (F.col("user_id") % 2 == 0), "trained").otherwise("skipped"))
    return governance.model_summary(m, ["facility_id"]).select("facility_id", "rows", "val_rows", r6(F.col("mae")).alias("mae"), "trained_at", "models", "status")


@query("union_model_keys", "SELECT DISTINCT user_id AS model_key FROM events WHERE event_type IN ('view', 'click')")
def keys(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "model_key")
    return governance.union_model_keys(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), KEYS)
