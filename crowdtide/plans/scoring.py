"""Scoring targets with stored models: plain, blended and recursive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdtide import config
from crowdtide.functions.levels import clamp, missing_share
from crowdtide.functions.timeparts import epoch_seconds
from crowdtide.operators import adjust, horizons, segments
from crowdtide.operators.asof import LAGS
from crowdtide.operators.profiles import profile_fallback_join
from crowdtide.operators.rolling_stats import DELTAS, MEAN_HOURS, RANGE_HOURS, STD_HOURS, TRENDS
from crowdtide.plans.feature_table import FEATURES, apply_limits, sanitize_features
from crowdtide.plans.training import TrainedModel, predict, quantile_bounds
from crowdtide.session import cut_lineage, shared_folder

KEY = ["model_key"]


def score(features: DataFrame, model: TrainedModel, profile: DataFrame) -> DataFrame:
    """p10, p50, p90 and the missing share of each feature row."""
    width = len(FEATURES) + len(model.locations)
    sane = sanitize_features(features).withColumn("missing", missing_share(list(FEATURES)) * (len(FEATURES) / float(width)))
    raw = predict(model.pipeline, apply_limits(sane, model.limits)).select(
        F.lit(model.key).alias("model_key"), "location_id", F.col("bucket_ts").alias("ts"), clamp(F.col("p50"), 0.0, config.RATIO_MAX).alias("p50"), "missing"
    )
    return quantile_bounds(raw, profile)


def model_scores(metrics: DataFrame) -> DataFrame:
    """Quality score per model from holdout errors, or validation errors without."""
    held = F.col("holdout_mae").isNotNull() & (F.col("holdout_rows") > 0)
    mae = F.when(held, F.col("holdout_mae")).otherwise(F.col("val_mae"))
    rows = F.when(held, F.col("holdout_rows")).otherwise(F.col("val_rows"))
    return metrics.select("model_key", adjust.quality_score(
        rows, mae, F.coalesce("holdout_coverage_err", "val_coverage_err"), F.col("missing"), F.col("drift_streak"), F.col("force_retrain")
    ).alias("score"))


def _side(scored: DataFrame, prefix: str, calibration: dict[str, DataFrame], now) -> DataFrame:
    """One model's predictions with its corrections, as prefixed columns."""
    hours = F.greatest(F.lit(0.0), (epoch_seconds(F.col("ts")) - epoch_seconds(now)) / 3600.0)
    rows = scored.withColumn("hours_ahead", hours)
    if "horizon" in calibration:
        rows = horizons.horizon_adjust(rows.join(horizons.horizon_profile(calibration["horizon"], KEY), KEY, "left")).drop("horizon_profile")
    whole = F.floor("hours_ahead")
    rows = segments.segment_profile_lookup(rows, calibration["regime"], KEY, "regime", ["mae"], hours_ahead=whole, points=config.BIAS_MIN_POINTS)
    rows = segments.segment_profile_lookup(
        rows, calibration["bias"], KEY, "bias", ["bias"], hours_ahead=whole, points=config.BIAS_MIN_POINTS, points_occupancy=config.BIAS_MIN_POINTS_OCCUPANCY
    )
    rows = segments.drift_bias_lookup(rows, calibration["drift"], KEY, whole)
    rows = rows.join(calibration["scores"], KEY, "left")
    names = {"p10": "p10", "p50": "p50", "p90": "p90", "missing": "missing", "regime": "mae", "score": "score"}
    return rows.select(
        "location_id", F.col("ts").alias("target_ts"), *[F.col(c).alias(f"{prefix}_{n}") for c, n in names.items()],
        (F.col("bias") + F.col("drift_bias")).alias(f"{prefix}_bias"),
    )


def estimate_locations(
    targets: DataFrame, scored: DataFrame, calibration: dict[str, DataFrame], profiles: DataFrame, live: DataFrame, now,
) -> DataFrame:
    """Counts p10/p50/p90 of every (location, target).

    ``targets`` holds location_id, target_ts, max_cap, samples, primary_key and
    fallback_key; ``live`` location_id, live_ratio, live_age.  The category model and
    the facility model are blended; without either the seasonal profile stands in.
    """
    primary_rows = scored.join(targets.select("location_id", F.col("primary_key").alias("model_key")).distinct(), ["location_id", "model_key"], "left_semi")
    fallback_rows = scored.join(
        targets.filter(F.col("fallback_key") != F.coalesce("primary_key", F.lit(""))).select("location_id", F.col("fallback_key").alias("model_key")).distinct(),
        ["location_id", "model_key"], "left_semi",
    )
    primary = cut_lineage(_side(primary_rows, "primary", calibration, now))
    fallback = cut_lineage(_side(fallback_rows, "fallback", calibration, now))
    rows = profile_fallback_join(targets, profiles, "target_ts")
    rows = rows.join(primary, ["location_id", "target_ts"], "left").join(fallback, ["location_id", "target_ts"], "left").join(live, "location_id", "left")
    rows = rows.withColumns({
        "profile_ratio": F.coalesce("profile_ratio", F.lit(0.0)),
        "hours_ahead": F.greatest(F.lit(0.0), (epoch_seconds(F.col("target_ts")) - epoch_seconds(now)) / 3600.0),
        "primary_score": F.coalesce("primary_score", F.lit(0.0)), "fallback_score": F.coalesce("fallback_score", F.lit(0.0)),
    })
    rows = adjust.with_primary_weight(rows)
    both = F.col("primary_p50").isNotNull() & F.col("fallback_p50").isNotNull()
    w = F.col("primary_weight")
    mix = lambda c: F.coalesce(w * F.col(f"primary_{c}") + (1.0 - w) * F.col(f"fallback_{c}"), F.col(f"primary_{c}"), F.col(f"fallback_{c}"))
    rows = rows.withColumns({
        **{p: F.coalesce(mix(p), F.col("profile_ratio")) for p in adjust.TRIPLE},
        "missing": F.coalesce(mix("missing"), F.lit(1.0)), "bias": F.coalesce(mix("bias"), F.lit(0.0)),
        "disagreement": F.when(both, F.abs(F.col("primary_p50") - F.col("fallback_p50"))),
        "model_key": F.when(F.col("primary_p50").isNotNull(), F.col("primary_key")).when(F.col("fallback_p50").isNotNull(), F.col("fallback_key")),
    })
    rows = adjust.with_triple(rows, adjust.ordered(*[F.col(p) for p in adjust.TRIPLE]))
    centred = adjust.centre_prediction(rows)
    with_margin = segments.segment_profile_lookup(
        centred.withColumn("ts", F.col("target_ts")), calibration["conformal"], KEY, "margin", ["margin"], hours_ahead=F.floor("hours_ahead"), points=config.CONFORMAL_MIN_SEGMENT
    )
    widened = with_margin.join(calibration["widen"].select("model_key", F.col("interval_multiplier").alias("drift_widen")), KEY, "left").withColumn(
        "drift_widen", F.coalesce("drift_widen", F.lit(1.0))
    )
    final = adjust.widen_prediction(widened)
    cap = F.greatest(F.lit(0), F.coalesce("max_cap", F.lit(0)))
    return final.select(
        "location_id", "target_ts", *[(F.col(p) * cap).alias(f"count_{p}") for p in adjust.TRIPLE], F.coalesce("samples", F.lit(0)).alias("samples"), cap.alias("max_cap"), "model_key"
    )


# -- recursion ----------------------------------------------------------------------


def tree_arrays(model: TrainedModel):
    """The trees of a model as flat arrays: at most rounds x 2^(depth+1) nodes."""
    import numpy as np

    trees = model.pipeline.stages[-1]
    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/crowdtide/{uuid.uuid4().hex}"
    trees.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    starts, offset = [], {}
    for i, n in enumerate(nodes):
        if n["treeID"] not in offset:
            offset[n["treeID"]] = i
            starts.append(i)
    feature, threshold, left, right, value = [], [], [], [], []
    for i, n in enumerate(nodes):
        base, leaf = offset[n["treeID"]], n["leftChild"] < 0
        feature.append(0 if leaf else n["split"]["featureIndex"])
        threshold.append(float("inf") if leaf else n["split"]["leftCategoriesOrThreshold"][0])
        left.append(i if leaf else base + n["leftChild"])
        right.append(i if leaf else base + n["rightChild"])
        value.append(n["prediction"])
    depth = max(t.depth for t in trees.trees)
    pack = lambda v, kind: np.asarray(v, dtype=kind)
    return (pack(starts, "int64"), pack(feature, "int64"), pack(threshold, "float64"), pack(left, "int64"), pack(right, "int64"),
            pack(value, "float64"), pack(trees.treeWeights, "float64"), depth)


def recursive_score(features: DataFrame, ratio: DataFrame, week_profiles: DataFrame, model: TrainedModel, *, grid: int = config.RESAMPLE_MINUTES, days_back: int = 8) -> DataFrame:
    """Predict one location's targets in time order; each feeds the lags of the later.

    A group is one location's forecast week and the eight days before it, whatever the
    length of the history.  Only lag features are worked out anew; the others come
    from the feature table.
    """
    trees = tree_arrays(model)
    limits = [model.limits[f] for f in FEATURES]
    names, places = list(FEATURES), sorted(model.locations)
    lags, steps = {**LAGS, "lag_15m": grid}, grid * 60
    means, stds, ranges = dict(MEAN_HOURS), dict(STD_HOURS), dict(RANGE_HOURS)
    deltas, trends = dict(DELTAS), dict(TRENDS)
    start = features.agg(F.min("bucket_ts").alias("_from"))
    recent = ratio.crossJoin(start).filter(  # one row
        F.col("bucket_ts") >= F.col("_from") - F.make_dt_interval(F.lit(days_back))
    )
    history = recent.groupBy("location_id").agg(
        F.sort_array(F.collect_list(F.struct(epoch_seconds(F.col("bucket_ts")).alias("s"), F.col("ratio").alias("r")))).alias("history")  # eight days of grid steps
    )
    base = sanitize_features(features).withColumn("sec", epoch_seconds(F.col("bucket_ts"))).withColumn("slot", F.weekday("bucket_ts") * 24 + F.hour("bucket_ts"))
    rows = base.join(history, "location_id", "left").join(week_profiles, "location_id", "left")
    schema = T.StructType([T.StructField("location_id", T.LongType()), features.schema["bucket_ts"], T.StructField("p50", T.DoubleType())])

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("sec")
        starts, feat, thr, left, right, value, weights, depth = trees
        first = pdf.iloc[0]
        known = {int(h["s"]): float(h["r"]) for h in (first["history"] if first["history"] is not None else [])}
        profile = first["week_profile"]
        place = first["location_id"]
        hot = np.zeros(len(places) + 1)
        hot[places.index(place) if place in places else len(places)] = 1.0
        column = {n: i for i, n in enumerate(names)}
        table = pdf[names].to_numpy(dtype="float64")
        at_profile = lambda s: np.nan if profile is None else float(profile[int((s // 86400 + 3) % 7 * 24 + s % 86400 // 3600)])
        window = lambda s, hours: [known[t] for t in range(s - max(hours * 3600, steps), s, steps) if t in known]
        out, guessed = [], []
        for row, s in zip(table, pdf["sec"].to_numpy()):
            s = int(s)
            x = row.copy()
            put = lambda n, v: x.__setitem__(column[n], v)
            get = lambda n: x[column[n]]
            latest = max((t for t in guessed if t < s), default=None)
            since = get("minutes_since_bucket")
            if latest is not None and (np.isnan(since) or (s - latest) / 60.0 < since):
                put("last_bucket", known[latest]), put("minutes_since_bucket", (s - latest) / 60.0)
            for n, minutes in lags.items():
                t = s - minutes * 60
                put(n, known.get(t, at_profile(t)))
            for n, lag in deltas.items():
                put(n, get("lag_15m") - get(lag))
            for n, h in means.items():
                v = window(s, h)
                put(n, np.mean(v) if v else np.nan)
            for n, h in stds.items():
                v = window(s, h)
                put(n, np.std(v) if len(v) > 1 else np.nan)
            for n, h in ranges.items():
                v = window(s, h)
                put(n, max(v) - min(v) if v else np.nan)
            for n, (a, b) in trends.items():
                put(n, get(a) - get(b))
            share = lambda group: float(np.mean([np.isnan(get(n)) for n in group]))
            put("lag_missing", share(lags)), put("delta_missing", share(deltas)), put("trend_missing", share(trends))
            put("roll_missing", share([*means, *stds, *ranges]))
            put("dynamics_missing", (get("lag_missing") + get("delta_missing") + get("trend_missing") + get("roll_missing")) / 4.0)
            for i, (fill, low, high) in enumerate(limits):
                v = fill if np.isnan(x[i]) else x[i]
                x[i] = v if low is None else min(max(v, low), high)
            full = np.concatenate([x, hot])
            node = starts.copy()
            for _ in range(depth):
                node = np.where(full[feat[node]] <= thr[node], left[node], right[node])
            p50 = float(min(max((value[node] * weights).sum(), 0.0), 1.2))
            out.append(p50)
            guessed = list(range(s, s + 3600, steps))  # this target and the hour after it
            known.update((t, p50) for t in guessed)
        return pd.DataFrame({"location_id": pdf["location_id"].to_numpy(), "bucket_ts": pdf["bucket_ts"].to_numpy(), "p50": out})

    return rows.groupBy("location_id").applyInPandas(lambda pdf: run(pdf), schema)
