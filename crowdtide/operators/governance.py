"""Decisions about models: promotion, guardrails, retraining, drift actions, controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdtide import config
from crowdtide.functions.levels import clamp
from crowdtide.operators.adjust import drift_multiplier
from crowdtide.operators.quantiles import quantiles

# --- fixed values: limits of the adaptive controls ------------------------------
RETRAIN_LIMITS, DRIFT_DAY_LIMITS, MULTIPLIER_LIMITS, STREAK_LIMITS = (8, 72), (7, 21), (0.12, 0.35), (1, 6)
STABLE_RATE, STABLE_RATIO, UNSTABLE_RATE, UNSTABLE_RATIO = 0.15, 1.03, 0.40, 1.12
# --------------------------------------------------------------------------------


def champion_gate(champion: DataFrame, challenger: DataFrame, keys: list[str]) -> DataFrame:
    """Promote a challenger only for a real gain without losing elsewhere.

    Both sides hold ``points, mae, rmse, coverage_err`` per model.
    """
    metrics = ("points", "mae", "rmse", "coverage_err")
    old = champion.select(*keys, *[F.col(m).alias(f"_o_{m}") for m in metrics])
    new = challenger.select(*keys, *[F.col(m).alias(f"_n_{m}") for m in metrics])
    o, n = (lambda m: F.col(f"_o_{m}")), (lambda m: F.col(f"_n_{m}"))
    better = (
        (o("mae") - n("mae") >= config.CHAMPION_MIN_MAE_GAIN) & (n("rmse") - o("rmse") <= config.CHAMPION_MAX_RMSE_LOSS)
        & (n("coverage_err") - o("coverage_err") <= config.CHAMPION_MAX_COVERAGE_LOSS)
    )
    broken = F.lit(False)
    for m in metrics[1:]:
        broken = broken | F.coalesce(F.isnan(o(m)), F.lit(True)) | F.coalesce(F.isnan(n(m)), F.lit(True))
    few = (o("points") < config.CHAMPION_MIN_ROWS) | (n("points") < config.CHAMPION_MIN_ROWS)
    reason = (
        F.when(o("points").isNull(), "no_champion_eval").when(n("points").isNull(), "no_challenger_eval")
        .when(few, "insufficient_eval_rows").when(broken, "invalid_eval_metrics").when(better, "promote").otherwise("champion_kept")
    )
    return old.join(new, keys, "full").select(
        *keys, reason.alias("reason"), (o("mae") - n("mae")).alias("mae_gain"),
    ).withColumn("promote", F.col("reason").isin("no_champion_eval", "insufficient_eval_rows", "promote"))


def guardrail(baseline: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a candidate stays close enough to the stored model, and why not.

    Both sides hold ``holdout_rows, holdout_mae, holdout_coverage_err, val_rows,
    val_mae, val_coverage_err``.
    """
    metrics = ("holdout_rows", "holdout_mae", "holdout_coverage_err", "val_rows", "val_mae", "val_coverage_err")
    old = baseline.select(*keys, *[F.col(m).alias(f"_o_{m}") for m in metrics])
    new = candidate.select(*keys, *[F.col(m).alias(f"_n_{m}") for m in metrics])
    o, n = (lambda m: F.col(f"_o_{m}")), (lambda m: F.col(f"_n_{m}"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    held = yes((o("holdout_rows") >= config.HOLDOUT_MIN_ROWS) & (n("holdout_rows") >= config.HOLDOUT_MIN_ROWS)
               & o("holdout_mae").isNotNull() & n("holdout_mae").isNotNull())
    checked = yes((o("val_rows") >= config.GUARD_MIN_VAL_ROWS) & (n("val_rows") >= config.GUARD_MIN_VAL_ROWS)
                  & o("val_mae").isNotNull() & n("val_mae").isNotNull())
    reason = (
        F.when(held & (n("holdout_mae") > o("holdout_mae") * (1 + config.GUARD_MAX_HOLDOUT_MAE)), "holdout_mae")
        .when(held & yes(n("holdout_coverage_err") - o("holdout_coverage_err") > config.GUARD_MAX_HOLDOUT_COVERAGE), "holdout_coverage")
        .when(checked & (n("val_mae") > o("val_mae") * (1 + config.GUARD_MAX_VAL_MAE)), "validation_mae")
        .when(checked & yes(n("val_coverage_err") - o("val_coverage_err") > config.GUARD_MAX_VAL_COVERAGE), "validation_coverage")
    )
    return new.join(old, keys, "left").select(*keys, reason.alias("reason")).withColumn("passed", F.col("reason").isNull())


def retrain_due(metadata: DataFrame, now: Column, hours: int = config.RETRAIN_HOURS, force: bool = False) -> DataFrame:
    """Whether each model is due: forced, never trained, force window, or too old."""
    until, forced = F.col("force_retrain_until"), F.coalesce(F.col("force_retrain"), F.lit(False))
    age = (F.unix_timestamp(now) - F.unix_timestamp("trained_at")) / 3600.0
    reason = (
        F.when(F.lit(force), "forced").when(F.col("trained_at").isNull(), "never_trained")
        .when(forced & until.isNull(), "flagged").when(until.isNotNull() & (now <= until), "force_window")
        .when(age >= max(1, hours), "age")
    )
    return metadata.withColumn("retrain_reason", reason).withColumn("retrain_due", reason.isNotNull())


def drift_streak(history: DataFrame, keys: list[str], at: str = "at", keep: int = config.HISTORY_POINTS) -> DataFrame:
    """Alerts in a row up to the newest entry, among the last entries of each model.

    Only the newest entries are needed, so they are found without ordering a model's
    whole history in one task: first per model and day, then among those.
    """
    per_day = Window.partitionBy(*keys, F.to_date(at)).orderBy(F.col(at).desc())
    newest = Window.partitionBy(*keys).orderBy(F.col(at).desc())
    recent = (
        history.withColumn("_n", F.row_number().over(per_day)).filter(F.col("_n") <= keep)
        .withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= keep)
    )
    calm = F.min(F.when(~F.col("alert"), F.col("_n")))
    return recent.groupBy(*keys).agg(
        (F.coalesce(calm, F.count("*") + 1) - 1).cast("int").alias("streak"), F.count("*").alias("entries"),
        F.max(at).alias("latest_at"),
    )


def union_model_keys(metadata: DataFrame, drift: DataFrame, keys: list[str]) -> DataFrame:
    return metadata.select(*keys).union(drift.select(*keys)).distinct()


def drift_actions(metadata: DataFrame, drift: DataFrame, keys: list[str], now: Column, *,
                  trigger: int = config.DRIFT_STREAK_RETRAIN, force_hours: int = config.DRIFT_FORCE_HOURS) -> DataFrame:
    """New streak, interval multiplier, forced retraining and rollback per model.

    ``metadata`` holds ``drift_streak, force_retrain, force_retrain_until,
    has_previous``; ``drift`` holds ``alert`` for the models that were evaluated.
    """
    joined = metadata.join(drift.select(*keys, "alert"), keys, "left")
    evaluated, alert = F.col("alert").isNotNull(), F.coalesce(F.col("alert"), F.lit(False))
    previous = F.coalesce(F.col("drift_streak"), F.lit(0))
    forced = F.coalesce(F.col("force_retrain"), F.lit(False))
    joined = joined.withColumn("streak", F.when(~evaluated, previous).when(alert, previous + 1).otherwise(0))
    rolled = evaluated & alert & (F.col("streak") >= config.DRIFT_STREAK_ROLLBACK) & F.coalesce(F.col("has_previous"), F.lit(False))
    triggered = evaluated & (F.col("streak") >= trigger)
    still = evaluated & forced & F.coalesce(now <= F.col("force_retrain_until"), F.lit(False))
    until = now + F.make_dt_interval(F.lit(0), F.lit(force_hours))
    return joined.withColumn("rolled_back", rolled).select(
        *keys, evaluated.alias("evaluated"), F.col("alert"), F.col("streak").cast("int").alias("streak"), "rolled_back",
        F.when(F.col("rolled_back"), True).when(evaluated, triggered | still).otherwise(forced).alias("force_retrain"),
        F.when(F.col("rolled_back") | triggered, until).when(still | ~evaluated, F.col("force_retrain_until")).alias("force_retrain_until"),
        F.when(F.col("rolled_back"), 1.0).when(evaluated | forced, drift_multiplier(F.col("streak"))).otherwise(1.0).alias("interval_multiplier"),
    )


def model_summary(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of several models as one: rows summed, errors weighted by their rows."""
    weighted = lambda c: F.try_divide(
        F.sum(F.when(F.col(c).isNotNull(), F.col(c) * F.col("val_rows"))), F.sum(F.when(F.col(c).isNotNull(), F.col("val_rows")))
    )
    return metrics.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("val_rows").alias("val_rows"), weighted("mae").alias("mae"), weighted("rmse").alias("rmse"),
        F.max("trained_at").alias("trained_at"), F.count("*").alias("models"),
        F.when(F.min("status") == F.max("status"), F.max("status")).otherwise("mixed").alias("status"),
    )


def adaptive_controls(history: DataFrame, at: str = "at") -> DataFrame:
    """Retrain and drift settings from the last 60 drift checks over all models.

    One row.  The newest checks are found per day first, then overall.
    """
    order = (F.col(at).desc(), F.col("model_key"))
    recent = (
        history.withColumn("_n", F.row_number().over(Window.partitionBy(F.to_date(at)).orderBy(*order)))
        .filter(F.col("_n") <= config.HISTORY_POINTS)
        .orderBy(*order).limit(config.HISTORY_POINTS)  # the 60 newest are what is asked for
        .withColumn("_ratio", F.when(F.col("baseline_mae") > 0, F.col("recent_mae") / F.col("baseline_mae")))
    )
    rates = recent.agg(F.count("*").alias("samples"), F.avg(F.col("alert").cast("double")).alias("_rate"), F.expr("percentile(_ratio, 0.5)").alias("_ratio"))
    stable = (F.col("_rate") <= STABLE_RATE) & (F.col("_ratio").isNull() | (F.col("_ratio") <= STABLE_RATIO))
    unstable = (F.col("_rate") >= UNSTABLE_RATE) | F.coalesce(F.col("_ratio") >= UNSTABLE_RATIO, F.lit(False))
    mode = F.when(F.col("samples") == 0, "default").when(stable, "stable_relax").when(unstable, "unstable_tighten").otherwise("default")

    def pick(base, relaxed, tightened, limits):
        value = F.when(F.col("mode") == "stable_relax", relaxed).when(F.col("mode") == "unstable_tighten", tightened).otherwise(base)
        return F.when(F.col("samples") == 0, base).otherwise(clamp(value, *limits))

    return rates.withColumn("mode", mode).select(
        "samples", F.bround("_rate", 4).alias("alert_rate"), F.bround("_ratio", 4).alias("median_mae_ratio"), "mode",
        pick(config.RETRAIN_HOURS, round(config.RETRAIN_HOURS * 1.5), round(config.RETRAIN_HOURS * 0.6), RETRAIN_LIMITS).alias("retrain_hours"),
        pick(config.DRIFT_DAYS, config.DRIFT_DAYS + 3, config.DRIFT_DAYS - 3, DRIFT_DAY_LIMITS).alias("drift_days"),
        F.bround(pick(config.DRIFT_MULTIPLIER, config.DRIFT_MULTIPLIER + 0.05, config.DRIFT_MULTIPLIER - 0.05, MULTIPLIER_LIMITS), 4).alias("drift_multiplier"),
        pick(config.DRIFT_STREAK_RETRAIN, config.DRIFT_STREAK_RETRAIN + 1, config.DRIFT_STREAK_RETRAIN - 1, STREAK_LIMITS).alias("retrain_streak"),
    )
