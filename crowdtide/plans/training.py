"""Training one model per unit on Spark ML, and judging it."""

from __future__ import annotations

import functools
import itertools
import random
from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdtide import config
from crowdtide.functions.levels import feature_quality_weight, missing_share, occupancy_weight, sensor_weight, transition_weight
from crowdtide.operators import row_weights, segments
from crowdtide.operators.quantiles import weighted_mean, weighted_quantiles
from crowdtide.plans.feature_table import (
    FEATURE_GROUPS, FEATURES, apply_limits, apply_unit_limits, collect_limits, feature_limits, missingness_summary, sanitize_features, supervised_rows,
)
from crowdtide.plans.pool import run_all
from crowdtide.session import cut_lineage


@dataclass(frozen=True)
class TreeParams:
    rounds: int = config.BOOST_ROUNDS
    depth: int = config.BOOST_DEPTH
    eta: float = config.BOOST_ETA
    subsample: float = config.BOOST_SUBSAMPLE
    columns: float = config.BOOST_COLSAMPLE
    bins: int = config.BOOST_BINS
    min_rows: int = 1
    min_gain: float = 0.0
    seed: int = config.TUNE_SEED
    patience: int = 0           # 0: the search ends where Spark ML ends it, at the first gain below 1 %


@dataclass
class TrainedModel:
    key: str
    pipeline: PipelineModel
    limits: dict
    rounds: int
    locations: list[int]
    metrics: dict = field(default_factory=dict)


def training_set(features: DataFrame, ratio: DataFrame, balance: DataFrame, locations: int | Column = 0, keys: list[str] | None = None) -> DataFrame:
    """Features with label, row weight and sample weight.

    Row weight = sensor x feature quality x schedule transition x location balance;
    sample weight = that x recency x occupancy, stabilised.  ``locations`` is the number of
    one-hot columns.  With ``keys`` the features hold several units' rows, ``balance`` has a
    weight per unit and location, and recency and stabilising are per unit.
    """
    keys = keys or []
    labelled = features.join(ratio.select("location_id", "bucket_ts", F.col("ratio").alias("label")), ["location_id", "bucket_ts"])
    share = missing_share(list(FEATURES)) * (len(FEATURES) / (F.lit(float(len(FEATURES))) + locations))
    weighed = labelled.join(balance.select(*keys, "location_id", "balance"), [*keys, "location_id"], "left").withColumns({
        "sensor": sensor_weight(F.col("flat_steps"), F.col("missing_recent"), F.col("minutes_since_raw")),
        "quality": feature_quality_weight(share), "missing": share,
        "transition": transition_weight(F.col("phase_near_open"), F.col("phase_near_close")),
        "balance": F.coalesce("balance", F.lit(1.0)),
    }).withColumn("row_weight", F.col("sensor") * F.col("quality") * F.col("transition") * F.col("balance"))
    recent = row_weights.with_recency(sanitize_features(weighed), "bucket_ts", keys)
    raw = recent.withColumn("raw_weight", F.col("recency") * F.col("row_weight") * occupancy_weight(F.col("label")))
    usable = cut_lineage(supervised_rows(raw, "label", "raw_weight"))
    return row_weights.stabilize_weights(usable, "raw_weight", "sample_weight", keys)


def trainable_category(rows: DataFrame, column: str = "category_key") -> DataFrame:
    """Rows of the categories that get a model of their own."""
    return rows.filter(F.col(column).isin(*config.TRAINABLE_CATEGORIES))


def one_hot_location() -> list:
    """Stages that turn the location into a one-hot vector, in id order."""
    index = StringIndexer(inputCol="location_key", outputCol="location_index", stringOrderType="alphabetAsc", handleInvalid="keep")
    return [index, OneHotEncoder(inputCol="location_index", outputCol="location_onehot", dropLast=False)]


def _with_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("location_key", F.lpad(F.col("location_id").cast("string"), 12, "0"))


def boosted_trees(params: TreeParams) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="vector", labelCol="label", weightCol="sample_weight", predictionCol="p50", maxIter=params.rounds, maxDepth=params.depth,
        stepSize=params.eta, subsamplingRate=params.subsample, featureSubsetStrategy=str(params.columns), maxBins=params.bins,
        minInstancesPerNode=params.min_rows, minInfoGain=params.min_gain, seed=params.seed,
    )


def vector_stages() -> list:
    """Stages from filled features to one vector."""
    return [*one_hot_location(), VectorAssembler(inputCols=[*FEATURES, "location_onehot"], outputCol="vector")]


def fit_trees(rows: DataFrame, params: TreeParams, *, validation: str | None = None) -> PipelineModel:
    """Boosted trees on filled features; a validation flag names the rows that find the number of rounds."""
    trees = boosted_trees(params)
    if validation and params.patience:
        stages = Pipeline(stages=vector_stages()).fit(_with_key(rows))
        ready = cut_lineage(stages.transform(_with_key(rows)).select(F.col(validation).alias("held"), "label", "sample_weight", "vector"))
        fitted, held = ready.filter("NOT held"), ready.filter("held")
        errors = [] if held.isEmpty() else trees.fit(fitted).evaluateEachIteration(held, "squared")
        rounds = best_rounds(errors, params.patience) or params.rounds
        return PipelineModel([*stages.stages, boosted_trees(replace(params, rounds=rounds)).fit(fitted)])
    if validation:
        trees = trees.setValidationIndicatorCol(validation)
    return Pipeline(stages=[*vector_stages(), trees]).fit(_with_key(rows))


def best_rounds(errors: list[float], patience: int) -> int:
    """Rounds with the lowest error before ``patience`` rounds without a lower one; 0 without errors."""
    best = 0
    for rounds, error in enumerate(errors, 1):
        if best == 0 or error < errors[best - 1]:
            best = rounds
        elif rounds - best >= patience:
            break
    return best


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(_with_key(rows))
    return out.drop("vector", "location_key", "location_index", "location_onehot")


def scored_columns(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(
        F.lit(key).alias("model_key"), "location_id", F.col("bucket_ts").alias("ts"), F.col("label").alias("y_true"), "p50", F.col("sample_weight").alias("weight")
    )


@dataclass
class Split:
    """A training set split by time and filled and clipped by the limits of the rows before the holdout."""

    ready: DataFrame
    limits: dict


def split_rows(rows: DataFrame) -> Split:
    split = cut_lineage(row_weights.time_split(rows, "bucket_ts"))
    limits = collect_limits(split.filter("part <> 'holdout'"))
    return Split(cut_lineage(apply_limits(split, limits).withColumn("is_validation", F.col("part") == "validation")), limits)


def split_units(sets: DataFrame) -> dict[str, Split]:
    """``split_rows`` of every unit of a set tagged with ``model_key``, all in the same few passes."""
    key = ["model_key"]
    split = cut_lineage(row_weights.time_split(sets, "bucket_ts", key))
    limits = cut_lineage(feature_limits(split.filter("part <> 'holdout'"), keys=key))
    ready = cut_lineage(apply_unit_limits(split, limits, key).withColumn("is_validation", F.col("part") == "validation"), by=key)
    found: dict[str, dict] = {r["model_key"]: {} for r in split.select("model_key").distinct().collect()}
    for r in limits.collect():      # an entry per unit and feature
        found[r["model_key"]][r["feature"]] = (r["fill"], r["low"], r["high"])
    return {k: Split(ready.filter(F.col("model_key") == k), {f: own.get(f, (0.0, None, None)) for f in FEATURES}) for k, own in found.items()}


def train_p50(rows: DataFrame | Split, key: str, params: TreeParams) -> TrainedModel:
    """Split by time, find the number of rounds on the validation part, refit on all.

    ``rows`` is a training set, or one that is split already.  Limits come from the rows before the holdout.
    """
    split = rows if isinstance(rows, Split) else split_rows(rows)
    limits, ready = split.limits, split.ready
    before = ready.filter("part <> 'holdout'")
    searched = fit_trees(before, params, validation="is_validation")
    rounds = searched.stages[-1].getNumTrees
    validated = predict(searched, before.filter("is_validation"))
    fresh = fit_trees(before, replace(params, rounds=max(1, rounds)))
    held = predict(fresh, ready.filter("part = 'holdout'"))
    profile = cut_lineage(segments.residual_interval_profile(scored_columns(validated, key), ["model_key"]))
    metrics = evaluate(scored_columns(validated, key), profile, "val") | evaluate(scored_columns(held, key), profile, "holdout")
    final = fit_trees(ready, replace(params, rounds=max(1, rounds)))
    locations = [r[0] for r in ready.select("location_id").distinct().orderBy("location_id").collect()]  # a facility's locations
    return TrainedModel(key, final, limits, rounds, locations, metrics | {"profile": profile, "validation": cut_lineage(scored_columns(validated, key))})


def quantile_bounds(scored: DataFrame, profile: DataFrame) -> DataFrame:
    """p10 and p90 around p50 from the residual quantiles of the row's segment."""
    found = segments.segment_profile_lookup(scored, profile, ["model_key"], "interval", ["q10", "q90"], points=config.INTERVAL_MIN_POINTS)
    found = found.withColumns({
        "p10": F.least(F.lit(config.RATIO_MAX), F.greatest(F.lit(0.0), F.col("p50") + F.col("interval_q10"))),
        "p90": F.least(F.lit(config.RATIO_MAX), F.greatest(F.lit(0.0), F.col("p50") + F.col("interval_q90"))),
    }).drop("interval_q10", "interval_q90")
    return found.withColumns({"p10": F.least("p10", "p90"), "p90": F.greatest("p10", "p90")})


def evaluate(scored: DataFrame, profile: DataFrame, prefix: str) -> dict:
    """Rows, MAE, RMSE and coverage error as metadata; empty parts give no errors."""
    row = segments.recent_evaluation(quantile_bounds(scored, profile), ["model_key"]).first()
    if row is None:
        return {f"{prefix}_rows": 0, f"{prefix}_mae": None, f"{prefix}_rmse": None, f"{prefix}_coverage_err": None}
    return {f"{prefix}_rows": row["points"], f"{prefix}_mae": row["mae"], f"{prefix}_rmse": row["rmse"], f"{prefix}_coverage_err": row["coverage_err"]}


def tuning_candidates(limit: int = config.TUNE_MAX_CANDIDATES, rounds: int = config.TUNE_ROUNDS, preferred: TreeParams | None = None) -> list[TreeParams]:
    """The parameters that won last time, the default and a seeded choice of its neighbours.

    L1 and L2 penalties have no counterpart in Spark ML and are not searched.
    """
    base = TreeParams(rounds=rounds)
    grid = [
        replace(base, depth=d, eta=e, subsample=s, columns=c, min_rows=m)
        for d, e, s, c, m in itertools.product((3, 4, 5), (0.03, 0.05, 0.08), (0.8, 0.9), (0.8, 0.9), (1, 3))
    ]
    won = replace(preferred, rounds=rounds, patience=base.patience) if preferred else base
    first = [won, base] if won != base else [base]
    others = [p for p in grid if p not in first]
    random.Random(config.TUNE_SEED).shuffle(others)
    return [*first, *others][:limit]


def fold_table(rows: DataFrame, folds: int = config.TUNE_FOLDS, keys: list[str] | None = None) -> DataFrame:
    """Rows of all folds, filled and clipped by their own fold's training part, written once.

    All folds, and with ``keys`` all units, go through the same few passes.
    """
    by = [*(keys or []), "fold"]
    split = cut_lineage(row_weights.cv_folds(rows, "bucket_ts", folds, keys), by=by)
    limits = cut_lineage(feature_limits(split.filter("fold_part = 'train'"), keys=by))
    return cut_lineage(apply_unit_limits(split, limits, by), by=by)


def fold_scores(scored: DataFrame, keys: list[str]) -> DataFrame:
    """MAE + 0.2 coverage error + 0.15 mean error of the worst tenth, for every candidate and fold at once.

    ``scored`` holds fold_part, label, p50 and weight.
    """
    residual = scored.filter("fold_part = 'train'").withColumn("_r", F.col("label") - F.col("p50"))
    bounds = weighted_quantiles(residual, keys, "_r", "weight", {"q10": config.INTERVAL_LOW_Q, "q90": config.INTERVAL_HIGH_Q}).select(*keys, "q10", "q90")
    valid = scored.filter("fold_part = 'validation'").withColumn("_e", F.abs(F.col("label") - F.col("p50")))
    cut = weighted_quantiles(valid, keys, "_e", "weight", {"tail": config.TUNE_TAIL_QUANTILE}).select(*keys, "tail")
    limits = cut_lineage(bounds.join(cut, keys))        # one row per candidate and fold
    inside = F.col("label").between(F.col("p50") + F.col("q10"), F.col("p50") + F.col("q90")).cast("double")
    target = config.INTERVAL_HIGH_Q - config.INTERVAL_LOW_Q
    return valid.join(limits, keys).groupBy(*keys).agg(
        weighted_mean(F.col("_e"), F.col("weight")).alias("mae"), weighted_mean(inside, F.col("weight")).alias("coverage"),
        weighted_mean(F.when(F.col("_e") >= F.col("tail"), F.col("_e")), F.col("weight")).alias("tail_mae"),
    ).withColumn("score", F.col("mae") + config.TUNE_COVERAGE_WEIGHT * F.abs(F.col("coverage") - target) + config.TUNE_TAIL_WEIGHT * F.col("tail_mae"))


def tuning_rungs(candidates: int, rounds: int, survivors: int = config.TUNE_SURVIVORS) -> list[tuple[int, int]]:
    """(candidates, rounds) of each rung: the last one compares what is left with all rounds."""
    sizes = [candidates]
    while survivors > 1 and sizes[-1] > survivors:
        sizes.append(-(-sizes[-1] // survivors))
    return [(n, max(1, rounds // survivors ** (len(sizes) - 1 - k))) for k, n in enumerate(sizes)]


def time_series_tuning(
    rows: DataFrame, candidates: list[TreeParams], folds: int = config.TUNE_FOLDS, *, survivors: int = config.TUNE_SURVIVORS,
    workers: int = config.TRAIN_WORKERS, ready: DataFrame | None = None,
) -> tuple[TreeParams, list[tuple[TreeParams, float]]]:
    """Lowest mean fold score, by successive halving; ``survivors=1`` compares all with all rounds.

    A rung fits its candidates on every fold with part of the rounds, several fits at a time, and
    the best go on.  All fits read one written fold table, and a rung is judged in one pass over
    the predictions of all its fits.  Folds are in time order and shared by all candidates, as are a
    fold's vectors.  ``ready`` is the fold table, if there is one already.
    """
    spark = rows.sparkSession
    ready = fold_table(rows, folds) if ready is None else ready

    def vectors(fold: int):
        part = _with_key(ready.filter(F.col("fold") == fold))
        stages = Pipeline(stages=vector_stages()).fit(part.filter("fold_part = 'train'"))
        return cut_lineage(stages.transform(part).select("fold", "fold_part", "label", "sample_weight", "vector"))

    parts = run_all(spark, {i: functools.partial(vectors, i) for i in range(1, folds + 1)}, workers, "tuning")
    for found in parts.values():
        if isinstance(found, Exception):
            raise found
    alive, scores = list(range(len(candidates))), []
    for n, rounds in tuning_rungs(len(candidates), candidates[0].rounds, survivors):
        alive = alive[:n]

        def fit(c: int, fold: int, rounds: int = rounds):
            model = boosted_trees(replace(candidates[c], rounds=rounds)).fit(parts[fold].filter("fold_part = 'train'"))
            return cut_lineage(model.transform(parts[fold]).select(F.lit(c).alias("candidate"), "fold", "fold_part", "label", "p50", F.col("sample_weight").alias("weight")))

        fits = run_all(spark, {(c, i): functools.partial(fit, c, i) for c in alive for i in range(1, folds + 1)}, workers, "tuning")
        broken = {c for (c, _), found in fits.items() if isinstance(found, Exception)}
        scored = [found for (c, _), found in fits.items() if c not in broken]
        if not scored:
            raise next(iter(fits.values()))
        judged = fold_scores(functools.reduce(DataFrame.unionByName, scored), ["candidate", "fold"]).groupBy("candidate").agg(F.avg("score").alias("score"))
        penalty = {c: config.TUNE_COMPLEXITY_WEIGHT * max(0.0, (candidates[c].depth - config.BOOST_DEPTH) / config.BOOST_DEPTH) for c in alive}
        found = {r["candidate"]: r["score"] + penalty[r["candidate"]] for r in judged.collect()}     # a row per candidate
        alive = sorted(found, key=lambda c: (found[c], c))
        scores = [(candidates[c], found[c]) for c in alive]
    return candidates[alive[0]], scores


def feature_ablation(model: TrainedModel, rows: DataFrame) -> DataFrame:
    """MAE when one group of features is taken away, worst loss first.

    Missing values are replaced by the fill values, and an unknown location stands
    for a zeroed one-hot vector.  Every row becomes one row per variant, so all variants are
    filled, scored and averaged in one pass.
    """
    groups = ["baseline", "onehot_location", *FEATURE_GROUPS]
    varied = rows.withColumn("feature_group", F.explode(F.array(*[F.lit(g) for g in groups])))
    taken = {n: F.when(F.col("feature_group") != group, F.col(n)) for group, names in FEATURE_GROUPS.items() for n in names}
    taken["location_id"] = F.when(F.col("feature_group") == "onehot_location", F.lit(-1)).otherwise(F.col("location_id")).cast("bigint")
    scored = predict(model.pipeline, apply_limits(varied.withColumns(taken), model.limits))
    errors = cut_lineage(scored.groupBy("feature_group").agg(weighted_mean(F.abs(F.col("p50") - F.col("label")), F.col("sample_weight")).alias("mae")))
    base = errors.filter("feature_group = 'baseline'").select(F.col("mae").alias("_base"))
    ranked = errors.filter("feature_group <> 'baseline'").crossJoin(base)  # one row
    return ablation_ranking(ranked.select("feature_group", "mae", (F.col("mae") - F.col("_base")).alias("delta_mae")))


def ablation_ranking(errors: DataFrame) -> DataFrame:
    return errors.orderBy(F.desc("delta_mae"), "feature_group")


def training_block_reason(rows: DataFrame, locations: int) -> str | None:
    return missingness_summary(rows, locations).first()["block_reason"]


def training_block_reasons(sets: DataFrame, locations: dict[str, int]) -> dict[str, str | None]:
    """``training_block_reason`` of every unit with rows, in one pass; one row per unit."""
    known = sets.sparkSession.createDataFrame(list(locations.items()), "model_key STRING, _places INT")
    found = missingness_summary(sets.join(F.broadcast(known), "model_key"), F.col("_places"), keys=["model_key"])
    return {r["model_key"]: r["block_reason"] for r in found.collect()}


def unit_rows(sets: DataFrame) -> dict[str, int]:
    """Training rows of every unit of a set tagged with ``model_key``; one pass, one row per unit."""
    return {r["model_key"]: r["count"] for r in sets.groupBy("model_key").count().collect()}
