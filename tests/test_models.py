"""Models: shapes, bounds, storage and monotone facts, never exact predictions."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from crowdtide.catalog import base, models as catalog
from crowdtide.operators import row_weights
from crowdtide.plans import feature_table as ft
from crowdtide.plans import scoring, training
from crowdtide.session import cut_lineage
from crowdtide.sources import dimensions, model_store
from crowdtide.sources.schedule import read_schedule_document

FOLDER = "/root/testdata/sf0.001"
PARAMS = training.TreeParams(rounds=2, depth=2, bins=16)


@pytest.fixture(scope="module")
def rows(spark):
    features = cut_lineage(catalog.features(spark, FOLDER))
    grid = base.ratio(spark, FOLDER)
    counts = grid.groupBy("location_id").agg(F.count("*").alias("samples"))
    return cut_lineage(training.training_set(features, grid, row_weights.location_balance_weights(counts), 12))


@pytest.fixture(scope="module")
def model(spark, rows):
    limits = ft.collect_limits(rows)
    fitted = training.fit_trees(ft.apply_limits(rows, limits), PARAMS)
    places = sorted(r[0] for r in rows.select("location_id").distinct().collect())
    return training.TrainedModel("unit", fitted, limits, PARAMS.rounds, places, {"val_mae": 0.3})


def test_weights_average_one(rows):
    assert abs(rows.agg(F.avg("sample_weight")).first()[0] - 1.0) < 1e-6


def test_features_are_complete(rows):
    assert len(ft.FEATURES) == 119 and set(ft.FEATURES) <= set(rows.columns)


def test_intervals_are_ordered(spark, rows, model):
    scored = training.scored_columns(training.predict(model.pipeline, ft.apply_limits(rows, model.limits)), "unit")
    profile = cut_lineage(training.segments.residual_interval_profile(scored, ["model_key"]))
    out = scoring.score(rows.select("location_id", "bucket_ts", *ft.FEATURES), model, profile)
    assert out.count() == rows.count()
    assert out.filter("p10 > p90 OR p50 < 0 OR p50 > 1.2 OR p10 < 0 OR p90 > 1.2").count() == 0


def test_store_keeps_versions(spark, model, tmp_path):
    root, when = str(tmp_path), dt.datetime(2024, 1, 1)
    assert model_store.load_model(spark, root, "unit", locations=model.locations) == (None, "missing")
    assert [model_store.save_model(spark, root, model, when) for _ in range(2)] == [1, 2]
    loaded, reason = model_store.load_model(spark, root, "unit", locations=model.locations)
    assert reason is None and loaded.limits.keys() == model.limits.keys()
    assert model_store.load_model(spark, root, "unit", locations=[1])[1] == "locations"
    assert model_store.load_model(spark, root, "unit", locations=model.locations, feature_count=3)[1] == "feature_count"
    assert model_store.rollback(spark, root, "unit") == 1 and model_store.rollback(spark, root, "unit") is None


def test_recursion_without_gaps_equals_plain_trees(spark, rows, model):
    """The first target of each location has no guess before it, so trees agree."""
    start = F.lit("2024-01-20").cast("timestamp_ntz")
    grid = cut_lineage(base.ratio(spark, FOLDER))
    known = grid.filter(F.col("bucket_ts") < start)
    ahead = rows.filter(F.col("bucket_ts") >= start).select("location_id", "bucket_ts", *ft.FEATURES)
    firsts = ahead.groupBy("location_id").agg(F.min("bucket_ts").alias("bucket_ts"))
    weeks = ft.profile_arrays(catalog.seasonal_profiles(grid))
    recursive = scoring.recursive_score(ahead, known, weeks, model, grid=60).join(firsts, ["location_id", "bucket_ts"])
    plain = training.predict(model.pipeline, ft.apply_limits(ahead.join(firsts, ["location_id", "bucket_ts"]), model.limits))
    a = {r.location_id: r.p50 for r in recursive.collect()}
    b = {r.location_id: min(max(r.p50, 0.0), 1.2) for r in plain.collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_registered_models_leave_no_facility_out(spark, monkeypatch):
    """Every grid step is scored, and every location gets the whole week after the last step."""
    asked, train = [], training.train_p50
    monkeypatch.setattr(training, "train_p50", lambda sets, key, params: asked.append((key, params)) or train(sets, key, PARAMS))
    built = catalog.facility_models(spark, FOLDER)
    assert asked == [("0__all", training.TreeParams()), ("1__all", training.TreeParams())]
    monkeypatch.setattr(catalog, "facility_models", lambda *_: built)
    grid = built[1]
    scored = catalog.train_and_score(spark, FOLDER)
    assert scored.count() == grid.count() and scored.select("location_id", "ts").exceptAll(grid.select("location_id", "bucket_ts")).isEmpty()
    ahead = catalog.recursive(spark, FOLDER).groupBy("location_id").agg(F.count("*").alias("n"), F.min("bucket_ts").alias("first"), F.countDistinct(F.to_date("bucket_ts")).alias("days")).collect()
    assert {r.location_id for r in ahead} == {r[0] for r in grid.select("location_id").distinct().collect()}
    last = grid.agg(F.max("bucket_ts")).first()[0]
    assert len({r.n for r in ahead}) == 1 and all(r.days == 7 and r.first > last for r in ahead)


def test_ablation_ranks_by_loss(rows, model):
    ranked = training.feature_ablation(model, rows).collect()
    assert {r.feature_group for r in ranked} == {"time_calendar", "lags_trends_sensor", "weather", "onehot_location"}
    assert [r.delta_mae for r in ranked] == sorted((r.delta_mae for r in ranked), reverse=True)


def test_ablation_in_one_pass_equals_variant_by_variant(rows, model):
    got = {r.feature_group: r.mae for r in training.feature_ablation(model, rows).collect()}
    for group in ("weather", "onehot_location"):
        if group == "onehot_location":
            variant = rows.withColumn("location_id", F.lit(-1).cast("bigint"))
        else:
            variant = rows.withColumns({n: F.lit(None).cast("double") for n in ft.FEATURE_GROUPS[group]})
        alone = training.predict(model.pipeline, ft.apply_limits(variant, model.limits))
        mae = alone.agg(training.weighted_mean(F.abs(F.col("p50") - F.col("label")), F.col("sample_weight")).alias("mae")).first().mae
        assert abs(mae - got[group]) < 1e-9


def test_tuning_candidates():
    found = training.tuning_candidates()
    assert len(found) == 16 == len(set(found)) and found == training.tuning_candidates()


def test_documents(spark, tmp_path):
    schedule = {"facilities": [
        {"facilityId": 5, "status": "ok", "sections": [{"title": "Hours", "rows": [{"label": "Daily", "hours": "6am - 9pm"}]}, {"title": "Note", "note": "n", "rows": []}]},
        {"facilityId": 6, "status": "error", "sections": [{"title": "x", "rows": []}]},
    ]}
    (tmp_path / "s.json").write_text(json.dumps(schedule))
    got = read_schedule_document(spark, str(tmp_path / "s.json")).orderBy("section_idx").collect()
    assert [(r.facility_id, r.section_idx, r.row_idx, r.label) for r in got] == [(5, 0, 0, "Daily"), (5, 1, None, None)]
    sections = {"facilities": {"5": {"shortName": " ", "facilityName": "Hall", "sections": [{"key": "A  b", "ids": [1, "2", "x"]}, {"key": "c", "ids": [2, 3]}]}}}
    (tmp_path / "d.json").write_text(json.dumps(sections))
    rows = {(r.section_key, r.location_id) for r in dimensions.read_section_dimension(spark, str(tmp_path / "d.json")).collect()}
    assert rows == {("a b", 1), ("a b", 2), ("c", 2), ("c", 3), ("overall", 1), ("overall", 2), ("overall", 3)}
    assert dimensions.location_dimension(spark).count() == 27 and dimensions.section_dimension(spark).filter("section_key = 'overall'").count() == 26
