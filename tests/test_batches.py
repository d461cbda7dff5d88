"""Work done for all units and folds at once equals the work for each alone."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crowdtide.operators import row_weights
from crowdtide.plans import feature_table as ft
from crowdtide.plans import training
from crowdtide.session import cut_lineage

START = dt.datetime(2024, 1, 1)
NAMES = ("a", "b", "unknown")
PARAMS = training.TreeParams(rounds=2, depth=2, bins=16)


@pytest.fixture(scope="module")
def sets(spark):
    """Two units of different sizes; the second has gaps, and nobody knows one feature."""
    rows = []
    for key, n in (("0__all", 700), ("1__all", 460)):
        for i in range(n):
            at = START + dt.timedelta(hours=i // 2)
            rows.append((key, i % 2, at, None if key[0] == "1" and i % 5 == 0 else float(i * 7 % 101), (i % 13) / 13.0, None, (i * 31 % 97) / 97.0, 1.0 + i % 3))
    made = spark.createDataFrame(rows, "model_key STRING, location_id BIGINT, bucket_ts TIMESTAMP_NTZ, a DOUBLE, b DOUBLE, unknown DOUBLE, label DOUBLE, sample_weight DOUBLE")
    wide = made.withColumns({f: F.when(F.lit(i < 60), F.col(NAMES[i % 2])) for i, f in enumerate(ft.FEATURES)})
    return cut_lineage(wide.drop(*NAMES), by=["model_key"])


def same(got, wanted):
    assert got.columns == wanted.columns and got.count() > 0
    return got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()


def alone(sets, key):
    return sets.filter(F.col("model_key") == key)


def test_splits_and_folds_of_all_units_are_those_of_each(sets):
    split, folds = row_weights.time_split(sets, "bucket_ts", ["model_key"]), row_weights.cv_folds(sets, "bucket_ts", 3, ["model_key"])
    for key in ("0__all", "1__all"):
        wanted = row_weights.time_split(alone(sets, key), "bucket_ts")
        assert same(alone(split, key).select(wanted.columns), wanted)
        wanted = row_weights.cv_folds(alone(sets, key), "bucket_ts", 3)
        assert same(alone(folds, key).select(wanted.columns), wanted)


def test_prepared_units_equal_units_prepared_alone(sets):
    found = training.split_units(sets)
    assert found.keys() == {"0__all", "1__all"}
    for key, split in found.items():
        wanted = training.split_rows(alone(sets, key))
        assert split.limits == wanted.limits and len(wanted.limits) == len(ft.FEATURES)
        assert same(split.ready.select(wanted.ready.columns), wanted.ready)


def test_a_fold_is_filled_by_its_own_limits(sets):
    """The one table of all units and folds equals each fold filled and clipped by its collected limits."""
    made = training.fold_table(sets, 2, ["model_key"])
    for key in ("0__all", "1__all"):
        for i in (1, 2):
            fold = row_weights.cv_folds(alone(sets, key), "bucket_ts", 2).filter(F.col("fold") == i)
            wanted = ft.apply_limits(fold, ft.collect_limits(fold.filter("fold_part = 'train'")))
            assert same(alone(made, key).filter(F.col("fold") == i).select(wanted.columns), wanted)


def test_block_reasons_of_all_units_are_those_of_each(sets):
    found = training.training_block_reasons(sets, {"0__all": 2, "1__all": 200, "2__all": 1})
    assert found == {k: training.training_block_reason(alone(sets, k), n) for k, n in (("0__all", 2), ("1__all", 200))}
    assert len(set(found.values())) == 2


def test_units_share_their_preparation(sets, monkeypatch):
    """Limits are worked out once for all splits and once for all folds, however many units there are."""
    calls, limits = [], training.feature_limits
    monkeypatch.setattr(training, "feature_limits", lambda rows, **k: calls.append(k["keys"]) or limits(rows, **k))
    training.split_units(sets)
    training.fold_table(sets, 2, ["model_key"])
    assert calls == [["model_key"], ["model_key", "fold"]]


def test_trees_of_shared_vectors_are_those_of_the_whole_pipeline(sets):
    part = cut_lineage(training.split_rows(alone(sets, "0__all")).ready).coalesce(1)
    whole = training.fit_trees(part, PARAMS)
    keyed = training._with_key(part)
    vectors = cut_lineage(training.Pipeline(stages=training.vector_stages()).fit(keyed).transform(keyed).select("label", "sample_weight", "vector"))
    shared = training.boosted_trees(PARAMS).fit(vectors)
    assert shared.toDebugString.split("\n")[1:] == whole.stages[-1].toDebugString.split("\n")[1:]
