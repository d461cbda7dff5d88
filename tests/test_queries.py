"""Every registered query with SQL gives the same rows as DuckDB at the smallest scale."""

import pytest

from crowdtide.catalog import load
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = load()
# The hourly grid of these needs more events than the smallest scale has.
DENSER = "/root/testdata/sf0.01"
NEED_DENSER = (
    "infer_step_minutes", "label_runs", "crowd_bands", "windows_from_bands", "quiet_windows", "merge_adjacent_bands", "band_at_midpoint", "clip_to_open_windows",
    "contained_in_open_window", "current_band", "bridge_bands_until_stable", "compact_windows", "model_store",
)


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(SQL) - set(NEED_DENSER)))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, QUERIES[name], SQL[name], FOLDER) is None


@pytest.mark.parametrize("name", NEED_DENSER)
def test_query_of_a_dense_grid_equals_sql(spark, name):
    assert compare(spark, connect(DENSER), QUERIES[name], SQL[name], DENSER) is None


def test_entry_runs(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
