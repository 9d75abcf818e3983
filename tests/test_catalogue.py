"""Registered queries against their SQL. All of them with BARLOOM_ALL=1."""

import os

import pytest
from compare import compare, connect

from barloom.catalogue import ENTRIES

SF = os.environ.get("BARLOOM_SF_DIR", "/root/testdata/sf0.001")
QUICK = [
    "tick_bars_1h", "daily_order_bars", "resample_with_quotes", "price_features", "range_features",
    "forward_targets", "information_coefficient", "fold_plan_defaults", "allowed_timeframes",
    "row_removal_reasons", "normalize_bars", "validation_issues", "tick_removal_reasons",
    "top_of_book", "depth_within_levels", "sweep_fills", "execution_reports", "field_profile",
    "parse_columns", "file_names", "preset_range", "metric_bands",
]
NAMES = list(ENTRIES) if os.environ.get("BARLOOM_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    ok, note = compare(spark, con, *ENTRIES[name], SF)
    assert ok, note


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 5
