"""Registered queries against their SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.01"
# one query per operator family; the rest run in the driver's correctness pass
NAMES = (
    "bars_daily", "feat_sma_bollinger", "feat_rsi_macd", "quality_by_entity", "fold_checks", "fold_scaler",
    "gate_momentum", "daily_ic", "boot_fold_ci", "backtest_daily", "backtest_subperiods", "break_even",
    "perm_sharpe", "dm_tests", "factor_regression_capm", "ece", "rank_stability_summary", "calibrate_and_report",
    "attribution_rows",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, message = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, message


def test_fold_arrays_hold_every_role(spark, con):
    ok, message = compare(spark, con, "fold_arrays", entry.queries()["fold_arrays"], entry.oracle_sql()["fold_arrays"], SF)
    assert ok, message
    rows = entry.queries()["fold_arrays"](spark, SF).groupBy("fold", "role").count().collect()
    want = entry.queries()["fold_balance"](spark, SF).filter("role <> 'embargo'").collect()
    assert {(r.fold, r.role): r["count"] for r in rows} == {(r.fold, r.role): r.n_rows for r in want}
    assert {r.role for r in rows} == {"model_train", "cal", "test"}


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 3
