"""Queries against the same definition in an independent engine, at the smallest scale."""

import duckdb
import pytest

import compare
from tickloom import catalog

NAMES = [
    "bars", "bar_upsert_replace", "universe", "volume_unit", "action_sources", "run_progress", "ind_window_all", "ind_recursive_q", "ind_cci_q", "institution_proxy", "consensus", "contrarian", "comprehensive_score", "rule_breakdown", "multifactor_prediction", "macd_prediction",
    "regime", "zero_cycles", "factors", "composite", "risk_statistics", "decisions", "trades_with_dividends", "composed_actions", "adjusted_prices", "limit_streaks", "flow_buckets", "flow_buckets_legacy", "flow_groups", "flow_groups_legacy", "flow_as_of", "rank_ic", "category_returns", "versus_peers",
    "topn_periods", "value_screen", "backtest_multifactor", "events_daily",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    compare.tables(c, sf)
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, sf, name):
    a, b = compare.canon(catalog.queries()[name](spark, sf).toPandas()), compare.canon(con.sql(catalog.oracle_sql()[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b) and a.equals(b)


def test_registry_has_sql_for_all_but_stateful_queries():
    """What has no SQL walks trades or accounts bar by bar; plain versions of those are in test_kernels and test_rules."""
    stateful = {"patterns", "backtest_comprehensive", "backtest_macd_legacy", "backtest_two_path", "ledger_risk", "ledger_trend", "ledger_benchmark", "sub_scores"}
    over_them = {"backtest_comprehensive_summary", "backtest_macd_legacy_summary", "category_summary", "batch_leaders", "nav_curve", "totals", "selected_trial", "annual", "ledger_check", "population_gaps", "paired_versions", "chart_marks"}
    assert set(catalog.queries()) - set(catalog.oracle_sql()) <= stateful | over_them
