"""All named queries: importing the modules registers their relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions import indicators, scalars  # noqa: F401
from .operators import events, factors, fronts, replay, reports, risk, signals, subscores  # noqa: F401
from .plans.core import RELATIONS, build, statement
from .sources import bars, providers  # noqa: F401
from .streaming import daily  # noqa: F401

#: Building blocks with unrounded doubles; queries over them are registered, they aren't.
INTERNAL = {"bar_steps", "bar_flows", "ind_rolling", "ind_cci", "ind_recursive", "ind_all", "signal_base", "signal_rows", "score_parts", "scores", "multifactor_score", "factor_j", "factor_values", "factor_ranks", "forward_returns", "front_pool", "front_masks", "es63", "risk_rows", "bar_steps_ret", "adjusted_rows", "topn_trades", "replay_rows", "ledger_all", "ledger_pair", "accounts", "trades_multifactor", "front_layer_1", "front_left", "bars_adjusted", "history_quality", "atom_masks_allowed", "rebalance_ranks", "pareto_trades", "leaderboard_features", "leaderboard_heights", "batch_rows", "bar_ages", "last_bars", "provider_responses", "wide_parts", "wide_scores", "score_rows", "last_scores", "macd_rows", "wide_atoms", "wide_masks", "flow_by_day", "ind_marked", "marked_parts", "marked_scores", "two_path_in_place", "checked_events", "ledger_check_in_place", "decisions_in_place"}

#: Variants of relations over other inputs (name__variant) are building blocks as well.
NAMES = [name for name in RELATIONS if name not in INTERNAL and "__" not in name]

#: Queries that run as another relation, whose rows are the same and which deals fewer.
INSTEAD = {"decisions": "decisions_in_place", "backtest_two_path": "two_path_in_place", "ledger_check": "ledger_check_in_place"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, name=name: build(spark, sf_dir, INSTEAD.get(name, name))) for name in NAMES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in NAMES if (sql := statement(name))}
