"""Picks, as-of flows, conflicts and dividends on rows made by hand."""

import datetime as dt

from tickloom import catalog  # noqa: F401  registers the relations
from tickloom.plans.core import RELATIONS

DAY = dt.date(2024, 1, 2)


def test_leaderboard_pick_returns_every_pick_of_each_day(spark):
    rows = [(f"{600000 + i}", DAY + dt.timedelta(days=i % 3), 16.0 + i, 5.0, 2) for i in range(120)]
    edge = [("601001", DAY, 20.0, 12.5, 3), ("601002", DAY, 20.0, None, 2)]
    fail = [("601003", DAY, 900.0, 5.0, 1), ("601004", DAY, 900.0, 12.6, 2), ("601005", DAY, 15.0, 5.0, 2), ("601006", DAY, None, 5.0, 2)]
    df = spark.createDataFrame(rows + edge + fail, "code string, d date, net_buy_ratio double, turnover_rate double, height int")
    board = df.selectExpr("code", "d AS list_date", "'b' AS reason", "net_buy_ratio", "turnover_rate", "1e8 AS market_turnover")
    later = board.selectExpr("code", "list_date", "'c' AS reason", "900.0 AS net_buy_ratio", "5.0 AS turnover_rate", "market_turnover")  # not the first row of its code and day
    got = RELATIONS["leaderboard_pick"](leaderboard=board.union(later), limit_streaks=df.select("code", "d", "height"))
    assert sorted(r.code for r in got.collect()) == sorted(r[0] for r in rows + edge)


def test_flow_as_of_takes_the_nearest_flow(spark):
    flow = spark.createDataFrame([("600001", DAY, 2.0), ("600001", DAY + dt.timedelta(days=1), 7.0)], "code string, d date, main_net double")
    events = spark.createDataFrame([("600001", DAY + dt.timedelta(days=k)) for k in (-1, 0, 1, 5)], "code string, ex_date date")
    got = {(r.d - DAY).days: r.flow for r in RELATIONS["flow_as_of"](fund_flow=flow, actions_sparse=events).collect()}
    assert got == {-1: None, 0: 2.0, 1: 7.0, 5: 7.0}


def test_action_conflicts_looks_at_all_rows(spark):
    rows = [(1, 1, 0.01), (2, 1, 0.09), (13, 2, 0.01), (3, 2, 0.02), (4, 3, 0.06)]
    items = spark.createDataFrame([(k, s, DAY, x) for k, s, x in rows], "l_orderkey long, l_suppkey long, l_shipdate date, l_discount double")
    got = {r.code: (r.n, r.cash, r.conflict) for r in RELATIONS["action_conflicts"](lineitem=items).collect()}
    assert got == {"600001": (2, 1, True), "600002": (2, 1, False), "600003": (1, 2, False)}


def test_dividend_income_has_every_holding(spark):
    day = lambda k: DAY + dt.timedelta(days=k)
    bars = spark.createDataFrame([("600001", day(k)) for k in range(60)], "code string, d date")
    events = spark.createDataFrame([("600001", day(10), 1.0, 1.1), ("600001", day(45), 2.0, 1.0)], "code string, ex_date date, cash_per_share double, share_multiplier double")
    got = {(r.buy_d - DAY).days: (r.events, round(r.cash, 4)) for r in RELATIONS["dividend_income"](bars_sparse=bars, actions_sparse=events).collect()}
    want = {}
    for k in range(20):
        first, second = k < 10 <= k + 40, k < 45 <= k + 40
        if first or second:
            want[k] = (first + second, 1.0 * first + 2.0 * second * (1.1 if first else 1))
    assert got == want
