"""Streaks, event studies, as-of lookups, rebalances and the quality screen."""

from __future__ import annotations

from ..functions.scalars import MAIN_BOARD
from ..plans.core import Relation, q
from .factors import WEIGHTS, percent_rank

# ---- streaks: runs of hits found as islands between misses ------------------------------------------------------------

Relation(
    "limit_streaks",
    """WITH x AS (SELECT code, d, coalesce(close / lag(close) OVER (PARTITION BY code ORDER BY d) - 1 >= 0.095, false) AS hit FROM {bars_jumpy}),
g AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY code ORDER BY d) AS island FROM x)
SELECT code, d, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY code, island ORDER BY d) AS INT) AS height FROM g""",
)
Relation("current_streak", "SELECT code, d, height FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS age FROM {limit_streaks}) x WHERE age = 1")
Relation(
    "flow_streaks",
    """WITH g AS (SELECT code, d, main_net, sum(CASE WHEN main_net > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY code ORDER BY d) AS island FROM {fund_flow})
SELECT code, d, CAST(sum(CASE WHEN main_net > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY code, island ORDER BY d) AS INT) AS streak FROM g""",
)
# ---- studies ---------------------------------------------------------------------------------------------------------

_RANKS = "SELECT f.code, f.d, main_net, (rank() OVER (PARTITION BY f.d ORDER BY main_net) + (count(*) OVER (PARTITION BY f.d ORDER BY main_net RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0) / count(*) OVER (PARTITION BY f.d) AS r FROM {fund_flow} f"
_NEXT = "SELECT code, d, close, (close / lag(close) OVER (PARTITION BY code ORDER BY d) - 1) * 100 AS pct, lead(close) OVER (PARTITION BY code ORDER BY d) AS nc FROM {bars_jumpy}"
_BIN = "CASE WHEN r < 0.2 THEN 0 WHEN r < 0.5 THEN 1 WHEN r < 0.8 THEN 2 WHEN r < 0.95 THEN 3 ELSE 4 END"
#: The same ranks and next closes by counting and by numbered bars, for the comparison statements.
_RANKS_AGAIN = "SELECT a.code, a.d, a.main_net, (count_if(b.main_net < a.main_net) + (count_if(b.main_net = a.main_net) + 1) / 2.0) / count(*) AS r FROM {fund_flow} a JOIN {fund_flow} b ON b.d = a.d GROUP BY a.code, a.d, a.main_net"
_NEXT_AGAIN = "SELECT x.code, x.d, x.close, (x.close / y.close - 1) * 100 AS pct, z.close AS nc FROM numbered x LEFT JOIN numbered y ON y.code = x.code AND y.k = x.k - 1 LEFT JOIN numbered z ON z.code = x.code AND z.k = x.k + 1"
_NUMBERED = "numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d) AS k FROM {bars_jumpy})"


def _flow_buckets(top: str, hit: str) -> tuple[str, str]:
    """Five buckets of a day's flow ranks against a limit-up of the next bar, and the statement to compare with."""
    mine = f"WITH r AS ({_RANKS}), n AS ({_NEXT}) SELECT bin, count(*) AS n, count_if({hit}) AS hits, count_if(nc IS NULL) AS missing FROM (SELECT {_BIN} AS bin, r.r, nc, close FROM r LEFT JOIN n ON n.code = r.code AND n.d = r.d WHERE {top}) x GROUP BY bin"
    cuts = "(VALUES (0, -1.0, 0.2), (1, 0.2, 0.5), (2, 0.5, 0.8), (3, 0.8, 0.95), (4, 0.95, 1.01)) AS b(bin, lo, hi)"
    other = f"WITH {_NUMBERED}, r AS ({_RANKS_AGAIN}), n AS ({_NEXT_AGAIN}) SELECT bin, count(*) AS n, sum(CASE WHEN {hit} THEN 1 ELSE 0 END)::BIGINT AS hits, count(*) - count(nc) AS missing FROM r JOIN {cuts} ON r.r >= lo AND r.r < hi LEFT JOIN n USING (code, d) WHERE {top} GROUP BY bin"
    return mine, other


#: The day's top rank is in the last bucket; a missing next bar is counted apart and is no hit.
_sql, _oracle = _flow_buckets("true", "nc / close - 1 >= 0.095")
Relation("flow_buckets", _sql, oracle=_oracle)
#: As first published: the top rank (1.0) is in no bucket, a missing next bar counts as a miss.
_sql, _oracle = _flow_buckets("r.r < 1.0", "coalesce(nc / close - 1 >= 0.095, false)")
Relation("flow_buckets_legacy", _sql, oracle=_oracle)
#: Next-bar limit-ups by the sign of the flow, and by days of inflow in a row (groups of fewer than 100 have no rate).
Relation(
    "flow_signs",
    f"""WITH n AS ({_NEXT}), x AS (SELECT f.main_net, s.streak, coalesce(nc / close - 1 >= 0.095, false) AS hit FROM {{fund_flow}} f JOIN {{flow_streaks}} s ON s.code = f.code AND s.d = f.d LEFT JOIN n ON n.code = f.code AND n.d = f.d),
g AS (SELECT 'in' AS grp UNION ALL SELECT 'out' UNION ALL SELECT 'first day' UNION ALL SELECT 'second day' UNION ALL SELECT 'third day or later')
SELECT grp, count(*) AS n, CASE WHEN count(*) >= 100 OR grp IN ('in', 'out') THEN {q('count_if(hit) * 100.0 / count(*)')} END AS rate FROM x JOIN g ON CASE grp WHEN 'in' THEN main_net > 0 WHEN 'out' THEN main_net < 0 WHEN 'first day' THEN streak = 1 WHEN 'second day' THEN streak = 2 ELSE streak >= 3 END GROUP BY grp""",
)
#: Groups of the flow backtest, by the rank r of a day's flow (r2 among rows of group 9), the day's rise and the streak.
_GROUPS = {
    "out 5%": "r < 0.05", "in 50-80%": "r >= 0.5 AND r < 0.8", "in 80-95%": "r >= 0.8 AND r < 0.95", "in 5%": "r >= 0.95 AND TOP",
    "in 5%, up over 7%": "r >= 0.95 AND pct > 7", "in 5%, up 3-7%": "r >= 0.95 AND pct > 3 AND pct <= 7", "in 5%, up 0-3%": "r >= 0.95 AND pct > 0 AND pct <= 3", "in 5%, down": "r >= 0.95 AND pct < 0",
    "in 5%, up 3-7%, upper half": "r >= 0.95 AND pct > 3 AND pct <= 7 AND r2 >= 0.5", "three days in": "streak >= 3", "five days in": "streak >= 5",
}


def _flow_groups(name: str, top: str, ret: str) -> None:
    """Mean, wins and limit-ups of the next bar's return by group. Rows without one are dropped after the ranks are made."""
    chosen = "pct > 3 AND pct <= 7 AND r >= 0.95"
    keys = " UNION ALL ".join(f"SELECT '{g}' AS grp" for g in _GROUPS)
    match = "CASE grp " + " ".join(f"WHEN '{g}' THEN {c.replace('TOP', top)}" for g, c in _GROUPS.items()) + " END"
    islands = "y AS (SELECT x.*, sum(CASE WHEN main_net > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY code ORDER BY d) AS island FROM x)"
    second = f"CASE WHEN {chosen} THEN (rank() OVER (PARTITION BY d, {chosen} ORDER BY main_net) + (count(*) OVER (PARTITION BY d, {chosen} ORDER BY main_net RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0) / count(*) OVER (PARTITION BY d, {chosen}) END"
    tail = f"SELECT grp, count(*) AS n, {q('avg(ret)')} AS mean_next, {q('count_if(ret > 0) * 100.0 / count(*)')} AS wins, {q('count_if(ret >= 9.5) * 100.0 / count(*)')} AS limit_ups"
    mine = f"""WITH r AS ({_RANKS}), n AS ({_NEXT}), x AS (SELECT r.code, r.d, r.main_net, r.r, pct, ({ret}) * 100 AS ret FROM r JOIN n ON n.code = r.code AND n.d = r.d WHERE nc IS NOT NULL),
{islands}, z AS (SELECT y.*, sum(CASE WHEN main_net > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY code, island ORDER BY d) AS streak, {second} AS r2 FROM y), g AS ({keys})
{tail} FROM z JOIN g ON {match} GROUP BY grp"""
    other = f"""WITH {_NUMBERED}, r AS ({_RANKS_AGAIN}), n AS ({_NEXT_AGAIN}), x AS MATERIALIZED (SELECT r.*, pct, ({ret}) * 100 AS ret, row_number() OVER (PARTITION BY code ORDER BY d) AS k FROM r JOIN n USING (code, d) WHERE nc IS NOT NULL),
c AS (SELECT * FROM x WHERE {chosen}), c2 AS (SELECT a.code, a.d, (count_if(b.main_net < a.main_net) + (count_if(b.main_net = a.main_net) + 1) / 2.0) / count(*) AS r2 FROM c a JOIN c b ON b.d = a.d GROUP BY a.code, a.d),
s AS (SELECT code, d, k - coalesce(max(CASE WHEN main_net > 0 THEN NULL ELSE k END) OVER (PARTITION BY code ORDER BY k), 0) AS streak FROM x),
z AS (SELECT x.*, r2, streak FROM x JOIN s USING (code, d) LEFT JOIN c2 USING (code, d)) {" UNION ALL ".join(tail.replace("SELECT grp", f"SELECT '{g}' AS grp") + f" FROM z WHERE {c.replace('TOP', top)}" for g, c in _GROUPS.items())}"""
    Relation(name, mine, oracle=f"SELECT * FROM ({other}) z WHERE n > 0")


_flow_groups("flow_groups", "true", "nc / close - 1")
#: As first published: the top rank is not in the last bucket, and the next day's return is upside down (today over tomorrow).
_flow_groups("flow_groups_legacy", "r < 1.0", "close / nc - 1")
_SCORE = f"WITH r AS ({_RANKS}) SELECT code, d, {q('r * 10')} AS z FROM r"
Relation("flow_score", _SCORE.replace("{fund_flow}", "{flow_by_day}"), oracle=_SCORE)
#: Leaderboard rows by height of the limit-up streak (a missing streak is 0), for strong net buying, then for low turnover
#: (up to the median) as well; fewer than 30 rows have no figures.
_HEIGHTS = {
    "0": "height = 0", "1": "height = 1", "2": "height = 2", "3": "height = 3", "4 or more": "height >= 4", "0, low turnover": "low AND height = 0", "2, low turnover": "low AND height = 2",
    "3, low turnover": "low AND height = 3", "4 or more, low turnover": "low AND height >= 4", "2 or more, low turnover": "low AND height >= 2",
}
Relation("leaderboard_heights", "SELECT l.*, coalesce(s.height, 0) AS height, turnover_rate <= (SELECT @percentile(turnover_rate, 0.5) FROM {leaderboard_features}) AS low FROM {leaderboard_features} l LEFT JOIN {limit_streaks} s ON s.code = l.code AND s.d = l.d")
Relation(
    "height_study",
    "WITH g AS (" + " UNION ALL ".join(f"SELECT '{g}' AS grp" for g in _HEIGHTS) + "), x AS (SELECT * FROM {leaderboard_heights} WHERE nbr > 15) SELECT grp, count(*) AS n, "
    + ", ".join(f"CASE WHEN count(*) >= 30 THEN {q(f'avg(after_{k})', 6)} END AS mean_{k}, CASE WHEN count(*) >= 30 THEN {q(f'count_if(after_{k} > 0) * 100.0 / nullif(count(after_{k}), 0)')} END AS wins_{k}" for k in (1, 2, 5))
    + " FROM x JOIN g ON CASE grp " + " ".join(f"WHEN '{g}' THEN {c}" for g, c in _HEIGHTS.items()) + " END GROUP BY grp",
)
Relation("height_distribution", "SELECT CAST(height AS INT) AS height, count(*) AS n FROM {leaderboard_heights} WHERE height <= 5 GROUP BY 1")
#: All picks of each day, main board only: a limit-up, the second in a row or later, strong net buying, no more turnover
#: than the bound (unknown passes). Of a security's rows of a day the first counts, whatever the others say.
Relation(
    "leaderboard_pick",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY code, list_date ORDER BY reason) AS r FROM {leaderboard})
SELECT l.code, l.list_date AS d, net_buy_ratio, turnover_rate, height FROM l JOIN {limit_streaks} s ON s.code = l.code AND s.d = l.list_date
WHERE r = 1 AND net_buy_ratio > 15 AND (turnover_rate IS NULL OR turnover_rate <= 12.5) AND height >= 2 AND substr(l.code, 1, 3) IN (""" + ", ".join(f"'{p}'" for p in MAIN_BOARD) + ")",
)
Relation(
    "leaderboard_signals",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY code, list_date ORDER BY reason) AS r FROM {leaderboard})
SELECT l.code, l.list_date AS d, greatest(-50, least(50, net_buy_ratio)) AS ratio FROM l WHERE r = 1 AND market_turnover > 3e7 AND net_buy_ratio > 15 AND turnover_rate < 12.5 AND EXISTS (SELECT 1 FROM {bars_jumpy} b WHERE b.code = l.code AND b.d = l.list_date)""",
)
Relation("not_collected", "SELECT b.code, count(*) AS n FROM {bars_sparse} b WHERE NOT EXISTS (SELECT 1 FROM {leaderboard} l WHERE l.code = b.code AND l.list_date = b.d) GROUP BY b.code")
#: Backward as-of: the last flow at or before each leaderboard day, carried along a union in date order.
Relation(
    "flow_as_of",
    """WITH u AS (SELECT code, d, 0 AS is_event, main_net FROM {fund_flow} UNION ALL SELECT code, ex_date AS d, 1 AS is_event, CAST(NULL AS DOUBLE) AS main_net FROM {actions_sparse}),
g AS (SELECT *, count(main_net) OVER (PARTITION BY code ORDER BY d, is_event ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM u), v AS (SELECT code, d, is_event, max(main_net) OVER (PARTITION BY code, island) AS flow FROM g)
SELECT code, d, flow FROM v WHERE is_event = 1""",
)
# ---- rebalances ------------------------------------------------------------------------------------------------------

#: A rebalance every 20 sessions, the last such day excepted: all securities with 300 bars in all, a bar that day and a
#: price of 5. They are ranked among themselves; a missing factor ranks in the middle.
_DIMS = {"low_vol": "low_vol", "atr_amp": "atr_amp", "liq_factor": "liq_factor", "bias_health": "bias_health", "reversal": "-mom_60"}
Relation(
    "rebalance_ranks",
    "WITH p AS (SELECT f.*, -mom_60 AS reversal, k.ci, count(*) OVER (PARTITION BY f.code) AS bars FROM {factor_values} f JOIN {calendar} k ON k.d = f.d), s AS (SELECT * FROM p WHERE ci % 20 = 0 AND ci < (SELECT max(ci) - max(ci) % 20 FROM {calendar}) AND bars >= 300 AND close >= 5) SELECT code, d, ci, count(*) OVER (PARTITION BY d) AS pool, "
    + ", ".join(f"CAST(coalesce({percent_rank(n)}, 50) AS DOUBLE) AS {n}" for n in [*WEIGHTS, "reversal"]) + " FROM s",
)


def _filled(picks: str) -> str:
    """Picks bought at the next open and sold at the close 20 sessions on, at the last session if that is earlier."""
    return f"""p AS ({picks}), t AS (SELECT p.code, p.d AS signal_d, p.ci, least(p.ci + 1, m.last_ci) AS buy_ci, least(p.ci + 21, m.last_ci) AS sell_ci FROM p JOIN (SELECT max(ci) AS last_ci FROM {{calendar}}) m ON p.ci <= m.last_ci)
SELECT t.code, signal_d, t.ci, x.open AS buy, y.close AS sell, y.close * (1 - 0.0003 - 0.0005) / (x.open * (1 + 0.0003)) - 1 AS net FROM t JOIN {{calendar}} a ON a.ci = buy_ci JOIN {{calendar}} b ON b.ci = sell_ci JOIN {{bars}} x ON x.code = t.code AND x.d = a.d JOIN {{bars}} y ON y.code = t.code AND y.d = b.d WHERE x.open > 0"""


_SCORE = "(" + " + ".join(f"CAST({w} AS DOUBLE) * {n}" for n, w in WEIGHTS.items()) + f") / CAST({sum(abs(w) for w in WEIGHTS.values())!r} AS DOUBLE)"
#: The five best composite scores of the pool.
Relation("topn_trades", "WITH s AS (SELECT code, d, ci, pool, " + q(_SCORE, 9) + " AS score FROM {rebalance_ranks}), " + _filled("SELECT code, d, ci FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, code) AS place FROM s) x WHERE place <= 5 AND pool >= 5"))
_PERIODS = f"WITH r AS (SELECT signal_d, ci, sum(net) / 5 AS ret, sum(net) * 1000000 AS profit, count(*) AS filled FROM {{{{TRADES}}}} GROUP BY signal_d, ci) SELECT signal_d, filled, {q('ret', 6)} AS ret, {q('sum(profit) OVER (ORDER BY ci)', 2)} AS profit, {q('exp(sum(ln(1 + ret)) OVER (ORDER BY ci)) * 5000000', 2)} AS pool FROM r"
#: Missing fills earn nothing; a period without any is left out. One row a period.
Relation("topn_periods", _PERIODS.replace("{{TRADES}}", "{topn_trades}"))
_MORE = " AND ".join(f"b.{x} >= a.{x}" for x in _DIMS)
_ROOM = " + ".join(f"lead({x}) OVER (PARTITION BY d ORDER BY {x}, code) - lag({x}) OVER (PARTITION BY d ORDER BY {x}, code)" for x in _DIMS)
#: The same on the non-dominated set of five ranked dimensions; of more than five the least crowded (ends first, ties by code).
Relation(
    "pareto_trades",
    "WITH f AS (SELECT a.* FROM {rebalance_ranks} a WHERE pool >= 5 AND NOT EXISTS (SELECT 1 FROM {rebalance_ranks} b WHERE b.d = a.d AND " + _MORE + " AND (" + " OR ".join(f"b.{x} > a.{x}" for x in _DIMS) + ")))"
    + f", g AS (SELECT code, d, ci, {_ROOM} AS room FROM f), h AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY coalesce({q('room')}, 1e300) DESC, code) AS place FROM g), "
    + _filled("SELECT code, d, ci FROM h WHERE place <= 5"),
)
Relation("pareto_periods", _PERIODS.replace("{{TRADES}}", "{pareto_trades}"))
Relation("buy_hold", f"WITH e AS (SELECT code, min_by(close, d) AS first_c, max_by(close, d) AS last_c, min(d) AS first_d, max(d) AS last_d FROM {{bars_sparse}} GROUP BY code), v AS (SELECT code, sum(cash_per_share) AS cash FROM {{actions_sparse}} GROUP BY code) SELECT e.code, first_d, last_d, {q('(last_c / first_c - 1) * 100')} AS price_pct, {q('(last_c + coalesce(cash, 0)) / first_c * 100 - 100')} AS total_pct FROM e LEFT JOIN v ON v.code = e.code")
# ---- quality screen --------------------------------------------------------------------------------------------------

#: Annual reports, newest first, one a year; the last three decide. A value that any of them lacks makes its check unavailable.
Relation(
    "value_screen",
    """WITH u AS (SELECT *, row_number() OVER (PARTITION BY code, y ORDER BY revenue DESC) AS copy FROM {report_rows}), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY y DESC) AS k, count(*) OVER (PARTITION BY code) AS n, max(CASE WHEN financial THEN 1 ELSE 0 END) OVER (PARTITION BY code) AS fin FROM u WHERE copy = 1),
a AS (SELECT code, max(n) AS n, max(fin) AS fin, count(core_profit) AS cores, max(CASE WHEN k = 1 THEN core_profit END) AS latest, count_if(core_profit <= 0) AS losses, sum(core_profit) AS core, count(operating_cash_flow) AS flows, sum(operating_cash_flow) AS flow, count(roe) AS roes, @percentile(roe, 0.5) AS roe,
  max(CASE WHEN k = 1 THEN debt_ratio END) AS debt, max(CASE WHEN k = 1 THEN current_ratio END) AS cur, count(revenue) AS revenues, max(CASE WHEN k = 1 THEN revenue END) AS new_rev, max(CASE WHEN k = 3 THEN revenue END) AS old_rev FROM r WHERE k <= 3 GROUP BY code),
c AS (SELECT code, n, fin, CASE WHEN cores < 3 THEN 'unavailable' WHEN latest <= 0 OR losses >= 2 THEN 'fail' WHEN losses = 0 THEN 'pass' ELSE 'watch' END AS profit, CASE WHEN cores < 3 OR flows < 3 THEN 'unavailable' WHEN core > 0 AND flow / core >= 0.8 THEN 'pass' ELSE 'watch' END AS cash,
  CASE WHEN roes < 3 THEN 'unavailable' WHEN roe >= 10 THEN 'pass' WHEN roe >= 5 THEN 'watch' ELSE 'fail' END AS returns, CASE WHEN debt IS NULL THEN 'unavailable' WHEN debt > 80 AND cur < 1 THEN 'fail' WHEN debt <= 70 AND (cur IS NULL OR cur >= 1) THEN 'pass' ELSE 'watch' END AS debt,
  CASE WHEN revenues < 3 OR old_rev <= 0 THEN 'unavailable' WHEN new_rev >= old_rev THEN 'pass' ELSE 'watch' END AS sales FROM a)
SELECT code, CASE WHEN fin = 1 THEN 'not_applicable' WHEN n < 3 THEN 'insufficient' WHEN profit = 'fail' OR returns = 'fail' OR debt = 'fail' THEN 'no_go' WHEN profit = 'pass' AND cash = 'pass' AND returns = 'pass' AND debt = 'pass' THEN 'go' ELSE 'watch' END AS status,
  CASE WHEN fin = 0 AND n >= 3 THEN profit END AS profit, CASE WHEN fin = 0 AND n >= 3 THEN cash END AS cash, CASE WHEN fin = 0 AND n >= 3 THEN returns END AS returns, CASE WHEN fin = 0 AND n >= 3 THEN debt END AS debt, CASE WHEN fin = 0 AND n >= 3 THEN sales END AS sales FROM c""",
    oracle="""WITH l AS (SELECT code, list(struct_pack(c := core_profit, f := operating_cash_flow, r := roe, d := debt_ratio, q := current_ratio, s := revenue) ORDER BY y DESC) AS x, bool_or(financial) AS fin FROM {report_rows} GROUP BY code),
t AS (SELECT code, fin, len(x) AS n, x[1:3] AS x FROM l), v AS (SELECT code, fin, n, x[1] AS new, list_transform(x, lambda e: e.c) AS c, list_transform(x, lambda e: e.f) AS f, list_transform(x, lambda e: e.r) AS r, list_transform(x, lambda e: e.s) AS s FROM t),
k AS (SELECT *, CASE WHEN list_count(c) < 3 THEN 'unavailable' WHEN c[1] <= 0 OR len(list_filter(c, lambda e: e <= 0)) >= 2 THEN 'fail' WHEN list_min(c) > 0 THEN 'pass' ELSE 'watch' END AS p_, CASE WHEN list_count(c) < 3 OR list_count(f) < 3 THEN 'unavailable' WHEN list_sum(c) <= 0 THEN 'watch' WHEN list_sum(f) / list_sum(c) >= 0.8 THEN 'pass' ELSE 'watch' END AS c_,
  CASE WHEN list_count(r) < 3 THEN 'unavailable' ELSE ['fail', 'watch', 'pass'][1 + (list_sort(r)[2] >= 5)::INT + (list_sort(r)[2] >= 10)::INT] END AS r_, CASE WHEN new.d IS NULL THEN 'unavailable' WHEN new.d > 80 AND coalesce(new.q, 9) < 1 THEN 'fail' WHEN new.d <= 70 AND coalesce(new.q, 9) >= 1 THEN 'pass' ELSE 'watch' END AS d_, CASE WHEN list_count(s) < 3 OR s[3] <= 0 THEN 'unavailable' WHEN s[1] / s[3] - 1 >= 0 THEN 'pass' ELSE 'watch' END AS s_ FROM v)
SELECT code, CASE WHEN fin THEN 'not_applicable' WHEN n < 3 THEN 'insufficient' WHEN list_contains([p_, r_, d_], 'fail') THEN 'no_go' WHEN len(list_distinct([p_, c_, r_, d_])) = 1 AND p_ = 'pass' THEN 'go' ELSE 'watch' END AS status,
  CASE WHEN NOT fin AND n >= 3 THEN p_ END AS profit, CASE WHEN NOT fin AND n >= 3 THEN c_ END AS cash, CASE WHEN NOT fin AND n >= 3 THEN r_ END AS returns, CASE WHEN NOT fin AND n >= 3 THEN d_ END AS debt, CASE WHEN NOT fin AND n >= 3 THEN s_ END AS sales FROM k""",
)
