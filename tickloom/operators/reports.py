"""Population totals, curves, selections and independent checks over ledgers."""

from __future__ import annotations

from ..plans.core import Relation, q, variant
from . import replay  # noqa: F401  whose ledgers are varied

TRAIN_END = "DATE '2023-03-31'"
#: Net asset value of all accounts by session: what each close changed, summed by session and then over sessions, so a
#: missing bar carries the last value without a row for it.
Relation(
    "nav_curve",
    f"""WITH c AS (SELECT code, d, nav - coalesce(lag(nav) OVER (PARTITION BY code ORDER BY d), 1000000) AS moved FROM {{ledger_trend}} WHERE kind = 'close'), s AS (SELECT d, sum(moved) AS moved FROM c GROUP BY d), n AS (SELECT count(DISTINCT code) AS accounts FROM c)
SELECT k.d, accounts, {q('accounts * 1000000.0 + sum(coalesce(moved, 0)) OVER (ORDER BY k.d)', 2)} AS nav FROM {{calendar}} k JOIN n ON accounts >= 0 LEFT JOIN s ON s.d = k.d""",
)
Relation(
    "accounts",
    """SELECT version, vol_target, code, max_by(nav, d) AS nav, max_by(cash, @pair(d, seq)) AS cash, max_by(shares, @pair(d, seq)) AS shares, sum(coalesce(fee, 0)) AS fees, sum(CASE WHEN kind = 'action' THEN gross ELSE 0 END) AS dividends,
  count_if(kind = 'build') AS builds, count_if(kind = 'add') AS adds, count_if(kind = 'reduce') AS reduces, count_if(kind = 'exit') AS exits, count_if(kind = 'unfilled') AS unfilled, max_by(CASE WHEN d <= """ + TRAIN_END + """ THEN nav END, CASE WHEN d <= """ + TRAIN_END + """ AND kind = 'close' THEN d END) AS train_nav
FROM {ledger_all} GROUP BY version, vol_target, code""",
)
#: Accounts of the versions that a report reads, so that no other is walked.
_RISK, _PAIR = variant("accounts", "risk", {"ledger_all": "ledger_risk"}), variant("accounts", "pair", {"ledger_all": "ledger_pair"})
Relation("totals", f"SELECT version, vol_target, count(*) AS accounts, {q('sum(nav)', 2)} AS nav, {q('sum(nav) / count(*) / 1000000 - 1', 6)} AS ret, {q('sum(fees)', 2)} AS fees, {q('sum(dividends)', 2)} AS dividends, sum(builds) AS builds, sum(adds) AS adds, sum(reduces) AS reduces, sum(exits) AS exits, sum(unfilled) AS unfilled, count_if(shares > 0) AS residual FROM {{accounts}} GROUP BY version, vol_target")
#: The volatility target with most profit up to the end of training; of equals the lower.
Relation("selected_trial", f"SELECT vol_target, {q('sum(train_nav - 1000000)', 2)} AS train_profit FROM {{{_RISK}}} WHERE version = 'risk' GROUP BY vol_target ORDER BY 2 DESC, 1 LIMIT 1")
Relation("annual", f"WITH y AS (SELECT version, vol_target, code, year(d) AS y, max_by(nav, CASE WHEN kind = 'close' THEN d END) AS nav FROM {{ledger_all}} GROUP BY version, vol_target, code, year(d)), s AS (SELECT version, vol_target, y, sum(nav) AS nav, count(*) AS n FROM y GROUP BY version, vol_target, y) SELECT version, vol_target, y, {q('nav - coalesce(lag(nav) OVER (PARTITION BY version, vol_target ORDER BY y), n * 1000000.0)', 2)} AS profit FROM s")
#: Every event once more from the one before it, with bars, actions and the calendar: balances, prices with slippage, fees
#: at the rates of the day, lots, shares that may be sold (none bought today), signals before fills, no buying at the end.
_FEE = "greatest(5, gross * 0.0003) + CASE WHEN kind IN ('build', 'add') THEN 0 WHEN d >= DATE '2023-08-28' THEN gross * 0.0005 ELSE gross * 0.001 END + CASE WHEN d >= DATE '2022-04-29' THEN gross * 0.00001 ELSE gross * 0.00002 END"
_FAULTS = {
    "bad_action": "kind = 'action' AND NOT (seq = 0 AND price IS NULL AND fee IS NULL AND cps IS NOT NULL AND abs(gross - held * cps) <= 0.02 AND abs(quantity - held * (mult - 1)) <= 0.0001 AND abs(cash - had - gross) <= 0.02 AND abs(shares - held * mult) <= 0.0001)",
    "bad_price": "fills AND NOT coalesce(abs(price - raw * CASE WHEN buys THEN 1.0005 ELSE 0.9995 END) <= 0.000001 AND abs(gross - quantity * price) <= 0.02, false)",
    "bad_fee": f"fills AND NOT coalesce(abs(fee - ({_FEE})) <= 0.02, false)",
    "bad_balance": "(fills AND NOT (abs(cash - (had + CASE WHEN buys THEN -gross - fee ELSE gross - fee END)) <= 0.02 AND abs(shares - (held + CASE WHEN buys THEN quantity ELSE -quantity END)) <= 0.0001)) OR (kind IN ('unfilled', 'close') AND NOT (abs(cash - had) <= 0.02 AND abs(shares - held) <= 0.0001 AND gross IS NULL AND fee IS NULL))",
    "bad_lot": "fills AND (buys OR target <> 0) AND abs(quantity - floor(quantity / 100 + 0.5) * 100) > 0.0001",
    "sold_too_soon": "fills AND NOT buys AND quantity > held - bought + 0.0001",
    "bad_kind": "fills AND kind <> CASE WHEN buys AND held = 0 THEN 'build' WHEN buys THEN 'add' WHEN shares <= 0.0001 THEN 'exit' ELSE 'reduce' END",
    "bad_signal": "kind NOT IN ('action', 'close') AND NOT coalesce(CASE WHEN signal_d IS NULL THEN target = 0 AND ci > last_ci - 5 ELSE signal_ci < ci AND (target = 0 OR ci = signal_ci + 1) END AND target BETWEEN 0 AND 1, false)",
    "bought_at_the_end": "fills AND buys AND ci > last_ci - 5",
    "bad_nav": "kind = 'close' AND NOT coalesce(abs(cash + shares * price - nav) <= 0.02 AND abs(price - bar_close) <= 0.000001, false)",
    "overdrawn": "cash < -0.02 OR shares < -0.0001",
}
_COUNTS = f"""e AS (SELECT version, vol_target, count(*) AS events, count_if(kind = 'action') AS actions, count(DISTINCT code) AS accounts, {", ".join(f"count_if({c}) AS {n}" for n, c in _FAULTS.items())} FROM x GROUP BY version, vol_target), w AS (SELECT count(*) AS due FROM {{actions}} a JOIN {{bars}} b ON b.code = a.code AND b.d = a.ex_date)
SELECT e.*, due - actions AS missing_actions FROM e JOIN w ON due >= 0"""
Relation(
    "ledger_check",
    f"""WITH x AS (SELECT l.*, k.ci, s.ci AS signal_ci, m.last_ci, b.open, b.close AS bar_close, a.cash_per_share AS cps, a.share_multiplier AS mult, kind IN ('build', 'add', 'reduce', 'exit') AS fills, kind IN ('build', 'add') AS buys, CASE WHEN reason = 'deadline close' THEN b.close ELSE b.open END AS raw,
  coalesce(lag(l.cash) OVER (PARTITION BY version, vol_target, l.code ORDER BY l.d, seq), 1000000) AS had, coalesce(lag(l.shares) OVER (PARTITION BY version, vol_target, l.code ORDER BY l.d, seq), 0) AS held, coalesce(sum(CASE WHEN kind IN ('build', 'add') THEN quantity END) OVER (PARTITION BY version, vol_target, l.code, l.d ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bought
  FROM {{ledger_all}} l LEFT JOIN {{calendar}} k ON k.d = l.d LEFT JOIN {{calendar}} s ON s.d = l.signal_d JOIN (SELECT max(ci) AS last_ci FROM {{calendar}}) m ON last_ci >= 0 LEFT JOIN {{bars}} b ON b.code = l.code AND b.d = l.d LEFT JOIN {{actions}} a ON a.code = l.code AND a.ex_date = l.d),
{_COUNTS}""",
)
#: The same over events that come from their walk with the bar, the action and the events before; what holds for a whole
#: day of the calendar is joined by broadcast.
Relation(
    "ledger_check_in_place",
    f"""WITH x AS (SELECT /*+ BROADCAST(k, s, m) */ l.*, k.ci, s.ci AS signal_ci, m.last_ci, kind IN ('build', 'add', 'reduce', 'exit') AS fills, kind IN ('build', 'add') AS buys, CASE WHEN reason = 'deadline close' THEN bar_close ELSE open END AS raw
  FROM {{checked_events}} l LEFT JOIN {{calendar}} k ON k.d = l.d LEFT JOIN {{calendar}} s ON s.d = l.signal_d JOIN (SELECT max(ci) AS last_ci FROM {{calendar}}) m ON last_ci >= 0),
{_COUNTS}""",
)
#: Fills for a chart: the position of their bar among the security's, prices and signals checked; other events have no mark.
Relation(
    "chart_marks",
    f"""WITH p AS (SELECT code, d, CAST(row_number() OVER (PARTITION BY code ORDER BY d) - 1 AS INT) AS position FROM {{bars}})
SELECT l.code, kind, l.d, position, {q('price')} AS price, quantity > 0 AND price > 0 AND coalesce(signal_d < l.d, true) AS valid FROM {{ledger_trend}} l JOIN p ON p.code = l.code AND p.d = l.d WHERE kind IN ('build', 'add', 'reduce', 'exit')""",
)
HEAT_COLUMNS, LINE_POINTS = 240, 800
#: Bars for a heat map: both ends and as evenly spaced others as whole positions allow; for a line, every step-th bar.
Relation(
    "chart_days",
    f"""WITH p AS (SELECT code, d, CAST(row_number() OVER (PARTITION BY code ORDER BY d) - 1 AS BIGINT) AS i, count(*) OVER (PARTITION BY code) AS n FROM {{bars}}), m AS (SELECT *, least(n, {HEAT_COLUMNS}) AS m, greatest(1, CAST(floor(n / {LINE_POINTS}.0) AS BIGINT)) AS step FROM p),
c AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE CAST(ceil(i * (m - 1) / CAST(n - 1 AS DOUBLE) - 1e-9) AS BIGINT) END AS column FROM m)
SELECT code, d, i AS position, n <= 1 OR m >= n OR CAST(floor(column * (n - 1) / CAST(m - 1 AS DOUBLE) + 1e-9) AS BIGINT) = i AS on_map, i % step = 0 AS on_line FROM c""",
    oracle=f"""WITH l AS (SELECT code, list(d ORDER BY d) AS x FROM {{bars}} GROUP BY code), g AS (SELECT code, x, len(x) AS n, least(len(x), {HEAT_COLUMNS}) AS m FROM l), s AS (SELECT code, list_distinct(list_transform(range(m), lambda k: ((k * (n - 1)) // greatest(m - 1, 1))::BIGINT)) AS chosen, x, n FROM g)
SELECT code, x[i + 1] AS d, i::BIGINT AS position, list_contains(chosen, i) AS on_map, i % greatest(1, n // {LINE_POINTS}) = 0 AS on_line FROM (SELECT *, unnest(range(n)) AS i FROM s) y""",
)
#: Accounts of one version that another lacks, both ways: must be empty.
Relation("population_gaps", f"(SELECT code FROM {{{_PAIR}}} WHERE version = 'trend' EXCEPT SELECT code FROM {{{_PAIR}}} WHERE version = 'benchmark') UNION ALL (SELECT code FROM {{{_PAIR}}} WHERE version = 'benchmark' EXCEPT SELECT code FROM {{{_PAIR}}} WHERE version = 'trend')")
Relation("paired_versions", f"SELECT a.code, {q('a.nav', 2)} AS trend, {q('b.nav', 2)} AS benchmark, {q('a.nav - b.nav', 2)} AS difference FROM {{{_PAIR}}} a JOIN {{{_PAIR}}} b ON a.code = b.code WHERE a.version = 'trend' AND b.version = 'benchmark'")
