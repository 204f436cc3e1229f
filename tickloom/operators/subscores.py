"""Technical, game and fundamental sub-scores of a security at its last bar, from price and volume alone.

One row per security: the last 251 bars are aggregated by age (1 is the last bar), so a security costs one exchange.
Points and bands are fixed values of the rules; a missing indicator gives no points.
"""

from __future__ import annotations

from ..plans.core import Relation, half_even, q

_LAST = ("close", "dif", "dea", "bar", "rsi", "k", "dd", "j", "wr", "boll_u", "boll_l", "atr", "volume", "obv")
Relation(
    "bar_ages",
    "SELECT i.*, lag(volume) OVER (PARTITION BY code ORDER BY d) AS pv, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS age, count(*) OVER (PARTITION BY code) AS n FROM {ind_all} i",
)
_MEAN = lambda c, a, z: f"avg(CASE WHEN age BETWEEN {a} AND {z} THEN {c} END)"
_AT = lambda c, k: f"max(CASE WHEN age = {k} THEN {c} END)"
_COUNT = lambda cond: f"count_if({cond})"
#: What the scores need of the last bars.
Relation(
    "last_bars",
    "WITH t AS (SELECT code, @percentile(volume, 0.7) AS large FROM {bar_ages} WHERE age <= 60 GROUP BY code) SELECT b.code, max(n) AS n, max(b.d) AS d, "
    + ", ".join(f"{_AT(c, 1)} AS {c}" for c in _LAST)
    + f""", {_MEAN('close', 1, 60)} AS ma60, {_MEAN('close', 1, 20)} AS ma20, {_MEAN('close', 1, 10)} AS ma10, {_AT('dif', 6)} AS dif5, {_AT('bar', 4)} AS bar3, {_MEAN('volume', 2, 21)} AS vol20, {_MEAN('obv', 2, 21)} AS obv20_before, max(CASE WHEN age <= 60 THEN high END) AS high60, min(CASE WHEN age <= 60 THEN low END) AS low60,
  {_MEAN('obv', 1, 5)} AS obv5, {_MEAN('obv', 1, 20)} AS obv20, {_AT('close', 6)} AS c5, {_AT('obv', 6)} AS o5, {_COUNT('age <= 5 AND close > pc AND volume > pv * 1.2')} AS strong_ups, {_COUNT('age <= 5 AND close < pc AND volume > pv * 1.2')} AS strong_downs, {_COUNT('age <= 21 AND volume > large')} AS large_days,
  {_COUNT('age <= 21 AND volume > large AND close > pc')} AS large_ups, {_COUNT('age <= 5 AND close > pc')} AS ups, stddev_pop(CASE WHEN age <= 11 THEN ret END) * 100 AS moves, max(CASE WHEN age <= 250 THEN close END) AS high250, min(CASE WHEN age <= 250 THEN close END) AS low250, {_AT('close', 251)} AS c250, {_AT('close', 61)} AS c60, {_COUNT('age <= 60 AND ret > 0')} AS gains
FROM {{bar_ages}} b JOIN t ON t.code = b.code WHERE age <= 251 GROUP BY b.code""",
)
_RATIO = "(CASE WHEN vol20 > 0 THEN volume / vol20 ELSE 1 END)"
_BAND = "CASE WHEN boll_u <> boll_l THEN (close - boll_l) / (boll_u - boll_l) * 100 ELSE 50 END"
#: The parts of each score with their weights and points.
TECHNICAL = {
    "trend": (0.25, "(50 + CASE WHEN close > ma60 THEN 15 ELSE 0 END + CASE WHEN ma10 > ma20 AND ma20 > ma60 THEN 20 WHEN ma10 > ma20 THEN 10 ELSE 0 END) * 0.5 + (50 + CASE WHEN dif > dea THEN 15 ELSE 0 END + CASE WHEN dif > 0 THEN 15 ELSE 0 END + CASE WHEN dif > dif5 THEN 10 ELSE 0 END + CASE WHEN bar > 0 AND bar > bar3 THEN 10 ELSE 0 END) * 0.5"),
    "momentum": (0.20, "(50 + CASE WHEN coalesce(rsi, 50) > 70 THEN -15 WHEN rsi < 30 THEN 15 ELSE 20 END) * 0.4 + (50 + CASE WHEN k > dd THEN 20 WHEN k < dd THEN -15 ELSE 0 END + CASE WHEN j < 0 THEN 15 WHEN j > 100 THEN -15 ELSE 0 END) * 0.35 + (50 + CASE WHEN wr > 80 THEN 15 WHEN wr < 20 THEN -15 ELSE 0 END) * 0.25"),
    "volume": (0.20, f"(50 + CASE WHEN {_RATIO} > 2 THEN 10 WHEN {_RATIO} >= 1 THEN 15 WHEN {_RATIO} < 0.5 THEN -10 ELSE 0 END) * 0.4 + (50 + CASE WHEN obv > obv20_before THEN 25 ELSE -15 END) * 0.35 + (50 + CASE WHEN {_RATIO} > 1.5 THEN 10 WHEN {_RATIO} < 0.7 THEN -10 ELSE 0 END) * 0.25"),
    "channel": (0.15, f"(50 + CASE WHEN {_BAND} BETWEEN 20 AND 80 THEN 15 WHEN {_BAND} < 5 THEN 20 WHEN {_BAND} > 95 THEN -15 ELSE 0 END) * 0.6 + (50 + CASE WHEN coalesce(atr, 0) / close * 100 BETWEEN 1.5 AND 4 THEN 15 ELSE 0 END) * 0.4"),
    "shape": (0.10, "greatest(10, least(100, 50 + coalesce(points, 0))) * 0.6 + (50 + CASE WHEN n < 60 THEN 0 WHEN close > low60 + (high60 - low60) * 0.618 THEN 10 WHEN close < low60 + (high60 - low60) * 0.382 THEN -10 ELSE 0 END) * 0.4"),
    "holders": (0.10, "50 + CASE WHEN close > ma20 THEN 15 ELSE 0 END + CASE WHEN close > ma60 THEN 10 WHEN close < ma60 THEN -15 ELSE 0 END"),
}
GAME = {
    "obv": (0.30, "50 + CASE WHEN obv5 > obv20 * 1.05 THEN 20 WHEN obv5 < obv20 * 0.95 THEN -20 ELSE 0 END + CASE WHEN close > c5 AND obv < o5 THEN -25 WHEN close < c5 AND obv > o5 THEN 20 ELSE 0 END"),
    "price_volume": (0.25, "greatest(10, least(100, 50 + 5 * strong_ups - 8 * strong_downs))"),
    "flow": (0.30, "50 + CASE WHEN large_days = 0 THEN 0 WHEN large_ups > 0.6 * large_days THEN 20 WHEN large_ups > 0.5 * large_days THEN 10 WHEN large_ups < 0.4 * large_days THEN -15 ELSE 0 END + CASE WHEN ups >= 4 THEN 10 WHEN ups <= 1 THEN -10 ELSE 0 END"),
    "event": (0.15, "50 + CASE WHEN moves > 5 THEN 25 WHEN moves >= 2 THEN 15 ELSE 0 END"),
}
_PLACE = "(CASE WHEN high250 <> low250 THEN (close - low250) / (high250 - low250) * 100 ELSE 50 END)"
_YEAR, _QUARTER = "((close / coalesce(c250, close) - 1) * 100)", "((close / coalesce(c60, close) - 1) * 100)"
FUNDAMENTAL = {
    "valuation": (0.40, f"50 + CASE WHEN {_PLACE} < 20 THEN 25 WHEN {_PLACE} < 40 THEN 15 WHEN {_PLACE} > 80 THEN -20 WHEN {_PLACE} > 60 THEN -10 ELSE 0 END"),
    "growth": (0.30, f"50 + CASE WHEN n < 250 THEN 0 WHEN {_YEAR} > 30 THEN 25 WHEN {_YEAR} > 15 THEN 15 WHEN {_YEAR} > 0 THEN 5 WHEN {_YEAR} > -15 THEN -10 ELSE -20 END"),
    "quality": (0.30, f"50 + CASE WHEN {_QUARTER} > 20 THEN 25 WHEN {_QUARTER} > 10 THEN 15 WHEN {_QUARTER} > 0 THEN 5 WHEN {_QUARTER} > -10 THEN -5 ELSE -15 END + CASE WHEN gains > 35 THEN 10 ELSE 0 END"),
}
#: Shares of the three scores in the whole, and the bars from which each is known (50 before).
SCORES = {"technical": (0.30, 31, TECHNICAL), "game": (0.45, 30, GAME), "fundamental": (0.25, 60, FUNDAMENTAL)}
_PARTS = ", ".join(f"CASE WHEN n >= {least} THEN {half_even(x)} END AS {p}" for _, least, parts in SCORES.values() for p, (_, x) in parts.items())
_TOTALS = ", ".join(f"CASE WHEN n >= {least} THEN {' + '.join(f'{w} * {p}' for p, (w, _) in parts.items())} ELSE 50 END AS {name}" for name, (_, least, parts) in SCORES.items())
Relation(
    "sub_scores",
    f"""WITH p AS (SELECT code, sum(points) AS points FROM {{patterns}} GROUP BY code), x AS (SELECT l.code, l.d, n, {_PARTS} FROM {{last_bars}} l LEFT JOIN p ON p.code = l.code), y AS (SELECT x.*, {_TOTALS} FROM x)
SELECT code, d, {", ".join(p for *_, parts in SCORES.values() for p in parts)}, {", ".join(f"{q(s)} AS {s}" for s in SCORES)}, {q(" + ".join(f"{w} * {s}" for s, (w, *_) in SCORES.items()))} AS total FROM y""",
)
