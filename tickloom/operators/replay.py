"""Sequential replays per security: trade lists of three signal rules, and account ledgers of dated target weights.

Each is one grouped map over rows that windows and joins have prepared; the kernel walks a code's bars in order and
holds a few scalars. Trades and ledgers are plain relations again, so totals, curves and checks are SQL on them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.core import RELATIONS, Native, Relation, q, variant
from .risk import RiskConfig, rebalance_weight
from .signals import _REGIME

# ---- trade lists -----------------------------------------------------------------------------------------------------

TRADES = "code string, buy_d date, sell_d date, buy double, sell double, profit_pct double, hold int, reason string"


def _trades(rows: DataFrame, walk: Callable[[list[dict]], list[tuple]]) -> DataFrame:
    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("d")
        code = g["code"].iloc[0]
        g = g.astype(object).where(g.notna(), None)
        return pd.DataFrame([(code, *t) for t in walk(g.to_dict("records"))], columns=["code", "buy_d", "sell_d", "buy", "sell", "profit_pct", "hold", "reason"])

    return rows.groupBy("code").applyInPandas(kernel, TRADES)


def multifactor_trades(multifactor_score: DataFrame) -> DataFrame:
    """Same-close fills: in at score 2 or more while RSI is under 75; out on weakness, loss, gain or fading gain."""

    def walk(bars: list[dict]) -> list[tuple]:
        out, held = [], None
        for b in bars:
            if held is None:
                if b["score"] >= 2 and b["rsi"] is not None and b["rsi"] < 75:
                    held = b
                continue
            gain = (b["close"] / held["close"] - 1) * 100
            why = "weak" if b["score"] <= -3 else "fading" if gain > 8 and b["score"] <= -1 else "loss" if gain < -6 else "gain" if gain > 15 else None
            if why:
                out.append((held["d"], b["d"], held["close"], b["close"], gain, b["rn"] - held["rn"], why))
                held = None
        return out

    return _trades(multifactor_score.select("code", "d", "rn", "close", "rsi", "score"), walk)


Native(
    "trades_multifactor",
    multifactor_trades,
    ["multifactor_score"],
    """SELECT code, buy_d, sell_d, buy, sell, gain AS profit_pct, CAST(hold AS INT) AS hold, reason FROM (WITH RECURSIVE s AS MATERIALIZED (SELECT code, d, rn, close, rsi, score FROM {multifactor_score}),
r AS (SELECT code, rn, d, CASE WHEN score >= 2 AND rsi < 75 THEN d END AS hd, CASE WHEN score >= 2 AND rsi < 75 THEN close END AS hc, CASE WHEN score >= 2 AND rsi < 75 THEN rn END AS hr, NULL::DATE AS buy_d, NULL::DATE AS sell_d, NULL::DOUBLE AS buy, NULL::DOUBLE AS sell, NULL::DOUBLE AS gain, NULL::BIGINT AS hold, NULL::VARCHAR AS reason FROM s WHERE rn = 31
UNION ALL SELECT code, rn, d, CASE WHEN why IS NOT NULL THEN NULL WHEN hd IS NOT NULL THEN hd WHEN score >= 2 AND rsi < 75 THEN d END, CASE WHEN why IS NOT NULL THEN NULL WHEN hd IS NOT NULL THEN hc WHEN score >= 2 AND rsi < 75 THEN close END, CASE WHEN why IS NOT NULL THEN NULL WHEN hd IS NOT NULL THEN hr WHEN score >= 2 AND rsi < 75 THEN rn END,
  CASE WHEN why IS NOT NULL THEN hd END, CASE WHEN why IS NOT NULL THEN d END, CASE WHEN why IS NOT NULL THEN hc END, CASE WHEN why IS NOT NULL THEN close END, CASE WHEN why IS NOT NULL THEN (close / hc - 1) * 100 END, CASE WHEN why IS NOT NULL THEN rn - hr END, why
  FROM (SELECT s.*, r.hd, r.hc, r.hr, CASE WHEN r.hd IS NULL THEN NULL WHEN s.score <= -3 THEN 'weak' WHEN (s.close / r.hc - 1) * 100 > 8 AND s.score <= -1 THEN 'fading' WHEN (s.close / r.hc - 1) * 100 < -6 THEN 'loss' WHEN (s.close / r.hc - 1) * 100 > 15 THEN 'gain' END AS why FROM r JOIN s ON s.code = r.code AND s.rn = r.rn + 1) x)
SELECT * FROM r WHERE reason IS NOT NULL) z""",
)
Relation("backtest_multifactor", f"SELECT code, buy_d, sell_d, buy, sell, {q('profit_pct')} AS profit_pct, hold, reason FROM {{trades_multifactor}}")


def peaks(x: list[float], reach: int, first: int, last: int, apart: int, above: int = 0) -> list[int]:
    """Indices of local maxima over +-reach; of maxima closer than ``apart`` the highest. above: bars whose mean a peak must exceed."""
    found: list[int] = []
    for i in range(first, len(x) - last):
        if x[i] < max(x[max(0, i - reach) : i + reach + 1]):
            continue
        if above:
            prior = x[max(0, i - above) : i]
            if not prior or x[i] <= sum(prior) / len(prior):
                continue
        if not found or i - found[-1] > apart:
            found.append(i)
        elif x[i] > x[found[-1]]:
            found[-1] = i
    return found


def broken_neckline(x: list[float]) -> str | None:
    """A double top or head and shoulders in the last 251 closes whose neckline the last close broke, or an engulfing bar."""
    if len(x) < 61:
        return None
    w, last = x[-251:], x[-1]
    tops = peaks(w, 15, 20, 10, 15, above=30)
    if len(tops) >= 2:
        a, b = tops[-2:]
        if abs(w[a] - w[b]) / max(w[a], w[b]) < 0.05 and b - a >= 15 and last < min(w[a : b + 1]):
            return "double top"
    if len(tops) >= 3:
        a, h, b = tops[-3:]
        if w[h] > max(w[a], w[b]) and abs(w[a] - w[b]) / max(w[a], w[b]) < 0.10 and last < min(w[a : b + 1]):
            return "head and shoulders"
    if x[-4] < x[-3] and last < x[-2] * 0.97 and last < x[-3]:
        return "engulfing"
    return None


def classic_patterns(bars: DataFrame) -> DataFrame:
    """code, pattern, points: classic price patterns at each security's last bar."""

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("d")["close"].tolist()
        out: list[tuple[str, int]] = []
        if len(x) >= 60:
            tops = peaks(x, 10, 10, 10, 20)
            if len(tops) >= 2:
                a, b = tops[-2:]
                top, neck = max(x[a], x[b]), min(x[a : b + 1])
                if abs(x[a] - x[b]) / top < 0.05 and b - a >= 20 and (top - neck) / top > 0.03:
                    out.append(("double top", -25 if x[-1] < neck else -15))
            if len(tops) >= 3:
                a, h, b = tops[-3:]
                if x[h] > max(x[a], x[b]) and abs(x[a] - x[b]) / max(x[a], x[b]) < 0.08:
                    out.append(("head and shoulders", -30 if x[-1] < min(x[a : b + 1]) else -20))
            if x[-1] > x[-2] > x[-3] > x[-4]:
                out.append(("three soldiers", 15))
            if x[-3] < x[-4] and abs(x[-2] / x[-3] - 1) < 0.02 and x[-1] > max(x[-2], x[-3]):
                out.append(("morning star", 15))
            if x[-3] < x[-2] and x[-1] < x[-2] * 0.98:
                out.append(("engulfing", -15))
        return pd.DataFrame([(g["code"].iloc[0], p, n) for p, n in out], columns=["code", "pattern", "points"]).astype({"code": object, "pattern": object, "points": "int32"})

    return bars.select("code", "d", "close").groupBy("code").applyInPandas(kernel, "code string, pattern string, points int")


Native("patterns", classic_patterns, ["bars"])

COMMISSION, STAMP = 0.0003, 0.0005


def net_return(buy: float, sell: float) -> float:
    """Per cent, after commission on both sides and stamp duty on the sale; 0 if a price isn't positive."""
    if buy <= 0 or sell <= 0:
        return 0.0
    return (sell * (1 - COMMISSION - STAMP) / (buy * (1 + COMMISSION)) - 1) * 100


def comprehensive_trades(scores: DataFrame) -> DataFrame:
    """Signals at the close, fills at the next open; a position that is open at the end isn't reported."""

    def walk(bars: list[dict]) -> list[tuple]:
        out, held, order = [], None, None
        closes: list[float] = []
        for k, b in enumerate(bars):
            closes.append(b["close"])
            if b["rn"] <= 60:
                continue
            if order == "buy":
                held, order = b, None
            elif order is not None and held is not None:
                out.append((held["d"], b["d"], held["open"], b["open"], round(net_return(held["open"], b["open"]), 2), b["rn"] - held["rn"], order))
                held = order = None
            if b["dif"] is None or k + 1 == len(bars):
                continue
            if held is None:
                order = "buy" if b["s_star"] >= 69 and b["gate"] else None
                continue
            gain, age = net_return(held["open"], b["close"]), b["rn"] - held["rn"]
            order = "loss" if gain < -12 else "gain" if gain > 15 else "score" if b["s_star"] < 35 else "fading" if gain > 12 and b["s_star"] < 50 else "divergence" if b["top"] else None
            if order is None and age > 10 and age % 5 == 0:
                order = broken_neckline(closes)
        return out

    return _trades(scores.select("code", "d", "rn", "open", "close", "dif", "s_star", "gate", "top"), walk)


Native("backtest_comprehensive", lambda score_rows: comprehensive_trades(score_rows), ["score_rows"], reads=1)


def macd_legacy_trades(macd_rows: DataFrame, regime: DataFrame, divergences_legacy: DataFrame) -> DataFrame:
    """Whole-history divergences and confirmed crossings. Looks two bars ahead: kept for comparison, feeds nothing."""
    marks = divergences_legacy.groupBy("code", "d").agg(F.max(F.when(F.col("kind") == "top", 1).otherwise(0)).alias("is_top"), F.max(F.when(F.col("kind") == "bottom", 1).otherwise(0)).alias("is_bottom"))
    rows = macd_rows.select("code", "d", "rn", "close", "dif", "dea").join(regime, ["code", "d"]).join(marks, ["code", "d"], "left")

    def walk(bars: list[dict]) -> list[tuple]:
        n = len(bars)
        marks = [(i, "sell", "top") for i, b in enumerate(bars) if b["is_top"]] + [(i, "buy", "bottom") for i, b in enumerate(bars) if b["is_bottom"]]
        last_dead = -999
        above = [b["dif"] is not None and b["dea"] is not None and b["dif"] > b["dea"] for b in bars]
        below = [b["dif"] is not None and b["dea"] is not None and b["dif"] < b["dea"] for b in bars]
        for i in range(35, n - 1):
            b = bars[i]
            if b["dea"] is None or bars[i - 1]["dea"] is None:
                continue
            if above[i] and not above[i - 1] and b["dif"] > 0 and bars[i - 3]["dif"] is not None and b["dif"] > bars[i - 3]["dif"] and i - last_dead > 25 and b["regime"] == "bull" and i + 2 < n and above[i + 1] and above[i + 2]:
                if all(abs(j - i) >= 15 for j, side, _ in marks if side == "buy"):
                    marks.append((i, "buy", "golden cross"))
            if below[i] and not below[i - 1] and b["regime"] == "bear" and all(abs(j - i) >= 10 for j, side, _ in marks if side == "sell"):
                marks.append((i, "sell", "dead cross"))
                last_dead = i
        out, held = [], None
        for i, side, why in sorted(marks, key=lambda m: m[0]):
            b = bars[i]
            if side == "buy" and held is None:
                held = b
            elif side == "sell" and held is not None:
                out.append((held["d"], b["d"], held["close"], b["close"], (b["close"] / held["close"] - 1) * 100, b["rn"] - held["rn"], why))
                held = None
        return out

    return _trades(rows, walk)


Native("backtest_macd_legacy", lambda **frames: macd_legacy_trades(frames["macd_rows"], frames[_REGIME], frames["divergences_legacy"]), ["macd_rows", _REGIME, "divergences_legacy"], reads=1)
#: Count, wins, rate and compounded return of a trade list.
for _name in ("backtest_multifactor", "backtest_comprehensive", "backtest_macd_legacy"):
    Relation(f"{_name}_summary", f"SELECT code, count(*) AS trades, count_if(profit_pct > 0) AS wins, {q('count_if(profit_pct > 0) * 100.0 / count(*)')} AS win_rate, {q('CASE WHEN min(profit_pct) <= -100 THEN -100 ELSE (exp(sum(ln(CASE WHEN profit_pct > -100 THEN 1 + profit_pct / 100 END))) - 1) * 100 END', 3)} AS total_pct FROM {{{_name}}} GROUP BY code")


class Purse:
    """Cash and shares in any amount, without costs. One order waits for the next open: a value to hold, and a direction."""

    def __init__(self, capital: float):
        self.capital, self.cash, self.shares, self.paid, self.high = capital, capital, 0.0, 0.0, 0.0
        self.waiting: tuple[float, bool] | None = None

    def fill(self, price: float) -> None:
        """Trade towards the ordered value; an order whose value the price has already passed lapses."""
        value, up = self.waiting or (0.0, True)
        self.waiting = None
        gap = value - self.shares * price
        if up and gap > 0 and self.cash > 0:
            spent = min(self.cash, gap)
            self.cash, self.shares, self.paid, self.high = self.cash - spent, self.shares + spent / price, self.paid + spent, price
        elif not up and gap < 0:
            kept = 1 + gap / (self.shares * price)
            self.cash, self.shares, self.paid = self.cash - gap, self.shares * kept, self.paid * kept
        if self.shares <= 1e-9:
            self.shares = self.paid = self.high = 0.0

    def sell(self, price: float) -> None:
        self.cash, self.shares, self.paid, self.high = self.cash + self.shares * price, 0.0, 0.0, 0.0


def _path_rows(rows: DataFrame, before: Column, mean: Column, start: str | None, *keys: str) -> DataFrame:
    """What a bar says by itself: the share its score asks for, a limit-up that didn't hold, weakness against its own mean."""
    score = F.col("s_star") + F.coalesce("z", F.lit(0.0))
    limit = F.round(before * 1.1, 2)
    return rows.select(
        "code", "d", *keys, "open", "close", F.col("dif").isNotNull().alias("known"), (F.coalesce("listed", F.lit(False)) & F.col("gate")).alias("all_in"), ((score >= 69) & F.col("gate")).alias("enter"),
        F.when(score >= 85, 1.0).when(score >= 80, 0.75).when(score >= 75, 0.5).otherwise(0.25).alias("share"), F.coalesce(((F.col("high") >= limit) & (limit > F.col("close"))) | (score < 35), F.lit(False)).alias("halve"), F.coalesce(F.col("close") < mean, F.lit(False)).alias("weak"),
        F.coalesce(F.col("d") >= F.to_date(F.lit(start)), F.lit(True)).alias("counts"),
    )


def _walk_path(g: pd.DataFrame) -> pd.DataFrame:
    """code, final cash of one security's rows in order."""
    opens, closes, known, all_in, enter, share, halve, weak, counts = (g[c].to_numpy() for c in ("open", "close", "known", "all_in", "enter", "share", "halve", "weak", "counts"))
    purse, leave = Purse(1_000_000.0), None
    for i in range(60, len(g)):
        if not counts[i]:
            continue
        if purse.waiting:
            purse.fill(opens[i])
        if leave is not None and i >= leave:
            purse.sell(opens[i])
            leave = None
        if not known[i] or leave is not None:
            continue
        if purse.shares == 0:
            if all_in[i]:
                purse.waiting, leave = (float("inf"), True), i + 2
            elif enter[i]:
                purse.waiting = (0.25 * purse.capital, True)
            continue
        held, purse.high = purse.shares * opens[i] / purse.capital, max(purse.high, closes[i])
        if share[i] > held + 1e-9:
            purse.waiting = (share[i] * purse.capital, True)
        elif halve[i] and held > 0.51:
            purse.waiting = (0.5 * purse.capital, False)
        elif weak[i] or closes[i] <= 0.92 * max(purse.high, purse.paid / purse.shares):
            purse.waiting = (0.0, False)
    if purse.shares > 0:
        purse.sell(opens[-1])
    return pd.DataFrame({"code": [g["code"].iloc[0]], "final": [purse.cash]})


def two_path(scores: DataFrame, flow_score: DataFrame, leaderboard_signals: DataFrame, start: str | None = None) -> DataFrame:
    """code, final cash. A leaderboard signal goes all in for two bars; otherwise quarters are built by score and trailed."""
    w = Window.partitionBy("code").orderBy("d")
    listed = leaderboard_signals.select("code", "d", F.lit(True).alias("listed"))
    rows = scores.select("code", "d", "open", "high", "close", "dif", "s_star", "gate").join(flow_score, ["code", "d"], "left").join(listed, ["code", "d"], "left")
    rows = _path_rows(rows, F.lag("close").over(w), F.avg("close").over(w.rowsBetween(-4, 0)), start)
    return rows.groupBy("code").applyInPandas(lambda g: _walk_path(g.sort_values("d")), "code string, final double")


def in_place(walk: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """walk on each code of rows that are in order of code and day. The row numbers prove that every code is there from its
    first bar."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(rows: pd.DataFrame) -> pd.DataFrame:
            code = rows["code"].to_numpy()
            starts = np.nonzero(np.concatenate([[True], code[1:] != code[:-1]]))[0]
            ends = np.append(starts[1:], len(code))
            if not np.array_equal(rows["rn"].to_numpy(), np.arange(1, len(code) + 1) - np.repeat(starts, ends - starts)):
                raise ValueError("rows of a code aren't together, or not in order of days")
            return pd.concat([walk(rows.iloc[a:b]) for a, b in zip(starts, ends, strict=True)], ignore_index=True)

        held = None
        for rows in parts:
            if not len(rows):
                continue
            rows = pd.concat([held, rows], ignore_index=True) if held is not None else rows
            cut = int((rows["code"].to_numpy() == rows["code"].iloc[-1]).argmax())  # the last code may go on in the next part
            held = rows.iloc[cut:]
            if cut:
                yield done(rows.iloc[:cut])
        if held is not None:
            yield done(held)

    return run


def two_path_in_place(marked_scores: DataFrame) -> DataFrame:
    """The same of scores whose rows carry flow and mark and are in order of code and day: nothing is dealt again."""
    rows = _path_rows(marked_scores, F.col("pc"), F.col("ma5"), None, "rn")
    return rows.mapInPandas(in_place(_walk_path), "code string, final double")


Native("backtest_two_path", two_path, ["scores", "flow_score", "leaderboard_signals"], reads=1)
#: Flow and mark join the bars before the recursions do, where rows are still dealt by code and in order.
Relation("ind_marked", "SELECT i.*, f.z, l.listed FROM {ind_cci} i LEFT JOIN {flow_score} f ON f.code = i.code AND f.d = i.d LEFT JOIN (SELECT code, d, true AS listed FROM {leaderboard_signals}) l ON l.code = i.code AND l.d = i.d")
Relation("marked_parts", RELATIONS["score_parts"].sql.replace("SELECT code, d, rn,", "SELECT code, d, rn, pc, ma5, z, listed,", 1).replace("{signal_rows}", "{" + variant("signal_rows", "marked", {"ind_cci": "ind_marked"}) + "}"))
Relation("marked_scores", RELATIONS["scores"].sql.replace("{score_parts}", "{marked_parts}"))
Native("two_path_in_place", two_path_in_place, ["marked_scores"], reads=1)

# ---- accounts --------------------------------------------------------------------------------------------------------

#: Features of a replay are those of bars with prices adjusted forward only; fills and actions are on raw ones. A bar
#: after an open that no action explains, a reference that isn't positive, or a security whose history of rights isn't
#: known makes its rows ineligible.
ADJUSTED = variant("adjusted_rows", "dense", {"bars_sparse": "bars", "actions_sparse": "actions"})
Relation("bars_adjusted", f"SELECT code, d, open, high, low, close, volume FROM {{{ADJUSTED}}}")
Relation("history_quality", "SELECT DISTINCT code, substr(code, 6, 1) <> '7' AS allowed FROM {bars}")
_ON_ADJUSTED = {"bars": "bars_adjusted"}
Relation(
    "atom_masks_allowed",
    f"SELECT m.code, m.d, m.eligible AND NOT x.quarantined AND NOT x.bad AND h.allowed AS eligible, m.gate, m.nn, m.pos FROM {{{variant('atom_masks', 'adj', _ON_ADJUSTED)}}} m JOIN {{{ADJUSTED}}} x ON x.code = m.code AND x.d = m.d JOIN {{history_quality}} h ON h.code = m.code",
)
_FRONTS, _RISK, _TREND = variant("fronts", "allowed", {"atom_masks": "atom_masks_allowed"}), variant("risk_rows", "adj", _ON_ADJUSTED), variant("holding_trend", "adj", _ON_ADJUSTED)
#: What a replay reads per bar.
Relation(
    "replay_rows",
    f"""SELECT /*+ BROADCAST(k) */ b.code, b.d, k.ci, b.open, b.close, coalesce(a.cash_per_share, 0) AS act_cash, coalesce(a.share_multiplier, 1) AS act_mult, x.tradable, x.block_buy, x.block_sell, coalesce(f.layer = 1, false) AS front, coalesce(m.eligible, false) AS eligible, coalesce(m.gate, false) AS gate, h.allowed, r.annual_vol AS vol, r.daily_es AS es, t.known, t.entry, t.leave,
  lag(b.close) OVER (PARTITION BY b.code ORDER BY b.d) AS prev_close
FROM {{bars}} b JOIN {{calendar}} k ON k.d = b.d JOIN {{execution_blocks}} x ON x.code = b.code AND x.d = b.d LEFT JOIN {{actions}} a ON a.code = b.code AND a.ex_date = b.d LEFT JOIN {{{_FRONTS}}} f ON f.code = b.code AND f.d = b.d JOIN {{atom_masks_allowed}} m ON m.code = b.code AND m.d = b.d JOIN {{{_RISK}}} r ON r.code = b.code AND r.d = b.d JOIN {{{_TREND}}} t ON t.code = b.code AND t.d = b.d JOIN {{history_quality}} h ON h.code = b.code
WHERE b.open > 0 AND b.high > 0 AND b.low > 0 AND b.close > 0""",
)

LEDGER = "code string, version string, vol_target double, d date, seq int, kind string, reason string, quantity double, price double, gross double, fee double, cash double, shares double, target double, signal_d date, nav double"
#: Dates from which fees changed, and rates before and after.
STAMP_FROM, STAMP_RATES = "2023-08-28", (0.001, 0.0005)
TRANSFER_FROM, TRANSFER_RATES = "2022-04-29", (0.00002, 0.00001)


class Book:
    """Cash and shares of one account: lots of 100, T+1, dated fees, a drawdown latch with a cooldown."""

    capital, commission, least_fee, slip, drawdown, rest = 1_000_000.0, 0.0003, 5.0, 0.0005, 0.15, 20

    def __init__(self, log: list[dict]):
        self.cash, self.shares, self.fresh = self.capital, 0.0, 0.0
        self.peak, self.latched, self.blocked_to, self.builds = self.capital, False, -1, 0
        self.log = log

    def worth(self, price: float) -> float:
        return self.cash + self.shares * price

    def note(self, kind: str, reason: str, quantity: float, **more) -> None:
        self.log.append({"kind": kind, "reason": reason, "quantity": float(quantity), "cash": self.cash, "shares": self.shares, **more})

    def action(self, cash: float, mult: float) -> None:
        paid, before = self.shares * cash, self.shares
        self.cash, self.shares = self.cash + paid, self.shares * mult
        self.note("action", "ex-date", self.shares - before, gross=paid)

    def cost(self, day: str, gross: float, buys: bool) -> float:
        stamp = 0.0 if buys else gross * STAMP_RATES[day >= STAMP_FROM]
        return max(self.least_fee, gross * self.commission) + stamp + gross * TRANSFER_RATES[day >= TRANSFER_FROM]

    def order(self, day: str, price: float, weight: float, tradable: bool, no_buy: bool, no_sell: bool, reason: str, signal_d=None) -> None:
        def unfilled(why: str, n: float) -> None:
            self.note("unfilled", why, n, price=price, target=weight, signal_d=signal_d)

        if not tradable:
            return unfilled("not tradable", self.shares if weight == 0 else 0.0)
        gap = math.floor(self.worth(price) * weight / price / 100) * 100 - self.shares
        if gap == 0:
            return None
        buys, asked = gap > 0, abs(gap) if weight == 0 else math.floor(abs(gap) / 100) * 100
        if no_buy if buys else no_sell:
            return unfilled("buy blocked" if buys else "sell blocked", abs(gap))
        if asked == 0:
            return unfilled("below a lot", abs(gap))
        fill = price * (1 + (self.slip if buys else -self.slip))
        if buys:
            n = min(asked, math.floor(self.cash / fill / 100) * 100)
            while n > 0 and n * fill + self.cost(day, n * fill, True) > self.cash:
                n -= 100
        else:
            n = min(asked, max(0.0, self.shares - self.fresh))
            n = n if weight == 0 else math.floor(n / 100) * 100
        gross = n * fill
        fee = self.cost(day, gross, buys) if n > 0 else 0.0
        if n <= 0 or (not buys and self.cash + gross - fee < 0):
            return unfilled("no cash" if buys else "bought today", asked)
        had = self.shares
        self.cash += -(gross + fee) if buys else gross - fee
        if buys:
            self.shares, self.fresh, self.builds = had + n, self.fresh + n, self.builds + (had == 0)
        else:
            self.shares = self.fresh if n == had - self.fresh else had - n
            if self.shares == 0:
                self.latched, self.peak = False, self.cash
        self.note(("build" if had == 0 else "add") if buys else ("exit" if self.shares == 0 else "reduce"), reason, n, price=fill, gross=gross, fee=fee, target=weight, signal_d=signal_d)
        if n < asked:
            unfilled("no cash" if buys else "bought today", asked - n)
        return None

    def close(self, ci: int, price: float) -> bool:
        """Whether the drawdown latch asks for an exit."""
        worth = self.worth(price)
        if self.shares == 0:
            self.peak, self.latched = worth, False
            return False
        self.peak = max(self.peak, worth)
        if not self.latched and (self.peak - worth) / self.peak >= self.drawdown:
            self.latched, self.peak, self.blocked_to = True, worth, ci + self.rest
        return self.latched


def walk_account(rows: list[dict], version: str, config: RiskConfig, end: str | None, last_ci: int, start: str | None = None) -> list[dict]:
    """The ledger of one security: actions, then the order of the last close (or the deadline's exit), then the close."""
    log: list[dict] = []
    book, order = Book(log), None
    for r in rows:
        day, ci, at = str(r["d"])[:10], int(r["ci"]), len(log)
        if end is not None and day > end:
            break
        if start is not None and day < start:
            continue
        book.fresh = 0.0
        if r["act_cash"] or r["act_mult"] != 1:
            book.action(r["act_cash"], r["act_mult"])
        closing = ci > last_ci - 5
        if closing:
            book.order(day, r["open"], 0.0, r["tradable"], False, r["block_sell"], "deadline")
        elif order is not None and (ci == order[2] + 1 or order[0] == 0):
            held_cap = order[3] == "risk cap"
            book.order(day, r["open"], order[0], r["tradable"], r["block_buy"] or ci <= book.blocked_to or held_cap, r["block_sell"], order[3], order[1])
        order = None
        leaves = book.close(ci, r["close"])
        worth = book.worth(r["close"])
        free = not leaves and ci > book.blocked_to
        known = r["vol"] is not None and r["es"] is not None
        cap = min(config.max_weight, config.annual_vol_target / max(r["vol"], 1e-8), config.es_budget / max(r["es"], 1e-8)) if known else 0.0
        sound = r["eligible"] and r.get("allowed", True)
        allowed = r["front"] and sound and r["gate"] and free
        if not closing and version == "risk":
            want = cap if allowed else 0.0
            buy = book.commission + 0.00002 + book.slip
            to = rebalance_weight(book.shares * r["close"] / worth, want, r["vol"] or 0.0, buy, buy + STAMP_RATES[day >= STAMP_FROM], config, want)
            order = (to, r["d"], ci, "risk exit" if leaves else "risk target")
        elif not closing and version == "trend":
            limit = cap if sound and free and r["known"] else 0.0
            if book.shares:
                if limit == 0 or r["leave"]:
                    order = (0.0, r["d"], ci, "risk exit" if leaves else "trend exit" if r["leave"] else "invalid")
                elif book.shares * r["close"] / worth > limit:
                    order = (limit * 0.9, r["d"], ci, "risk cap")
            elif allowed and r["entry"] and limit > 0:
                order = (limit * 0.9, r["d"], ci, "trend entry")
        elif not closing and version == "benchmark" and book.builds == 0 and sound:
            order = (1.0, r["d"], ci, "benchmark entry")
        if day == end and book.shares:
            ref = ((r["prev_close"] if r["prev_close"] is not None else r["close"]) - r["act_cash"]) / r["act_mult"]
            book.order(day, r["close"], 0.0, r["tradable"], False, r["close"] <= ref * 0.952, "deadline close")
            book.close(ci, r["close"])
        book.note("close", "", 0.0, price=r["close"], nav=book.worth(r["close"]))
        for seq, e in enumerate(log[at:]):
            e.update(d=r["d"], seq=seq)
    return log


#: Version and volatility target of each account of a security.
RISK, TREND, BENCHMARK = (("risk", 0.10), ("risk", 0.15), ("risk", 0.20)), (("trend", 0.10),), (("benchmark", 0.10),)


def replay(replay_rows: DataFrame, calendar: DataFrame, version: str, vol_targets: tuple[float, ...] = (0.10,), end: str | None = None, start: str | None = None) -> DataFrame:
    """Ledgers of one version, see replay_all."""
    return replay_all(replay_rows, calendar, tuple((version, v) for v in vol_targets), end, start)


def replay_all(replay_rows: DataFrame, calendar: DataFrame, accounts: tuple[tuple[str, float], ...], end: str | None = None, start: str | None = None) -> DataFrame:
    """Ledgers (LEDGER) of a security's accounts, one row per event and per close.

    start and end bound the sessions of the accounts; features look back further. Without them all sessions count.
    """
    return replay_rows.groupBy("code").applyInPandas(_ledgers(calendar, accounts, end, start), LEDGER)


def _ledgers(calendar: DataFrame, accounts: tuple[tuple[str, float], ...], end: str | None = None, start: str | None = None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The kernel of replay_all."""
    last = (calendar.filter(F.col("d") <= F.to_date(F.lit(end))) if end else calendar).agg(F.max("ci"), F.max("d").cast("string")).first()
    last_ci, end = last[0] or 0, end or last[1]
    kinds = {c: {"double": "float64", "int": "int32"}.get(t, object) for c, t in (x.split() for x in LEDGER.split(", "))}

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("d")
        rows = g.astype(object).where(g.notna(), None).to_dict("records")
        out = []
        for version, v in accounts:
            for e in walk_account(rows, version, RiskConfig(annual_vol_target=v), end, last_ci, start):
                out.append({"code": rows[0]["code"], "version": version, "vol_target": v, **e})
        # columns of their own type: one that no event fills would come out as doubles
        return pd.DataFrame({c: pd.Series([e.get(c) for e in out], dtype=kind) for c, kind in kinds.items()})

    return kernel


#: What a check of an event reads besides the event: the bar and the action of its day, and the events before it.
FACTS = "open double, bar_close double, cps double, mult double, had double, held double, bought double"


def with_facts(ledger: pd.DataFrame, bars: pd.DataFrame) -> pd.DataFrame:
    """Events of one security's accounts, each with FACTS. bars: d and the bar's part of them."""
    x = ledger.sort_values(["version", "vol_target", "d", "seq"], kind="stable", ignore_index=True)
    account = x.groupby(["version", "vol_target"], sort=False, dropna=False)
    x["had"], x["held"] = account["cash"].shift().fillna(Book.capital), account["shares"].shift().fillna(0.0)
    built = x["quantity"].where(x["kind"].isin(["build", "add"]), 0.0).fillna(0.0)
    x["bought"] = built.groupby([x["version"], x["vol_target"], x["d"]], sort=False, dropna=False).cumsum() - built
    return x.merge(bars, on="d", how="left")


def checked_events(replay_rows: DataFrame, calendar: DataFrame, bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Events of all ledgers with what their check reads. A security's bars come to its walk, so no event is dealt."""
    kernel = _ledgers(calendar, RISK + TREND + BENCHMARK)
    acts = actions.select("code", F.col("ex_date").alias("d"), F.col("cash_per_share").alias("cps"), F.col("share_multiplier").alias("mult"))
    beside = bars.select("code", "d", "open", F.col("close").alias("bar_close")).join(acts, ["code", "d"], "left")
    beside = beside.select(*(F.col(c).alias(c) for c in beside.columns))  # columns of their own: both sides of the group are made of bars
    schema = f"{LEDGER}, {FACTS}"
    names = [c.split()[0] for c in schema.split(", ")]

    def check(rows: pd.DataFrame, bar: pd.DataFrame) -> pd.DataFrame:
        return with_facts(kernel(rows), bar.drop(columns="code"))[names] if len(rows) else pd.DataFrame(columns=names)

    return replay_rows.groupBy("code").cogroup(beside.groupBy("code")).applyInPandas(check, schema)


Native("checked_events", checked_events, ["replay_rows", "calendar", "bars", "actions"], reads=1)
Native("ledger_risk", lambda replay_rows, calendar: replay_all(replay_rows, calendar, RISK), ["replay_rows", "calendar"], reads=1)
Native("ledger_trend", lambda replay_rows, calendar: replay_all(replay_rows, calendar, TREND), ["replay_rows", "calendar"], reads=1)
Native("ledger_benchmark", lambda replay_rows, calendar: replay_all(replay_rows, calendar, BENCHMARK), ["replay_rows", "calendar"], reads=1)
#: Several versions in one walk over the rows.
Native("ledger_pair", lambda replay_rows, calendar: replay_all(replay_rows, calendar, TREND + BENCHMARK), ["replay_rows", "calendar"], reads=1)
Native("ledger_all", lambda replay_rows, calendar: replay_all(replay_rows, calendar, RISK + TREND + BENCHMARK), ["replay_rows", "calendar"], reads=1)
