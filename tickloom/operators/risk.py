"""Rolling risk, trend, position targets, corporate-action adjustment and execution rules."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import full, windows
from ..plans.core import RELATIONS, Native, Relation, q, variant
from . import fronts, signals  # noqa: F401  whose relations are varied

TAIL = 4  # of 63 returns: the worst 5 %, rounded up


@dataclass(frozen=True)
class RiskConfig:
    max_weight: float = 1.0
    annual_vol_target: float = 0.10
    es_budget: float = 0.02
    tracking_penalty: float = 10.0

    def __post_init__(self):
        if not (0 < self.max_weight <= 1 and self.annual_vol_target > 0 and self.es_budget > 0 and self.tracking_penalty > 0):
            raise ValueError("weights must be in (0, 1], targets and penalty positive")


def expected_shortfall(bars: DataFrame, window: int = 63, tail: int = TAIL) -> DataFrame:
    """code, d, daily_es: mean of the ``tail`` largest losses of the last ``window`` returns, from a sorted window array."""
    from pyspark.sql import Window

    w = Window.partitionBy("code").orderBy("d")
    ret = bars.select("code", "d", (F.col("close") / F.lag("close").over(w) - 1).alias("r"))
    loss = ret.withColumn("loss", F.greatest(F.lit(0.0), -F.col("r"))).withColumn("n", F.count("r").over(w))
    worst = F.slice(F.sort_array(F.collect_list("loss").over(w.rowsBetween(1 - window, 0)), asc=False), 1, tail)
    mean = F.aggregate(worst, F.lit(0.0), lambda a, x: a + x) / tail
    return loss.select("code", "d", F.when(F.col("n") >= window, mean).alias("daily_es"))


Native(
    "es63",
    expected_shortfall,
    ["bars"],
    f"""WITH r AS (SELECT code, d, rn, CASE WHEN pc IS NULL THEN NULL ELSE greatest(0, -ret) END AS loss FROM {{bar_flows}}),
a AS (SELECT code, d, rn, list(loss) OVER (PARTITION BY code ORDER BY d ROWS 62 PRECEDING) AS l FROM r)
SELECT code, d, CASE WHEN rn > 63 THEN list_sum(list_reverse_sort(l)[1:{TAIL}]) / {TAIL} END AS daily_es FROM a""",
)
Relation("risk_rows", f"SELECT r.code, r.d, r.vol AS annual_vol, e.daily_es FROM (SELECT code, d, {full(63, 'stddev_samp(ret) OVER w63 * sqrt(252)', 64)} AS vol FROM {{bar_steps_ret}} {windows(63)}) r JOIN {{es63}} e ON e.code = r.code AND e.d = r.d")
Relation("bar_steps_ret", "SELECT code, d, rn, ret FROM {bar_flows}")
Relation("risk_statistics", f"SELECT code, d, {q('annual_vol', 6)} AS annual_vol, {q('daily_es', 6)} AS daily_es FROM {{risk_rows}}")
#: Trend: at or above the 120-bar mean to enter, three closes below their own means to leave.
Relation("holding_trend", "SELECT code, d, ma120 IS NOT NULL AS known, coalesce(close >= ma120, false) AS entry, min(CASE WHEN close < ma120 THEN 1 ELSE 0 END) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1 AND rn >= 3 AS leave FROM {ind_rolling}")


def risk_cap(vol: Column | str, es: Column | str, config: RiskConfig = RiskConfig()) -> Column:
    """The largest weight that volatility target and shortfall budget allow; 0 if either is unknown."""
    vol, es = (F.col(x) if isinstance(x, str) else x for x in (vol, es))
    cap = F.least(F.lit(config.max_weight), F.lit(config.annual_vol_target) / F.greatest(vol, F.lit(1e-8)), F.lit(config.es_budget) / F.greatest(es, F.lit(1e-8)))
    return F.when(vol.isNotNull() & es.isNotNull(), cap).otherwise(F.lit(0.0))


_CAP = "CASE WHEN annual_vol IS NULL OR daily_es IS NULL THEN 0 ELSE least(1.0, 0.10 / greatest(annual_vol, 1e-8), 0.02 / greatest(daily_es, 1e-8)) END"
Relation("risk_target", f"SELECT f.code, f.d, {q(f'CASE WHEN layer = 1 THEN {_CAP} ELSE 0 END')} AS target FROM {{fronts}} f JOIN {{risk_rows}} r ON r.code = f.code AND r.d = f.d")


def rebalance_weight(current: float, desired: float, vol: float, buy_cost: float, sell_cost: float, config: RiskConfig, cap: float) -> float:
    """The weight that balances tracking the desired one against the cost of the trade: a soft threshold, then the cap."""
    if desired == 0:
        return 0.0
    buys = desired > current
    band = (buy_cost if buys else sell_cost) / max(vol, 1e-4) ** 2 / config.tracking_penalty
    moved = max(current, desired - band) if buys else min(current, desired + band)
    return min(max(moved, 0.0), cap)


Relation(
    "rebalance_weights",
    f"""WITH t AS (SELECT f.code, f.d, annual_vol AS vol, {_CAP} AS want, CAST(rn % 10 AS DOUBLE) / 10 AS cur FROM {{fronts}} f JOIN {{risk_rows}} r ON r.code = f.code AND r.d = f.d JOIN {{bar_steps}} b ON b.code = f.code AND b.d = f.d),
b AS (SELECT *, CASE WHEN want > cur THEN CAST(0.00082 AS DOUBLE) ELSE CAST(0.00182 AS DOUBLE) END / (greatest(vol, 1e-4) * greatest(vol, 1e-4)) / 10 AS band FROM t)
SELECT code, d, {q("CASE WHEN want = 0 THEN 0 ELSE greatest(0, least(want, CASE WHEN want > cur THEN greatest(cur, want - band) ELSE least(cur, want + band) END)) END")} AS weight FROM b""",
)

# ---- corporate actions -----------------------------------------------------------------------------------------------

#: Forward as-of: an action falls on the first bar on or after its date; none on a code's first bar or past its last.
#: A union of both sides ordered by date, and the next bar's date carried back: no range join.
Relation(
    "action_bars",
    """WITH u AS (SELECT code, d, 1 AS is_bar, CAST(NULL AS DATE) AS ex_date, CAST(NULL AS DOUBLE) AS cash, CAST(NULL AS DOUBLE) AS mult FROM {bars_sparse}
  UNION ALL SELECT code, ex_date AS d, 0 AS is_bar, ex_date, cash_per_share AS cash, share_multiplier AS mult FROM {actions_sparse}),
n AS (SELECT u.*, min(CASE WHEN is_bar = 1 THEN d END) OVER (PARTITION BY code ORDER BY d, is_bar ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS on_d, min(CASE WHEN is_bar = 1 THEN d END) OVER (PARTITION BY code) AS first_d FROM u)
SELECT code, ex_date, on_d AS d, cash, mult FROM n WHERE is_bar = 0 AND on_d > first_d""",
)


def compose(action_bars: DataFrame) -> DataFrame:
    """code, d, cash, mult: actions of one bar composed in order of their dates, cash on shares that earlier ones made."""
    by_date = F.sort_array(F.collect_list(F.struct("ex_date", "cash", "mult")))
    zero = F.struct(F.lit(0.0).alias("cash"), F.lit(1.0).alias("mult"))
    both = F.aggregate(by_date, zero, lambda a, x: F.struct((a["cash"] + a["mult"] * x["cash"]).alias("cash"), (a["mult"] * x["mult"]).alias("mult")))
    return action_bars.groupBy("code", "d").agg(both.alias("x")).select("code", "d", "x.cash", "x.mult")


Native(
    "composed_actions",
    compose,
    ["action_bars"],
    """SELECT code, d, cash, mult FROM (WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY code, d ORDER BY ex_date) AS k, count(*) OVER (PARTITION BY code, d) AS n FROM {action_bars}),
c AS (SELECT code, d, k, n, cash, mult FROM o WHERE k = 1 UNION ALL SELECT o.code, o.d, o.k, o.n, c.cash + c.mult * o.cash, c.mult * o.mult FROM c JOIN o ON o.code = c.code AND o.d = c.d AND o.k = c.k + 1)
SELECT * FROM c WHERE k = n) z""",
)


def adjust(bars_sparse: DataFrame, composed_actions: DataFrame) -> DataFrame:
    """Bars with prices scaled forward only: at an action bar the scale grows by previous close over ex-rights reference,
    the share scale by the multiplier; earlier bars never change. bad: a reference that isn't positive."""

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("d")
        before = g["close"].shift()
        ref = (before - g["cash"].fillna(0)) / g["mult"].fillna(1)
        step = (before / ref).where(g["cash"].notna() & before.notna(), 1.0)
        out = g[["code", "d"]].copy()
        out["scale"], out["share_scale"] = step.cumprod(), g["mult"].fillna(1).cumprod()
        for c in ("open", "high", "low", "close"):
            out[c] = g[c] * out["scale"]
        out["volume"] = g["volume"] / out["share_scale"]
        out["bad"] = bool((ref <= 0).any())
        jump = (g["open"] / ref - 1).abs().fillna(0) > 0.25
        out["quarantined"] = jump.cummax()
        return out

    rows = bars_sparse.join(composed_actions, ["code", "d"], "left")
    schema = "code string, d date, scale double, share_scale double, open double, high double, low double, close double, volume double, bad boolean, quarantined boolean"
    return rows.groupBy("code").applyInPandas(kernel, schema)


Native(
    "adjusted_rows",
    adjust,
    ["bars_sparse", "composed_actions"],
    """WITH x AS (SELECT b.*, lag(close) OVER (PARTITION BY b.code ORDER BY b.d) AS pc, a.cash, coalesce(a.mult, 1) AS mult FROM {bars_sparse} b LEFT JOIN {composed_actions} a ON a.code = b.code AND a.d = b.d),
y AS (SELECT *, (pc - coalesce(cash, 0)) / mult AS ref FROM x), z AS (SELECT *, product(CASE WHEN cash IS NOT NULL AND pc IS NOT NULL THEN pc / ref ELSE 1 END) OVER w AS scale, product(mult) OVER w AS share_scale,
  max(CASE WHEN abs(open / ref - 1) > 0.25 THEN 1 ELSE 0 END) OVER w AS jumped, min(ref) OVER (PARTITION BY code) AS low_ref FROM y WINDOW w AS (PARTITION BY code ORDER BY d))
SELECT code, d, scale, share_scale, open * scale AS open, high * scale AS high, low * scale AS low, close * scale AS close, volume / share_scale AS volume, coalesce(low_ref <= 0, false) AS bad, jumped = 1 AS quarantined FROM z""",
)
Relation("adjusted_prices", f"SELECT code, d, {q('scale', 6)} AS scale, {q('share_scale', 6)} AS share_scale, {q('open')} AS open, {q('close')} AS close, {q('volume', 3)} AS volume, bad, quarantined FROM {{adjusted_rows}}")
#: Whether an order can fill at the open: traded at all, and no adverse gap of 4.8 % against the ex-rights reference.
Relation(
    "execution_blocks",
    """WITH x AS (SELECT b.code, b.d, open, volume, lag(close) OVER (PARTITION BY b.code ORDER BY b.d) AS pc, coalesce(a.cash_per_share, 0) AS cash, coalesce(a.share_multiplier, 1) AS mult FROM {bars} b LEFT JOIN {actions} a ON a.code = b.code AND a.ex_date = b.d)
SELECT code, d, open > 0 AND volume > 0 AS tradable, coalesce(open / nullif((pc - cash) / mult, 0) - 1 >= 0.048, false) AS block_buy, coalesce(open / nullif((pc - cash) / mult, 0) - 1 <= -0.048, false) AS block_sell FROM x""",
)
#: A dividend's holders: shares compound over ex-dates in (buy, sell]; a range join on code and dates.
Relation(
    "dividend_income",
    f"""WITH t AS (SELECT code, d AS buy_d, lead(d, 40) OVER (PARTITION BY code ORDER BY d) AS sell_d FROM {{bars_sparse}}),
h AS (SELECT * FROM t WHERE sell_d IS NOT NULL), j AS (SELECT h.code, buy_d, sell_d, a.ex_date, cash_per_share AS cash, coalesce(exp(sum(ln(share_multiplier)) OVER (PARTITION BY h.code, buy_d ORDER BY a.ex_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS shares
  FROM h JOIN {{actions_sparse}} a ON a.code = h.code AND a.ex_date > buy_d AND a.ex_date <= sell_d)
SELECT code, buy_d, sell_d, count(*) AS events, {q("sum(cash * shares)", 6)} AS cash FROM j GROUP BY code, buy_d, sell_d""",
)
#: The first rule that holds decides, for who holds and who doesn't; stars are its strength. Without evidence nothing is
#: done: that is a precaution, not a signal. Scores don't sell a holding: only its trend or its risk cap does.
_VETO = "greatest((coalesce(rsi, 50) - 92) / 8, (-0.6 - coalesce(obv_flow, 0)) / 0.4, 0)"
Relation(
    "decisions",
    f"""WITH x AS (SELECT m.code, m.d, m.eligible, m.gate, f.layer, i.rsi, i.obv_flow, annual_vol, daily_es, t.known, t.entry, t.leave, {_CAP} AS cap FROM {{atom_masks}} m JOIN {{ind_all}} i ON i.code = m.code AND i.d = m.d JOIN {{risk_rows}} r ON r.code = m.code AND r.d = m.d JOIN {{holding_trend}} t ON t.code = m.code AND t.d = m.d LEFT JOIN {{fronts}} f ON f.code = m.code AND f.d = m.d WHERE i.rn >= 60),
h AS (SELECT x.*, g.holding FROM x JOIN (SELECT true AS holding UNION ALL SELECT false) g ON x.eligible IS NOT NULL),
y AS (SELECT *, CASE WHEN NOT eligible THEN 'none' WHEN holding AND (annual_vol IS NULL OR daily_es IS NULL OR NOT known) THEN 'none' WHEN holding AND cap <= 0 THEN 'cap' WHEN holding AND leave THEN 'trend' WHEN holding THEN 'stay' WHEN NOT gate THEN 'gate' WHEN layer <> 1 THEN 'dominated' WHEN NOT entry THEN 'below' WHEN annual_vol IS NULL OR daily_es IS NULL OR layer IS NULL THEN 'none' WHEN cap <= 0 THEN 'cap' ELSE 'buy' END AS rule FROM h)
SELECT code, d, holding, rule, CASE WHEN rule = 'none' THEN CASE WHEN holding THEN 'hold off' ELSE 'do not buy' END WHEN holding THEN CASE WHEN rule = 'stay' THEN 'hold' ELSE 'exit' END WHEN rule = 'buy' THEN 'buy' ELSE 'do not buy' END AS decision, CASE WHEN rule = 'none' THEN 'precaution' ELSE 'signal' END AS kind,
  CAST(CASE rule WHEN 'none' THEN 1 WHEN 'cap' THEN 5 WHEN 'gate' THEN greatest(1, least(5, ceil(5 * {_VETO}))) WHEN 'buy' THEN greatest(1, least(5, ceil(5 * cap))) ELSE 3 END AS INT) AS stars FROM y""",
    oracle="""WITH c AS (SELECT code, d, annual_vol AS v, daily_es AS s, coalesce(list_min([1.0, 0.1 / greatest(annual_vol, 1e-8), 0.02 / greatest(daily_es, 1e-8)]), 0) AS cap, annual_vol IS NULL OR daily_es IS NULL AS unknown FROM {risk_rows}),
a AS (SELECT * FROM {atom_masks} JOIN c USING (code, d) JOIN {holding_trend} USING (code, d) JOIN (SELECT code, d, rn, rsi, obv_flow FROM {ind_all}) USING (code, d) LEFT JOIN (SELECT code, d, layer FROM {fronts}) USING (code, d) WHERE rn >= 60)
SELECT code, d, true AS holding, CASE WHEN NOT eligible OR unknown OR NOT known THEN 'none' WHEN cap <= 0 THEN 'cap' WHEN leave THEN 'trend' ELSE 'stay' END AS rule, CASE WHEN NOT eligible OR unknown OR NOT known THEN 'hold off' WHEN cap <= 0 OR leave THEN 'exit' ELSE 'hold' END AS decision, CASE WHEN NOT eligible OR unknown OR NOT known THEN 'precaution' ELSE 'signal' END AS kind, CASE WHEN NOT eligible OR unknown OR NOT known THEN 1 WHEN cap <= 0 THEN 5 ELSE 3 END AS stars FROM a
UNION ALL SELECT code, d, false, rule, CASE rule WHEN 'buy' THEN 'buy' ELSE 'do not buy' END, CASE rule WHEN 'none' THEN 'precaution' ELSE 'signal' END, stars FROM (SELECT code, d, CASE WHEN NOT eligible THEN 'none' WHEN NOT gate THEN 'gate' WHEN layer > 1 THEN 'dominated' WHEN NOT entry THEN 'below' WHEN unknown OR layer IS NULL THEN 'none' WHEN cap <= 0 THEN 'cap' ELSE 'buy' END AS rule,
  CASE WHEN NOT eligible THEN 1 WHEN NOT gate THEN list_max([1, list_min([5, ceil(5 * list_max([(coalesce(rsi, 50) - 92) / 8, (-0.6 - coalesce(obv_flow, 0)) / 0.4]))])])::INT WHEN layer > 1 OR NOT entry THEN 3 WHEN unknown OR layer IS NULL THEN 1 WHEN cap <= 0 THEN 5 ELSE least(5, greatest(1, ceil(cap / 0.2)))::INT END AS stars FROM a) n""",
)
#: The same over masks that carry RSI and flow, so that indicators aren't joined to them.
_FRONTS = variant("fronts", "wide", {"atom_masks": "wide_masks"})
_WIDE = RELATIONS["decisions"].sql.replace(" JOIN {ind_all} i ON i.code = m.code AND i.d = m.d", "").replace("i.rsi, i.obv_flow", "m.rsi, m.obv_flow").replace("i.rn", "m.rn")
Relation("decisions_in_place", _WIDE.replace("{atom_masks}", "{wide_masks}").replace("{fronts}", f"{{{_FRONTS}}}"))
#: Trades with the dividends and share changes of their holding, (buy, sell], and the return after costs with both.
Relation(
    "trades_with_dividends",
    f"""WITH t AS (SELECT code, buy_d, sell_d, buy, sell FROM {{trades_multifactor}}), j AS (SELECT t.*, a.ex_date, cash_per_share AS cash, share_multiplier AS mult, exp(sum(ln(share_multiplier)) OVER (PARTITION BY t.code, buy_d ORDER BY a.ex_date)) / share_multiplier AS shares FROM t JOIN {{actions}} a ON a.code = t.code AND a.ex_date > buy_d AND a.ex_date <= sell_d),
s AS (SELECT code, buy_d, count(*) AS events, sum(cash * shares) AS cash, exp(sum(ln(mult))) AS mult FROM j GROUP BY code, buy_d)
SELECT t.code, t.buy_d, t.sell_d, coalesce(events, 0) AS events, {q('coalesce(mult, 1)', 6)} AS share_multiplier, {q('coalesce(cash, 0)', 6)} AS dividends, {q('coalesce(cash, 0) / buy * 100')} AS yield_pct, {q('(sell * coalesce(mult, 1) * (1 - 0.0003 - 0.0005) + coalesce(cash, 0)) / (buy * (1 + 0.0003)) * 100 - 100')} AS total_pct FROM t LEFT JOIN s ON s.code = t.code AND s.buy_d = t.buy_d""",
    oracle=f"""WITH e AS (SELECT t.code, t.buy_d, t.sell_d, t.buy, t.sell, list(struct_pack(c := cash_per_share, m := share_multiplier) ORDER BY ex_date) FILTER (ex_date IS NOT NULL) AS x FROM {{trades_multifactor}} t LEFT JOIN {{actions}} a ON a.code = t.code AND a.ex_date > t.buy_d AND a.ex_date <= t.sell_d GROUP BY ALL),
p AS (SELECT *, coalesce(list_product(list_transform(x, lambda k: k.m)), 1) AS mult, coalesce(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i].c * coalesce(list_product(list_transform(x[1:i - 1], lambda k: k.m)), 1))), 0) AS cash FROM e)
SELECT code, buy_d, sell_d, coalesce(len(x), 0) AS events, {q('mult', 6)} AS share_multiplier, {q('cash', 6)} AS dividends, {q('cash / buy * 100')} AS yield_pct, {q('(sell * mult * 0.9992 + cash) / (buy * 1.0003) * 100 - 100')} AS total_pct FROM p""",
)
