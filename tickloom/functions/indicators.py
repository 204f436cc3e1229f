"""Technical indicators per security, ordered by date. Warm-up is NULL, never NaN.

Indicators with a fixed window are window expressions over one partitioning and order, so Spark sorts once. Indicators
with a recursion from a seed share one grouped map: a code's arrays are shuffled once, and each recursion is an
exponential mean started at its seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.core import Native, Relation, half_even, q

_W = "PARTITION BY code ORDER BY d"


def windows(*sizes: int) -> str:
    """WINDOW clause: w, and wN for the last N rows."""
    return "WINDOW w AS (" + _W + "), " + ", ".join(f"w{n} AS ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sizes)


def full(n: int, x: str, first: int | None = None) -> str:
    """x where a whole window of n rows (or the row number ``first``) is there."""
    return f"CASE WHEN rn >= {first or n} THEN {x} END"


#: Bars with row number, previous values and the running pieces of the indicators.
Relation(
    "bar_steps",
    f"""SELECT b.*, CAST(row_number() OVER w AS INT) AS rn, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl,
  lag(close, 5) OVER w AS c5, lag(close, 11) OVER w AS c11, lag(close, 12) OVER w AS c12, lag(close, 20) OVER w AS c20, lag(close, 60) OVER w AS c60, lag(close, 250) OVER w AS c250 FROM {{bars}} b {windows(1)}""",
)
Relation(
    "bar_flows",
    """SELECT *, (high + low + close) / 3 AS tp, CASE WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END AS signed, close / pc - 1 AS ret,
  greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN pc IS NULL THEN 0 WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm,
  CASE WHEN pc IS NULL THEN 0 WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss, (ph + pl) / 2 AS pm FROM {bar_steps}""",
)
Relation(
    "ind_rolling",
    f"""SELECT code, d, rn, open, high, low, close, volume, pc, c5, c20, c60, c250, ret,
  {full(5, "avg(close) OVER w5")} AS ma5, {full(10, "avg(close) OVER w10")} AS ma10, {full(20, "avg(close) OVER w20")} AS ma20, {full(60, "avg(close) OVER w60")} AS ma60, {full(120, "avg(close) OVER w120")} AS ma120, {full(250, "avg(close) OVER w250")} AS ma250,
  avg(close) OVER w20 AS ma20_partial, avg(close) OVER w60 AS ma60_partial,
  {full(20, "avg(close) OVER w20 + 2 * stddev_pop(close) OVER w20")} AS boll_u, {full(20, "avg(close) OVER w20 - 2 * stddev_pop(close) OVER w20")} AS boll_l,
  {full(10, "CASE WHEN max(high) OVER w10 = min(low) OVER w10 THEN 50 ELSE (max(high) OVER w10 - close) / (max(high) OVER w10 - min(low) OVER w10) * 100 END")} AS wr,
  sum(signed) OVER w AS obv, CASE WHEN rn = 1 THEN 0 WHEN sum(CASE WHEN rn > 1 THEN volume ELSE 0 END) OVER w5 > 0 THEN sum(signed) OVER w5 / sum(CASE WHEN rn > 1 THEN volume ELSE 0 END) OVER w5 ELSE 0 END AS obv_flow,
  {full(6, "(close - avg(close) OVER w6) / (avg(close) OVER w6) * 100")} AS bias6, {full(12, "(close - avg(close) OVER w12) / (avg(close) OVER w12) * 100")} AS bias12, {full(24, "(close - avg(close) OVER w24) / (avg(close) OVER w24) * 100")} AS bias24,
  {full(24, "(avg(close) OVER w3 + avg(close) OVER w6 + avg(close) OVER w12 + avg(close) OVER w24) / 4")} AS bbi,
  {full(26, "CASE WHEN sum(CASE WHEN signed < 0 THEN volume WHEN signed = 0 THEN volume / 2 ELSE 0 END) OVER w26 > 0 THEN sum(CASE WHEN signed > 0 THEN volume WHEN signed = 0 THEN volume / 2 ELSE 0 END) OVER w26 / sum(CASE WHEN signed < 0 THEN volume WHEN signed = 0 THEN volume / 2 ELSE 0 END) OVER w26 * 100 ELSE 100 END", 27)} AS vr,
  {full(26, "CASE WHEN sum(greatest(pc - low, 0)) OVER w26 > 0 THEN sum(greatest(high - pc, 0)) OVER w26 / sum(greatest(pc - low, 0)) OVER w26 * 100 ELSE 100 END", 27)} AS br,
  {full(26, "CASE WHEN sum(open - low) OVER w26 > 0 THEN sum(high - open) OVER w26 / sum(open - low) OVER w26 * 100 ELSE 100 END", 27)} AS ar,
  {full(26, "CASE WHEN sum(greatest(pm - low, 0)) OVER w26 > 0 THEN sum(greatest(high - pm, 0)) OVER w26 / sum(greatest(pm - low, 0)) OVER w26 * 100 ELSE 100 END", 27)} AS cr,
  {full(50, "avg(close) OVER w10 - avg(close) OVER w50")} AS dma, {full(20, "c11 - avg(close) OVER w20")} AS dpo, close - c12 AS mtm,
  {full(26, "avg(close) OVER w26 * 1.06")} AS ene_u, {full(26, "avg(close) OVER w26 * 0.94")} AS ene_l,
  {full(20, "max(high) OVER w20")} AS lon_u, {full(20, "min(low) OVER w20")} AS lon_l, {full(14, "avg(tp) OVER w14")} AS tp14,
  {full(250, "max(close) OVER w250")} AS h250, {full(250, "min(close) OVER w250")} AS l250, {full(60, "stddev_pop(ret) OVER w61 * sqrt(252) * 100", 61)} AS vol61, tp,
  {full(5, "avg(volume) OVER w5")} AS v5, {full(20, "avg(volume) OVER w20")} AS v20, tr, pdm, mdm, gain, loss, signed
FROM {{bar_flows}} {windows(3, 5, 6, 10, 12, 14, 20, 24, 26, 50, 60, 61, 120, 250)}""",
)
#: The mean deviation from the window's own mean: the window's 14 values, by lag, against that mean.
Relation(
    "ind_cci",
    "SELECT x.*, CASE WHEN mad <= 0 THEN 0 ELSE (tp - tp14) / (0.015 * mad) END AS cci FROM (SELECT r.*, ("
    + " + ".join(f"abs(lag(tp, {k}) OVER w - tp14)" for k in range(14))
    + ") / 14 AS mad FROM {ind_rolling} r WINDOW w AS (PARTITION BY code ORDER BY d)) x",
)
Relation("ind_window_all", "SELECT code, d, " + ", ".join(f"{q(c)} AS {c}" for c in "ma5 ma10 ma20 ma60 ma120 ma250 ma20_partial ma60_partial boll_u boll_l wr obv obv_flow bias6 bias12 bias24 bbi vr br ar cr dma dpo mtm ene_u ene_l lon_u lon_l h250 l250 vol61".split()) + " FROM {ind_rolling}")
Relation("ind_cci_q", f"SELECT code, d, {q('cci', 3)} AS cci FROM {{ind_cci}}")


def seeded(x: np.ndarray, seed_end: int, seed: float, alpha: float) -> np.ndarray:
    """NaN before seed_end, seed there, then alpha * x + (1 - alpha) * previous."""
    out = np.full(len(x), np.nan)
    if seed_end < len(x):
        run = np.concatenate([[seed], x[seed_end + 1 :]])
        out[seed_end:] = pd.Series(run).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return out


def ema(x: np.ndarray, period: int, start: int = 0) -> np.ndarray:
    end = start + period - 1
    return seeded(x, end, x[start : end + 1].mean(), 2 / (period + 1)) if end < len(x) else np.full(len(x), np.nan)


def recursive_arrays(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> dict[str, np.ndarray]:
    """All seeded recursions of one security's ordered history."""
    n = len(close)
    nan = lambda: np.full(n, np.nan)
    out: dict[str, np.ndarray] = {"ema12": ema(close, 12), "ema26": ema(close, 26), "ema50": ema(close, 50)}
    out["dif"] = out["ema12"] - out["ema26"]
    out["dea"] = ema(out["dif"], 9, 25)
    out["bar"] = (out["dif"] - out["dea"]) * 2
    step = np.diff(close, prepend=close[:1])
    rsi = nan()
    if n >= 15:
        up, down = (seeded(g, 14, g[1:15].mean(), 1 / 14) for g in (np.maximum(step, 0), np.maximum(-step, 0)))
        with np.errstate(divide="ignore", invalid="ignore"):
            rsi = np.where(np.isnan(up), np.nan, np.where(down == 0, np.where(up == 0, 50.0, 100.0), 100 - 100 / (1 + up / down)))
    out["rsi"] = rsi
    hh, ll = (getattr(pd.Series(x).rolling(9), f)().to_numpy() for x, f in ((high, "max"), (low, "min")))
    with np.errstate(divide="ignore", invalid="ignore"):
        rsv = np.where(hh == ll, 50.0, (close - ll) / (hh - ll) * 100)
    out["k"] = seeded(rsv, 8, 50.0, 1 / 3)
    out["dd"] = seeded(out["k"], 8, 50.0, 1 / 3)
    out["j"] = 3 * out["k"] - 2 * out["dd"]
    out["skdj_d"] = seeded(out["dd"], 11, out["dd"][11], 1 / 3) if n > 11 else nan()
    before = np.concatenate([close[:1], close[:-1]])
    tr = np.maximum(high - low, np.maximum(abs(high - before), abs(low - before)))
    tr[:1] = 0
    out["atr"] = seeded(tr, 13, tr[1:14].mean(), 1 / 14) if n > 13 else nan()
    up, down = np.diff(high, prepend=high[:1]), -np.diff(low, prepend=low[:1])
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    for name in ("pdi", "mdi", "adx", "adxr"):
        out[name] = nan()
    if n >= 28:
        t, p, m = (seeded(x, 14, x[1:15].sum() / 14, 1 / 14) for x in (tr, plus, minus))  # a Wilder sum is 14 times this mean
        with np.errstate(divide="ignore", invalid="ignore"):
            pdi, mdi = p / t * 100, m / t * 100
            dx = np.where(pdi + mdi > 0, abs(pdi - mdi) / (pdi + mdi) * 100, 0.0)
        dx[:14] = np.nan
        adx = seeded(dx, 27, dx[14:28].mean(), 1 / 14)
        adxr = nan()
        adxr[41:] = (adx[41:] + adx[27:-14]) / 2
        out |= {"pdi": pdi, "mdi": mdi, "adx": adx, "adxr": adxr}
    trix = nan()
    if n >= 36:
        e3 = ema(ema(ema(close, 12), 12, 11), 12, 22)
        trix[34:] = (e3[34:] / e3[33:-1] - 1) * 100
    out["trix"] = trix
    return out


RECURSIVE = "ema12 ema26 ema50 dif dea bar rsi k dd j skdj_d atr pdi mdi adx adxr trix".split()


def recursive_indicators(bars: DataFrame) -> DataFrame:
    """code, d and the columns RECURSIVE. One exchange by code; a security's history fits a task by far."""

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("d")
        got = recursive_arrays(*(g[c].to_numpy(float) for c in ("high", "low", "close")))
        return pd.DataFrame({"code": g["code"], "d": g["d"], **got})

    schema = "code string, d date, " + ", ".join(f"{c} double" for c in RECURSIVE)
    return bars.select("code", "d", "high", "low", "close").groupBy("code").applyInPandas(kernel, schema)


def _recursive_sql() -> str:
    """The same recursions as one recursive statement, row by row, for the comparison."""

    def step(name: str, at: int, seed: str, x: str, a: str) -> str:
        return f"CASE WHEN b.rn = {at} THEN {seed} WHEN b.rn > {at} THEN ({x}) * {a} + r.{name} * (1 - {a}) END"

    two = lambda p: f"(2.0::DOUBLE / {p + 1})"
    w = "(1.0::DOUBLE / 14)"
    third = "(1.0::DOUBLE / 3)"
    return f"""SELECT code, d, ema12, ema26, ema50, ema12 - ema26 AS dif, dea, (ema12 - ema26 - dea) * 2 AS bar,
  CASE WHEN rn >= 15 THEN CASE WHEN dn = 0 THEN CASE WHEN up = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + up / dn) END END AS rsi,
  k, dd, 3 * k - 2 * dd AS j, skdj_d, atr, CASE WHEN n >= 28 THEN p / t * 100 END AS pdi, CASE WHEN n >= 28 THEN m / t * 100 END AS mdi, CASE WHEN n >= 28 THEN adx END AS adx,
  CASE WHEN n >= 28 AND rn >= 42 THEN (adx + lag(adx, 14) OVER (PARTITION BY code ORDER BY rn)) / 2 END AS adxr,
  CASE WHEN n >= 36 AND rn >= 35 THEN (e3 / lag(e3) OVER (PARTITION BY code ORDER BY rn) - 1) * 100 END AS trix FROM (
WITH RECURSIVE b AS MATERIALIZED (SELECT code, d, rn, close, gain, loss, coalesce(CASE WHEN rn > 1 THEN tr END, 0) AS tr, pdm, mdm, count(*) OVER (PARTITION BY code) AS n,
  avg(close) OVER (PARTITION BY code ORDER BY d ROWS 11 PRECEDING) AS a12, avg(close) OVER (PARTITION BY code ORDER BY d ROWS 25 PRECEDING) AS a26, avg(close) OVER (PARTITION BY code ORDER BY d ROWS 49 PRECEDING) AS a50,
  avg(gain) OVER v AS ag, avg(loss) OVER v AS al, avg(CASE WHEN rn > 1 THEN tr END) OVER (PARTITION BY code ORDER BY d ROWS 12 PRECEDING) AS atr13, avg(tr) OVER v AS tr14, avg(pdm) OVER v AS p14, avg(mdm) OVER v AS m14,
  CASE WHEN max(high) OVER x = min(low) OVER x THEN 50 ELSE (close - min(low) OVER x) / (max(high) OVER x - min(low) OVER x) * 100 END AS rsv
  FROM {{bar_flows}} WINDOW v AS (PARTITION BY code ORDER BY d ROWS 13 PRECEDING), x AS (PARTITION BY code ORDER BY d ROWS 8 PRECEDING)),
r AS (SELECT code, d, rn, n, NULL::DOUBLE AS ema12, NULL::DOUBLE AS ema26, NULL::DOUBLE AS ema50, 0::DOUBLE AS sdif, NULL::DOUBLE AS dea, NULL::DOUBLE AS up, NULL::DOUBLE AS dn, NULL::DOUBLE AS k, NULL::DOUBLE AS dd, NULL::DOUBLE AS skdj_d,
  NULL::DOUBLE AS atr, NULL::DOUBLE AS t, NULL::DOUBLE AS p, NULL::DOUBLE AS m, 0::DOUBLE AS sdx, NULL::DOUBLE AS adx, 0::DOUBLE AS s1, NULL::DOUBLE AS e2, 0::DOUBLE AS s2, NULL::DOUBLE AS e3 FROM b WHERE rn = 1
UNION ALL SELECT code, d, rn, n, ema12, ema26, ema50, sd2 AS sdif, {step("dea", 34, "sd2 / 9", "b.ema12 - b.ema26", two(9)).replace("r.dea", "b.odea")}, up, dn, k, {step("dd", 9, "50", "b.k", third).replace("r.dd", "b.odd")} AS dd2,
  CASE WHEN b.rn = 12 THEN dd3 WHEN b.rn > 12 THEN dd3 * {third} + oskdj * (1 - {third}) END, atr, t, p, m, CASE WHEN rn BETWEEN 15 AND 28 THEN osdx + dx ELSE osdx END, CASE WHEN rn = 28 THEN (osdx + dx) / 14 WHEN rn > 28 THEN dx * {w} + oadx * (1 - {w}) END,
  s1n, e2n, CASE WHEN rn BETWEEN 23 AND 34 THEN os2 + e2n ELSE os2 END, CASE WHEN rn = 34 THEN (os2 + e2n) / 12 WHEN rn > 34 THEN e2n * {two(12)} + oe3 * (1 - {two(12)}) END
  FROM (SELECT *, CASE WHEN rn BETWEEN 26 AND 34 THEN osdif + ema12 - ema26 ELSE osdif END AS sd2, CASE WHEN rn = 9 THEN 50 WHEN rn > 9 THEN k * {third} + odd * (1 - {third}) END AS dd3,
    CASE WHEN p + m > 0 THEN abs(p - m) / (p + m) * 100 ELSE 0 END AS dx, CASE WHEN rn BETWEEN 12 AND 23 THEN os1 + ema12 ELSE os1 END AS s1n, CASE WHEN rn = 23 THEN (os1 + ema12) / 12 WHEN rn > 23 THEN ema12 * {two(12)} + oe2 * (1 - {two(12)}) END AS e2n
    FROM (SELECT b.code, b.d, b.rn, b.n, {step("ema12", 12, "b.a12", "b.close", two(12))} AS ema12, {step("ema26", 26, "b.a26", "b.close", two(26))} AS ema26, {step("ema50", 50, "b.a50", "b.close", two(50))} AS ema50,
      {step("up", 15, "b.ag", "b.gain", w)} AS up, {step("dn", 15, "b.al", "b.loss", w)} AS dn, {step("k", 9, "50", "b.rsv", third)} AS k, {step("atr", 14, "b.atr13", "b.tr", w)} AS atr,
      {step("t", 15, "b.tr14", "b.tr", w)} AS t, {step("p", 15, "b.p14", "b.pdm", w)} AS p, {step("m", 15, "b.m14", "b.mdm", w)} AS m,
      r.sdif AS osdif, r.dea AS odea, r.dd AS odd, r.skdj_d AS oskdj, r.sdx AS osdx, r.adx AS oadx, r.s1 AS os1, r.e2 AS oe2, r.s2 AS os2, r.e3 AS oe3
      FROM r JOIN b ON b.code = r.code AND b.rn = r.rn + 1) b) b)
SELECT * FROM r) z"""


Native("ind_recursive", recursive_indicators, ["bars"], _recursive_sql())
Relation("ind_recursive_q", "SELECT code, d, " + ", ".join(f"{q(c)} AS {c}" for c in RECURSIVE) + " FROM {ind_recursive}")
Relation("ind_lwr", f"SELECT code, d, {q('100 - k')} AS lwr1, {q('100 - dd')} AS lwr2 FROM {{ind_recursive}}")
def extremes(close: np.ndarray, dif: np.ndarray, back: int = 30) -> dict[str, np.ndarray]:
    """DIF 5 bars before, and of the previous 30 bars that have a DIF: their number, lowest and highest close, the DIF there.

    Of equal closes the first bar counts.
    """
    n = len(close)
    out = {"dif5": np.full(n, np.nan), "n_dif": np.zeros(n), **{c: np.full(n, np.nan) for c in ("low_c", "high_c", "low_dif", "high_dif")}}
    out["dif5"][5:] = dif[:-5]
    known = ~np.isnan(dif)
    out["n_dif"] = (np.concatenate([[0], np.cumsum(known)[:-1]]) - np.concatenate([np.zeros(min(n, back + 1)), np.cumsum(known)[: max(0, n - back - 1)]])) if n else out["n_dif"]
    pad = np.concatenate([np.full(back, np.nan), np.where(known, close, np.nan)[:-1], [np.nan]])[: n + back - 1] if n else np.empty(0)
    if n:
        before = np.lib.stride_tricks.sliding_window_view(pad, back)  # row i: bars i - back to i - 1
        some = np.nonzero(out["n_dif"] > 0)[0]
        for c, pick, fill in (("low", np.argmin, np.inf), ("high", np.argmax, -np.inf)):
            at = pick(np.where(np.isnan(before[some]), fill, before[some]), axis=1) + some - back
            out[f"{c}_c"][some], out[f"{c}_dif"][some] = close[at], dif[at]
    return out


#: What a bar has from its security's history before it besides the recursions.
EXTREMES = "dif5 bar3 n_dif low_c high_c low_dif high_dif".split()
_HISTORY = [*RECURSIVE, *EXTREMES]


def _history(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """Columns _HISTORY of rows in order of code and day. The row numbers prove that every code is there from its first bar."""

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        code = rows["code"].to_numpy()
        starts = np.nonzero(np.concatenate([[True], code[1:] != code[:-1]]))[0]
        size = np.diff(np.append(starts, len(code)))
        if not np.array_equal(rows["rn"].to_numpy(), np.arange(1, len(code) + 1) - np.repeat(starts, size)):
            raise ValueError("rows of a code aren't together, or not in order of days")
        out = {c: np.empty(len(code)) for c in _HISTORY}
        high, low, close = (rows[c].to_numpy(float) for c in ("high", "low", "close"))
        for a, b in zip(starts, starts + size, strict=True):
            got = recursive_arrays(high[a:b], low[a:b], close[a:b])
            got |= extremes(close[a:b], got["dif"])
            got["bar3"] = np.concatenate([np.full(3, np.nan), got["bar"][:-3]])[: b - a]
            for c in _HISTORY:
                out[c][a:b] = got[c]
        return pd.DataFrame(out)

    held = None
    for part in parts:
        rows = pd.DataFrame(dict(zip(("code", "rn", "high", "low", "close"), part, strict=True)))
        if not len(rows):
            continue
        rows = pd.concat([held, rows], ignore_index=True) if held is not None else rows
        cut = int((rows["code"].to_numpy() == rows["code"].iloc[-1]).argmax())  # the last code may go on in the next part
        held = rows.iloc[cut:]
        if cut:
            yield done(rows.iloc[:cut])
    if held is not None:
        yield done(held)


def with_history(ind_cci: DataFrame) -> DataFrame:
    """Every indicator of a bar. The windows below leave a task's rows in order of code and day, so the recursions are
    columns of the same rows: nothing is dealt or joined for them. Not deterministic to the planner, so that no filter moves below."""
    history = F.pandas_udf(_history, ", ".join(f"{c} double" for c in _HISTORY)).asNondeterministic()
    rows = ind_cci.withColumn("_h", history("code", "rn", "high", "low", "close"))
    return rows.select(*ind_cci.columns, *(F.col(f"_h.{c}").alias(c) for c in _HISTORY))


#: Every indicator of a bar, for the scoring operators.
Native(
    "ind_all",
    with_history,
    ["ind_cci"],
    "SELECT r.*, " + ", ".join(f"x.{c}" for c in RECURSIVE) + " FROM {ind_cci} r JOIN {ind_recursive} x ON x.code = r.code AND x.d = r.d",
    reads=1,
)
#: How much institutions seem to take part, 0 to 100: steadiness of returns, volume and range over the last 61 bars, in
#: bands that are fixed values; 50 below 60 bars.
Relation(
    "institution_proxy",
    f"""WITH l AS (SELECT code, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS age, ret, volume, (high - low) / close * 100 AS span, count(*) OVER (PARTITION BY code) AS n FROM {{bar_flows}}),
s AS (SELECT code, max(n) AS n, stddev_pop(ret) * 100 AS vol, CASE WHEN avg(volume) > 0 THEN stddev_pop(volume) / avg(volume) * 100 ELSE 100 END AS cv, avg(span) AS amp FROM l WHERE age <= 61 GROUP BY code),
p AS (SELECT *, 50 + CASE WHEN vol < 15 THEN 25 WHEN vol < 25 THEN 15 WHEN vol < 35 THEN 5 WHEN vol > 50 THEN -20 WHEN vol > 40 THEN -10 ELSE 0 END AS a, 50 + CASE WHEN cv < 40 THEN 20 WHEN cv < 70 THEN 10 WHEN cv > 120 THEN -15 WHEN cv > 100 THEN -8 ELSE 0 END AS b, 50 + CASE WHEN amp < 2 THEN 20 WHEN amp < 3 THEN 10 WHEN amp > 5 THEN -15 ELSE 0 END AS c FROM s)
SELECT code, n, {q('vol')} AS vol, {q('cv')} AS cv, {q('amp')} AS amp, CASE WHEN n < 60 THEN 50 ELSE {half_even('a * 0.4 + b * 0.35 + c * 0.25')} END AS proxy FROM p""",
    oracle=f"""WITH x AS (SELECT code, list(close ORDER BY d) AS c, list(volume ORDER BY d) AS v, list((high - low) / close * 100 ORDER BY d) AS a FROM {{bars}} GROUP BY code), y AS (SELECT code, len(c) AS n, list_transform(range(greatest(2, len(c) - 60), len(c) + 1), lambda i: c[i] / c[i - 1] - 1) AS r, v[greatest(1, len(v) - 60):] AS v, a[greatest(1, len(a) - 60):] AS a FROM x),
z AS (SELECT code, n, list_stddev_pop(r) * 100 AS vol, list_stddev_pop(v) / list_avg(v) * 100 AS cv, list_avg(a) AS amp FROM y)
SELECT code, n, {q('vol')} AS vol, {q('cv')} AS cv, {q('amp')} AS amp, CASE WHEN n < 60 THEN 50 ELSE round_even(CAST((50 + [25, 15, 5, 0, -10, -20][1 + (vol >= 15)::INT + (vol >= 25)::INT + (vol >= 35)::INT + (vol > 40)::INT + (vol > 50)::INT]) * 40 + (50 + [20, 10, 0, -8, -15][1 + (cv >= 40)::INT + (cv >= 70)::INT + (cv > 100)::INT + (cv > 120)::INT]) * 35 + (50 + [20, 10, 0, -15][1 + (amp >= 2)::INT + (amp >= 3)::INT + (amp > 5)::INT]) * 25 AS DECIMAL(12, 1)) / 10, 0) / 10 END AS proxy FROM z""",
)
