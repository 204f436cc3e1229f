"""Votes, atoms, scores and predictions from the indicators of a bar.

All rules are CASE columns over one row, so they stay in generated code. A missing indicator fails every comparison, as
NULL does, and falls to the ELSE branch. Thresholds and weights below are fixed values of the rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.core import RELATIONS, Native, Relation, half_even, q, variant


def vote(bull: str, bear: str) -> str:
    return f"CASE WHEN {bull} THEN 1 WHEN {bear} THEN -1 ELSE 0 END"


#: The 18 auxiliary votes, in order, with their bullish and bearish conditions.
VOTES = {
    "dmi": ("pdi > mdi AND adx > 20", "mdi > pdi AND adx > 20"),
    "cci": ("cci < -100", "cci > 100"),
    "bias6": ("bias6 < -3", "bias6 > 5"),
    "bias12": ("bias12 < -5", "bias12 > 8"),
    "expma": ("ema12 > ema50 AND close > ema12", "ema12 < ema50 AND close < ema12"),
    "bbi": ("close > bbi", "close < bbi"),
    "trix": ("trix > 0.05", "trix < -0.05"),
    "vr": ("vr < 70", "vr > 350"),
    "br": ("br < 60", "br > 300"),
    "ar": ("ar < 60", "ar > 200"),
    "cr": ("cr < 50", "cr > 300"),
    "dma": ("dma > 0 AND close > ma10", "dma < 0 AND close < ma20"),
    "dpo": ("dpo < -0.05 * close", "dpo > 0.05 * close"),
    "mtm": ("mtm > 0", "mtm < 0"),
    "skdj": ("dd < 20 OR (dd > skdj_d AND dd < 50)", "dd > 80 OR (dd < skdj_d AND dd > 50)"),
    "lwr": ("100 - k > 80 AND 100 - dd > 70", "100 - k < 20 AND 100 - dd < 30"),
    "ene": ("(close - ene_l) / (ene_u - ene_l) * 100 < 10", "(close - ene_l) / (ene_u - ene_l) * 100 > 90"),
    "lon": ("(close - lon_l) / nullif(lon_u - lon_l, 0) * 100 < 20", "(close - lon_l) / nullif(lon_u - lon_l, 0) * 100 > 80"),
}
_SUM = " + ".join(f"v_{n}" for n in VOTES)

Relation("votes18", "SELECT code, d, rn, " + ", ".join(f"CASE WHEN rn < 60 THEN 0 ELSE {vote(*c)} END AS v_{n}" for n, c in VOTES.items()) + " FROM {ind_all}")
Relation("consensus", f"SELECT code, d, CAST(floor(({_SUM}) / 18.0 * 1000 + 0.5) AS DOUBLE) / 10 AS consensus, CAST({' + '.join(f'CASE WHEN v_{n} > 0 THEN 1 ELSE 0 END' for n in VOTES)} AS INT) AS bulls, CAST({' + '.join(f'CASE WHEN v_{n} < 0 THEN 1 ELSE 0 END' for n in VOTES)} AS INT) AS bears FROM {{votes18}}")
Relation("vote_panel", "SELECT code, d, bulls, bears, consensus, CASE WHEN bulls + bears > 0 THEN CAST(floor(bulls * 1000.0 / (bulls + bears) + 0.5) AS DOUBLE) / 10 END AS bull_pct FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS age FROM {consensus}) x WHERE age = 1")


def contrarian(base: Column, consensus: Column, beta: float = 0.08) -> Column:
    """A small correction of a score against the consensus of the votes."""
    if not 0 <= beta <= 0.2:
        raise ValueError("beta must be in [0, 0.2]")
    return base - F.lit(float(beta)) * F.greatest(F.lit(-100.0), F.least(F.lit(100.0), consensus))


Native(
    "contrarian",
    lambda scores: scores.select("code", "d", *[(F.floor(contrarian(F.col("base"), F.col("consensus"), b / 100) * 10000 + 0.4137).cast("double") / 10000).alias(f"beta_{b:02d}") for b in (0, 8, 20)]),
    ["scores"],
    "SELECT code, d, " + ", ".join(f"{q(f'base - {b / 100}::DOUBLE * CASE WHEN consensus > 100 THEN 100 WHEN consensus < -100 THEN -100 ELSE consensus END')} AS beta_{b:02d}" for b in (0, 8, 20)) + " FROM {scores}",
)

#: Price extremes of the previous 30 bars that have a DIF, and the DIF there; the first of equals counts. In Spark they come
#: with the recursions, whose rows are in order anyway.
_PREV = "PARTITION BY code ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING"
Native(
    "signal_base",
    lambda ind_all: ind_all,
    ["ind_all"],
    f"""SELECT i.*, lag(dif, 5) OVER w AS dif5, lag(bar, 3) OVER w AS bar3, count(dif) OVER p AS n_dif, min(CASE WHEN dif IS NOT NULL THEN close END) OVER p AS low_c, max(CASE WHEN dif IS NOT NULL THEN close END) OVER p AS high_c,
  min_by(dif, CASE WHEN dif IS NOT NULL THEN @pair(close, rn) END) OVER p AS low_dif, max_by(dif, CASE WHEN dif IS NOT NULL THEN @pair(close, -rn) END) OVER p AS high_dif
FROM {{ind_all}} i WINDOW w AS (PARTITION BY code ORDER BY d), p AS ({_PREV})""",
    reads=1,
)
Relation(
    "signal_rows",
    """SELECT b.*, coalesce(n_dif >= 5 AND close > low_c * 1.03 AND dif > low_dif, false) AS bottom, coalesce(n_dif >= 5 AND close >= high_c * 0.98 AND dif < high_dif * 0.9, false) AS top,
  coalesce(rsi, 50) AS rv, coalesce(k, 50) AS kv, coalesce(dd, 50) AS dv, coalesce(j, 50) AS jv, coalesce(wr, 50) AS wv, coalesce((close - boll_l) / nullif(boll_u - boll_l, 0) * 100, 50) AS bp,
  CASE WHEN rn >= 250 THEN CASE WHEN h250 = l250 THEN 50 ELSE (close - l250) / (h250 - l250) * 100 END END AS pos250, (close - c250) / c250 * 100 AS chg250, coalesce(close - c5, 0) AS chg5, (close - c5) / c5 * 100 AS ret5, (close - c20) / c20 * 100 AS ret20 FROM {signal_base} b""",
)
Relation("divergences", "SELECT code, d, bottom, top FROM {signal_rows} WHERE bottom OR top")

#: The 16 core atoms, in order; the 18 votes follow.
ATOMS = {
    "m_dif_dea": "CASE WHEN dif > dea THEN 1 ELSE -1 END",
    "m_dif_zero": "CASE WHEN dif > 0 THEN 1 ELSE -1 END",
    "m_dif_slope": "CASE WHEN dif > dif5 THEN 1 ELSE -1 END",
    "m_bar_trend": "CASE WHEN bar > bar3 THEN 1 ELSE 0 END",
    "m_low_repair": "CASE WHEN bottom THEN 1 ELSE 0 END",
    "m_top_weak": "CASE WHEN top THEN -1 ELSE 0 END",
    "f_rsi": "CASE WHEN rv <= 65 THEN 1 WHEN rv > 70 THEN -1 ELSE 0 END",
    "f_k_d": vote("kv > dv", "kv < dv"),
    "f_j": vote("jv < 0", "jv > 100"),
    "f_boll": vote("bp < 10", "bp > 90"),
    "f_wr": vote("wv > 80", "wv < 20"),
    "p_pos250": vote("pos250 < 40", "pos250 > 80"),
    "p_ret250": vote("chg250 > 20", "chg250 < -20"),
    "q_flow": vote("obv_flow > 0.4", "obv_flow < -0.4"),
    "q_price_volume": "CASE WHEN chg5 > 0 AND obv_flow < -0.2 THEN -1 WHEN chg5 < 0 AND obv_flow > 0.2 THEN 1 ELSE 0 END",
    "q_institution": "CASE WHEN rn <= 60 THEN 0 WHEN ret5 < -3 AND vol61 < 25 THEN 1 WHEN ret20 < -10 AND vol61 < 25 THEN 1 WHEN ret5 < -3 AND vol61 > 40 THEN -1 ELSE 0 END",
}
_ALL = [*ATOMS, *(f"v_{n}" for n in VOTES)]
_INLINE = ", ".join(f"CASE WHEN rn < 60 THEN 0 ELSE {vote(*c)} END AS v_{n}" for n, c in VOTES.items())
Relation(
    "atoms",
    "SELECT code, d, " + ", ".join(f"{x} AS {n}" for n, x in ATOMS.items()) + f", {_INLINE}, coalesce(rn > 250 AND volume > 0 AND rsi IS NOT NULL, false) AS eligible, coalesce(rsi <= 92 AND obv_flow >= -0.6, false) AS gate FROM {{signal_rows}}",
)
#: Each row's atoms as two bit masks: not negative, and positive.
Relation(
    "atom_masks",
    "SELECT code, d, eligible, gate, " + " + ".join(f"CASE WHEN {n} >= 0 THEN CAST({1 << k} AS BIGINT) ELSE 0 END" for k, n in enumerate(_ALL)) + " AS nn, "
    + " + ".join(f"CASE WHEN {n} > 0 THEN CAST({1 << k} AS BIGINT) ELSE 0 END" for k, n in enumerate(_ALL)) + " AS pos FROM {atoms}",
)

#: The same with what decisions read of the bar besides.
_BESIDE = "rn, rsi, obv_flow"
Relation("wide_atoms", RELATIONS["atoms"].sql.replace("SELECT code, d, ", f"SELECT code, d, {_BESIDE}, ", 1))
Relation("wide_masks", RELATIONS["atom_masks"].sql.replace("SELECT code, d, ", f"SELECT code, d, {_BESIDE}, ", 1).replace("{atoms}", "{wide_atoms}"))

# ---- the four-part score ---------------------------------------------------------------------------------------------

#: Rules and points of the comprehensive score, each part from a base of 50.
RULES = {
    "m": ["CASE WHEN dif > dea THEN 15 ELSE -15 END", "CASE WHEN dif > 0 THEN 12 ELSE -8 END", "CASE WHEN dif > dif5 THEN 8 ELSE -5 END", "CASE WHEN bar > bar3 THEN 5 ELSE 0 END", "CASE WHEN bottom THEN 10 ELSE 0 END", "CASE WHEN top THEN -15 ELSE 0 END"],
    "f": ["CASE WHEN rv < 30 THEN 15 WHEN rv <= 65 THEN 10 WHEN rv > 80 THEN -15 WHEN rv > 70 THEN -8 ELSE 0 END", "CASE WHEN kv > dv THEN 10 WHEN kv < dv THEN -8 ELSE 0 END", "CASE WHEN jv < 0 THEN 8 WHEN jv > 100 THEN -8 ELSE 0 END", "CASE WHEN bp < 10 THEN 12 WHEN bp > 90 THEN -8 ELSE 0 END", "CASE WHEN wv > 80 THEN 8 WHEN wv < 20 THEN -8 ELSE 0 END"],
    "p": ["CASE WHEN pos250 < 25 THEN 20 WHEN pos250 < 40 THEN 10 WHEN pos250 > 80 THEN -15 ELSE 0 END", "CASE WHEN chg250 > 20 THEN 10 WHEN chg250 < -20 THEN -10 ELSE 0 END"],
    "q": ["CASE WHEN obv_flow > 0.4 THEN 12 WHEN obv_flow < -0.4 THEN -12 ELSE 0 END", "CASE WHEN chg5 > 0 AND obv_flow < -0.2 THEN -18 WHEN chg5 < 0 AND obv_flow > 0.2 THEN 12 ELSE 0 END", "CASE WHEN rn <= 60 THEN 0 WHEN ret5 < -3 AND vol61 < 25 THEN 10 WHEN ret20 < -10 AND vol61 < 25 THEN 15 WHEN ret5 < -3 AND vol61 > 40 THEN -8 ELSE 0 END"],
}
Relation("score_parts", "SELECT code, d, rn, open, close, high, top, dif, rsi, rv, obv_flow, CAST(floor((" + _SUM + ") / 18.0 * 1000 + 0.5) AS DOUBLE) / 10 AS consensus, " + ", ".join("50 + " + " + ".join(r) + f" AS {p}_score" for p, r in RULES.items()) + f" FROM (SELECT s.*, {_INLINE} FROM {{signal_rows}} s) x")
Relation("scores", "SELECT x.*, CAST(0.40 * m_score + 0.30 * f_score + 0.15 * p_score + 0.15 * q_score AS DOUBLE) AS base, CAST(0.40 * m_score + 0.30 * f_score + 0.15 * p_score + 0.15 * q_score - 0.08 * consensus AS DOUBLE) AS s_star, coalesce(obv_flow >= -0.6 AND rv <= 92 AND NOT (m_score < 35 AND f_score < 40), false) AS gate FROM {score_parts} x")
#: The same with indicators that are shown beside the score of a last bar, so that they needn't be joined to it.
Relation("wide_parts", RELATIONS["score_parts"].sql.replace("SELECT code, d, rn,", "SELECT code, d, rn, ma5, ma20, ma60, ma250, wr, boll_u, boll_l, vol61, c5, c20,", 1))
Relation("wide_scores", RELATIONS["scores"].sql.replace("{score_parts}", "{wide_parts}"))
#: What walks of scores read of a bar.
Relation("score_rows", "SELECT code, d, rn, open, close, dif, s_star, gate, top FROM {scores}")
Relation("comprehensive_score", f"SELECT code, d, m_score, f_score, p_score, q_score, consensus, {q('base')} AS base, {q('s_star')} AS s_star, gate FROM {{scores}} WHERE dif IS NOT NULL")


_LABELS = {"signal": ("strong buy", "buy", "hold", "reduce", "sell"), "action": ("buy", "buy", "wait", "do not buy", "do not buy"), "action_held": ("add", "keep", "reduce", "reduce", "sell")}


def actions(x: str, steps: tuple[float, ...], vetoed: str | None = None) -> str:
    """Signal, and action of who doesn't hold and who does, by four thresholds of a score; a veto waits."""
    out = []
    for name, labels in _LABELS.items():
        cases = [f"WHEN {vetoed} THEN '{'veto' if name == 'signal' else 'wait'}'"] if vetoed else []
        cases += [f"WHEN {x} >= {t} THEN '{label}'" for t, label in zip(steps, labels, strict=False)]
        out.append(f"CASE {' '.join(cases)} ELSE '{labels[-1]}' END AS {name}")
    return ", ".join(out)


#: The state at the last bar, from 60 bars on: score and parts, signal and actions, which gates failed, key levels.
_PREDICTION = (
    f"SELECT x.code, x.d, {q('x.close')} AS close, m_score, f_score, p_score, q_score, {q('base')} AS base, {q('s_star - base')} AS adjustment, {q('s_star')} AS s_star, gate, {actions('s_star', (70, 69, 50, 40), 'NOT gate')}"
    + f""", coalesce(x.obv_flow < -0.6, false) AS flow_failed, coalesce(rv > 92, false) AS rsi_failed, m_score < 35 AND f_score < 40 AS both_weak, top AS top_divergence, {q('ma20')} AS ma20, {q('ma60')} AS ma60, {q('boll_u')} AS boll_u, {q('boll_l')} AS boll_l,
  CASE WHEN x.rn > 60 THEN {half_even('vol61')} END AS vol_60, CASE WHEN x.rn > 60 THEN {half_even('(x.close / c5 - 1) * 100')} END AS ret_5, CASE WHEN x.rn > 60 THEN {half_even('(x.close / c20 - 1) * 100')} END AS ret_20
FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS age FROM {{scores}}) x JOIN {{ind_all}} i ON i.code = x.code AND i.d = x.d WHERE age = 1 AND x.rn >= 60"""
)
_WIDE = _PREDICTION.replace(" JOIN {ind_all} i ON i.code = x.code AND i.d = x.d", "").replace("{scores}", "{wide_scores}")
Relation("comprehensive_prediction", _WIDE, oracle=_PREDICTION)
#: Of it what batches read.
Relation("last_scores", f"SELECT code, {q('s_star')} AS s_star, {actions('s_star', (70, 69, 50, 40), 'NOT gate')} FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS age FROM {{score_rows}}) x WHERE age = 1 AND rn >= 60")
_PLACES = [(p, k, r) for p, rules in RULES.items() for k, r in enumerate(rules)]
#: Points of each rule at the last bar: its row is found once, then repeated for the sixteen rules.
Relation(
    "rule_breakdown",
    "WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS age FROM {signal_rows}) x WHERE age = 1), g AS (" + " UNION ALL ".join(f"SELECT '{p}' AS part, {k} AS place" for p, k, _ in _PLACES) + ") SELECT code, d, part, place, CASE "
    + " ".join(f"WHEN part = '{p}' AND place = {k} THEN {r}" for p, k, r in _PLACES) + " END AS points FROM l JOIN g ON place >= 0",
    oracle="SELECT code, d, part, place, points FROM (" + " UNION ALL ".join(f"SELECT code, d, rn, '{p}' AS part, {k} AS place, {r} AS points, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS age FROM {{signal_rows}}" for p, k, r in _PLACES) + ") x WHERE age = 1",
)
_SNAPSHOT = f"SELECT s.code, s.d, {q('s.close')} AS close, {q('i.ma5')} AS ma5, {q('i.ma250')} AS ma250, {q('i.rsi')} AS rsi14, {q('i.wr')} AS wr10, {q('s.s_star')} AS s_star, s.gate, s.consensus FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS age FROM {{scores}} WHERE rn >= 60) s JOIN {{ind_all}} i ON i.code = s.code AND i.d = s.d WHERE s.age = 1"
Relation("feature_snapshot", _SNAPSHOT.replace(" JOIN {ind_all} i ON i.code = s.code AND i.d = s.d", "").replace("(i.", "(s.").replace("{scores}", "{wide_scores}"), oracle=_SNAPSHOT)

#: Points of the multifactor score (backtest rules).
Relation(
    "multifactor_score",
    """SELECT code, d, rn, close, rsi, CASE WHEN rsi < 25 THEN 3 WHEN rsi < 35 THEN 2 WHEN rsi < 45 THEN 1 WHEN rsi > 80 THEN -3 WHEN rsi > 70 THEN -2 WHEN rsi > 60 THEN -1 ELSE 0 END
  + CASE WHEN k > dd AND pk <= pd THEN CASE WHEN k < 50 THEN 3 ELSE 2 END WHEN k < dd AND pk >= pd THEN CASE WHEN k > 50 THEN -3 ELSE -2 END WHEN k > dd THEN 1 ELSE -1 END
  + CASE WHEN j < 0 THEN 2 WHEN j > 100 THEN -2 ELSE 0 END + CASE WHEN close < boll_l THEN 2 WHEN close > boll_u THEN -1 ELSE 0 END + CASE WHEN wr > 85 THEN 2 WHEN wr < 15 THEN -2 ELSE 0 END + CASE WHEN close > ma20 THEN 1 ELSE -1 END AS score
FROM (SELECT i.*, lag(k) OVER w AS pk, lag(dd) OVER w AS pd FROM {ind_all} i WINDOW w AS (PARTITION BY code ORDER BY d)) x WHERE rn > 30""",
)
#: Points of the predictor, whose bands are not the backtest's.
_POINTS = """CASE WHEN rsi < 35 THEN 2 WHEN rsi > 70 THEN -2 WHEN rsi < 50 THEN 1 ELSE -1 END + CASE WHEN coalesce(k, 50) > coalesce(dd, 50) THEN 2 ELSE -2 END + CASE WHEN j < 0 THEN 2 WHEN j > 100 THEN -2 ELSE 0 END
  + CASE WHEN close < coalesce(boll_l, close * 0.9) THEN 2 WHEN close > coalesce(boll_u, close * 1.1) THEN -1 ELSE 0 END + CASE WHEN wr > 80 THEN 1 WHEN wr < 20 THEN -1 ELSE 0 END + CASE WHEN close > ma20 THEN 1 ELSE -1 END"""
#: The state at the last bar with an RSI, from the 36th on.
Relation(
    "multifactor_prediction",
    f"SELECT code, d, score, {actions('score', (4, 2, 0, -2))}, coalesce(volume > v20 * 1.3, false) AS volume_boost, {q('ma20')} AS ma20 FROM (SELECT code, d, volume, v20, ma20, {_POINTS} AS score FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS age FROM {{ind_all}} WHERE rsi IS NOT NULL) x WHERE age = 1 AND rn > 35) y",
    oracle=f"""WITH l AS (SELECT i.* FROM {{ind_all}} i JOIN (SELECT code, max(rn) AS rn FROM {{ind_all}} WHERE rsi IS NOT NULL GROUP BY code) m USING (code, rn) WHERE rn >= 36),
p AS (SELECT *, [2, 1, -1, -2][1 + (rsi >= 35)::INT + (rsi >= 50)::INT + (rsi > 70)::INT] + [-2, 2][1 + (coalesce(k, 50) > coalesce(dd, 50))::INT] + coalesce([2, 0, -2][1 + (j >= 0)::INT + (j > 100)::INT], 0) + CASE WHEN close < boll_l THEN 2 WHEN close > boll_u THEN -1 ELSE 0 END + [-1, 0, 1][1 + (coalesce(wr, 50) >= 20)::INT + (coalesce(wr, 50) > 80)::INT] + [-1, 1][1 + coalesce(close > ma20, false)::INT] AS score FROM l)
SELECT code, d, score::INT AS score, ['sell', 'reduce', 'hold', 'buy', 'strong buy'][1 + (score >= -2)::INT + (score >= 0)::INT + (score >= 2)::INT + (score >= 4)::INT] AS signal, ['do not buy', 'do not buy', 'wait', 'buy', 'buy'][1 + (score >= -2)::INT + (score >= 0)::INT + (score >= 2)::INT + (score >= 4)::INT] AS action,
  ['sell', 'reduce', 'reduce', 'keep', 'add'][1 + (score >= -2)::INT + (score >= 0)::INT + (score >= 2)::INT + (score >= 4)::INT] AS action_held, coalesce(volume > v20 * 1.3, false) AS volume_boost, {q('ma20')} AS ma20 FROM p""",
)

# ---- regimes, cycles, whole-history divergences ----------------------------------------------------------------------

#: A regime changes when five raw labels in a row agree: it is the label of the last such run.
Relation(
    "regime",
    """WITH m AS (SELECT code, d, rn, close, ma60, lag(ma60, 10) OVER (PARTITION BY code ORDER BY d) AS before FROM {ind_rolling}),
r AS (SELECT code, d, rn, CASE WHEN rn > 70 AND close > ma60 AND ma60 > before THEN 1 ELSE 0 END AS bull FROM m),
s AS (SELECT code, d, rn, bull, sum(bull) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS five FROM r),
t AS (SELECT code, d, bull, CASE WHEN rn > 5 AND five = 5 THEN rn WHEN rn <= 5 OR five = 0 THEN -rn END AS mark FROM s),
u AS (SELECT code, d, max(abs(mark)) OVER (PARTITION BY code ORDER BY d) AS turn, max(mark) OVER (PARTITION BY code ORDER BY d) AS last_bull FROM t)
SELECT code, d, CASE WHEN last_bull = turn THEN 'bull' ELSE 'bear' END AS regime FROM u""",
)
#: What relations on DIF read of a bar, and the regime on the same rows.
Relation("macd_rows", "SELECT code, d, rn, close, ma60, dif, dea, bar FROM {ind_all}")
_REGIME = variant("regime", "macd", {"ind_rolling": "macd_rows"})
#: Segments of the sign of DIF. A segment starts where DIF crosses or leaves zero; the last is still going on.
Relation(
    "zero_cycles",
    """WITH x AS (SELECT code, d, rn, dif, lag(dif) OVER (PARTITION BY code ORDER BY d) AS pdif FROM {ind_all}),
e AS (SELECT code, d, rn, CASE WHEN pdif <= 0 AND dif > 0 THEN 'above' WHEN pdif >= 0 AND dif < 0 THEN 'below' END AS zone FROM x WHERE rn > 34),
s AS (SELECT code, d, rn, zone, lag(zone) OVER (PARTITION BY code ORDER BY d) AS before, lead(rn) OVER (PARTITION BY code ORDER BY d) AS next_rn, lead(zone) OVER (PARTITION BY code ORDER BY d) AS next_zone FROM e WHERE zone IS NOT NULL),
n AS (SELECT code, max(rn) AS n FROM x GROUP BY code)
SELECT s.code, s.d AS start_d, zone, CAST(coalesce(next_rn, n + 1) - rn AS INT) AS duration, next_rn IS NULL AS ongoing FROM s JOIN n ON n.code = s.code WHERE next_zone IS NULL OR next_zone <> zone""",
)
#: Looks back from a new 60-bar extreme; later bars can change which mark of a cluster stays (not causal, kept apart).
_DIVERGENCES = (
    """WITH x AS (SELECT code, d, rn, close, dif, count(dif) OVER s AS n, max(close) OVER p AS hi, min(close) OVER p AS lo, avg(close) OVER h AS mean_c, max(dif) OVER h AS max_dif, min(dif) OVER h AS min_dif FROM {ind_all}
  WINDOW s AS (PARTITION BY code ORDER BY d ROWS BETWEEN 60 PRECEDING AND CURRENT ROW), p AS (PARTITION BY code ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), h AS (PARTITION BY code ORDER BY d ROWS BETWEEN 60 PRECEDING AND 31 PRECEDING)),
e AS (SELECT code, d, rn, dif, 'top' AS kind, dif AS o FROM x WHERE rn > 94 AND n = 61 AND close > hi AND close > mean_c AND dif < max_dif * 0.95 UNION ALL SELECT code, d, rn, dif, 'bottom' AS kind, -dif AS o FROM x WHERE rn > 94 AND n = 61 AND close < lo AND close < mean_c AND dif > min_dif * 1.05),
g AS (SELECT *, CASE WHEN rn - lag(rn) OVER (PARTITION BY code, kind ORDER BY rn) <= 20 THEN 0 ELSE 1 END AS fresh FROM e),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY code, kind ORDER BY rn) AS cluster FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY code, kind, cluster ORDER BY o DESC, rn) AS k FROM c)
SELECT code, d, kind FROM r WHERE k = 1"""
)
Relation("divergences_legacy", _DIVERGENCES.replace("{ind_all}", "{macd_rows}"), oracle=_DIVERGENCES)
#: The state at the last bar with a DIF, from the 36th on: slopes over 5 and 10 bars, days until lines cross at that
#: pace, and whether the last whole-history top of 120 days is being outrun by price but not by DIF.
Relation(
    "macd_prediction",
    f"""WITH x AS (SELECT code, d, rn, close, dif, dea, bar, lag(bar) OVER w AS bar1, lag(dif, 5) OVER w AS dif5, lag(dif, 10) OVER w AS dif10 FROM {{macd_rows}} WINDOW w AS (PARTITION BY code ORDER BY d)),
l AS (SELECT x.*, r.regime, dif - dif5 AS s5, dif - dif10 AS s10 FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS age FROM x WHERE dif IS NOT NULL) x JOIN {{{_REGIME}}} r ON r.code = x.code AND r.d = x.d WHERE age = 1 AND rn > 35),
v AS (SELECT v.code, v.d, v.kind, i.close, i.dif FROM {{divergences_legacy}} v JOIN {{macd_rows}} i ON i.code = v.code AND i.d = v.d),
t AS (SELECT l.code, count_if(v.kind = 'top') AS tops, count_if(v.kind = 'bottom') AS bottoms, max(CASE WHEN v.kind = 'top' THEN v.d END) AS top_d, max_by(v.close, CASE WHEN v.kind = 'top' THEN v.d END) AS top_close, max_by(v.dif, CASE WHEN v.kind = 'top' THEN v.d END) AS top_dif FROM l JOIN v ON v.code = l.code WHERE @days(l.d, v.d) < 120 GROUP BY l.code),
s AS (SELECT l.*, coalesce(tops, 0) AS tops, coalesce(bottoms, 0) AS bottoms, top_d, coalesce(l.close > top_close AND l.dif < top_dif, false) AS diverging FROM l LEFT JOIN t ON t.code = l.code),
p AS (SELECT *, CASE WHEN dif > dea THEN 2 ELSE -2 END + CASE WHEN dif > 0 THEN 1 ELSE -1 END + CASE WHEN regime = 'bull' THEN 2 ELSE -2 END + CASE WHEN s5 > 0 THEN 1 WHEN s5 <= 0 THEN -1 ELSE 0 END - CASE WHEN diverging THEN 3 ELSE 0 END AS score FROM s)
SELECT code, d, score, {actions('score', (4, 2, 0, -2))}, CASE WHEN dif > dea AND s5 < 0 THEN 'dead cross' WHEN NOT dif > dea AND s5 > 0 THEN 'golden cross' END AS cross_kind, CASE WHEN (dif > dea AND s5 < 0) OR (NOT dif > dea AND s5 > 0) THEN CAST(floor(abs(dif - dea) / abs(s5 / 5)) AS BIGINT) END AS cross_days,
  CASE WHEN dif > 0 AND s10 < 0 THEN 'below zero' WHEN NOT dif > 0 AND s10 > 0 THEN 'above zero' END AS zero_kind, CASE WHEN (dif > 0 AND s10 < 0) OR (NOT dif > 0 AND s10 > 0) THEN CAST(floor(abs(dif) / abs(s10 / 10)) AS BIGINT) END AS zero_days, CASE WHEN bar < 0 AND bar > bar1 THEN 'bears weaken' WHEN bar > 0 AND bar < bar1 THEN 'bulls weaken' END AS bar_trend,
  tops, bottoms, diverging, @days(d, top_d) AS last_top_days FROM p""",
    oracle="""WITH a AS (SELECT code, list(struct_pack(d := d, rn := rn, c := close, f := dif, e := dea, b := bar) ORDER BY d) AS x FROM {ind_all} WHERE dif IS NOT NULL GROUP BY code), l AS (SELECT code, x[-1] AS n, x[-1].f - x[-6].f AS s5, x[-1].f - x[-11].f AS s10, x[-2].b AS b1 FROM a WHERE x[-1].rn > 35),
v AS (SELECT l.code, list(struct_pack(d := t.d, c := i.close, f := i.dif) ORDER BY t.d) FILTER (t.kind = 'top') AS tops, count(*) FILTER (t.kind = 'bottom') AS bottoms FROM l JOIN {divergences_legacy} t ON t.code = l.code AND date_diff('day', t.d, l.n.d) < 120 JOIN {ind_all} i ON i.code = t.code AND i.d = t.d GROUP BY l.code),
p AS (SELECT l.*, r.regime, coalesce(len(tops), 0) AS tops_, coalesce(bottoms, 0) AS bottoms_, tops[-1] AS top FROM l JOIN {regime} r ON r.code = l.code AND r.d = l.n.d LEFT JOIN v ON v.code = l.code),
q AS (SELECT *, coalesce(n.c > top.c AND n.f < top.f, false) AS diverging, n.f > n.e AS golden FROM p),
z AS (SELECT *, CAST((CASE WHEN golden THEN 2 ELSE -2 END) + (CASE WHEN n.f > 0 THEN 1 ELSE -1 END) + (CASE regime WHEN 'bull' THEN 2 ELSE -2 END) + (CASE WHEN s5 > 0 THEN 1 ELSE -1 END) - 3 * diverging::INT AS INT) AS score FROM q)
SELECT code, n.d AS d, score, ['sell', 'reduce', 'hold', 'buy', 'strong buy'][1 + (score >= -2)::INT + (score >= 0)::INT + (score >= 2)::INT + (score >= 4)::INT] AS signal, ['do not buy', 'do not buy', 'wait', 'buy', 'buy'][1 + (score >= -2)::INT + (score >= 0)::INT + (score >= 2)::INT + (score >= 4)::INT] AS action, ['sell', 'reduce', 'reduce', 'keep', 'add'][1 + (score >= -2)::INT + (score >= 0)::INT + (score >= 2)::INT + (score >= 4)::INT] AS action_held,
  CASE WHEN golden AND s5 < 0 THEN 'dead cross' WHEN NOT golden AND s5 > 0 THEN 'golden cross' END AS cross_kind, CASE WHEN golden = (s5 < 0) AND s5 <> 0 THEN floor(abs(n.f - n.e) / (abs(s5) / 5))::BIGINT END AS cross_days, CASE WHEN n.f > 0 AND s10 < 0 THEN 'below zero' WHEN n.f <= 0 AND s10 > 0 THEN 'above zero' END AS zero_kind,
  CASE WHEN (n.f > 0) = (s10 < 0) AND s10 <> 0 THEN floor(abs(n.f) / (abs(s10) / 10))::BIGINT END AS zero_days, CASE WHEN n.b < 0 AND n.b > b1 THEN 'bears weaken' WHEN n.b > 0 AND n.b < b1 THEN 'bulls weaken' END AS bar_trend, tops_ AS tops, bottoms_ AS bottoms, diverging, date_diff('day', top.d, n.d) AS last_top_days FROM z""",
)
