"""Cross-sections: factors per security, percent ranks per day, composite score, rank IC, quantile groups, scans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import full, windows
from ..functions.scalars import MAIN_BOARD
from ..plans.core import Native, Relation, keep, q

#: Factor weights; a negative weight ranks small values high.
WEIGHTS = {"low_vol": 0.154, "atr_amp": 0.147, "liq_factor": 0.144, "bias_health": 0.101, "boll_health": 0.019, "ma_align": -0.090, "mom_60": -0.085, "pv_corr": -0.084, "mom_250": -0.065, "vol_ratio_health": -0.055, "obv_flow": -0.037, "kdj_health": -0.021}


def adjusted_j(bars: DataFrame) -> DataFrame:
    """J of a KDJ whose smoothings are weighted means over the whole history (com = 2), not seeded ones."""

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("d")
        low, high = g["low"].rolling(9).min(), g["high"].rolling(9).max()
        k = ((g["close"] - low) / (high - low) * 100).ewm(com=2).mean()
        return pd.DataFrame({"code": g["code"], "d": g["d"], "j": 3 * k - 2 * k.ewm(com=2).mean()})

    return bars.select("code", "d", "high", "low", "close").groupBy("code").applyInPandas(kernel, "code string, d date, j double")


Native(
    "factor_j",
    adjusted_j,
    ["bars"],
    """SELECT code, d, 3 * k - 2 * dn / dw AS j FROM (
WITH RECURSIVE b AS MATERIALIZED (SELECT code, d, rn, CASE WHEN rn >= 9 THEN (close - min(low) OVER x) / nullif(max(high) OVER x - min(low) OVER x, 0) * 100 END AS rsv FROM {bar_steps} WINDOW x AS (PARTITION BY code ORDER BY d ROWS 8 PRECEDING)),
r AS (SELECT code, d, rn, rsv AS kn, 1.0::DOUBLE AS kw, rsv AS k, rsv AS dn, 1.0::DOUBLE AS dw FROM b WHERE rn = 9
UNION ALL SELECT code, d, rn, kn, kw, kn / kw, kn / kw + odn * (2.0::DOUBLE / 3), 1 + odw * (2.0::DOUBLE / 3) FROM (SELECT b.code, b.d, b.rn, b.rsv + r.kn * (2.0::DOUBLE / 3) AS kn, 1 + r.kw * (2.0::DOUBLE / 3) AS kw, r.dn AS odn, r.dw AS odw FROM r JOIN b ON b.code = r.code AND b.rn = r.rn + 1) y)
SELECT * FROM r) z UNION ALL SELECT code, d, NULL AS j FROM {bar_steps} WHERE rn < 9""",
)
Relation(
    "factor_values",
    f"""WITH f AS (SELECT code, d, rn, close, volume, c60, c250, ret, ma5, ma10, ma20, ma60, bias6, obv, v5, v20, (close - c20) / c20 AS ret20, {full(20, "stddev_samp(close) OVER w20")} AS s20, {full(20, "stddev_samp(ret) OVER w20", 21)} AS sr20,
  {full(14, "avg(gain) OVER w14", 15)} AS g14, {full(14, "avg(loss) OVER w14", 15)} AS l14, {full(14, "avg(CASE WHEN rn = 1 THEN high - low ELSE tr END) OVER w14")} AS tr14, {full(20, "avg(close * volume) OVER w20")} AS turn, sum(volume) OVER w5 AS v5s, lag(obv, 5) OVER w AS obv5 FROM {{ind_rolling}} {windows(5, 14, 20)})
SELECT f.code, f.d, f.rn, f.close, close / c60 - 1 AS mom_60, close / c250 - 1 AS mom_250, (ma5 / ma10 - 1) + (ma10 / ma20 - 1) + (ma20 / ma60 - 1) AS ma_align,
  100 - 2 * abs(CASE WHEN l14 = 0 THEN CASE WHEN g14 = 0 THEN NULL ELSE 100 END ELSE 100 - 100 / (1 + g14 / l14) END - 50) AS rsi_health, 100 - 200 * abs((close - (ma20 - 2 * s20)) / nullif(4 * s20, 0) - 0.5) AS boll_health, 100 - 2 * abs(j - 50) AS kdj_health, 100 - 200 * abs(close / ma20 - 1) AS bias_health,
  100 - 40 * abs(volume / v5 - 2) AS vol_ratio_health, (obv - obv5) / nullif(v5s, 0) AS obv_flow, ret20 * (v5 / v20 - 1) AS pv_corr, -sr20 * sqrt(252) AS low_vol, -tr14 / close AS atr_amp, -ln(turn) AS liq_factor FROM f JOIN {{factor_j}} x ON x.code = f.code AND x.d = f.d""",
)
_NAMES = [*WEIGHTS, "rsi_health"]
Relation("factors", "SELECT code, d, rn, close, " + ", ".join(f"{q(n, 6)} AS {n}" for n in _NAMES) + " FROM {factor_values}")


def percent_rank(x: str, by: str = "d") -> str:
    """Average rank of x among its peers that have one, as a per cent of their number. All such ranks share one exchange."""
    w = f"PARTITION BY {by} ORDER BY {x} NULLS LAST"
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({w}) + (count(*) OVER ({w} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) * 100 END"


Relation("factor_ranks", "SELECT code, d, " + ", ".join(f"CAST({percent_rank(n)} AS DOUBLE) AS {n}" for n in _NAMES) + " FROM {factor_values} WHERE rn > 250")
_TOTAL = sum(abs(w) for w in WEIGHTS.values())
Relation("composite", "SELECT code, d, " + q("(" + " + ".join(f"CAST({w} AS DOUBLE) * coalesce({n}, 50)" for n, w in WEIGHTS.items()) + f") / CAST({_TOTAL!r} AS DOUBLE)", 6) + " AS score FROM {factor_ranks}")
Relation("factor_ranks_q", "SELECT code, d, " + ", ".join(f"{q(n)} AS {n}" for n in _NAMES) + " FROM {factor_ranks}")
#: The day that scans look at unless told otherwise: the last session on which half of the securities traded. They rank
#: rows of one session only, never a mix of days.
AS_OF = "(SELECT max(d) FROM (SELECT d FROM {bars} GROUP BY d HAVING count(*) * 2 >= (SELECT count(DISTINCT code) FROM {bars})) s)"
#: What a quote must say of a pick: earnings, at a multiple of at most 100, and a price of 5; days by which a score may lag.
STALE_DAYS = 90
_QUOTED = "pe > 0 AND pe <= 100 AND price >= 5"
#: The best twenty of that session, of securities with 300 bars, by composite score; quotes filter after the ranking.
Relation(
    "scan_composite",
    f"""SELECT code, name, d, score, price, pe, market_value, CAST(row_number() OVER (ORDER BY score DESC, code) AS INT) AS place FROM (SELECT c.code, u.name, c.d, score, price, pe, market_value FROM {{composite}} c JOIN {{quotes}} u ON u.code = c.code JOIN (SELECT code, count(*) AS n FROM {{bars}} GROUP BY code HAVING count(*) >= 300) b ON b.code = c.code
  WHERE c.d = {AS_OF} AND {_QUOTED} AND substr(c.code, 1, 3) IN ({", ".join(f"'{p}'" for p in MAIN_BOARD)}) ORDER BY score DESC, c.code LIMIT 20) x""",
)
#: Latest score per security, not much older than the newest (the test bars end far apart), with the same quote filters.
Relation(
    "scan_s_star",
    f"""WITH l AS (SELECT code, d, s_star, gate, m_score, f_score, p_score, q_score, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS age FROM {{scores}} WHERE rn >= 60), m AS (SELECT max(d) AS as_of FROM l)
SELECT l.code, name, l.d, {q("s_star")} AS s_star, gate, m_score, f_score, p_score, q_score, price, pe, market_value FROM l JOIN m ON as_of >= l.d JOIN {{quotes}} u ON u.code = l.code WHERE age = 1 AND @days(as_of, l.d) <= {STALE_DAYS} AND {_QUOTED} AND substr(l.code, 1, 3) IN ({", ".join(f"'{p}'" for p in MAIN_BOARD)}) ORDER BY {q("s_star")} DESC, l.code LIMIT 20""",
)
#: Forward returns in per cent of 1, 2, 5 and 10 bars.
Relation("forward_returns", "SELECT code, d, " + ", ".join(f"(lead(close, {k}) OVER w / close - 1) * 100 AS after_{k}" for k in (1, 2, 5, 10)) + " FROM {bars_jumpy} WINDOW w AS (PARTITION BY code ORDER BY d)")
#: Leaderboard rows, one per security and day (first by reason), without delisted and hardly traded ones, and twelve
#: columns derived from them. The phrases are fixed values.
Relation(
    "leaderboard_features",
    f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY code, list_date ORDER BY reason) AS r FROM {{leaderboard_rows}}),
n AS (SELECT l.*, coalesce(TRY_CAST(nullif(regexp_extract(coalesce(interpretation, ''), '([0-9]+)家机构', 1), '') AS INT), 0) AS n_inst FROM l WHERE r = 1 AND NOT coalesce(position('退' IN name) > 0, false) AND market_turnover > 30000000)
SELECT n.code, n.list_date AS d, greatest(-100, least(100, net_buy_ratio)) AS nbr, lhb_net_buy, pct_change, turnover_rate, n_inst, n_inst > 0 AS is_inst, n_inst = 0 AS is_retail, coalesce(position('买一主买' IN interpretation) > 0, false) AS is_buy1, coalesce(position('连续三个交易日' IN reason) > 0, false) AS is_repeat,
  coalesce(pct_change >= 9.5, false) AS is_limit, coalesce(pct_change >= 5 AND pct_change < 9.5, false) AS is_large, coalesce(lhb_net_buy > 0, false) AS net_buy, ln(1 + abs(lhb_net_buy)) AS net_buy_abs, ln(1 + float_market_cap) AS log_cap, greatest(0, least(1, lhb_turnover / market_turnover)) AS lhb_ratio, after_1, after_2, after_5, after_10
FROM n LEFT JOIN {{forward_returns}} f ON f.code = n.code AND f.d = n.list_date""",
)
Relation("leaderboard_features_q", "SELECT code, d, n_inst, is_inst, is_retail, is_buy1, is_repeat, is_limit, is_large, net_buy, " + ", ".join(f"{q(c)} AS {c}" for c in ("nbr", "lhb_net_buy", "pct_change", "turnover_rate", "net_buy_abs", "log_cap", "lhb_ratio", "after_1", "after_2", "after_5", "after_10")) + " FROM {leaderboard_features}")


def spread_rank(df: DataFrame, group: str, order: list[str], method: str) -> DataFrame:
    """df with ``r``, the rank of each row in its group, for groups that may hold the whole table.

    Rows are dealt by ranges of (group, order), so equal ones meet; a rank is that inside the range plus the rows of the
    ranges before, of which there is one count each. method: "average" of equals, or "first" (the order tells all apart).
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep(df.repartitionByRange(parts, group, order[0]).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(group, "part").agg(F.count("*").alias("n"))
    before = sizes.select(group, "part", F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    w = Window.partitionBy(group, "part").orderBy(*order)
    inside = F.rank().over(w) + (F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2 if method == "average" else F.row_number().over(w)
    return dealt.withColumn("inside", inside).join(F.broadcast(before), [group, "part"]).withColumn("r", F.col("before") + F.col("inside")).drop("part", "inside", "before")


_FEATURES, _LABELS = ("nbr", "lhb_net_buy", "net_buy_abs", "pct_change", "turnover_rate", "log_cap", "lhb_ratio"), ("after_1", "after_2", "after_5", "after_10")


def rank_ic(leaderboard_features: DataFrame) -> DataFrame:
    """feature, label, n, ic: correlation of ranks over the rows that have both; null below 100 rows."""
    pairs = [F.struct(F.lit(f"{f} {y}").alias("pair"), F.col(f).cast("double").alias("x"), F.col(y).alias("y")) for f in _FEATURES for y in _LABELS]
    rows = leaderboard_features.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter("x IS NOT NULL AND y IS NOT NULL")
    both = spread_rank(spread_rank(rows, "pair", ["x"], "average").withColumnRenamed("r", "a"), "pair", ["y"], "average")
    found = both.groupBy("pair").agg(F.count("*").alias("n"), F.when(F.count("*") >= 100, F.corr("a", "r")).alias("ic"))
    return found.select(F.split("pair", " ")[0].alias("feature"), F.split("pair", " ")[1].alias("label"), "n", F.expr(q("ic", 3)).alias("ic"))


Native(
    "rank_ic",
    rank_ic,
    ["leaderboard_features"],
    " UNION ALL ".join(
        f"SELECT '{n}' AS feature, '{y}' AS label, count(*) AS n, CASE WHEN count(*) >= 100 THEN {q('corr(a, b)', 3)} END AS ic FROM (SELECT rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0 AS a, rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS b FROM {{leaderboard_features}} WHERE {n} IS NOT NULL AND {y} IS NOT NULL) t"
        for n in _FEATURES
        for y in _LABELS
    ),
)


def quantile_groups(leaderboard_features: DataFrame, feature: str = "nbr", label: str = "after_5", bins: int = 5) -> DataFrame:
    """bin, n, mean, wins of a label by equal-sized bins of a feature's rank, ties by security and day; empty below 200 rows."""
    rows = leaderboard_features.filter(F.col(feature).isNotNull() & F.col(label).isNotNull()).select(F.lit(0).alias("all"), F.col(feature).alias("x"), "code", "d", F.col(label).alias("y"))
    ranked = spread_rank(rows, "all", ["x", "code", "d"], "first")
    n = ranked.agg(F.count("*").alias("total"))
    found = ranked.crossJoin(F.broadcast(n)).filter("total >= 200").withColumn("bin", F.greatest(F.ceil((F.col("r") - 1) * bins / (F.col("total") - 1)) - 1, F.lit(0)).cast("int"))
    return found.groupBy("bin").agg(F.count("*").alias("n"), F.expr(q("avg(y)")).alias("mean"), F.expr(q("avg(CASE WHEN y > 0 THEN 1.0D ELSE 0.0D END)")).alias("wins"))


Native(
    "quantile_groups",
    quantile_groups,
    ["leaderboard_features"],
    f"""WITH r AS (SELECT after_5, row_number() OVER (ORDER BY nbr, code, d) AS k, count(*) OVER () AS n FROM {{leaderboard_features}} WHERE nbr IS NOT NULL AND after_5 IS NOT NULL)
SELECT CAST(greatest(ceil((k - 1) * 5.0 / (n - 1)) - 1, 0) AS INT) AS bin, count(*) AS n, {q("avg(after_5)")} AS mean, {q("avg(CASE WHEN after_5 > 0 THEN 1.0 ELSE 0.0 END)")} AS wins FROM r WHERE n >= 200 GROUP BY 1""",
)
_CATEGORIES = {"limit": "is_limit", "large": "is_large", "repeat": "is_repeat", "institutions": "is_inst", "others": "is_retail", "first buyer": "is_buy1", "net buying": "net_buy"}
#: Categories overlap; each has its rows, and mean and share of gains after one and five bars.
Relation(
    "category_returns",
    "WITH g AS (" + " UNION ALL ".join(f"SELECT '{c}' AS category" for c in _CATEGORIES) + f") SELECT category, count(*) AS n, {q('avg(after_1)')} AS mean_1, {q('count_if(after_1 > 0) * 100.0 / nullif(count(after_1), 0)')} AS wins_1, {q('avg(after_5)')} AS mean_5, {q('count_if(after_5 > 0) * 100.0 / nullif(count(after_5), 0)')} AS wins_5 FROM {{leaderboard_features}} JOIN g ON CASE category "
    + " ".join(f"WHEN '{c}' THEN {x}" for c, x in _CATEGORIES.items()) + " END GROUP BY category",
    oracle=" UNION ALL ".join(f"SELECT '{c}' AS category, count(*) AS n, {q('avg(after_1)')} AS mean_1, {q('avg(CASE WHEN after_1 > 0 THEN 100.0 WHEN after_1 IS NOT NULL THEN 0.0 END)')} AS wins_1, {q('avg(after_5)')} AS mean_5, {q('avg(CASE WHEN after_5 > 0 THEN 100.0 WHEN after_5 IS NOT NULL THEN 0.0 END)')} AS wins_5 FROM {{leaderboard_features}} WHERE {x} HAVING count(*) > 0" for c, x in _CATEGORIES.items()),
)
#: A batch of backtests: score, signal and trades of every security, in the category of its last digit.
_BATCH = "SELECT p.code, substr(p.code, 6, 1) AS category, p.s_star, p.signal, coalesce(t.trades, 0) AS trades, t.win_rate, t.total_pct FROM {comprehensive_prediction} p LEFT JOIN {backtest_comprehensive_summary} t ON t.code = p.code"
Relation("batch_rows", _BATCH.replace("{comprehensive_prediction}", "{last_scores}"), oracle=_BATCH)
Relation("category_summary", f"SELECT category, count(*) AS n, count_if(signal IN ('strong buy', 'buy')) AS buys, {q('coalesce(avg(s_star), 0)')} AS mean_score, {q('coalesce(avg(CASE WHEN trades > 0 THEN win_rate END), 0)')} AS mean_win_rate, {q('coalesce(avg(CASE WHEN trades > 0 THEN total_pct END), 0)', 3)} AS mean_total FROM {{batch_rows}} GROUP BY category")
Relation("batch_leaders", "SELECT code, category, s_star, signal, trades, win_rate, total_pct, CAST(row_number() OVER (ORDER BY s_star DESC, code) AS INT) AS place FROM (SELECT * FROM {batch_rows} WHERE s_star IS NOT NULL ORDER BY s_star DESC, code LIMIT 20) x")
