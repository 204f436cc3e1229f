"""Daily bars and what belongs to them: loaders, ingest rules, and the relations that map the test tables to bars.

Bars are (code, d, open, high, low, close, volume): one row per security and session, code a six-digit text. Parquet
scans stay lazy, so date and code predicates reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import MAIN_BOARD
from ..plans.core import Relation, q

SCHEMA = T.StructType([T.StructField("code", T.StringType()), T.StructField("d", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]])


def read_bars(spark: SparkSession, path: str, code: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from Parquet, with pushed-down predicates."""
    df = spark.read.schema(SCHEMA).parquet(path)
    for cond in ((F.col("code") == code) if code else None, (F.col("d") >= F.to_date(F.lit(start))) if start else None, (F.col("d") <= F.to_date(F.lit(end))) if end else None):
        df = df if cond is None else df.filter(cond)
    return df


def write_bars(df: DataFrame, path: str, fmt: str = "parquet", buckets: int = 64) -> None:
    """Parquet partitioned by a bucket of code (co-locates a security's history), or CSV or JSON with one row per bar."""
    if fmt == "parquet":
        df.withColumn("bucket", F.pmod(F.xxhash64("code"), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(path)
    elif fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replace: bool) -> DataFrame:
    """old with the rows of new: on equal keys new wins if replace, else old. One exchange on the keys."""
    from pyspark.sql import Window

    both = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    order = F.col("_p").desc() if replace else F.col("_p").asc()
    w = Window.partitionBy(*keys).orderBy(order, *[F.col(c).asc_nulls_last() for c in old.columns if c not in keys])
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_p")


_WALK = """WITH t AS (SELECT CAST(600000 + l_suppkey AS VARCHAR(10)) AS code, CAST(l_shipdate AS DATE) AS d,
  avg((l_quantity - 25.5) / 25.5) AS r, floor(avg(l_discount) * 1000000 + 0.5) / 1000000 AS a,
  floor(avg(l_tax) * 1000000 + 0.5) / 1000000 AS b, sum(l_quantity) AS v FROM {lineitem} GROUP BY 1, 2),
w AS (SELECT code, d, v, a, b, floor(30 * exp(CAST(STEP AS DOUBLE) *
  sum(floor(r * 1000000 + 0.5) / 1000000) OVER (PARTITION BY code ORDER BY d)) * 10000 + 0.5) / 10000 AS c FROM t),
z AS (SELECT code, d, v, b, c, floor(coalesce(lag(c) OVER (PARTITION BY code ORDER BY d), c)
  * (1 + (a - 0.05) * 0.1) * 10000 + 0.5) / 10000 AS o FROM w)
SELECT code, d, o AS open, floor(greatest(o, c) * (1 + b * 0.1) * 10000 + 0.5) / 10000 AS high,
  floor(least(o, c) * (1 - b * 0.1) * 10000 + 0.5) / 10000 AS low, c AS close, v AS volume FROM z"""

#: In Spark a row is dealt once, by the code of its bar; sums by code and day and the windows over them follow in place.
_KEYS = "CAST(600000 + l_suppkey AS VARCHAR(10)) AS code, CAST(l_shipdate AS DATE) AS d"
_DEALT = _WALK.replace(_KEYS, "code, d").replace("{lineitem}", f"(SELECT /*+ REPARTITION(code) */ {_KEYS}, l_quantity, l_discount, l_tax FROM {{lineitem}}) l")

#: Bars of the test tables: quiet, jumpy (with limit-ups), and on a dense calendar.
Relation("bars_sparse", _DEALT.replace("STEP", "0.03"), oracle=_WALK.replace("STEP", "0.03"))
Relation("bars_jumpy", _DEALT.replace("STEP", "0.12"), oracle=_WALK.replace("STEP", "0.12"))
Relation("bars", "SELECT code, DATE '2022-04-01' + CAST(row_number() OVER (PARTITION BY code ORDER BY d) - 1 AS INT) AS d, open, high, low, close, volume FROM {bars_sparse}")
Relation("calendar", "SELECT d, CAST(row_number() OVER (ORDER BY d) - 1 AS INT) AS ci FROM (SELECT DISTINCT d FROM {bars}) x")
Relation("fund_flow", "SELECT CAST(600000 + l_suppkey AS VARCHAR(10)) AS code, CAST(l_shipdate AS DATE) AS d, sum(CASE l_returnflag WHEN 'N' THEN l_quantity WHEN 'R' THEN -l_quantity ELSE 0 END) AS main_net FROM {lineitem} GROUP BY 1, 2")
#: The same for ranks of a day: a row is dealt once, by its day.
Relation("flow_by_day", f"SELECT code, d, sum(net) AS main_net FROM (SELECT /*+ REPARTITION(d) */ {_KEYS}, CASE l_returnflag WHEN 'N' THEN l_quantity WHEN 'R' THEN -l_quantity ELSE 0 END AS net FROM {{lineitem}}) l GROUP BY 1, 2")
Relation(
    "leaderboard",
    """SELECT CAST(600000 + l_suppkey AS VARCHAR(10)) AS code, CAST(l_shipdate AS DATE) AS list_date, concat(l_returnflag, l_linestatus) AS reason,
  max((l_discount - 0.05) * 800) AS net_buy_ratio, max(l_tax * 200) AS turnover_rate, sum(l_extendedprice) * 1000 AS market_turnover
  FROM {lineitem} WHERE l_orderkey % 11 = 0 GROUP BY 1, 2, 3""",
)
Relation(
    "actions_sparse",
    """SELECT CAST(600000 + l_suppkey AS VARCHAR(10)) AS code, CAST(l_shipdate AS DATE) + CAST(l_orderkey % 7 AS INT) AS ex_date,
  max(l_discount) AS cash_per_share, CAST(max(CASE WHEN l_linenumber = 1 THEN 1.1 ELSE 1.0 END) AS DOUBLE) AS share_multiplier
  FROM {lineitem} WHERE l_orderkey % 97 = 0 GROUP BY 1, 2""",
)
Relation("actions", "SELECT code, d AS ex_date, CAST(0.25 AS DOUBLE) AS cash_per_share, CAST(CASE WHEN CAST(volume AS INT) % 2 = 0 THEN 1.1 ELSE 1.0 END AS DOUBLE) AS share_multiplier FROM {bars} WHERE CAST(volume AS INT) % 41 = 0")
Relation(
    "reports",
    """SELECT o_custkey AS code, year(o_orderdate) AS y, sum(o_totalprice) AS revenue, sum(CASE WHEN o_orderstatus = 'F' THEN -0.1 ELSE 0.1 END * o_totalprice) AS core_profit,
  sum(CASE WHEN o_orderpriority LIKE '1%' THEN -0.1 ELSE 0.1 END * o_totalprice) AS operating_cash_flow, CAST(5 * count(*) AS DOUBLE) AS roe,
  CAST(30 + o_custkey % 60 AS DOUBLE) AS debt_ratio, CAST((o_custkey % 25) / 10.0 AS DOUBLE) AS current_ratio FROM {orders} GROUP BY o_custkey, year(o_orderdate)""",
)
#: The same with gaps, a financial firm here and there, and a year reported twice.
Relation(
    "report_rows",
    """SELECT code, y, CASE WHEN code % 13 = 1 AND y % 2 = 0 THEN NULL ELSE revenue END AS revenue, CASE WHEN code % 17 = 2 AND y % 3 = 0 THEN NULL ELSE core_profit END AS core_profit, CASE WHEN code % 19 = 3 AND y % 3 = 1 THEN NULL ELSE operating_cash_flow END AS operating_cash_flow,
  CASE WHEN code % 11 = 4 AND y % 4 = 1 THEN NULL ELSE roe END AS roe, CASE WHEN code % 23 = 5 THEN NULL ELSE debt_ratio END AS debt_ratio, CASE WHEN code % 7 = 6 THEN NULL ELSE current_ratio END AS current_ratio, code % 29 = 7 AND y % 5 = 0 AS financial FROM {reports}""",
)
#: Quotes of the day: price, earnings multiple (losses are negative, some unknown), market value in hundred millions.
Relation(
    "quotes",
    """SELECT CAST(600000 + s_suppkey AS VARCHAR(10)) AS code, s_name AS name, CAST(3 + s_suppkey % 40 AS DOUBLE) AS price, CASE WHEN s_suppkey % 11 = 5 THEN NULL ELSE CAST(floor(s_acctbal / 60) AS DOUBLE) END AS pe, CAST(10 + s_suppkey % 500 AS DOUBLE) AS market_value FROM {supplier}""",
)
#: Leaderboard rows with all that providers give; the phrases are fixed values.
Relation(
    "leaderboard_rows",
    """SELECT l.code, l.list_date, concat(l.reason, CASE WHEN l.reason LIKE 'A%' THEN '连续三个交易日内涨幅' ELSE '日涨幅' END) AS reason, CASE CAST(floor(turnover_rate) AS INT) % 3 WHEN 0 THEN concat(CAST(1 + CAST(floor(turnover_rate) AS INT) % 4 AS VARCHAR(4)), '家机构买入') WHEN 1 THEN '买一主买' END AS interpretation,
  concat('S', l.code, CASE WHEN l.code LIKE '%9' THEN '退' ELSE '' END) AS name, net_buy_ratio, turnover_rate, market_turnover, net_buy_ratio / 100 * market_turnover AS lhb_net_buy, market_turnover * turnover_rate / 15 AS lhb_turnover, market_turnover * (1 + turnover_rate) AS float_market_cap, pct AS pct_change
FROM {leaderboard} l LEFT JOIN (SELECT code, d, (close / lag(close) OVER (PARTITION BY code ORDER BY d) - 1) * 100 AS pct FROM {bars_jumpy}) b ON b.code = l.code AND b.d = l.list_date""",
)

# ---- scans and ingest ------------------------------------------------------------------------------------------------

Relation("bar_scan", "SELECT code, d, close FROM {bars_sparse} WHERE code = '600003' AND d <= DATE '1996-06-30'")
Relation("bar_days", "SELECT code, min(d) AS first_d, max(d) AS last_d, count(*) AS n FROM {bars_sparse} GROUP BY code")
Relation(
    "bar_invariants",
    """SELECT code, count(*) AS n, count_if(NOT (open > 0 AND high > 0 AND low > 0 AND close > 0)) AS nonpositive, count_if(high < greatest(open, close)) AS high_low,
  count_if(low > least(open, close)) AS low_high, count_if(volume < 0) AS bad_volume, count(*) - count(DISTINCT d) AS repeated FROM {bars_sparse} GROUP BY code""",
)
Relation(
    "bar_upsert_ignore",
    """WITH n AS (SELECT code, d, open + 1 AS open, high + 1 AS high, low + 1 AS low, close + 1 AS close, volume FROM {bars_sparse} WHERE CAST(volume AS INT) % 5 = 0),
o AS (SELECT * FROM {bars_sparse} WHERE CAST(volume AS INT) % 3 <> 0),
u AS (SELECT *, 0 AS p FROM o UNION ALL SELECT *, 1 AS p FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY code, d ORDER BY p) AS k FROM u)
SELECT code, d, open, high, low, close, volume FROM r WHERE k = 1""",
)
Relation(
    "bar_upsert_replace",
    """WITH n AS (SELECT code, d, open + 1 AS open, high + 1 AS high, low + 1 AS low, close + 1 AS close, volume FROM {bars_sparse} WHERE CAST(volume AS INT) % 5 = 0),
o AS (SELECT * FROM {bars_sparse} WHERE CAST(volume AS INT) % 3 <> 0),
u AS (SELECT *, 0 AS p FROM o UNION ALL SELECT *, 1 AS p FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY code, d ORDER BY p DESC) AS k FROM u)
SELECT code, d, open, high, low, close, volume FROM r WHERE k = 1""",
)
Relation("dividend_history", "SELECT code, ex_date, cash_per_share, share_multiplier, CAST(row_number() OVER (PARTITION BY code ORDER BY ex_date DESC) AS INT) AS age FROM {actions_sparse} WHERE ex_date IS NOT NULL")
Relation(
    "universe",
    """SELECT b.code, min(d) AS first_d, max(d) AS last_d, count(*) AS n, coalesce(max(s_name), '') AS name FROM {bars_sparse} b
  LEFT JOIN (SELECT CAST(600000 + s_suppkey AS VARCHAR(10)) AS code, s_name FROM {supplier} WHERE s_suppkey % 7 <> 0) s ON s.code = b.code
  WHERE substr(b.code, 1, 3) IN (""" + ", ".join(f"'{p}'" for p in MAIN_BOARD) + ") GROUP BY b.code",
)
Relation(
    "volume_unit",
    """WITH f AS (SELECT code, d, volume * CASE CAST(substr(code, 6, 1) AS INT) % 4 WHEN 0 THEN 1 WHEN 1 THEN 100 WHEN 2 THEN 0.01 ELSE 37 END AS volume FROM {bars_sparse}),
l AS (SELECT code, max(d) AS last_d FROM {bars_sparse} GROUP BY code),
r AS (SELECT b.code, f.volume / b.volume AS ratio FROM {bars_sparse} b JOIN f ON f.code = b.code AND f.d = b.d JOIN l ON l.code = b.code WHERE b.d < l.last_d AND b.volume > 0 AND f.volume > 0),
m AS (SELECT code, count(*) AS days, bool_and(abs(ratio - 1) <= 0.01 * greatest(ratio, 1)) AS one, bool_and(abs(ratio - 100) <= 0.01 * greatest(ratio, 100)) AS hundred, bool_and(abs(ratio - 0.01) <= 0.01 * greatest(ratio, 0.01)) AS hundredth FROM r GROUP BY code)
SELECT code, days, CAST(CASE WHEN days < 3 THEN NULL WHEN one THEN 1 WHEN hundred THEN 100 WHEN hundredth THEN 0.01 END AS DOUBLE) AS unit FROM m""",
)
Relation(
    "action_conflicts",
    """WITH e AS (SELECT CAST(600000 + l_suppkey AS VARCHAR(10)) AS code, CAST(l_shipdate AS DATE) AS ex_date, CASE WHEN l_discount > 0.05 THEN 2 ELSE 1 END AS cash FROM {lineitem})
SELECT code, ex_date, count(*) AS n, min(cash) AS cash, count(DISTINCT cash) > 1 AS conflict FROM e GROUP BY code, ex_date""",
)
Relation(
    "action_sources",
    """WITH p AS (SELECT code, ex_date, cash_per_share AS cash, CASE WHEN cash_per_share > 0.08 THEN NULL ELSE share_multiplier > 1 END AS rights FROM {actions_sparse} WHERE cash_per_share > 0.02),
s AS (SELECT code, ex_date, cash_per_share AS cash, CASE WHEN cash_per_share < 0.04 THEN NULL ELSE cash_per_share > 0.07 END AS rights FROM {actions_sparse} WHERE cash_per_share < 0.09)
SELECT coalesce(p.code, s.code) AS code, coalesce(p.ex_date, s.ex_date) AS ex_date, coalesce(p.cash, s.cash) AS cash, p.rights OR s.rights AS rights,
  CASE WHEN p.code IS NULL THEN 'secondary' WHEN s.code IS NULL THEN 'primary' ELSE 'both' END AS origin, (p.rights OR s.rights) IS NULL AS unknown
FROM p FULL OUTER JOIN s ON p.code = s.code AND p.ex_date = s.ex_date""",
)
Relation(
    "rights_overlap",
    """WITH r AS (SELECT code, ex_date, least(ex_date, ex_date + CAST(cash_per_share * 100 AS INT)) AS a, greatest(ex_date, ex_date + CAST(cash_per_share * 300 AS INT)) AS z, cash_per_share AS issue FROM {actions_sparse})
SELECT code, ex_date, issue, a <= DATE '1996-12-31' AND z >= DATE '1995-01-01' AS overlaps, issue > 0 AS issued FROM r""",
)
# ---- provider rows: bars, dividends, rights, coverage -----------------------------------------------------------------

#: A provider's bars at half past two of the last session: exact and conflicting repeats, broken and future rows.
Relation(
    "bar_feed",
    """WITH b AS (SELECT code, d, open, high, low, close, volume, row_number() OVER (PARTITION BY code ORDER BY d) AS k FROM {bars}), e AS (SELECT b.*, substr(code, 6, 1) AS digit FROM b)
SELECT code, d, open, high, low, close, volume FROM e UNION ALL SELECT code, d, open, high, low, close + CASE WHEN digit = '2' AND k = 9 THEN 0.01 ELSE 0 END, volume FROM e WHERE digit IN ('1', '2') AND k % 3 = 0
UNION ALL SELECT code, d + 1000, open, high, low, close, volume FROM e WHERE digit = '3' AND k = 5 UNION ALL SELECT code, d - 30, open, low, high, close, volume FROM e WHERE digit = '4' AND k = 5 UNION ALL SELECT code, d - 4000, open, high, low, close, volume FROM e WHERE digit = '5' AND k <= 3""",
)
#: Per security: whether the feed stands, why not, and what is kept. Equal repeats are one row, others reject the feed; so
#: do broken ranges and future days. The session of ``now`` counts from 15:00 on, and history from its first day.
NOW, HISTORY_FROM = "TIMESTAMP '2023-11-08 14:30:00'", "DATE '2015-01-01'"
Relation(
    "bar_ingest",
    f"""WITH u AS (SELECT code, d, open, high, low, close, volume, count(*) AS copies FROM {{bar_feed}} GROUP BY code, d, open, high, low, close, volume), x AS (SELECT *, count(*) OVER (PARTITION BY code, d) AS versions FROM u),
s AS (SELECT code, count_if(d > CAST({NOW} AS DATE)) AS future, count_if(NOT (open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0 AND high >= greatest(open, low, close) AND low <= least(open, high, close))) AS broken, count_if(versions > 1) AS conflicting, sum(copies - 1) AS repeats,
  count_if(d = CAST({NOW} AS DATE) AND hour({NOW}) < 15) AS unfinished, count_if(d >= {HISTORY_FROM} AND NOT (d = CAST({NOW} AS DATE) AND hour({NOW}) < 15)) AS bars, min(CASE WHEN d >= {HISTORY_FROM} THEN d END) AS first_d FROM x GROUP BY code)
SELECT code, CASE WHEN future > 0 THEN 'future' WHEN broken > 0 THEN 'invalid' WHEN conflicting > 0 THEN 'conflict' WHEN bars = 0 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN future + broken + conflicting = 0 THEN bars ELSE 0 END AS kept, CAST(repeats AS BIGINT) AS repeats, unfinished > 0 AS unfinished, first_d FROM s""",
    oracle=f"""WITH f AS (SELECT DISTINCT * FROM {{bar_feed}}), d AS (SELECT code, d, count(*) AS v FROM f GROUP BY ALL), j AS (SELECT code, bool_or(d > DATE '2023-11-08') AS future, bool_or(least(open, high, low, close) <= 0 OR high <> greatest(open, high, low, close) OR low <> least(open, high, low, close)) AS broken FROM f GROUP BY code)
SELECT j.code, CASE WHEN future THEN 'future' WHEN broken THEN 'invalid' WHEN max(v) > 1 THEN 'conflict' WHEN count(*) FILTER (d.d >= {HISTORY_FROM} AND d.d <> DATE '2023-11-08') = 0 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN future OR broken OR max(v) > 1 THEN 0 ELSE count(*) FILTER (d.d >= {HISTORY_FROM} AND d.d <> DATE '2023-11-08') END AS kept,
  (SELECT count(*) FROM {{bar_feed}} r WHERE r.code = j.code) - (SELECT count(*) FROM f r WHERE r.code = j.code) AS repeats, bool_or(d.d = DATE '2023-11-08') AS unfinished, min(d.d) FILTER (d.d >= {HISTORY_FROM}) AS first_d FROM j JOIN d USING (code) GROUP BY j.code, future, broken""",
)
#: Dividend rows as a provider prints them: a profile per ten shares, and its numbers, which may be missing or disagree.
#: Words of the profile and of the progress are fixed values.
Relation(
    "dividend_rows",
    """SELECT p_partkey AS k, concat('10', CASE WHEN p_size % 3 = 0 THEN concat('送', CAST(p_size % 5 AS VARCHAR(9)), '股') ELSE '' END, CASE WHEN p_size % 4 = 1 THEN concat('转增', CAST(p_size % 7 AS VARCHAR(9)), '.5') ELSE '' END, CASE WHEN p_size % 2 = 0 THEN concat('派', CAST(p_size AS VARCHAR(9)), '.25元') ELSE '' END, CASE WHEN p_size = 10 THEN '派1' WHEN p_size = 21 THEN '?' ELSE '' END, '(含税)') AS profile,
  CASE WHEN p_size % 3 = 0 THEN CAST(p_size % 5 AS DOUBLE) WHEN p_partkey % 2 = 0 THEN NULL ELSE CAST(0 AS DOUBLE) END AS bonus, CASE WHEN p_size % 4 = 1 THEN p_size % 7 + CAST(0.5 AS DOUBLE) ELSE NULL END AS transfer, CASE WHEN p_size % 2 = 0 THEN p_size + CASE WHEN p_partkey % 9 = 0 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.254 AS DOUBLE) END WHEN p_partkey % 2 = 0 THEN NULL ELSE CAST(0 AS DOUBLE) END AS cash,
  CASE p_partkey % 8 WHEN 0 THEN '预案' WHEN 1 THEN '不分配' WHEN 2 THEN '搁置' ELSE '实施分配' END AS progress, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE DATE '2020-01-01' + CAST(p_partkey % 2000 AS INT) END AS ex_date, CASE WHEN p_partkey % 13 = 0 THEN DATE '2030-01-01' ELSE DATE '2020-01-01' END AS record_date FROM {part}""",
)
_NUMBER = "([0-9]+(?:[.][0-9]+)?)(?:股|元)?"
_FROM, _TO = "DATE '2021-01-01'", "DATE '2024-12-31'"


def _component(name: str, words: str, mark: str) -> str:
    """SQL columns of a profile's component: its number (0 if it isn't there), the tolerance of its digits, and a repeat."""
    text = f"regexp_extract(main, '{words}{_NUMBER}', 1)"
    digits = f"CASE WHEN position('.' IN {text}) > 0 THEN greatest(2, length({text}) - position('.' IN {text})) ELSE 2 END"
    return f"coalesce(TRY_CAST(nullif({text}, '') AS DOUBLE), 0) AS p_{name}, CASE WHEN {text} = '' THEN 1e-10 ELSE 0.5 * power(CAST(10 AS DOUBLE), -({digits})) + 1e-10 END AS t_{name}, length(main) - length(replace(main, '{mark}', '')) > 1 AS again_{name}"


_TOKEN = f"(?:送|转增|转|派){_NUMBER}"
#: Cash per share and share multiplier of a dividend row, or why it has none. A missing number is 0 only if the profile can
#: be read as a whole and doesn't name it; a number that differs from the profile by more than its digits allow is an error.
Relation(
    "dividend_text",
    f"""WITH m AS (SELECT *, regexp_extract(regexp_replace(regexp_replace(profile, '[（(].*$', ''), '[ ]', ''), '^10(.*)$', 1) AS main FROM {{dividend_rows}}),
c AS (SELECT *, {_component('bonus', '送', '送')}, {_component('transfer', '(?:转增|转)', '转')}, {_component('cash', '派', '派')}, main <> '' AND regexp_replace(regexp_replace(regexp_replace(main, '{_TOKEN}', ''), '{_TOKEN}', ''), '{_TOKEN}', '') = '' AS known FROM m),
v AS (SELECT *, {", ".join(f"CASE WHEN {n} IS NULL AND known AND p_{n} = 0 THEN 0 ELSE {n} END AS v_{n}" for n in ("bonus", "transfer", "cash"))} FROM c),
e AS (SELECT *, CASE WHEN progress IN ('预案', '董事会预案', '股东大会预案', '股东大会通过', '不分配', '取消分配', '取消') THEN 'skip' WHEN progress <> '实施分配' THEN 'unknown progress' WHEN again_bonus OR again_transfer OR again_cash THEN 'repeated component' WHEN v_bonus IS NULL OR v_transfer IS NULL OR v_cash IS NULL THEN 'missing number'
  WHEN known AND ({" OR ".join(f"abs(v_{n} - p_{n}) > t_{n}" for n in ("bonus", "transfer", "cash"))}) THEN 'conflict' WHEN ex_date IS NULL AND v_cash = 0 AND v_bonus + v_transfer = 0 THEN 'skip' WHEN ex_date IS NULL THEN 'no ex-date' WHEN ex_date < {_FROM} OR ex_date > {_TO} THEN 'skip' WHEN record_date > ex_date THEN 'record after ex-date' ELSE 'ok' END AS status FROM v)
SELECT k, status, CASE WHEN status = 'ok' THEN {q('v_cash / 10', 6)} END AS cash_per_share, CASE WHEN status = 'ok' THEN {q('1 + (v_bonus + v_transfer) / 10', 6)} END AS share_multiplier FROM e""",
)
#: Evidence that a security's actions are known: every given gate must hold, gates that aren't given are open.
Relation(
    "coverage",
    """SELECT code, max(d) AS last_d, min(d) AS first_d, CASE substr(code, 6, 1) WHEN '1' THEN 'error' ELSE 'ok' END AS status, CASE substr(code, 6, 1) WHEN '2' THEN true WHEN '3' THEN NULL ELSE false END AS rights, CASE substr(code, 6, 1) WHEN '4' THEN true ELSE false END AS blocked, CASE substr(code, 6, 1) WHEN '5' THEN false WHEN '6' THEN NULL ELSE true END AS matches_quote,
  CASE substr(code, 6, 1) WHEN '7' THEN false ELSE true END AS complete, CASE substr(code, 5, 1) WHEN '1' THEN min(d) + 1 WHEN '2' THEN NULL ELSE min(d) END AS covered_from, CASE substr(code, 5, 1) WHEN '3' THEN max(d) - 1 WHEN '4' THEN DATE '2030-01-01' ELSE max(d) END AS covered_to, CASE substr(code, 5, 1) WHEN '5' THEN max(d) - 1 WHEN '6' THEN NULL ELSE max(d) END AS quote_d FROM {bars} GROUP BY code""",
)
Relation(
    "verified_actions",
    """WITH t AS (SELECT max(d) AS today FROM {bars}), e AS (SELECT code, bool_and(ex_date <= today AND cash_per_share >= 0 AND share_multiplier > 0) AS sound FROM {actions} JOIN t ON today IS NOT NULL GROUP BY code)
SELECT c.code, coalesce(status = 'ok' AND rights = false AND blocked = false, false) AND coalesce(matches_quote, true) AND coalesce(complete, true) AND coalesce(covered_from <= first_d, true) AND coalesce(covered_to >= last_d AND covered_to <= today, true) AND coalesce(quote_d = last_d, true) AND coalesce(sound, true) AS verified
FROM {coverage} c JOIN t ON today IS NOT NULL LEFT JOIN e ON e.code = c.code""",
)
#: Rows as canonical JSON (keys in order, no spaces) with their digest, paths hidden, amounts with separators.
Relation(
    "canonical_rows",
    """WITH j AS (SELECT s_suppkey AS k, concat(chr(123), '"code":"', CAST(600000 + s_suppkey AS VARCHAR(10)), '","nation":', CAST(s_nationkey AS VARCHAR(10)), ',"positive":', CASE WHEN s_acctbal > 0 THEN 'true' ELSE 'false' END, chr(125)) AS body, concat('saved in /home/user_', CAST(s_suppkey AS VARCHAR(10)), '/runs/x.json, again') AS note, CAST(floor(abs(s_acctbal)) AS BIGINT) AS units FROM {supplier})
SELECT k, body, sha256_hex, regexp_replace(note, '(?:/home|/Users|/tmp|/mnt|/var)/[^ ,]+', '<path>') AS note, CASE WHEN units >= 1000 THEN concat(CAST(CAST(floor(units / 1000) AS BIGINT) AS VARCHAR(20)), ',', lpad(CAST(units % 1000 AS VARCHAR(3)), 3, '0')) ELSE CAST(units AS VARCHAR(20)) END AS amount FROM (SELECT *, @sha256(body) AS sha256_hex FROM j) x""",
)
#: Names of securities, the newest row of each with a name that isn't blank; older ones stay where the new has none.
Relation(
    "name_upsert",
    """WITH o AS (SELECT CAST(600000 + s_suppkey AS VARCHAR(10)) AS code, s_name AS name, 0 AS version FROM {supplier}), n AS (SELECT CAST(600000 + c_custkey AS VARCHAR(10)) AS code, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END AS name, 1 AS version FROM {customer} WHERE c_custkey % 3 = 0),
u AS (SELECT * FROM o UNION ALL SELECT * FROM n WHERE trim(name) <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY version DESC) AS k FROM u) SELECT code, name FROM r WHERE k = 1""",
)
#: Runs of one kind a day: the newest of a day is current, older ones that didn't finish are superseded by it.
Relation(
    "run_states",
    """WITH r AS (SELECT o_orderkey AS run_id, o_custkey % 7 AS kind, o_orderdate AS day, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'running' END AS state FROM {orders}), x AS (SELECT *, row_number() OVER (PARTITION BY kind, day ORDER BY run_id DESC) AS age FROM r)
SELECT run_id, kind, CASE WHEN age > 1 AND state = 'running' THEN 'superseded' ELSE state END AS state, age = 1 AS current FROM x""",
)
Relation("adj_factor", "SELECT a.code, a.d, CAST(floor(a.close / b.close * 1000000 + 0.5) AS DOUBLE) / 1000000 AS factor FROM {bars_jumpy} a JOIN {bars_sparse} b ON a.code = b.code AND a.d = b.d WHERE abs(a.close / b.close - 1) > 0.000001")
Relation(
    "months",
    """WITH m AS (SELECT DISTINCT CAST(year(d) AS INT) AS y, CAST(month(d) AS INT) AS m FROM {bars_sparse}) SELECT y, m, make_date(y, m, 1) AS first_d, last_day(make_date(y, m, 1)) AS last_d FROM m""",
)
#: Jobs of ten runs in every state, with what a finished one measured.
Relation(
    "jobs",
    """SELECT o_custkey % 10 AS run_id, o_orderkey AS code, status, CASE WHEN status = 'success' THEN CASE o_orderkey % 4 WHEN 0 THEN 'insufficient_history' WHEN 1 THEN 'stale_history' ELSE 'eligible' END WHEN status = 'failed' THEN 'fetch_failed' END AS result_status,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) END AS win_rate_pct, CAST(o_custkey % 41 AS DOUBLE) - 20 AS price_return_pct, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 9 AS BIGINT) END AS trade_count, CAST(o_orderkey % 4 AS BIGINT) AS win_count
FROM (SELECT *, CASE WHEN o_custkey % 10 = 3 OR o_orderstatus = 'O' THEN 'success' WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'running' END AS status FROM {orders}) o""",
)
#: The thirteen measures of a run, its state, and the win rate over all trades.
Relation(
    "run_progress",
    f"""SELECT run_id, CASE WHEN count(*) = count_if(status = 'success') THEN 'completed' ELSE 'running' END AS state, count(*) AS total, count_if(status = 'success') AS success, count_if(status = 'failed') AS failed, count_if(status = 'pending') AS pending, count_if(status = 'running') AS running,
  count_if(result_status = 'eligible') AS eligible, count_if(result_status = 'insufficient_history') AS insufficient, count_if(result_status = 'stale_history') AS stale, count_if(result_status = 'fetch_failed') AS fetch_failed,
  {q("coalesce(avg(CASE WHEN status = 'success' AND result_status = 'eligible' THEN win_rate_pct END), 0)")} AS mean_win_rate, {q("coalesce(avg(CASE WHEN status = 'success' AND result_status = 'eligible' THEN price_return_pct END), 0)")} AS mean_return,
  CAST(coalesce(sum(CASE WHEN status = 'success' THEN trade_count END), 0) AS BIGINT) AS trades, CAST(coalesce(sum(CASE WHEN status = 'success' THEN win_count END), 0) AS BIGINT) AS wins,
  {q("coalesce(sum(CASE WHEN status = 'success' THEN win_count END) * 100.0 / nullif(sum(CASE WHEN status = 'success' THEN trade_count END), 0), 0)")} AS win_rate
FROM {{jobs}} GROUP BY run_id""",
)
Relation("claim_order", "SELECT run_id, code, place FROM (SELECT o_custkey % 10 AS run_id, o_orderkey AS code, CAST(row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderdate, o_totalprice, o_orderkey) AS INT) AS place FROM {orders}) x WHERE place <= 20")
