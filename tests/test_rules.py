"""Rules that SQL can't be compared with, against plain versions, and rules on rows made by hand."""

import datetime as dt
import statistics

import numpy as np
import pytest

from tickloom import catalog  # noqa: F401  registers the relations
from tickloom.operators.signals import contrarian
from tickloom.plans.core import RELATIONS, half_even

DAY = dt.date(2022, 1, 3)
SCHEMA = "code string, d date, open double, high double, low double, close double, volume double"


def bars_of(code, n, seed):
    r = np.random.default_rng(seed)
    close = 20 * np.exp(np.cumsum(r.normal(0.0005, 0.02, n)) + 0.1 * np.sin(np.arange(n) / (9 + seed)))
    return [(code, DAY + dt.timedelta(days=k), float(c * 0.995), float(c * (1.01 + r.uniform(0, 0.01))), float(c * (0.99 - r.uniform(0, 0.01))), float(c), float(round(r.uniform(50, 400)))) for k, c in enumerate(close)]


@pytest.fixture(scope="module")
def made(spark):
    rows = [x for k, n in enumerate((320, 280, 251, 250, 130, 60, 45, 31, 12)) for x in bars_of(f"60000{k}", n, k)]
    frames = {"bars": spark.createDataFrame(rows, SCHEMA).cache()}

    def get(name):
        if name not in frames:
            r = RELATIONS[name]
            frames[name] = r(**{i: get(i) for i in r.inputs}).cache()
        return frames[name]

    return get


def by_code(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.d):
        out.setdefault(r.code, []).append(r)
    return out


def sub_scores(x, points):
    """The three scores of a list of bars with their indicators, as the rules say."""
    n, c, v, obv = len(x), [b.close for b in x], [b.volume for b in x], [b.obv for b in x]
    last = x[-1]
    mean = lambda s: sum(s) / len(s)
    out = {}
    if n >= 31:
        ma60, ma20, ma10 = mean(c[-60:]), mean(c[-20:]), mean(c[-10:])
        t = 50 + 15 * (c[-1] > ma60) + (20 if ma10 > ma20 > ma60 else 10 if ma10 > ma20 else 0)
        above = lambda a, b: a is not None and b is not None and a > b
        m = 50 + 15 * above(last.dif, last.dea) + 15 * above(last.dif, 0) + 10 * above(last.dif, x[-6].dif) + 10 * (above(last.bar, 0) and above(last.bar, x[-4].bar))
        out["trend"] = (t + m) / 2
        rsi = 50 if last.rsi is None else last.rsi
        a = 50 + (20 if 30 <= rsi <= 70 else 15 if rsi < 30 else -15)
        b = 50 + (20 if last.k > last.dd else -15 if last.k < last.dd else 0) + (15 if last.j < 0 else -15 if last.j > 100 else 0)
        out["momentum"] = a * 0.4 + b * 0.35 + (50 + (15 if last.wr > 80 else -15 if last.wr < 20 else 0)) * 0.25
        ratio = v[-1] / mean(v[-21:-1])
        out["volume"] = (50 + (15 if 1 <= ratio <= 2 else 10 if ratio > 2 else -10 if ratio < 0.5 else 0)) * 0.4 + (50 + (25 if obv[-1] > mean(obv[-21:-1]) else -15)) * 0.35 + (50 + (10 if ratio > 1.5 else -10 if ratio < 0.7 else 0)) * 0.25
        place = (c[-1] - last.boll_l) / (last.boll_u - last.boll_l) * 100
        span = (last.atr or 0) / c[-1] * 100
        out["channel"] = (50 + (15 if 20 <= place <= 80 else 20 if place < 5 else -15 if place > 95 else 0)) * 0.6 + (50 + 15 * (1.5 <= span <= 4)) * 0.4
        high, low = max(b.high for b in x[-60:]), min(b.low for b in x[-60:])
        level = 0 if n < 60 else 10 if c[-1] > low + (high - low) * 0.618 else -10 if c[-1] < low + (high - low) * 0.382 else 0
        out["shape"] = min(100, max(10, 50 + points)) * 0.6 + (50 + level) * 0.4
        out["holders"] = 50 + 15 * (c[-1] > ma20) + (10 if c[-1] > ma60 else -15 if c[-1] < ma60 else 0)
    if n >= 30:
        s = 50 + (20 if mean(obv[-5:]) > mean(obv[-20:]) * 1.05 else -20 if mean(obv[-5:]) < mean(obv[-20:]) * 0.95 else 0)
        out["obv"] = s + (-25 if c[-1] > c[-6] and obv[-1] < obv[-6] else 20 if c[-1] < c[-6] and obv[-1] > obv[-6] else 0)
        steps = [(c[k] - c[k - 1], v[k] > 1.2 * v[k - 1]) for k in range(n - 5, n)]
        out["price_volume"] = min(100, max(10, 50 + sum(5 if up > 0 else -8 if up < 0 else 0 for up, strong in steps if strong)))
        large = float(np.percentile(v[-60:], 70))
        days = [c[k] > c[k - 1] for k in range(max(1, n - 21), n) if v[k] > large]
        share = sum(days) / len(days) if days else 0.5
        ups = sum(up > 0 for up, _ in steps)
        out["flow"] = 50 + (20 if share > 0.6 else 10 if share > 0.5 else -15 if share < 0.4 else 0) + (10 if ups >= 4 else -10 if ups <= 1 else 0)
        moves = statistics.pstdev(c[k] / c[k - 1] - 1 for k in range(n - 11, n)) * 100
        out["event"] = 50 + (25 if moves > 5 else 15 if moves >= 2 else 0)
    if n >= 60:
        high, low = max(c[-250:]), min(c[-250:])
        place = (c[-1] - low) / (high - low) * 100
        out["valuation"] = 50 + (25 if place < 20 else 15 if place < 40 else -20 if place > 80 else -10 if place > 60 else 0)
        year = (c[-1] / c[-251] - 1) * 100 if n > 250 else 0.0
        out["growth"] = 50 + (0 if n < 250 else 25 if year > 30 else 15 if year > 15 else 5 if year > 0 else -10 if year > -15 else -20)
        quarter = (c[-1] / c[-61] - 1) * 100 if n > 60 else 0.0
        gains = sum(c[k] > c[k - 1] for k in range(max(1, n - 60), n))
        out["quality"] = 50 + (25 if quarter > 20 else 15 if quarter > 10 else 5 if quarter > 0 else -5 if quarter > -10 else -15) + 10 * (gains > 35)
    return {k: round(float(x), 1) for k, x in out.items()}


WEIGHTS = {"trend": 0.25, "momentum": 0.2, "volume": 0.2, "channel": 0.15, "shape": 0.1, "holders": 0.1, "obv": 0.3, "price_volume": 0.25, "flow": 0.3, "event": 0.15, "valuation": 0.4, "growth": 0.3, "quality": 0.3}
PARTS = {"technical": list(WEIGHTS)[:6], "game": list(WEIGHTS)[6:10], "fundamental": list(WEIGHTS)[10:]}


def test_sub_scores(made):
    bars, points = by_code(made("ind_all")), {}
    for r in made("patterns").collect():
        points[r.code] = points.get(r.code, 0) + r.points
    got = {r.code: r for r in made("sub_scores").collect()}
    assert set(got) == set(bars)
    for code, x in bars.items():
        want = sub_scores(x, points.get(code, 0))
        for part in WEIGHTS:
            assert (got[code][part] is None) == (part not in want), (code, part)
            assert part not in want or abs(got[code][part] - want[part]) < 0.051, (code, part, got[code][part], want[part])
        for score, parts in PARTS.items():
            total = sum(WEIGHTS[p] * got[code][p] for p in parts) if parts[0] in want else 50
            assert abs(got[code][score] - total) < 1e-3, (code, score)
        assert abs(got[code].total - 0.3 * got[code].technical - 0.45 * got[code].game - 0.25 * got[code].fundamental) < 1e-3


def test_half_even(spark):
    for x, want in ((61.25, 61.2), (61.75, 61.8), (-0.25, -0.2), (0.35, 0.4), (2.04, 2.0), (2.06, 2.1), (-2.06, -2.1)):
        assert spark.sql(f"SELECT {half_even(f'CAST({x} AS DOUBLE)')} AS x").first().x == want, x


def test_contrarian_refuses_a_large_beta(spark):
    from pyspark.sql import functions as F

    for beta in (-0.01, 0.21):
        with pytest.raises(ValueError):
            contrarian(F.lit(50.0), F.lit(10.0), beta)
    assert spark.range(1).select(contrarian(F.lit(50.0), F.lit(250.0), 0.1).alias("x")).first().x == 40.0


def test_value_screen_by_hand(spark):
    rows = []

    def firm(code, cores, flows=(9, 9, 9), roes=(12, 12, 12), debt=50.0, cur=2.0, sales=(3, 2, 1), financial=False):
        rows.extend((code, 2020 - k, None if s is None else float(s), None if c is None else float(c), None if f is None else float(f), None if r is None else float(r), debt, cur, financial and k == 1) for k, (c, f, r, s) in enumerate(zip(cores, flows, roes, sales, strict=False)))

    firm(1, (5, 5, 5)), firm(2, (5, 5)), firm(3, (-1, 5, 5)), firm(4, (5, -5, -5)), firm(5, (5, -9, 5)), firm(6, (-5, -5, None)), firm(7, (5, 5, 5), financial=True)
    firm(8, (5, 5, 5), flows=(1, 1, 1)), firm(9, (5, 5, 5), flows=(9, None, 9)), firm(10, (5, -20, 5), flows=(-30, 1, 1)), firm(11, (5, 5, 5), roes=(4, 3, 12)), firm(12, (5, 5, 5), roes=(None, 12, 12)), firm(13, (5, 5, 5), roes=(7, 7, 20))
    firm(14, (5, 5, 5), debt=90.0, cur=0.5), firm(15, (5, 5, 5), debt=90.0, cur=None), firm(16, (5, 5, 5), debt=None), firm(17, (5, 5, 5), debt=70.0, cur=None), firm(18, (5, 5, 5), sales=(1, 2, 3)), firm(19, (5, 5, 5), sales=(1, None, 3)), firm(20, (5, 5, 5, -9, -9), (9,) * 5, (12,) * 5, sales=(1,) * 5)
    got = {r.code: r for r in RELATIONS["value_screen"](report_rows=spark.createDataFrame(rows, "code long, y int, revenue double, core_profit double, operating_cash_flow double, roe double, debt_ratio double, current_ratio double, financial boolean")).collect()}
    want = {1: "go", 2: "insufficient", 3: "no_go", 4: "no_go", 5: "watch", 6: "watch", 7: "not_applicable", 8: "watch", 9: "watch", 10: "watch", 11: "no_go", 12: "watch", 13: "watch", 14: "no_go", 15: "watch", 16: "watch", 17: "go", 18: "go", 19: "go", 20: "go"}
    assert {k: r.status for k, r in got.items()} == want
    assert (got[6].profit, got[10].cash, got[12].returns, got[16].debt, got[18].sales, got[19].sales, got[2].profit) == ("unavailable", "watch", "unavailable", "unavailable", "watch", "unavailable", None)


def test_decisions_take_the_first_rule_that_holds(spark):
    cases = {  # eligible, gate, layer, rsi, obv_flow, vol, es, known, entry, leave -> not holding, holding
        "a": ((False, True, None, 50, 0, 0.1, 0.01, True, True, False), ("do not buy", 1), ("hold off", 1)),
        "b": ((True, False, None, 96, 0, 0.1, 0.01, True, True, False), ("do not buy", 3), ("hold", 3)),
        "c": ((True, False, None, 50, -0.95, 0.1, 0.01, True, True, True), ("do not buy", 5), ("exit", 3)),
        "d": ((True, True, 5, 50, 0, 0.1, 0.01, True, True, False), ("do not buy", 3), ("hold", 3)),
        "e": ((True, True, 1, 50, 0, 0.1, 0.01, True, False, False), ("do not buy", 3), ("hold", 3)),
        "f": ((True, True, 1, 50, 0, None, 0.01, True, True, False), ("do not buy", 1), ("hold off", 1)),
        "g": ((True, True, 1, 50, 0, 0.2, 0.01, True, True, False), ("buy", 3), ("hold", 3)),
        "h": ((True, True, 1, 50, 0, 0.05, 0.01, False, True, False), ("buy", 5), ("hold off", 1)),
    }
    table = lambda cols, schema: spark.createDataFrame([(c, DAY, *[x[0][k] for k in cols]) for c, x in cases.items() if x[0][cols[0]] is not None], f"code string, d date, {schema}")
    ind = spark.createDataFrame([(c, DAY, 300, float(x[0][3]), float(x[0][4])) for c, x in cases.items()], "code string, d date, rn int, rsi double, obv_flow double")
    risk = spark.createDataFrame([(c, DAY, x[0][5], x[0][6]) for c, x in cases.items()], "code string, d date, annual_vol double, daily_es double")
    out = RELATIONS["decisions"](atom_masks=table((0, 1), "eligible boolean, gate boolean"), fronts=table((2,), "layer int"), ind_all=ind, risk_rows=risk, holding_trend=table((7, 8, 9), "known boolean, entry boolean, leave boolean"))
    got = {(r.code, r.holding): (r.decision, r.stars) for r in out.collect()}
    for c, (_, free, held) in cases.items():
        assert (got[c, False], got[c, True]) == (free, held), c


@pytest.fixture(scope="module")
def account(spark):
    """Bars, actions and calendar of one security, and the ledger of an account that trades, collects and leaves."""
    from tickloom.operators import replay

    days = [dt.date(2023, 8, 1) + dt.timedelta(days=k) for k in range(45)]
    price = [10 + (k % 7) * 0.1 for k in range(45)]
    acts = {12: (0.5, 1.1), 30: (0.2, 1.0)}
    rows = []
    for k, d in enumerate(days):
        cash, mult = acts.get(k, (0.0, 1.0))
        on = 3 <= k < 20 or 24 <= k
        rows.append(("600001", d, k, price[k], price[k] + 0.05, cash, mult, True, False, False, on, on, on, 0.1 if k % 6 else 0.3, 0.01, True, on, not on, price[k - 1] + 0.05 if k else None))
    schema = "code string, d date, ci int, open double, close double, act_cash double, act_mult double, tradable boolean, block_buy boolean, block_sell boolean, front boolean, eligible boolean, gate boolean, vol double, es double, known boolean, entry boolean, leave boolean, prev_close double"
    calendar = spark.createDataFrame([(d, k) for k, d in enumerate(days)], "d date, ci int")
    bars = spark.createDataFrame([("600001", d, p, p + 0.05) for d, p in zip(days, price, strict=True)], "code string, d date, open double, close double")
    actions = spark.createDataFrame([("600001", days[k], *x) for k, x in acts.items()], "code string, ex_date date, cash_per_share double, share_multiplier double")
    ledger = replay.replay(spark.createDataFrame(rows, schema), calendar, "risk").cache()
    return ledger, {"bars": bars, "actions": actions, "calendar": calendar}


def test_verifier_accepts_the_ledger_and_finds_what_is_changed(account):
    from pyspark.sql import functions as F

    ledger, others = account
    fills = ledger.filter("kind IN ('build', 'add', 'reduce', 'exit')")
    assert {r.kind for r in fills.collect()} == {"build", "add", "reduce", "exit"}

    def faults(frame):
        r = RELATIONS["ledger_check"](ledger_all=frame, **others).first().asDict()
        return {k for k, v in r.items() if k not in ("version", "vol_target", "events", "actions", "accounts") and v}

    assert faults(ledger) == set()
    first = {k: fills.filter(f"kind = '{k}'").orderBy("d").first().d for k in ("build", "reduce", "exit")}
    paid = ledger.filter("kind = 'action' AND gross > 0").orderBy("d").first().d

    def changed(column, value, kind, day):
        return ledger.withColumn(column, F.when((F.col("kind") == kind) & (F.col("d") == F.lit(day)), value).otherwise(F.col(column)))

    assert "bad_fee" in faults(changed("fee", F.col("fee") + 1, "reduce", first["reduce"]))
    assert "bad_price" in faults(changed("price", F.col("price") * 1.01, "build", first["build"]))
    assert "bad_lot" in faults(changed("quantity", F.col("quantity") + 50, "build", first["build"]))
    assert "bad_balance" in faults(changed("cash", F.col("cash") + 5, "exit", first["exit"]))
    assert "bad_kind" in faults(changed("kind", F.lit("add"), "build", first["build"]))
    assert "bad_signal" in faults(changed("signal_d", F.col("d"), "build", first["build"]))
    assert "bad_action" in faults(changed("gross", F.col("gross") + 1, "action", paid))
    assert "bad_nav" in faults(changed("nav", F.col("nav") + 1, "close", first["build"]))
    assert "missing_actions" in faults(ledger.filter(~((F.col("kind") == "action") & (F.col("d") == F.lit(paid)))))


def test_check_in_place_finds_what_the_check_of_dealt_events_finds(spark, account):
    from tickloom.operators import replay

    ledger, others = account
    whole, dealt = ledger.toPandas(), spark.createDataFrame([], ledger.schema)
    bars = others["bars"].join(others["actions"].withColumnRenamed("ex_date", "d"), ["code", "d"], "left").selectExpr("d", "open", "close AS bar_close", "cash_per_share AS cps", "share_multiplier AS mult").toPandas()
    events = spark.createDataFrame([], f"{replay.LEDGER}, {replay.FACTS}")
    for k, (column, value, kind) in enumerate([("fee", 99.0, "reduce"), ("price", 1.0, "build"), ("quantity", 50.0, "build"), ("cash", 5.0, "exit"), ("shares", 7.0, "close"), ("kind", "add", "build"), ("gross", 1.0, "action"), ("nav", 1.0, "close"), ("d", None, "")]):
        x = whole.assign(vol_target=float(k))
        if column != "d":
            x.loc[x.index[x["kind"] == kind][0], column] = value
        rows = lambda f: f.astype(object).where(f.notna(), None).values.tolist()
        dealt = dealt.union(spark.createDataFrame(rows(x), ledger.schema))
        events = events.union(spark.createDataFrame(rows(replay.with_facts(x.sample(frac=1, random_state=k), bars)[events.columns]), events.schema))
    want = {r.vol_target: r for r in RELATIONS["ledger_check"](ledger_all=dealt, **others).collect()}
    got = {r.vol_target: r for r in RELATIONS["ledger_check_in_place"](checked_events=events, **others).collect()}
    assert got == want and len(want) == 9
    assert [k for k, r in want.items() if not any(v for c, v in r.asDict().items() if c not in ("version", "vol_target", "events", "actions", "accounts"))] == [8.0]


def test_curve_carries_values_over_missing_bars(spark, account):
    ledger, others = account
    gone = [DAY, dt.date(2023, 8, 20)]
    thin = ledger.withColumn("version", ledger.version).filter(~ledger.d.isin(gone))
    rows = {r.d: r for r in RELATIONS["nav_curve"](ledger_trend=thin, calendar=others["calendar"]).collect()}
    close = {r.d: r.nav for r in ledger.filter("kind = 'close'").collect()}
    assert abs(rows[dt.date(2023, 8, 20)].nav - close[dt.date(2023, 8, 19)]) < 0.02 and abs(rows[dt.date(2023, 8, 25)].nav - close[dt.date(2023, 8, 25)]) < 0.02


def test_dividend_profiles_by_hand(spark):
    ex = dt.date(2022, 5, 5)
    rows = [
        (1, "10送3股转增2派1.5元(含税)", 3.0, 2.0, 1.5, "实施分配", ex, None), (2, "10派2.00元", None, None, 2.0, "实施分配", ex, ex), (3, "10派2.00元", None, None, 2.01, "实施分配", ex, None), (4, "10派2派3", None, None, 2.0, "实施分配", ex, None),
        (5, "不详", None, 0.0, 2.0, "实施分配", ex, None), (6, "10转5", 0.0, 5.0, 0.0, "预案", None, None), (7, "10转5", None, 5.0, None, "实施分配", None, None), (8, "10派0", 0.0, 0.0, 0.0, "实施分配", None, None), (9, "10转5", None, 5.0, None, "实施分配", ex, ex + dt.timedelta(days=1)), (10, "10转5", None, 5.0, None, "?", ex, None), (11, "10转5", None, 5.0, None, "实施分配", dt.date(2019, 1, 1), None),
    ]
    got = {r.k: (r.status, r.cash_per_share, r.share_multiplier) for r in RELATIONS["dividend_text"](dividend_rows=spark.createDataFrame(rows, "k int, profile string, bonus double, transfer double, cash double, progress string, ex_date date, record_date date")).collect()}
    assert got[1] == ("ok", 0.15, 1.5) and got[2] == ("ok", 0.2, 1.0)
    assert {k: v[0] for k, v in got.items() if k > 2} == {3: "conflict", 4: "repeated component", 5: "missing number", 6: "skip", 7: "no ex-date", 8: "skip", 9: "record after ex-date", 10: "unknown progress", 11: "skip"}


def test_comprehensive_trades_by_searching_signals(made):
    """Entry and exit signals are searched one after the other; the kernel walks the bars once."""
    from tickloom.operators.replay import broken_neckline, net_return

    got = {}
    for t in made("backtest_comprehensive").collect():
        got.setdefault(t.code, []).append((t.buy_d, t.sell_d, t.hold, t.reason, round(t.profit_pct, 2)))
    found = 0
    for code, x in by_code(made("scores")).items():
        n, closes, want, at = len(x), [b.close for b in x], [], 60

        def why(k, buy):
            gain, age = net_return(x[buy].open, closes[k]), k - buy
            rules = [("loss", gain < -12), ("gain", gain > 15), ("score", x[k].s_star < 35), ("fading", gain > 12 and x[k].s_star < 50), ("divergence", x[k].top)]
            named = next((name for name, holds in rules if holds), None)
            return named or (broken_neckline(closes[: k + 1]) if age > 10 and age % 5 == 0 else None)

        while True:
            entry = next((k for k in range(at, n - 1) if x[k].dif is not None and x[k].s_star >= 69 and x[k].gate), None)
            leave = None if entry is None else next((k for k in range(entry + 1, n - 1) if why(k, entry + 1)), None)
            if leave is None:
                break
            buy, at = entry + 1, leave + 1
            want.append((x[buy].d, x[at].d, at - buy, why(leave, buy), round(net_return(x[buy].open, x[at].open), 2)))
        assert sorted(got.get(code, [])) == sorted(want), code
        found += len(want)
    assert found >= 5


def test_two_path_by_holdings_of_each_open(made, spark):
    """Final cash once more, with the state as value and cost of the holding at every open."""
    rows = by_code(made("scores"))
    r = np.random.default_rng(3)
    flows = {(b.code, b.d): float(r.uniform(0, 10)) for x in rows.values() for b in x if r.uniform() < 0.8}
    listed = {(b.code, b.d) for x in rows.values() for b in x if r.uniform() < 0.05}
    flow = spark.createDataFrame([(*k, z) for k, z in flows.items()], "code string, d date, z double")
    marks = spark.createDataFrame([(*k, 20.0) for k in listed], "code string, d date, ratio double")
    got = {x.code: x.final for x in RELATIONS["backtest_two_path"](scores=made("scores"), flow_score=flow, leaderboard_signals=marks).collect()}
    moved = 0
    for code, x in rows.items():
        cash, held, price_paid, top, plan, until = 1e6, 0.0, 0.0, 0.0, None, None
        for k in range(60, len(x)):
            b, p = x[k], x[k].open
            if plan is not None:
                change = min(plan - held * p, cash) if plan >= held * p else plan - held * p
                if plan_up and change > 0:
                    price_paid = (price_paid * held + change) / (held + change / p)
                    top = p
                if (change > 0) == plan_up:
                    cash, held = cash - change, held + change / p
                plan = None
                if held < 1e-9:
                    held = price_paid = top = 0.0
            if until is not None and k >= until:
                cash, held, price_paid, top, until = cash + held * p, 0.0, 0.0, 0.0, None
            if b.dif is None or until is not None:
                continue
            score = b.s_star + flows.get((code, b.d), 0.0)
            if not held:
                if (code, b.d) in listed and b.gate:
                    plan, plan_up, until = 1e18, True, k + 2
                elif score >= 69 and b.gate:
                    plan, plan_up = 0.25e6, True
                continue
            share, top = (1 if score >= 85 else 0.75 if score >= 80 else 0.5 if score >= 75 else 0.25), max(top, b.close)
            bound = round(x[k - 1].close * 1.1, 2)
            if share * 1e6 > held * p + 1e-3:
                plan, plan_up = share * 1e6, True
            elif (b.high >= bound > b.close or score < 35) and held * p > 0.51e6:
                plan, plan_up = 0.5e6, False
            elif b.close <= top * 0.92 or b.close <= price_paid * 0.92 or b.close < sum(y.close for y in x[k - 4 : k + 1]) / 5:
                plan, plan_up = 0.0, False
        want = cash + held * x[-1].open
        assert abs(got[code] - want) < 1e-3, code
        moved += abs(want - 1e6) > 1
    assert moved >= 3
