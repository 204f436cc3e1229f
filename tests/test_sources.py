import datetime as dt

from pyspark.sql import functions as F

from tickloom.functions import scalars
from tickloom.sources.bars import SCHEMA, read_bars, upsert, write_bars
from tickloom.streaming.daily import daily_counts, run_daily, upsert_stream

BARS = [("600001", dt.date(2024, 1, k), 1.0, 2.0, 0.5, 1.5, 10.0 * k) for k in range(1, 5)] + [("000002", dt.date(2024, 1, 1), 1.0, 2.0, 0.5, 1.5, None)]


def test_bars_round_trip_and_pushdown(spark, tmp_path):
    df = spark.createDataFrame(BARS, SCHEMA)
    write_bars(df, str(tmp_path / "p"))
    got = read_bars(spark, str(tmp_path / "p"), code="600001", end="2024-01-02")
    assert got.count() == 2 and "PushedFilters: [IsNotNull(code)" in got._jdf.queryExecution().toString()
    for fmt in ("csv", "json"):
        write_bars(df, str(tmp_path / fmt), fmt)
    assert spark.read.json(str(tmp_path / "json")).count() == 5
    assert read_bars(spark, str(tmp_path / "p"), code="nobody").count() == 0


def test_upsert_keeps_or_replaces(spark):
    df = spark.createDataFrame(BARS, SCHEMA)
    new = df.withColumn("close", F.lit(9.0)).limit(100)
    assert upsert(df, new, ["code", "d"], True).filter("close = 9").count() == 5
    assert upsert(df, new, ["code", "d"], False).filter("close = 9").count() == 0
    assert upsert(df.limit(0), new, ["code", "d"], False).count() == 5


def test_scalars(spark):
    df = spark.createDataFrame([("1", "20240131", "nan", "12家机构"), ("600519", "2024-01-31", "1.5", None), (None, "x", "inf", "none")], "c string, d string, x string, t string")
    r = df.select(scalars.security_code(F.col("c")).alias("c"), scalars.parse_day(F.col("d")).alias("d"), scalars.number_or_null(F.col("x")).alias("x"), scalars.institutions(F.col("t")).alias("n"), scalars.closest(F.coalesce("c", F.lit("predct")), ["chart", "predict"]).alias("w")).collect()
    assert [x.c for x in r] == ["000001", "600519", None] and r[0].d == r[1].d == dt.date(2024, 1, 31) and r[2].d is None
    assert [x.x for x in r] == [None, 1.5, None] and [x.n for x in r] == [12, 0, 0] and r[2].w == "predict"
    assert spark.createDataFrame([("600519",), ("300750",)], "c string").filter(scalars.is_main_board(F.col("c"))).count() == 1


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    events.coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    run_daily(spark, str(tmp_path / "in" / "*"), events.schema, str(tmp_path / "check"), str(tmp_path / "out"))
    got = {(r.d, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.d, r.event_type): r.n for r in daily_counts(events).collect()}
    assert got and all(want[k] == n for k, n in got.items())  # days past the watermark only


def test_upsert_stream_touches_only_its_buckets(spark, tmp_path):
    schema = "code string, d int, x double"
    source, target = str(tmp_path / "in"), str(tmp_path / "table")
    rows = {(f"c{k}", 1): float(k) for k in range(40)}

    def send(batch, replace):
        spark.createDataFrame([(c, d, x) for c, d, x in batch], schema).coalesce(1).write.mode("append").parquet(source)
        upsert_stream(spark.readStream.schema(schema).parquet(source), target, ["code", "d"], str(tmp_path / "check"), replace, buckets=8).awaitTermination()

    send([(c, d, x) for (c, d), x in rows.items()], True)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}
    send([("c3", 1, 99.0), ("c3", 1, 98.0), ("c50", 1, 5.0)], True)
    got = {(r.code, r.d): r.x for r in spark.read.parquet(target).collect()}
    assert got == rows | {("c3", 1): 98.0, ("c50", 1): 5.0}
    kept = [p for p in before if p.exists()]
    assert len(kept) >= 6 and all(p.stat().st_mtime_ns == before[p] for p in kept)
    send([("c3", 1, 1.0), ("c60", 1, 2.0)], False)
    got = {(r.code, r.d): r.x for r in spark.read.parquet(target).collect()}
    assert got == rows | {("c3", 1): 98.0, ("c50", 1): 5.0, ("c60", 1): 2.0}
