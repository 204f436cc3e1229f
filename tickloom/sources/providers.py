"""Bars from providers' raw responses, parsed in plans: three layouts, the first that is whole counts.

A response is whole if it has rows and no row lacks a field. Layouts differ in nesting and in the order of prices, which
are fixed values: objects with names; arrays day, open, close, high, low, volume; texts with commas in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.core import Native, Relation

FIELDS = ("day", "open", "high", "low", "close", "volume")
_PLACES = {"day": 0, "open": 1, "high": 3, "low": 4, "close": 2, "volume": 5}


def _row(x: Column) -> Column:
    return F.struct(*[F.get(x, F.lit(_PLACES[f])).alias(f) for f in FIELDS])


def from_objects(raw: Column) -> Column:
    return F.from_json(raw, "array<struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">>")


def from_arrays(raw: Column, symbol: Column) -> Column:
    found = F.from_json(raw, "struct<data:map<string,struct<day:array<array<string>>>>>")["data"]
    return F.transform(F.try_element_at(found, symbol)["day"], _row)


def from_texts(raw: Column) -> Column:
    return F.transform(F.from_json(raw, "struct<data:struct<klines:array<string>>>")["data"]["klines"], lambda x: _row(F.split(x, ",")))


def whole(rows: Column) -> Column:
    """Whether a parsed response has rows, each with all its fields."""
    good = lambda x: F.forall(F.array(*[x[f] for f in FIELDS]), lambda v: F.coalesce(v != "", F.lit(False)))
    return F.coalesce((F.size(rows) > 0) & F.forall(rows, good), F.lit(False))


def symbol(code: Column) -> Column:
    return F.concat(F.when(code.startswith("6"), "sh").otherwise("sz"), code)


def first_whole(responses: DataFrame) -> DataFrame:
    """code, provider, rows (null if none is whole) from the raw texts objects, arrays and texts of each security."""
    parsed = responses.select("code", from_objects(F.col("objects")).alias("objects"), from_arrays(F.col("arrays"), symbol(F.col("code"))).alias("arrays"), from_texts(F.col("texts")).alias("texts"))
    chosen = F.when(whole(F.col("objects")), F.struct(F.lit("objects").alias("provider"), F.col("objects").alias("rows")))
    for name in ("arrays", "texts"):
        chosen = chosen.when(whole(F.col(name)), F.struct(F.lit(name).alias("provider"), F.col(name).alias("rows")))
    return parsed.withColumn("x", chosen).select("code", "x.provider", "x.rows")


def as_bars(chosen: DataFrame) -> DataFrame:
    """Bars of whole responses; what isn't a finite number is null."""
    number = lambda c: F.when(~F.isnan(c.try_cast("double")) & (F.abs(c.try_cast("double")) < float("inf")), c.try_cast("double"))
    rows = chosen.select("code", "provider", F.explode("rows").alias("r"))
    return rows.select("code", "provider", F.try_to_date("r.day", "yyyy-MM-dd").alias("d"), *[number(F.col(f"r.{f}")).alias(f) for f in FIELDS[1:]])


def made_responses(bars: DataFrame) -> DataFrame:
    """Responses for the test bars. By a code's last digit some are broken: no JSON, a short row, an empty field, nothing."""
    b = bars.select("code", F.struct(F.col("d").cast("string").alias("day"), *[F.col(f).cast("string").alias(f) for f in FIELDS[1:]]).alias("r"))
    rows = b.groupBy("code").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    digit = F.substring("code", 6, 1)
    ordered = lambda r: [r[f] for f in sorted(FIELDS, key=_PLACES.get)]
    objects = F.when(digit.isin("1", "2", "3"), F.lit("<html>busy</html>")).when(digit == "4", F.to_json(F.transform("rows", lambda r: r.withField("volume", F.lit(""))))).otherwise(F.to_json("rows"))
    lists = F.transform("rows", lambda r: F.when(digit == "2", F.array(*ordered(r)[:5])).otherwise(F.array(*ordered(r))))
    arrays = F.when(digit == "4", F.lit('{"data":null}')).otherwise(F.concat(F.lit('{"data":{"'), symbol(F.col("code")), F.lit('":{"day":'), F.to_json(lists), F.lit("}}}")))
    texts = F.when(digit == "4", F.lit("{}")).otherwise(F.concat(F.lit('{"data":{"klines":'), F.to_json(F.transform("rows", lambda r: F.concat_ws(",", *ordered(r), F.lit("0.5")))), F.lit("}}")))
    return rows.select("code", objects.alias("objects"), arrays.alias("arrays"), texts.alias("texts"))


_CHOSEN = "CASE WHEN substr(code, 6, 1) IN ('1', '3') THEN 'arrays' WHEN substr(code, 6, 1) = '2' THEN 'texts' WHEN substr(code, 6, 1) <> '4' THEN 'objects' END"
Native("provider_responses", made_responses, ["bars"])
Native("provider_bars", lambda provider_responses: as_bars(first_whole(provider_responses)), ["provider_responses"], f"SELECT code, {_CHOSEN} AS provider, d, open, high, low, close, volume FROM {{bars}} WHERE substr(code, 6, 1) <> '4'")
Native("provider_status", lambda provider_responses: first_whole(provider_responses).select("code", F.coalesce("provider", F.lit("none")).alias("provider"), F.coalesce(F.size("rows"), F.lit(0)).alias("n")), ["provider_responses"], f"SELECT code, coalesce({_CHOSEN}, 'none') AS provider, CAST(CASE WHEN substr(code, 6, 1) = '4' THEN 0 ELSE count(*) END AS INT) AS n FROM {{bars}} GROUP BY code")
#: Values as a report prints them: units of a hundred million, per cent, ratios; a dash where there is none.
Relation(
    "display_values",
    "SELECT code, y, CASE WHEN revenue IS NULL THEN '—' ELSE @format('%.2f亿元', revenue / 1e8) END AS revenue, CASE WHEN core_profit IS NULL THEN '—' ELSE @format('%.2f亿元', core_profit / 1e8) END AS core_profit, CASE WHEN roe IS NULL THEN '—' ELSE @format('%.1f%%', roe) END AS roe, CASE WHEN current_ratio IS NULL THEN '—' ELSE @format('%.2f', current_ratio) END AS current_ratio FROM {report_rows}",
)
