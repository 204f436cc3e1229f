"""Scalar functions of the data layer, and one relation that exercises them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.core import Relation

#: The code prefixes of the main boards.
MAIN_BOARD = ("600", "601", "603", "605", "000", "001", "002", "003")


def security_code(c: Column) -> Column:
    """Six digits, zero-padded."""
    return F.lpad(F.regexp_replace(c.cast("string"), "[^0-9]", ""), 6, "0")


def is_main_board(code: Column) -> Column:
    return F.substring(code, 1, 3).isin(*MAIN_BOARD)


def parse_day(text: Column) -> Column:
    """YYYY-MM-DD or YYYYMMDD; anything else is null."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("yyyyMMdd"))).cast("date")


def number_or_null(text: Column) -> Column:
    """A finite number, else null."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def institutions(text: Column) -> Column:
    """The count before the word for institutions in an interpretation, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(text, "([0-9]+)家机构", 1), F.lit("")).cast("int"), F.lit(0))


def redact_paths(text: Column) -> Column:
    return F.regexp_replace(text, "/(?:[A-Za-z0-9_.-]+/)+", "<path>/")


def closest(word: Column, choices: list[str]) -> Column:
    """The choice with the smallest edit distance, the first of equals."""
    return F.array_min(F.array(*[F.struct(F.levenshtein(word, F.lit(c)).alias("n"), F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(choices)]))["c"]


Relation(
    "scalar_functions",
    """SELECT p_partkey AS k, lpad(CAST(p_partkey AS VARCHAR(10)), 6, '0') AS code, substr(lpad(CAST(p_partkey AS VARCHAR(10)), 6, '0'), 1, 3) IN ('600', '601', '603', '605', '000', '001', '002', '003') AS main_board,
  coalesce(CAST(nullif(regexp_extract(p_type || ' 3 desks', '([0-9]+) desks', 1), '') AS INT), 0) AS desks, coalesce(position('TIN' IN p_type) > 0, false) AS has_tin,
  greatest(-1, least(1, p_retailprice / 1000 - 1.2)) AS clipped, CAST(floor(ln(1 + p_retailprice) * 10000 + 0.4137) AS DOUBLE) / 10000 AS l1, CAST(sign(p_size - 25) AS INT) AS side,
  TRY_CAST(substr(p_name, 1, 1) AS DOUBLE) AS parsed, TRY_CAST(CAST(p_size AS VARCHAR(10)) AS DOUBLE) AS size_number, sqrt(CAST(p_size AS DOUBLE)) AS root, CAST(ceil(p_retailprice / 7) AS BIGINT) AS up, md5(p_name) AS digest, levenshtein(substr(p_name, 1, 6), 'almond') AS edits FROM {part}""",
)
