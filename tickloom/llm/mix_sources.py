"""Mixing sources to target weights with hash-threshold histograms.

Each row has a uniform 60-bit hash of its id. Sizes are summed by source and the top 12 hash bits; the bucket in which
a source's running sum meets its budget is found, only that bucket is divided by the next 12 bits, and only what is
left of it by single hashes. Rows at or below the resulting threshold are taken: a filter, no sort, no sampling, and a
smaller budget takes a subset of what a larger one takes.

Defined results: a null size counts as 0, a null source is a source of its own (ordered last); rows with equal ids
share a hash and stand or fall together; a source without size has target 0; an empty table gives an empty result;
other columns pass unchanged, whatever their names, except those that the caller names as new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, unused

BITS = 12
#: Tables with a row per source are broadcast up to so many sources.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(key: Column) -> Column:
    """60 bits of MD5, as a bigint: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, none above most * source_size.

    Water filling in closed form: sources in order of the level at which they are full; a source is full if the level
    that remains after all before it reaches it. One row per source, so the ordered windows are small.
    """
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights)).cast("int") + 1)
    ranked = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every, order = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), "place")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    left = (total - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(ahead), F.lit(0.0)))
    full = ranked.withColumn("full", left >= F.col("cap") / F.col("w")).withColumn("total", total)
    gone, weight = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(every)
    level = F.when(weight > 0, (F.col("total") - gone) / F.when(weight > 0, weight)).otherwise(0.0)
    return full.withColumn("level", level).select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"))


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _crossing(hist: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """Of (by, bucket, size, rest): the bucket in which the running size reaches rest, and what is left when it begins."""
    run = Window.partitionBy(*by).orderBy(bucket)
    return hist.withColumn("upto", F.sum("size").over(run)).filter("upto >= rest and upto - size < rest").select(*by, bucket, (F.col("rest") - (F.col("upto") - F.col("size"))).alias("rest"))


#: What ``mix_rows`` adds: a row's size, its source's size and target, what the mix takes of it, and how often.
ADDED = ("size", "source_size", "target", "taken", "copies")


def mix_sources(df: DataFrame, id_col: str, source_col: str, size: Column, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per input row: id, size, source_size, target (its source's), taken (size times copies), copies the mix takes."""
    slim = df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.coalesce(size, F.lit(0)).cast("long").alias("_size"))
    slim = Scratch(df.sparkSession, "mixed").save(slim, "rows")
    return mix_rows(slim, "_id", "_source", F.col("_size"), weights, share, most).select(F.col("_id").alias(id_col), *ADDED)


def mix_rows(df: DataFrame, id_col: str, source_col: str, size: Column, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, added: tuple[str, ...] = ADDED) -> DataFrame:
    """df with five columns, named by ``added``; columns of df with these names are replaced, all others pass unchanged."""
    scratch = Scratch(df.sparkSession, "mix")
    rows = scratch.save(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size")).withColumn("h", id_hash(F.col("id"))), "rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = scratch.save(targets(sizes, weights, share, most).withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "plan")
    few = plan.count() <= BROADCAST_SOURCES

    def joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        """Equal columns, null equals null; b has a row per source at most."""
        renamed = b.select(*[F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in b.columns])
        cond = F.lit(True)
        for c in on:
            cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return a.join(_small(renamed, few), cond, how).drop(*[f"_{c}" for c in on])

    b0, b1 = F.shiftright("h", 60 - BITS), F.shiftright("h", 60 - 2 * BITS)
    level0 = joined(rows.groupBy("source", b0.alias("b0")).agg(F.sum("size").alias("size")), plan.select("source", "rest"), ["source"])
    cross0 = scratch.save(_crossing(level0, ["source"], "b0"), "cross0")
    level1 = joined(rows.withColumn("b0", b0), cross0, ["source", "b0"]).groupBy("source", "b0", b1.alias("b1")).agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    cross1 = scratch.save(_crossing(level1, ["source", "b0"], "b1").select("source", "b1", "rest"), "cross1")
    single = joined(rows.withColumn("b1", b1), cross1, ["source", "b1"]).groupBy("source", "b1", "h").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    run = F.sum("size").over(Window.partitionBy("source", "b1").orderBy("h"))
    taken = single.withColumn("upto", run).withColumn("over", F.col("upto") - F.col("rest")).filter("over <= 0 or over < size - over")
    last = taken.groupBy("source", "b1").agg(F.max("h").alias("h"))
    cuts = joined(cross1, last.select("source", "h"), ["source"], "left").select("source", F.coalesce("h", F.shiftleft(F.col("b1"), 60 - 2 * BITS) - 1).alias("cut"))
    plan = joined(plan, cuts, ["source"], "left").select("source", "source_size", "target", "copies", F.coalesce("cut", F.lit(-1)).alias("cut"))
    plan = scratch.save(plan, "cuts")
    n, h, group, source, source_size, target, copies, cut = unused([*df.columns, *added], "_n", "_h", "_group", "_source", "_source_size", "_target", "_copies", "_cut")
    plan = plan.select(F.col("source").alias(source), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("copies").alias(copies), F.col("cut").alias(cut))
    sized = df.withColumns({n: F.coalesce(size, F.lit(0)).cast("long"), h: id_hash(F.col(id_col)), group: F.col(source_col)})
    out = sized.join(_small(plan, few), F.col(group).eqNullSafe(F.col(source)))
    times = F.col(copies) + (F.col(h) <= F.col(cut)).cast("long")
    gone = {c.lower() for c in added}
    new = (F.col(n), F.col(source_size), F.col(target), F.col(n) * times, times)
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone], *[c.alias(name) for c, name in zip(new, added, strict=True)])
