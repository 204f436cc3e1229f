"""Exact deduplication: group by a 128-bit content hash, keep one stable id, compare bytes inside the groups.

Only (id, hash, digest) rows are grouped, with partial aggregation, so a group of a third of all rows costs one row a
task. Where a hash repeats, its smallest and largest text are taken, also with partial aggregation: if they differ,
the hash stands for several texts (a collision), and its rows are grouped anew by the SHA-256 of their text. The
groups with several rows are broadcast to the rows; if they are too many for that, those of over LARGE rows are, of
which there can't be many, and the rest are joined.

Defined results: null text counts as empty; a null id sorts below all others (it is kept last under "max", first under
"min"); of rows that share the kept id exactly one is kept; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch

#: Up to so many groups (a hash, two numbers and a count each) are broadcast.
BROADCAST_GROUPS = 500_000
#: A group of more rows than this is never dealt to one task by its hash.
LARGE = 100_000


def folded(text: Column) -> Column:
    """ASCII letters in lower case, all else as it is; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def exact_dedup(df: DataFrame, id_col: str, text_col: str, keep: str = "min", content_hash=None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep: "min" or "max" id of each group stays. content_hash: Column -> binary Column, 128 bits by default; tests
    pass a poor one to force collisions.
    """
    scratch = Scratch(df.sparkSession, "exact")
    content_hash = content_hash or (lambda t: F.unhex(F.md5(t)))
    text = folded(F.col(text_col))
    docs = df.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("h", content_hash(F.col("t")))
    keys = scratch.save(docs.select("id", "h", F.unhex(F.sha2("t", 256)).alias("sha"), F.monotonically_increasing_id().alias("row")), "keys")
    best = (F.min if keep == "min" else F.max)(F.struct("id", "row"))
    groups = scratch.save(keys.groupBy("h").agg(best.alias("k"), F.count("*").alias("n")), "groups")

    repeated = groups.filter("n > 1")
    few = repeated.count() <= BROADCAST_GROUPS
    rows = docs.join(F.broadcast(repeated.select("h")), "h", "left_semi") if few else docs
    mixed = scratch.save(rows.groupBy("h").agg(F.min("t").alias("low"), F.max("t").alias("high")).filter("low <> high").select("h"), "mixed")
    if not mixed.isEmpty():
        keys = scratch.save(keys.join(mixed.withColumn("mixed", F.lit(True)), "h", "left").withColumn("h", F.when(F.col("mixed"), F.concat("h", "sha")).otherwise(F.col("h"))).drop("mixed"), "apart")
        groups = scratch.save(keys.groupBy("h").agg(best.alias("k"), F.count("*").alias("n")), "regrouped")
        repeated = groups.filter("n > 1")
        few = repeated.count() <= BROADCAST_GROUPS

    found = keys.join(F.broadcast(repeated if few else groups.filter(F.col("n") > LARGE)), "h", "left")
    if few:
        out = found.withColumn("k", F.coalesce("k", F.struct("id", "row"))).withColumn("n", F.coalesce("n", F.lit(1)))
    else:
        out = found.filter("n IS NOT NULL").unionByName(found.filter("n IS NULL").drop("k", "n").join(groups, "h"))
    return out.select(F.col("id").alias(id_col), F.col("k.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("k.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
