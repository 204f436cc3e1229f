"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table, from two hashes of its name; shards
take turns to claim their next free slot until the table is full. A row's slot is its key's hash modulo the table size,
its shard the slot's owner: one broadcast lookup. Shards differ by at most one slot, and removing a shard moves few rows.

The table has ``slots`` rows whatever the input, which bounds the broadcast. The fill is a few thousand steps on the
driver; rows meet only DataFrame functions.

Defined results: a null key has the hash of the empty string; equal keys share a shard unless the key is hot and
``spread_by`` is given; an empty table gives an empty result; other columns pass unchanged, whatever their names (the
two new ones are named by the caller and take the place of columns of that name).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused
from .mix_sources import id_hash

SHARDS, SLOTS = 64, 16381


def fill(names: list[str], slots: int) -> list[int]:
    """Owner of each slot. slots is a prime of at least len(names)."""
    if not names or len(set(names)) < len(names):
        raise ValueError("shard names must be given and differ")
    if slots < len(names) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards")
    digests = [hashlib.md5(x.encode()).digest() for x in names]
    place = [int.from_bytes(d[:8], "big") % slots for d in digests]
    skip = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digests]
    owner, left = [-1] * slots, slots
    while left:
        for k in range(min(len(names), left) if left < len(names) else len(names)):
            while owner[place[k]] >= 0:
                place[k] = (place[k] + skip[k]) % slots
            owner[place[k]] = k
            left -= 1
    return owner


def lookup(spark: SparkSession, owner: list[int], slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """The table as rows (slot, shard), cut out of one binary literal of 4 bytes a slot."""
    body = F.lit(b"".join(k.to_bytes(4, "big") for k in owner))
    number = F.conv(F.hex(F.substring(body, (F.col("id") * 4 + 1).cast("int"), F.lit(4))), 16, 10).cast("int")
    return spark.range(0, len(owner), 1, 1).select(F.col("id").alias(slot_col), number.alias(shard_col))


def shard(df: DataFrame, key: Column, n_shards: int = SHARDS, slots: int = SLOTS, spread_by: Column | None = None, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with the slot and shard of each row; columns of df with these two names are replaced.

    spread_by: keys with more rows than a shard's even share (fewer than n_shards keys can have that) are divided by
    the hash of this column over as many slots as shares they have.
    """
    spark = df.sparkSession
    names = df.columns
    at, own, k, hot_key, count, parts = unused([*names, slot_col, shard_col], "_slot", "_shard", "_key", "_hot", "_n", "_parts")
    rows = df.withColumn(k, key.cast("string"))
    h = id_hash(F.col(k))
    if spread_by is not None:
        rows = rows.withColumn(at, id_hash(spread_by))
        counts = rows.groupBy(k).agg(F.count("*").alias(count))
        total = counts.agg(F.sum(count)).first()[0] or 0
        hot = counts.filter(F.col(count) * n_shards > total).select(F.col(k).alias(hot_key), F.ceil(F.col(count) * n_shards / F.lit(max(total, 1))).alias(parts))
        rows = rows.join(F.broadcast(hot), F.col(k).eqNullSafe(F.col(hot_key)), "left")
        part = F.when(F.col(parts).isNotNull(), F.concat(F.coalesce(k, F.lit("")), F.lit("#"), (F.col(at) % F.col(parts)).cast("string"))).otherwise(F.col(k))
        h = id_hash(part)
    table = F.broadcast(lookup(spark, fill([f"shard-{x}" for x in range(n_shards)], slots), hot_key + "_slot", own))
    out = rows.withColumn(at, h % F.lit(slots)).join(table, F.col(at) == F.col(hot_key + "_slot"))
    gone = {slot_col.lower(), shard_col.lower()}
    return out.select(*[F.col(f"`{c}`") for c in names if c.lower() not in gone], F.col(at).alias(slot_col), F.col(own).alias(shard_col))
