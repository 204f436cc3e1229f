"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by their number of shingles (powers of two). An item's sketch is its k smallest shingle hashes;
with u the largest size of its partition and c the containment, k = 2 * floor((1 - c) * u) + 1, or all it has. A document
with at least c of an item's n shingles lacks at most floor((1 - c) * n) of them, so it has at least k - floor((1 - c) * n)
of the sketch's hashes, which is more than half. Documents are sketched by their hashes up to the largest in any item's
sketch; pairs that share as many as the item's partition asks are candidates, and for them all shingles are counted. No
qualifying pair is lost, however long the document, and a single common passage makes no candidate.

DataFrame functions only. Shingles are made by generators inside generated code, one at a time, and meet the broadcast
sketch before any exchange, so what is shuffled are hits. Item tables are broadcast below BROADCAST_ROWS rows (16 bytes
each), counted first; above, they are joined.

Defined results: words are what white space separates, in lower case; a text of fewer than five words has its whole
sequence as one shingle, without words it has none and matches nothing; rows that share an id are one document (or
item); null ids are an id of their own; ties do not arise (all qualifying pairs are returned); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, Scratch

BROADCAST_ROWS = 2_000_000


def shingle_rows(df: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """(key, h): a row for each run of k words, repeats included."""
    clean = F.btrim(F.lower(F.col(text)), F.lit(" \t\n\x0b\x0c\r"))
    w = df.select(F.col(key), F.split(clean, SPACES).alias("_w")).filter((F.col("_w")[0] != "") & (F.size("_w") > 0))
    at = w.select(key, "_w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_w") - k, F.lit(0)))).alias("_i"))
    return at.select(key, F.xxhash64(*[F.get("_w", F.col("_i") + j) for j in range(k)]).alias("h"))


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find_contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", percent: int = 80, k: int = 5) -> DataFrame:
    """Pairs of a document and an item of whose shingles it has at least ``percent`` in 100: doc_id, item_id, item_shingles, shared, containment."""
    scratch = Scratch(docs.sparkSession, "contain")
    docs = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    own = shingle_rows(items.select(F.col(item_id).alias("item"), F.col(text).alias("t")), "item", "t", k).distinct()
    sized = own.join(own.groupBy("item").agg(F.count("*").alias("n")).withColumnRenamed("item", "_item"), F.col("item").eqNullSafe(F.col("_item"))).drop("_item")
    largest = F.expr("shiftleft(1L, cast(ceil(log2(n)) AS int))")  # of the partition: sizes in (u/2, u]
    lacks = lambda size: F.floor(size * (100 - percent) / 100)
    sized = sized.withColumn("k", F.least("n", 2 * lacks(largest) + 1)).withColumn("need", F.col("k") - lacks(F.col("n")))
    sized = scratch.save(sized, "items")
    rows = sized.count()
    # A hash's rank in its sketch is a bit of a mask; where ranks share bits, as many bits are asked for as that leaves.
    sketch = sized.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("h"))).filter("r <= k")
    sketch = sketch.select("item", "h", F.expr("shiftleft(1L, cast(r % 63 AS int))").alias("bit"), F.ceil(F.col("need") / F.ceil(F.col("k") / 63)).alias("need"))
    sketch = scratch.save(sketch, "sketch")
    top = sketch.agg(F.max("h")).first()[0]
    if top is None:
        top = -(1 << 63)
    probe = shingle_rows(docs, "d", "t", k).filter(F.col("h") <= F.lit(top))
    hits = probe.join(_maybe_broadcast(sketch, rows), "h").groupBy("d", "item").agg(F.bit_or("bit").alias("bits"), F.first("need").alias("need"))
    hits = scratch.save(hits.filter(F.bit_count("bits") >= F.col("need")).select("d", "item"), "hits")

    found = hits.select("d").distinct()
    n_found = found.count()
    nullsafe: Column = F.col("d").eqNullSafe(F.col("_d"))
    chosen = docs.join(_maybe_broadcast(found.withColumnRenamed("d", "_d"), n_found), nullsafe, "left_semi")
    shared = shingle_rows(chosen, "d", "t", k).join(_maybe_broadcast(sized.select("item", "h", "n"), rows), "h").distinct().groupBy("d", "item").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    shared = shared.filter(F.col("shared") * 100 >= F.col("n") * percent)
    pairs = shared.join(hits.select(F.col("d").alias("_d"), F.col("item").alias("_item")), nullsafe & F.col("item").eqNullSafe(F.col("_item")), "left_semi")
    return pairs.select(F.col("d").alias(doc_id), F.col("item").alias(item_id), F.col("n").alias("item_shingles"), "shared", (F.col("shared") / F.col("n")).alias("containment"))
