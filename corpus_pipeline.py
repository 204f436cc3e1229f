"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage works on all rows its predecessor kept, and its decision takes effect: language ID drops documents whose
language it can't tell, the Jaccard join keeps one document of each class, decontamination drops documents that hold a
benchmark item, mixing repeats or drops rows by its plan, sharding adds slot and shard. All but the last return the
columns of documents, whatever those are; helper columns take names that documents don't have.

Null and empty texts have no language and go in the first stage. Rows are told apart by doc_id where that is unique and
not null, else by a number in order of doc_id (nulls last) and text, so a row's fate never depends on another that
shares its id, but for the mix, which takes rows by the hash of their id. Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, language_id, ngram_join, registry
from tickloom.llm.common import Scratch, read, small_batches, unused, width
from tickloom.llm.mix_sources import ADDED, mix_rows, word_count
from tickloom.llm.shard import shard

#: Up to so many ids are broadcast to pick rows by; beyond, they are joined.
BROADCAST_IDS = 500_000
#: A language must be more likely than all others together.
LEAST_SCORE = 0.5


def numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """docs, and the name of a column that tells its rows apart: doc_id, or one that is added to a copy."""
    rows, ids = docs.agg(F.count("*"), F.count("doc_id")).first()
    if rows == ids and docs.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").isEmpty():
        return docs, "doc_id"
    (key,) = unused(docs.columns, "row_number")
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last()]
    return scratch.save(docs.repartitionByRange(width(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id()), "numbered"), key


def without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows of docs whose key is not in gone's column of that name."""
    gone = gone.select(key).distinct()
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, key, "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null text, no letter in it, or a prediction of less than LEAST_SCORE.

    The classifier learns from the labelled rows of its input. If there are none, every text is undetermined, and only
    those go that no language can be in.
    """
    model = language_id.train(docs, "doc_id", "text", "lang")
    lang, score = unused(docs.columns, "_lang", "_score")
    with small_batches(spark):
        known = language_id.classify(docs, model, "text", lang, score)
        known = known.filter((F.col(lang) != language_id.UND) & (F.col(score) >= LEAST_SCORE) if model.labels else F.col("text").rlike(r"\p{L}"))
        return Scratch(spark, "stage-language").save(known.select([F.col(f"`{c}`") for c in docs.columns]), "docs")


def join_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each class of similar documents the first: the smallest id, of equal ids the smallest text."""
    scratch = Scratch(spark, "stage-join")
    rows, key = numbered(docs, scratch)
    classes = scratch.save(ngram_join.link_classes(rows, key, "text"), "classes")
    return without(rows, key, classes.filter(f"component_id <> {key}")).select([F.col(f"`{c}`") for c in docs.columns])


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    rows, key = numbered(docs, Scratch(spark, "stage-decontaminate"))
    return without(rows, key, decontaminate.find_contained(rows, read(spark, sf_dir, "benchmark"), doc_id=key)).select([F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Rows with equal ids share that number."""
    added = unused(docs.columns, *ADDED)
    (copy,) = unused([*docs.columns, *added], "_copy")
    mixed = mix_rows(docs, "doc_id", "source", word_count(F.col("text")), added=tuple(added))
    return mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(added[-1]).cast("int")))).select([F.col(f"`{c}`") for c in docs.columns])


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The slot and shard of each row, by the hash of its id; a null id counts as the empty string."""
    return shard(docs, F.col("doc_id"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_join", join_similar),
    ("decontaminate", decontaminate_benchmark),
    ("mix_sources", mix),
    ("shard", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs


#: The first stage's classifier is beyond SQL, so the whole has none.
ORACLE_SQL = None
#: The other four stages over the rows that the first kept (table p1), for DuckDB; a test compares them.
REST_SQL = f"""WITH RECURSIVE
{registry.linked_sql("p1")},
p2 AS (SELECT p1.* FROM p1 JOIN classes USING (doc_id) WHERE component_id = p1.doc_id),
{registry.contained_sql("p2")},
p3 AS (SELECT * FROM p2 WHERE doc_id NOT IN (SELECT doc_id FROM pairs)),
{registry.mix_sql("p3")},
p4 AS (SELECT p3.* FROM p3 JOIN d USING (doc_id) JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source
  LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h JOIN range(1, 3) t(i) ON i <= copies + CASE WHEN k.h IS NULL THEN 0 ELSE 1 END)
SELECT *, {registry.shard_sql()} FROM p4"""
