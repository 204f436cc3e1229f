"""The contract queries opN_<name> and, where SQL can say it, the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, lm_score, ngram_join, suffix_dedup, token_file, warc
from .common import Scratch, read
from .exact_dedup import exact_dedup
from .mix_sources import mix_sources, word_count
from .shard import SHARDS, SLOTS, fill, shard

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HASH = "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)"
_WORD = r"[^\x20\x09-\x0D]+"


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), "doc_id", "text", keep="max")


OP9_SQL = f"""
WITH t AS (SELECT doc_id, {_FOLD} AS n FROM documents),
g AS (SELECT n, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.n) AS text_sha256
FROM t JOIN g USING (n)"""


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"), "doc_id", "source", word_count(F.col("text")), (5, 2, 1), 1.5, 2).drop("copies")


def mix_sql(documents: str = "documents") -> str:
    return f"""
d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size, {_HASH} AS h FROM {documents}),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s0),
s2 AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, sum(CAST(source_size AS DOUBLE)) OVER () * 1.5::DOUBLE AS total,
  (sum(CAST(source_size AS DOUBLE)) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) >= cap / w AS is_full
  FROM s2 WINDOW o AS (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS gone, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS weight FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN is_full THEN cap WHEN weight > 0 THEN (total - gone) / weight * w ELSE 0 END AS target FROM s4),
s6 AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS copies FROM s5),
s7 AS (SELECT *, target - copies * source_size AS rest FROM s6),
g AS (SELECT source, h, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source, h),
r AS (SELECT source, h, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY h) AS BIGINT) AS upto FROM g),
k AS (SELECT r.source, r.h FROM r JOIN s7 ON r.source IS NOT DISTINCT FROM s7.source
  WHERE rest > 0 AND (upto <= rest OR (upto - size < rest AND upto - rest < size - (upto - rest))))"""


_MIX_OUT = "CAST(d.size * (copies + CASE WHEN k.h IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS taken"
_MIX_FROM = "d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h"
OP2_SQL = f"WITH {mix_sql()}\nSELECT d.doc_id, d.size, source_size, target, {_MIX_OUT} FROM {_MIX_FROM}"


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"))


def shard_sql() -> str:
    """SQL for slot and shard of a doc_id; the lookup table stands in it as text, two digits a slot."""
    owner = "".join(f"{k:02d}" for k in fill([f"shard-{k}" for k in range(SHARDS)], SLOTS))
    return f"{_HASH} % {SLOTS} AS slot, CAST(substr('{owner}', CAST({_HASH} % {SLOTS} AS INTEGER) * 2 + 1, 2) AS INTEGER) AS shard"


OP3_SQL = f"SELECT doc_id, {shard_sql()} FROM documents"

TOKENIZER = "word_bpe_49k.json"


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_file.encode_documents(read(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path(TOKENIZER), end_id=1)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"), "page_id", "url", "html", Scratch(spark, "warc").path("archives"))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> p.page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 100"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def contained_sql(documents: str = "documents") -> str:
    """Common table expressions; the last, ``pairs``, has doc_id, item_id, item_shingles, shared."""
    cut = """CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END"""
    return f"""
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM {documents}),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest({cut}) AS s FROM dw),
its AS (SELECT DISTINCT item_id, unnest({cut}) AS s FROM iw),
n AS (SELECT item_id, count(*) AS item_shingles FROM its GROUP BY 1),
sh AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN its USING (s) GROUP BY 1, 2),
pairs AS (SELECT doc_id, item_id, item_shingles, shared FROM sh JOIN n USING (item_id) WHERE shared * 100 >= item_shingles * 80)"""


OP10_SQL = f"WITH {contained_sql()}\nSELECT *, shared / item_shingles AS containment FROM pairs"



def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.filter(~held), "doc_id", "text", "lang")
    return language_id.classify(docs.select("doc_id", "text", held.alias("held_out")), model, "text").select("doc_id", "held_out", "lang_pred", "score")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(read(spark, sf_dir, "documents"), "doc_id", "text")


def linked_sql(documents: str = "documents") -> str:
    """Common table expressions; the last, ``classes``, has doc_id, n_shingles, component_id."""
    return f"""
jw AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_WORD}') AS w FROM {documents}),
js AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM jw),
jn AS (SELECT doc_id, count(*) AS n FROM js GROUP BY 1),
jo AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM js a JOIN js b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM jo JOIN jn x ON x.doc_id = a JOIN jn y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY 1),
classes AS (SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
  FROM {documents} d LEFT JOIN jn ON jn.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id)"""


OP6_SQL = f"WITH RECURSIVE {linked_sql()}\nSELECT * FROM classes"


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_classes(read(spark, sf_dir, "documents"), "doc_id", "text")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "op4_suffix_dedup": op4_suffix_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_language_id": op7_language_id,
    "op8_lm_score": op8_lm_score,
    "op1_token_file": op1_token_file,
    "op2_mix_sources": op2_mix_sources,
    "op3_shard": op3_shard,
    "op5_warc": op5_warc,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_decontaminate": op10_decontaminate,
}
ORACLE_SQL = {"op2_mix_sources": OP2_SQL, "op3_shard": OP3_SQL, "op5_warc": OP5_SQL, "op6_ngram_join": OP6_SQL, "op9_exact_dedup": OP9_SQL, "op10_decontaminate": OP10_SQL}
