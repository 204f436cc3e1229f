"""WARC archives: write captures, read records, assemble transactions.

Writing: each page becomes a response (or a revisit of an earlier equal payload), a request and a metadata record, the
latter two naming the first in WARC-Concurrent-To. Spark's text writer puts the records out as they are (a record ends
in CRLF CRLF, whose last LF is the writer's line end), gzipped, to any file system. Payload bytes move to the writer
only; equal payloads are found by digest and length.

Reading: archives are cut at the version mark and put together by Content-Length, in order, so payloads may hold the
mark. Assembly groups requests and metadata by the record they are concurrent to, and joins them to it: one nested row
per capture.

Defined results: a null payload is empty; null url is the empty string; a null page id is never the one that others
revisit unless no other has the payload; rows with equal page ids and equal payloads get equal records, and all rows
that share the smallest id are responses; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settings, small_batches

MARK = "WARC/1."
#: Repeated digests are broadcast up to so many (40 bytes each), beyond that joined.
BROADCAST_DIGESTS = 500_000
SCHEMA = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, warc_date string, content_type string, declared_digest string, http_length long, payload binary, payload_digest string, fields map<string,string>"
DATE = "2024-01-01T00:00:00Z"


def _uuid(kind: str, page: Column, digest: Column) -> Column:
    text = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(text, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1\r\n")]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))


def write(df: DataFrame, id_col: str, url_col: str, html_col: str, path: str, least: int = 100) -> None:
    """Payloads of ``least`` bytes or more that an earlier page (by id) has are revisits of the first such page."""
    spark = df.sparkSession
    body = F.coalesce(F.col(html_col), F.lit(""))
    pages = df.select(F.col(id_col).alias("page"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\r\n]+", " ").alias("url"), body.alias("body")).withColumn("digest", F.sha2("body", 256)).withColumn("size", F.octet_length("body"))
    repeated = pages.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    if repeated.count() <= BROADCAST_DIGESTS:
        repeated = F.broadcast(repeated)
    rows = pages.join(repeated, "digest", "left").withColumn("revisit", F.coalesce(~F.col("page").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))
    own, first = _uuid("response", F.col("page"), F.col("digest")), _uuid("response", F.col("first"), F.col("digest"))
    uri, date, digest = F.col("url"), F.lit(DATE), F.concat(F.lit("sha256:"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    when = lambda value: F.when(F.col("revisit"), value)
    capture = _record(
        [("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("WARC-Profile", when(F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("WARC-Refers-To", when(first)), ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("body"))),
    )
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _uuid("request", F.col("page"), F.col("digest"))), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.when(uri == "", F.lit("/")).otherwise(uri), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    fields = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page").cast("string"), F.lit("\r\n")), F.lit("")), F.coalesce(when(F.concat(F.lit("refers-to-page: "), F.col("first").cast("string"), F.lit("\r\n"))), F.lit("")))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _uuid("metadata", F.col("page"), F.col("digest"))), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], fields)
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        rows.select(F.explode(F.array(capture, request, metadata)).alias("value")).write.mode("overwrite").option("lineSep", "\n").option("compression", "gzip").text(path)


def _headers(block: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in block.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            found[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return found


def parse(record: bytes) -> dict:
    """A record, from its version line on, as a row of SCHEMA."""
    head, _, rest = record.partition(b"\r\n\r\n")
    h = _headers(head)
    block = rest[: int(h.get("content-length", len(rest)))]
    kind, payload, http_length, fields = h.get("warc-type"), block, None, None
    if h.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        said = _headers(top).get("content-length", "")
        http_length = int(said) if said.isdigit() else None
    elif h.get("content-type") == "application/warc-fields":
        fields = _headers(b"\r\n" + block)
    return {"record_id": h.get("warc-record-id"), "record_type": kind, "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri"), "warc_date": h.get("warc-date"), "content_type": h.get("content-type"), "declared_digest": h.get("warc-payload-digest"), "http_length": http_length, "payload": payload, "payload_digest": hashlib.sha256(payload).hexdigest(), "fields": fields}


def _need(record: bytes | bytearray) -> int | None:
    """Bytes of the record up to the end of its block; None while its head isn't whole."""
    end = record.find(b"\r\n\r\n")
    if end < 0:
        return None
    for line in bytes(record[:end]).split(b"\r\n"):
        if line[:15].lower() == b"content-length:":
            return end + 4 + int(line[15:])
    return end + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of gzipped archives, rows of SCHEMA. A record that its file cuts short is an error."""
    chunks = spark.read.option("lineSep", MARK).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    schema = pa.schema([(n, pa.string()) for n in ("record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "warc_date", "content_type", "declared_digest")] + [("http_length", pa.int64()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: bytearray | None = None
        need: int | None = None
        where = None
        mark = MARK.encode()

        def whole() -> dict:
            if need is None or len(held) < need:
                raise ValueError(f"a record of {where} is cut short")
            return parse(bytes(held))

        for b in batches:
            out: list[dict] = []
            for value, file in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                value = value.as_py() or b""
                if file != where:
                    if held is not None:
                        out.append(whole())
                    held, where = None, file
                    if not value.strip():
                        continue  # what stands before the first mark
                if held is not None and (need is None or len(held) < need):
                    held += mark + value  # the mark stood in the payload
                else:
                    if held is not None:
                        out.append(whole())
                    held = bytearray(mark + value)
                need = _need(held)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([whole()], schema)

    return chunks.mapInArrow(rows, SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture (response, revisit or resource): capture_id, capture, requests, metadata."""
    body = F.struct(*[c for c in records.columns if c not in ("record_id", "concurrent_to")])
    rows = records.select("record_id", "record_type", "concurrent_to", body.alias("r"))
    captures = rows.filter(F.col("record_type").isin("response", "revisit", "resource")).select(F.col("record_id").alias("capture_id"), F.col("r").alias("capture"))
    own = F.struct("record_id", "r.*")
    others = rows.filter(F.col("record_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    joined = others.groupBy(F.col("concurrent_to").alias("capture_id")).agg(
        F.collect_list(F.when(F.col("record_type") == "request", own)).alias("requests"), F.collect_list(F.when(F.col("record_type") == "metadata", own)).alias("metadata")
    )
    return captures.join(joined, "capture_id", "left")


def round_trip(df: DataFrame, id_col: str, url_col: str, html_col: str, path: str, least: int = 100) -> DataFrame:
    """Write, read, assemble; then per capture: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = df.sparkSession
    write(df, id_col, url_col, html_col, path, least)
    with small_batches(spark):
        keep = ["record_id", "record_type", "concurrent_to", "declared_digest", "http_length", "payload_digest", "fields"]
        records = read(spark, path).select(*keep, F.octet_length("payload").cast("long").alias("payload_bytes"))
        whole = assemble(records)
        c, m = F.col("capture"), F.col("metadata")[0]["fields"]
        revisit = c["record_type"] == "revisit"
        return whole.select(
            m["page-id"].cast("long").alias(id_col),
            F.when(revisit, c["http_length"]).otherwise(c["payload_bytes"]).alias("payload_bytes"),
            F.when(revisit, F.regexp_extract(c["declared_digest"], "([0-9a-f]+)$", 1)).otherwise(c["payload_digest"]).alias("payload_digest"),
            c["record_type"].alias("record_type"),
            m["refers-to-page"].cast("long").alias("refers_to"),
        )
