"""An extension: daily bars from an event stream, with a watermark, and incremental upserts by foreachBatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.core import Native
from ..sources.bars import upsert


def daily_counts(events: DataFrame, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """Events, users and purchases of each day and type. The same plan runs on a stream (late rows past the watermark go) and on a table."""
    events = events.withColumn(ts, events[ts].cast("timestamp"))
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id", 0.02).alias("users") if events.isStreaming else F.count_distinct("user_id").alias("users")).select(F.to_date("w.start").alias("d"), "event_type", "n", "users")


def run_daily(spark: SparkSession, source: str, schema, checkpoint: str, sink: str, ts: str = "ts") -> None:
    """Everything that is there now, into a Parquet table of days, resumable from the checkpoint."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = daily_counts(stream, ts).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def upsert_stream(stream: DataFrame, target: str, keys: list[str], checkpoint: str, replace: bool = True, buckets: int = 64):
    """Each micro-batch is merged into a Parquet table by key; a batch that runs again gives the same table.

    The table is partitioned by a hash of the key (column ``bucket``), and a batch reads and overwrites only the buckets
    that it touches. Of rows of a batch with one key the first by its other columns counts.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets at most
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        old = spark.read.schema(new.schema).parquet(target).filter(F.col("bucket").isin(touched)) if there else new.limit(0)
        merged = upsert(old, new, keys, replace)
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


Native("events_daily", daily_counts, ["events"], "SELECT CAST(ts AS DATE) AS d, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM {events} GROUP BY 1, 2")
