"""Rate limiting and ingest, as batch and as stream: the same expressions for both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.functions.keys import content_hash


def rate_buckets(events: DataFrame, client: str, at: str, every: str = "1 minute", most: int = 10) -> DataFrame:
    """Requests of each client and time bucket and whether all were within the limit.

    On a stream the watermark keeps a bucket for two minutes after its time; on a table it does nothing.
    """
    source = events.withWatermark(at, "2 minutes") if events.isStreaming else events
    counted = source.groupBy(F.window(at, every).alias("bucket"), F.col(client)).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select(client, F.col("bucket.start").alias("bucket_start"), "requests", (F.col("requests") <= most).alias("allowed"))


def unexpired(rows: DataFrame, expires: str, now: str) -> DataFrame:
    """Rows that haven't expired at a given time."""
    return rows.filter(F.col(expires) > F.lit(now).cast("timestamp"))


def ingest_stream(documents: DataFrame, target: str, checkpoint: str, at: str = "loaded_at") -> StreamingQuery:
    """New documents into a Parquet table, repeated bodies within a day dropped by their hash."""
    fresh = documents.withWatermark(at, "1 day").withColumn("content_hash", content_hash(F.col("text")))
    return fresh.dropDuplicatesWithinWatermark(["content_hash"]).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
