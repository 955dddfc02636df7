"""Event volume by time bucket, over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def volume(stream: DataFrame, ts: str, bucket: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(bucket, n): events in each bucket. An event that comes more than `late` after the latest time seen is dropped,
    so state is kept for open buckets only. ts must be a timestamp with time zone, which watermarks need."""
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, bucket)).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("bucket"), "n")


def run_available(counts: DataFrame, path: str, checkpoint: str) -> None:
    """Writes the buckets that are closed by what there is to read, and stops; the next run goes on from there."""
    counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
