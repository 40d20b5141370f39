"""Bars from a stream of files: windowed aggregation with a watermark, and upserts by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quantloom.operators.frames import dedup_first
from quantloom.sources.files import upsert_parquet
from quantloom.sources.partitions import upsert_partitions


def stream(spark: SparkSession, path: str, ddl: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files).parquet(path)


def bars(events: DataFrame, symbol: str = "event_type", value: str = "value", at: str = "ts", nth: str = "event_id", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(symbol, timestamp, open, high, low, close, volume) by window; on a stream, rows later than late are left out."""
    if events.isStreaming:  # watermarks need a TIMESTAMP
        events = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    by = events.groupBy(F.col(symbol).alias("symbol"), F.window(at, every).alias("_w"))
    out = by.agg(F.min_by(value, nth).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, nth).alias("close"), F.count("*").cast("double").alias("volume"))
    return out.select("symbol", F.col("_w.start").cast("timestamp_ntz").alias("timestamp"), "open", "high", "low", "close", "volume")


def upsert_stream(df: DataFrame, path: str, keys: Sequence[str], order: str, checkpoint: str, by: str | None = None) -> StreamingQuery:
    """Each batch's last row of a key goes into the Parquet table at path; a repeated batch changes nothing.

    by: the column that the table is partitioned by; then a batch rewrites only the partitions that it changes.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        latest = dedup_first(batch, keys, [F.desc(order)])
        if by:
            upsert_partitions(batch.sparkSession, path, latest, keys, by)
        else:
            upsert_parquet(batch.sparkSession, path, latest, keys, f"{path}-staging")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
