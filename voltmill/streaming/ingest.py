"""Structured Streaming ingest of observations: an extension, the batch model polls instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "observation_id long, station_key int, observed_at timestamp, received_at timestamp, availability_status string, source_payload_hash string"


def observations(spark: SparkSession, path: str, watermark: str = "1 hour", skew: str = "5 minutes") -> DataFrame:
    """Landing files as a stream: rows ahead of their receipt by more than skew are refused, replays within the watermark dropped."""
    raw = spark.readStream.schema(SCHEMA).json(path)
    sane = raw.where(F.col("observed_at") <= F.col("received_at") + F.expr(f"INTERVAL {skew}"))
    return sane.withWatermark("observed_at", watermark).dropDuplicatesWithinWatermark(["station_key", "observed_at", "source_payload_hash"])


def slot_counts(stream: DataFrame) -> DataFrame:
    """Observations of each station, quarter hour and status; late rows count until the watermark passes."""
    return stream.groupBy(F.window("observed_at", "15 minutes").alias("slot"), "station_key", "availability_status").agg(F.count("*").alias("n"))


def append_batches(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch once: a batch's folder carries its number, so a replayed batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
