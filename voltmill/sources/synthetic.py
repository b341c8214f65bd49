"""Seeded observations for fixtures: demand by hour and weekday, two per cent faults; a row is a function of its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def observations(spark: SparkSession, stations: int, days: int = 30, seed: int = 42, first: str = "2024-01-01") -> DataFrame:
    """One row per station and hour: station_key, observed_at, availability_status, queue_level, available and total connectors, is_simulated."""
    i = spark.range(stations * days * 24)
    i = i.select((F.col("id") % stations).cast("int").alias("station_key"), F.expr(f"id div {stations}").alias("h"))
    at = F.lit(first).cast("timestamp") + F.make_dt_interval(hours=F.col("h").cast("int"))
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "station_key", "h"), F.lit(1_000_000)) / 1e6
    hour, weekend = F.hour("observed_at"), F.weekday("observed_at") >= 5
    busy = F.when(hour.between(8, 10) | hour.between(17, 20), 0.55).when(hour.between(0, 5), 0.08).otherwise(0.25) * F.when(weekend, 0.8).otherwise(1.0)
    x = i.withColumn("observed_at", at).withColumn("p", busy).withColumn("total_connectors", (F.col("station_key") % 4 + 1))
    status = F.when(draw(1) < 0.02, "broken").when(draw(2) < F.col("p"), "busy").otherwise("available")
    x = x.withColumn("availability_status", status)
    free = F.when(F.col("availability_status") == "available", F.least("total_connectors", 1 + F.floor(draw(3) * F.col("total_connectors"))).cast("int")).otherwise(0)
    queue = F.when(F.col("availability_status") != "busy", "none").when(draw(4) < 0.5, "short").when(draw(4) < 0.85, "medium").otherwise("long")
    return x.select("station_key", "observed_at", "availability_status", queue.alias("queue_level"), free.alias("available_connectors"), "total_connectors", F.lit(True).alias("is_simulated"))
