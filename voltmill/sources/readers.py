"""Scans and sinks of station data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATION_SCHEMA = (
    "id string, name string, operator string, address_line string, locality string, city string, state string, postal_code string, country string, "
    "latitude double, longitude double, is_24_hours boolean, opening_time string, closing_time string, operational_status string, "
    "connectors array<struct<id: string, station_id: string, connector_type: string, charging_standard: string, power_kw: double, quantity: int, pricing_type: string, price_per_kwh: double, currency: string>>"
)


def read_station_json(spark: SparkSession, path: str) -> DataFrame:
    """Stations with nested connectors from a file that holds one JSON array."""
    return spark.read.option("multiLine", True).schema(STATION_SCHEMA).json(path)


def connectors_of(stations: DataFrame) -> DataFrame:
    return stations.select(F.col("id").alias("station"), F.explode("connectors").alias("c")).select("station", "c.*")


def read_station_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV with a header whose coordinates can be read; others are left out."""
    raw = spark.read.option("header", True).csv(path)
    x = raw.withColumn("latitude", F.col("latitude").try_cast("double")).withColumn("longitude", F.col("longitude").try_cast("double"))
    return x.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def read_table(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], partitions: int, **options: str) -> DataFrame:
    """A database table in key ranges, so that executors read it side by side."""
    lo, hi = bounds
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(lo), upperBound=str(hi), numPartitions=str(partitions), **options).load()


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for dimensions and daily rows that people download."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def read_landed_pages(spark: SparkSession, path: str, date_from: str | None = None) -> DataFrame:
    """Rows (offset, payload) of a partner feed's landed pages: files page_<offset>.json that hold one JSON array each.

    Spark's own readers read them, so any file system will do.  Records last updated before date_from are left out;
    those without a time stay.  A folder without pages is an error, as a feed that landed nothing isn't an empty one.
    """
    pages = spark.read.option("wholetext", True).text(f"{path.rstrip('/')}/page_*.json")
    offset = F.regexp_extract(F.col("_metadata.file_name"), r"page_([0-9]+)\.json$", 1).cast("int")
    records = pages.select(offset.alias("offset"), F.explode(F.from_json("value", "array<string>", {"mode": "FAILFAST"})).alias("payload"))
    if date_from is None:
        return records
    updated = F.get_json_object("payload", "$.last_updated")
    return records.where(updated.isNull() | (updated >= date_from))


def run_record(spark: SparkSession, source: str, state: str, counters: dict[str, int], error: str | None = None) -> DataFrame:
    """One accounting row of an execution; secrets in error texts are hidden."""
    from voltmill.functions.text import scrub_secrets

    row = spark.createDataFrame([(source, state, counters, error)], "source_name string, state string, counters map<string, long>, error string")
    return row.withColumn("error", scrub_secrets(F.col("error"))).withColumn("finished_at", F.current_timestamp())


def run_state(fetched: int, rejected: int, warnings: int) -> str:
    """PARTIAL for nothing fetched, rejects or warnings."""
    return "PARTIAL" if fetched == 0 or rejected or warnings else "SUCCEEDED"
