"""Star-schema operators: calendar, daily evidence, versioned dimensions, fact loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Scores of queue levels; an unknown level has none.
QUEUE_SCORES = {"none": 0.0, "short": 0.33, "medium": 0.66, "long": 1.0}


def calendar(spark: SparkSession, first: str = "2024-01-01", last: str = "2032-12-31") -> DataFrame:
    """One row per UTC date: date_key, full_date, year, quarter, month, month_name, week (ISO), day, day_of_week (1 Monday), day_name, is_weekend."""
    d = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("full_date"))
    key = F.year("full_date") * 10000 + F.month("full_date") * 100 + F.day("full_date")
    dow = F.weekday("full_date") + 1
    return d.select(
        key.alias("date_key"), "full_date", F.year("full_date").alias("year"), F.quarter("full_date").alias("quarter"), F.month("full_date").alias("month"),
        F.date_format("full_date", "MMMM").alias("month_name"), F.weekofyear("full_date").alias("week"), F.day("full_date").alias("day"),
        dow.alias("day_of_week"), F.date_format("full_date", "EEEE").alias("day_name"), (dow >= 6).alias("is_weekend"),
    )


def time_slots(spark: SparkSession) -> DataFrame:
    """The 96 quarter hours: time_key, slot_15min, hour, minute, day_part."""
    t = spark.range(96).select(F.col("id").cast("int").alias("time_key"))
    h, m = F.expr("time_key div 4").cast("int"), (F.col("time_key") % 4 * 15).cast("int")
    part = F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")
    slot = F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"))
    return t.select("time_key", slot.alias("slot_15min"), h.alias("hour"), m.alias("minute"), part.alias("day_part"))


def utc_keys(ts: Column) -> tuple[Column, Column]:
    """date_key and quarter-hour time_key of a UTC timestamp."""
    return F.year(ts) * 10000 + F.month(ts) * 100 + F.day(ts), F.hour(ts) * 4 + F.floor(F.minute(ts) / 15).cast("int")


def queue_score(level: Column) -> Column:
    score = F.lit(None).cast("double")
    for name, value in QUEUE_SCORES.items():
        score = F.when(level == name, F.lit(value)).otherwise(score)
    return score


def daily_evidence(observations: DataFrame, reports: DataFrame, reviews: DataFrame, date_key: int | None = None) -> DataFrame:
    """One row per station and date with any evidence; ratios and scores are null without their evidence.

    The three facts become one stream of rows of one shape, so a single partial aggregate and one exchange
    give the union of their keys.
    """
    none = F.lit(None)
    obs = observations.select(
        "station_key", "date_key", F.lit(1).alias("o"), F.lit(0).alias("rep"), none.cast("int").alias("rating"),
        "availability_status", queue_score(F.col("queue_level")).alias("q"), "source_key",
        ((F.col("availability_status") != "unknown") & (F.col("queue_level") != "unknown") & (F.coalesce("total_connectors", F.lit(0)) > 0)).cast("int").alias("full"),
    )
    empty = [none.cast("string").alias("availability_status"), none.cast("double").alias("q"), none.cast("int").alias("source_key"), none.cast("int").alias("full")]
    rep = reports.select("station_key", "date_key", F.lit(0).alias("o"), F.lit(1).alias("rep"), none.cast("int").alias("rating"), *empty)
    rev = reviews.select("station_key", "date_key", F.lit(0).alias("o"), F.lit(0).alias("rep"), F.col("rating").cast("int").alias("rating"), *empty)
    rows = obs.unionByName(rep).unionByName(rev)
    if date_key is not None:
        rows = rows.where(F.col("date_key") == date_key)
    n = F.sum("o")
    status = {s: F.sum(F.when(F.col("availability_status") == s, 1).otherwise(0)) for s in ("available", "busy", "broken")}
    ratio = lambda x: (x / F.nullif(n, F.lit(0))).alias
    return rows.groupBy("station_key", "date_key").agg(
        n.alias("observation_count"), F.sum("rep").alias("report_count"), F.count("rating").alias("review_count"),
        status["available"].alias("available_count"), status["busy"].alias("busy_count"), status["broken"].alias("broken_count"),
        ratio(status["available"])("availability_ratio"), ratio(status["busy"])("busy_ratio"), ratio(status["broken"])("broken_ratio"),
        F.avg("q").alias("avg_queue_score"), F.max("q").alias("peak_queue_score"), F.avg("rating").alias("avg_rating"),
        F.avg("full").alias("data_completeness_score"), F.count_distinct("source_key").alias("source_count"),
        F.lit("cold").alias("maturity"), F.lit(True).alias("has_evidence"),
    )


def scd2_sync(current: DataFrame, incoming: DataFrame, key: str, tracked: list[str], now: Column) -> DataFrame:
    """Version a dimension: rows of unchanged keys stay, changed ones are closed at now and opened as the next version, new ones opened.

    current has key, tracked, version, effective_from, effective_to, is_current; texts are equal to null when empty.
    """
    same = None
    for c in tracked:
        a, b = F.col(f"c.{c}"), F.col(f"i.{c}")
        kind = dict(incoming.dtypes)[c]
        if kind == "string":
            e = F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))
        elif kind == "double":
            e = F.coalesce(F.abs(a - b) <= 1e-5, a.isNull() & b.isNull())
        else:
            e = a.eqNullSafe(b)
        same = e if same is None else same & e
    open_now = current.where("is_current").alias("c")
    pair = open_now.join(incoming.alias("i"), F.col(f"c.{key}") == F.col(f"i.{key}"), "full")
    action = F.when(F.col(f"i.{key}").isNull(), "keep").when(F.col(f"c.{key}").isNull(), "new").when(same, "keep").otherwise("change")
    pair = pair.withColumn("__action", action)
    cols = [key, *tracked, "version", "effective_from", "effective_to", "is_current"]
    kept = pair.where("__action = 'keep'").select(*[F.col(f"c.{c}") for c in cols])
    closed = pair.where("__action = 'change'").select(*[F.col(f"c.{c}") for c in (key, *tracked, "version", "effective_from")], now.alias("effective_to"), F.lit(False).alias("is_current"))
    version = F.coalesce(F.col("c.version"), F.lit(0)) + 1
    opened = pair.where("__action IN ('change', 'new')").select(F.col(f"i.{key}"), *[F.col(f"i.{c}") for c in tracked], version.alias("version"), now.alias("effective_from"), F.lit(None).cast(dict(current.dtypes)["effective_to"]).alias("effective_to"), F.lit(True).alias("is_current"))
    return current.where("NOT is_current").select(*cols).unionByName(kept).unionByName(closed).unionByName(opened)


def disjoint_periods(versions: DataFrame, key: str) -> DataFrame:
    """Periods (key, effective_from, effective_to, version_key) that don't overlap: at each time the version that began last, by key of equal ones.

    A key has few versions, so they meet each other here and not at each of its many events.
    """
    v = versions.select(key, "version_key", "effective_from", "effective_to").where("effective_to IS NULL OR effective_to > effective_from")
    edges = v.select(key, F.col("effective_from").alias("t")).union(v.where("effective_to IS NOT NULL").select(key, "effective_to")).distinct()
    spans = edges.withColumn("until", F.lead("t").over(W.partitionBy(key).orderBy("t")))
    over = spans.join(v, key).where("effective_from <= t AND (effective_to IS NULL OR effective_to > t)")
    top = F.max_by("version_key", F.struct("effective_from", "version_key"))
    return over.groupBy(key, F.col("t").alias("effective_from"), F.col("until").alias("effective_to")).agg(top.alias("version_key"))


def load_facts(events: DataFrame, versions: DataFrame, dates: DataFrame, key: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Facts with their point-in-time version, and rejected events with a reason (date outside the calendar, no version then).

    Each event meets at most one period, so equal events load as often as they come.
    """
    from .relational import valid_at

    date_key, _ = utc_keys(F.col(at))
    dated = events.withColumn("date_key", date_key).join(dates.select("date_key", F.lit(True).alias("__known")), "date_key", "left")
    joined = valid_at(dated, disjoint_periods(versions, key), key, at)
    reason = F.when(F.col("__known").isNull(), "date outside calendar").when(F.col("version_key").isNull(), "no version at event time")
    out = joined.withColumn("reason", reason).drop("__known", "effective_from")
    return out.where("reason IS NULL").drop("reason"), out.where("reason IS NOT NULL")


def current_versions(versions: DataFrame, key: str) -> DataFrame:
    """The open version of each key."""
    w = W.partitionBy(key).orderBy(F.col("effective_from").desc(), F.col("version_key").desc())
    return versions.where("effective_to IS NULL").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
