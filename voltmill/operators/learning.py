"""Anomalies, maturity gates, datasets, features and models with hard gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_REFERENCE = 10


@dataclass(frozen=True)
class Gate:
    """Thresholds of production readiness and of warming."""

    observations: int = 500
    stations: int = 5
    days: int = 30
    per_station: int = 50
    stale_hours: float = 72.0
    warming_observations: int = 50
    warming_stations: int = 2
    warming_days: int = 7


def zscore_anomalies(df: DataFrame, keys: list[str], value: str, threshold: float = 3.0) -> DataFrame:
    """Rows further than threshold population deviations from their group's mean; small and constant groups have none."""
    g = df.groupBy(*keys).agg(F.count(value).alias("__n"), F.avg(value).alias("__mu"), F.stddev_pop(value).alias("__sd")).where(f"__n >= {MIN_REFERENCE} AND __sd > 0")
    x = df.join(g, keys).withColumn("score", F.abs(F.col(value) - F.col("__mu")) / F.col("__sd"))
    return x.where(F.col("score") > threshold).drop("__n", "__mu", "__sd")


def index_quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles by position, sorted[n div 4] and sorted[3n div 4], and n; without keys one row of the whole set.

    Keys rank their groups in a window; a whole set is ranked in ranges, so no task holds all of it.
    """
    from .relational import numbered

    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    if keys:
        r = known.withColumn("__i", F.row_number().over(W.partitionBy(*keys).orderBy("__v")) - 1).withColumn("n", F.count("*").over(W.partitionBy(*keys)))
    else:
        r = numbered(known, [F.col("__v")], "__i")
        r = r.crossJoin(F.broadcast(r.agg(F.count("*").alias("n"))))
    at = lambda k: F.max(F.when(F.col("__i") == F.floor(F.col("n") * k / 4), F.col("__v")))
    return r.groupBy(*keys).agg(F.max("n").alias("n"), at(1).alias("q1"), at(3).alias("q3"))


def iqr_anomalies(df: DataFrame, keys: list[str], value: str, k: float = 1.5) -> DataFrame:
    """Rows outside the fences with how many interquartile ranges they are beyond."""
    q = index_quartiles(df, keys, value).where(f"n >= {MIN_REFERENCE}").withColumn("iqr", F.col("q3") - F.col("q1"))
    q = q.withColumn("lo", F.col("q1") - k * F.col("iqr")).withColumn("hi", F.col("q3") + k * F.col("iqr"))
    x = df.join(q, keys) if keys else df.crossJoin(F.broadcast(q))
    v = F.col(value)
    beyond = F.when(v < F.col("lo"), F.col("lo") - v).otherwise(v - F.col("hi"))
    return x.where((v < F.col("lo")) | (v > F.col("hi"))).withColumn("score", F.coalesce(F.try_divide(beyond, F.col("iqr")), F.lit(0.0))).drop("n", "q1", "q3", "iqr", "lo", "hi")


def spatial_mining(points: DataFrame, eps_m: float = 2000.0, min_points: int = 3, gap_m: float = 5000.0, k: float = 1.5, id_col: str = "id") -> dict[str, DataFrame]:
    """Density clusters, their profiles, isolated places, and outliers among the isolated ones' distances (km).

    summary is one row: stations, clustered, noise, clusters, gaps.
    """
    from . import geo
    from .graph import connected_components

    found = geo.dbscan(points, eps_m, min_points, connected_components, id_col)
    near = geo.nearest_other(points, id_col).where(F.col("distance") >= gap_m)
    gaps = near.select(F.col("id_a").alias("id"), "neighbour", (F.col("distance") / 1000).alias("km"))
    noise = F.col("cluster") == -1
    counts = found.agg(F.count("*").alias("stations"), F.count_if(~noise).alias("clustered"), F.count_if(noise).alias("noise"), F.count_distinct(F.when(~noise, F.col("cluster"))).alias("clusters"))
    return {
        "clusters": found, "profiles": geo.cluster_profile(points, found, id_col), "gaps": gaps, "outliers": iqr_anomalies(gaps, [], "km", k),
        "summary": counts.crossJoin(gaps.agg(F.count("*").alias("gaps"))),
    }


def history_summary(observations: DataFrame, key: str, at: str = "observed_at") -> DataFrame:
    """Per key: days with evidence, median number of events of such a day, and the span from first to last in days."""
    per = observations.groupBy(key, F.to_date(at).alias("day")).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return per.groupBy(key).agg(F.median("n").alias("median_daily"), F.count("*").alias("days"), ((micros(F.max("last")) - micros(F.min("first"))) / 86.4e9).alias("span_days"))


def maturity_evidence(observations: DataFrame, as_of: Column) -> DataFrame:
    """One row of evidence over real observations, each (station, time) once.

    observations has station_key, observed_at (UTC) and is_simulated.
    """
    real = observations.where(~F.coalesce("is_simulated", F.lit(False)) & F.col("station_key").isNotNull() & F.col("observed_at").isNotNull())
    once = real.select("station_key", "observed_at").distinct()
    per = once.groupBy("station_key").agg(F.count("*").alias("n"), F.min("observed_at").alias("first"), F.max("observed_at").alias("last"))
    days = once.select(F.to_date("observed_at").alias("d")).distinct().agg(F.count("*").alias("days"))
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.max("last").cast("timestamp"))) / 3.6e9
    span = (F.unix_micros(F.max("last").cast("timestamp")) - F.unix_micros(F.min("first").cast("timestamp"))) / 86.4e9
    totals = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("observations"), F.count("*").alias("stations"), F.min("n").alias("per_station_min"), F.max("n").alias("per_station_max"),
        F.median("n").alias("per_station_median"), age.alias("age_hours"), span.alias("span_days"),
    )
    return totals.crossJoin(days)


def gate_state(evidence: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """Add state (READY, WARMING, COLD) and the failed criteria."""
    c = F.col
    fails = F.array_compact(F.array(
        F.when(c("observations") < gate.observations, "observations"), F.when(c("stations") < gate.stations, "stations"), F.when(c("days") < gate.days, "days"),
        F.when(c("per_station_min") < gate.per_station, "per_station"), F.when(c("age_hours").isNull() | (c("age_hours") > gate.stale_hours), "freshness"),
    ))
    warm = (c("observations") >= gate.warming_observations) & (c("stations") >= gate.warming_stations) & (c("days") >= gate.warming_days)
    return evidence.withColumn("failed", fails).withColumn("state", F.when(F.size("failed") == 0, "READY").when(warm, "WARMING").otherwise("COLD"))


def classify_station(days_90: Column, observations: Column) -> Column:
    return F.when((days_90 >= 30) & (observations >= 200), "READY").when(days_90 >= 7, "WARMING").otherwise("COLD")


def split_feasible(events: Column, dates: Column) -> Column:
    return (events >= 30) & (dates >= 14)


def gated_dataset(opportunities: DataFrame, order: list[Column], target: str = "target", at: str = "ts") -> DataFrame:
    """Rows with a target and their chronological split; no rows at all where events or dates are too few."""
    from .relational import chronological_split

    events = opportunities.where(F.col(target).isNotNull())
    gate = events.agg(F.count("*").alias("n"), F.count_distinct(F.to_date(at)).alias("d")).select(split_feasible(F.col("n"), F.col("d")).alias("__open"))
    return chronological_split(events, order, (0.6, 0.2, 0.2), ("train", "valid", "test")).crossJoin(F.broadcast(gate)).where("__open").drop("__open")


def static_features(stations: DataFrame, connectors: DataFrame, key: str) -> DataFrame:
    """Connector count and power of each station; unknown stays null."""
    c = connectors.groupBy(key).agg(F.sum("quantity").alias("connector_count"), F.max("power_kw").alias("max_power_kw"))
    return stations.join(c, key, "left").withColumn("has_known_power", F.col("max_power_kw").isNotNull())


def temporal_features(points: DataFrame, events: DataFrame, key: str, at: str) -> DataFrame:
    """At each point in time: hour, ISO weekday, the last status and the week's events at or before it; null without history."""
    t = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    # One stream of events and points per key; a point comes after events of the same time.
    e = events.select(key, t("observed_at").alias("__t"), F.lit(0).alias("__p"), F.col("availability_status").alias("__s"), F.col("observation_id").alias("__o"), F.lit(None).cast("long").alias("point_id"))
    p = points.select(key, t(at).alias("__t"), F.lit(1).alias("__p"), F.lit(None).cast("string").alias("__s"), F.lit(None).cast("long").alias("__o"), "point_id")
    w = W.partitionBy(key).orderBy("__t", "__p", "__o").rowsBetween(W.unboundedPreceding, W.currentRow)
    week = W.partitionBy(key).orderBy("__t").rangeBetween(-7 * 86400 * 1_000_000, 0)
    x = e.unionByName(p).withColumn("recent_availability", F.last("__s", ignorenulls=True).over(w)).withColumn("__n", F.sum(1 - F.col("__p")).over(week)).withColumn("__past", F.sum(1 - F.col("__p")).over(w))
    ts = F.timestamp_micros("__t")
    return x.where("__p = 1").select("point_id", key, F.hour(ts).alias("hour_of_day"), (F.weekday(ts) + 1).alias("day_of_week"), "recent_availability", F.when(F.col("__past") > 0, F.col("__n")).alias("obs_count_7d"))


def mean_impute(df: DataFrame, fields: list[str], training: Column) -> DataFrame:
    """Fill missing fields by their means over the training rows; a field without any stays null."""
    means = df.where(training).agg(*[F.avg(f).alias(f"__m_{f}") for f in fields])
    return df.crossJoin(F.broadcast(means)).select(*[F.coalesce(F.col(c).cast("double"), F.col(f"__m_{c}")).alias(c) if c in fields else F.col(c) for c in df.columns])


def median_impute(df: DataFrame, fields: list[str], training: Column) -> DataFrame:
    """Fill missing fields by their training medians, and by 0.0 where every training value is missing."""
    med = df.where(training).agg(*[F.median(f).alias(f"__m_{f}") for f in fields])
    return df.crossJoin(F.broadcast(med)).select(*[F.coalesce(F.col(c).cast("double"), F.col(f"__m_{c}"), F.lit(0.0)).alias(c) if c in fields else F.col(c) for c in df.columns])


def demand_table(observations: DataFrame) -> DataFrame:
    """Occupancy target clipped to [0, 1] with neutral fills for hour, weekday and plugs (mining only)."""
    plugs = F.coalesce(F.nullif("total_connectors", F.lit(0)), F.lit(4))
    y = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.coalesce("available_connectors", plugs) / plugs))
    return observations.select(
        "observation_id", "station_key", "observed_at", y.alias("occupancy"), F.coalesce(F.hour("observed_at"), F.lit(12)).alias("hour"),
        F.coalesce(F.weekday("observed_at"), F.lit(0)).alias("weekday"), plugs.alias("plugs"), (F.weekday("observed_at") >= 5).cast("int").alias("is_weekend"),
    )


def forest_metrics(table: DataFrame, features: list[str], label: str, split: Column, trees: int = 100, depth: int = 8, seed: int = 42) -> DataFrame:
    """Random-forest regression against the hour-mean baseline: mae, rmse, r2, baseline_mae, and rows of each side."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    x = VectorAssembler(inputCols=features, outputCol="features").transform(table).withColumn("__train", split)
    train, test = x.where("__train"), x.where("NOT __train")
    model = RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(train)
    hour = train.groupBy("hour").agg(F.avg(label).alias("__b"))
    overall = train.agg(F.avg(label).alias("__all"))
    p = model.transform(test).join(F.broadcast(hour), "hour", "left").crossJoin(F.broadcast(overall)).withColumn("base", F.coalesce("__b", "__all"))
    y, e = F.col(label), F.col(label) - F.col("prediction")
    return p.agg(F.count("*").alias("rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / (F.var_pop(y) * F.count("*"))).alias("r2"), F.avg(F.abs(y - F.col("base"))).alias("baseline_mae"))


def kmeans_profile(table: DataFrame, features: list[str], k: int = 3, seed: int = 42) -> DataFrame:
    """Size and centroid of each cluster, numbered by centroid so that runs compare."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=features, outputCol="features").transform(table)
    labelled = KMeans(k=k, seed=seed, maxIter=50).fit(x).transform(x)
    g = labelled.groupBy("prediction").agg(F.count("*").alias("size"), *[F.avg(f).alias(f) for f in features])
    return g.select((F.row_number().over(W.orderBy(*features)) - 1).alias("cluster"), "size", *features)


def train_classifier(table: DataFrame, features: list[str], label: str, evidence: DataFrame, order: list[Column]) -> tuple[object | None, DataFrame]:
    """Gradient-boosted trees on a chronological 70/15/15 split with training medians, if the gate is READY.

    Returns the model (None where the gate is closed) and a report row; a model is never approved by itself.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    from .relational import chronological_split

    state = gate_state(evidence).select("state").first()["state"]
    spark = table.sparkSession
    schema = "state string, trained boolean, accuracy double, baseline_accuracy double, approved boolean"
    if state != "READY":
        return None, spark.createDataFrame([(state, False, None, None, False)], schema)
    s = chronological_split(table.where(F.col(label).isNotNull()), order, (0.70, 0.15, 0.15), ("train", "valid", "test"))
    s = median_impute(s, features, F.col("split") == "train")
    x = VectorAssembler(inputCols=features, outputCol="features").transform(s.withColumn("__y", F.col(label).cast("double")))
    model = GBTClassifier(featuresCol="features", labelCol="__y", maxIter=100, maxDepth=4, stepSize=0.1, minInstancesPerNode=10, seed=42).fit(x.where("split = 'train'"))
    majority = x.where("split = 'train'").groupBy("__y").count().orderBy(F.desc("count"), "__y").limit(1).select(F.col("__y").alias("__m"))
    t = model.transform(x.where("split = 'test'")).crossJoin(F.broadcast(majority))
    acc = t.agg(F.avg((F.col("prediction") == F.col("__y")).cast("double")).alias("accuracy"), F.avg((F.col("__m") == F.col("__y")).cast("double")).alias("baseline_accuracy"))
    return model, acc.select(F.lit(state).alias("state"), F.lit(True).alias("trained"), "accuracy", "baseline_accuracy", F.lit(False).alias("approved"))


def inference_status(model_approved: Column, age_hours: Column, schema_ok: Column, artefact_ok: Column) -> Column:
    """The first check that fails: approval, freshness (72 h at most, not in the future), schema, artefact."""
    fresh = F.coalesce(age_hours.between(0, 72), F.lit(False))
    ok = lambda c: F.coalesce(c, F.lit(False))
    return F.when(~ok(model_approved), "NO_APPROVED_MODEL").when(~fresh, "STALE_FEATURES").when(~ok(schema_ok), "SCHEMA_MISMATCH").when(~ok(artefact_ok), "ARTEFACT_INVALID").otherwise("READY")
