"""Anomalies, gates, datasets, features, models and maturity reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltmill.operators import learning, metrics, warehouse
from voltmill.sources.driver_tables import Star

from .core import query
from .explore import _DB_SQL, EPS, NEAREST, POINTS, points
from .star_sql import CTES

AS_OF = "2024-01-31 00:00:00"
_NOW = F.lit


@query("ml_07_zscore_anomalies", "SELECT observation_id, round(score, 9) AS score FROM (SELECT observation_id, abs(value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS score, count(*) OVER w AS n FROM fact_observation WINDOW w AS (PARTITION BY station_key)) WHERE n >= 10 AND score > 3")
def _(s: Star) -> DataFrame:
    return learning.zscore_anomalies(s.fact_observation.select("station_key", "observation_id", "value"), ["station_key"], "value").select("observation_id", F.round("score", 9).alias("score"))


@query("ml_08_iqr_anomalies", """WITH q AS (SELECT station_key, list(value ORDER BY value) AS v, count(*) AS n FROM fact_observation GROUP BY 1 HAVING count(*) >= 10), f AS (SELECT station_key, v[n // 4 + 1] AS q1, v[(3 * n) // 4 + 1] AS q3 FROM q)
SELECT o.observation_id, CASE WHEN q3 = q1 THEN 0 WHEN value < q1 THEN ((q1 - 1.5::DOUBLE * (q3 - q1)) - value) / (q3 - q1) ELSE (value - (q3 + 1.5::DOUBLE * (q3 - q1))) / (q3 - q1) END AS score FROM fact_observation o JOIN f USING (station_key) WHERE value < q1 - 1.5::DOUBLE * (q3 - q1) OR value > q3 + 1.5::DOUBLE * (q3 - q1)""")
def _(s: Star) -> DataFrame:
    return learning.iqr_anomalies(s.fact_observation.select("station_key", "observation_id", "value"), ["station_key"], "value").select("observation_id", "score")


_GAPS = "g AS (SELECT id, distance / 1000 AS km FROM nn WHERE distance >= 1500), q AS (SELECT list(km ORDER BY km) AS l, count(*) AS n FROM g), f AS (SELECT l[n // 4 + 1] AS q1, l[(3 * n) // 4 + 1] AS q3, n FROM q)"


@query("ml_06_gap_distance_outliers", f"WITH {_GAPS} SELECT id, round(km, 6) AS gap_km, round(CASE WHEN km > q3 THEN km - (q3 + 0.2::DOUBLE * (q3 - q1)) ELSE q1 - 0.2::DOUBLE * (q3 - q1) - km END / (q3 - q1), 4) AS score FROM g, f WHERE n >= 10 AND (km > q3 + 0.2::DOUBLE * (q3 - q1) OR km < q1 - 0.2::DOUBLE * (q3 - q1))", pts=POINTS, nn=NEAREST)
def _(s: Star) -> DataFrame:
    out = learning.spatial_mining(points(s), eps_m=2000.0, min_points=3, gap_m=1500.0, k=0.2)["outliers"]
    return out.select("id", F.round("km", 6).alias("gap_km"), F.round("score", 4).alias("score"))


@query("ml_06_spatial_summary", _DB_SQL.replace("SELECT p.id, coalesce(l.cluster, b.c, -1) AS cluster, l.id IS NOT NULL AS is_core FROM pts p", "SELECT count(*) AS stations, count(coalesce(l.cluster, b.c)) AS clustered, count(*) - count(coalesce(l.cluster, b.c)) AS noise, count(DISTINCT coalesce(l.cluster, b.c)) AS clusters, (SELECT count(*) FROM nn WHERE distance >= 1500) AS gaps FROM pts p").replace(", near AS", f", nn AS ({NEAREST}), near AS", 1))
def _(s: Star) -> DataFrame:
    return learning.spatial_mining(points(s), eps_m=float(EPS), min_points=3, gap_m=1500.0, k=0.2)["summary"]


EVID = f"""SELECT CAST(sum(n) AS BIGINT) AS observations, count(*) AS stations, min(n) AS per_station_min, max(n) AS per_station_max, median(n) AS per_station_median, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(l))) / 3.6e9 AS age_hours, (SELECT count(DISTINCT CAST(observed_at AS DATE)) FROM fact_observation WHERE NOT is_simulated) AS days
FROM (SELECT station_key, count(DISTINCT observed_at) AS n, max(observed_at) AS l FROM fact_observation WHERE NOT is_simulated GROUP BY 1)"""


def evidence(s: Star) -> DataFrame:
    return learning.maturity_evidence(s.fact_observation.select("station_key", "observed_at", "is_simulated"), F.lit(AS_OF))


@query("ml_12_maturity_evidence", "SELECT observations, stations, per_station_min, per_station_max, per_station_median, round(age_hours, 6) AS age_hours, days FROM evid", evid=EVID)
def _(s: Star) -> DataFrame:
    return evidence(s).drop("span_days").withColumn("age_hours", F.round("age_hours", 6))


@query("ml_13_gate_state", """SELECT CASE WHEN observations >= 500 AND stations >= 5 AND days >= 30 AND per_station_min >= 50 AND age_hours <= 72 THEN 'READY' WHEN observations >= 50 AND stations >= 2 AND days >= 7 THEN 'WARMING' ELSE 'COLD' END AS state,
concat_ws(',', CASE WHEN observations < 500 THEN 'observations' END, CASE WHEN stations < 5 THEN 'stations' END, CASE WHEN days < 30 THEN 'days' END, CASE WHEN per_station_min < 50 THEN 'per_station' END, CASE WHEN age_hours > 72 THEN 'freshness' END) AS failed FROM evid""", evid=EVID)
def _(s: Star) -> DataFrame:
    return learning.gate_state(evidence(s)).select("state", F.array_join("failed", ",").alias("failed"))


@query("ml_09_static_features", "SELECT s.station_key, s.latitude, s.is_24_hours, CAST(sum(c.quantity) AS BIGINT) AS connector_count, max(c.power_kw) AS max_power_kw, max(c.power_kw) IS NOT NULL AS has_known_power FROM dim_station s LEFT JOIN dim_connector c USING (station_key) GROUP BY 1, 2, 3")
def _(s: Star) -> DataFrame:
    return learning.static_features(s.dim_station.select("station_key", "latitude", "is_24_hours"), s.dim_connector, "station_key")


@query("ml_09_temporal_features", """SELECT p.report_id AS point_id, CAST(hour(p.observed_at) AS INT) AS hour_of_day, CAST(isodow(p.observed_at) AS INT) AS day_of_week, arg_max(o.availability_status, (o.observed_at, o.observation_id)) AS recent_availability, CASE WHEN count(o.observation_id) > 0 THEN count(o.observation_id) FILTER (WHERE o.observed_at >= p.observed_at - INTERVAL 7 DAY) END AS obs_count_7d
FROM fact_report p LEFT JOIN fact_observation o ON o.station_key = p.station_key AND o.observed_at <= p.observed_at GROUP BY 1, 2, 3""")
def _(s: Star) -> DataFrame:
    points = s.fact_report.select(F.col("report_id").alias("point_id"), "station_key", F.col("observed_at").alias("at"))
    return learning.temporal_features(points, s.fact_observation, "station_key", "at").drop("station_key")


@query("ml_10_mean_imputer", "SELECT connector_id, round(coalesce(power_kw, (SELECT avg(power_kw) FROM dim_connector WHERE connector_key % 5 < 3)), 9) AS power_kw FROM dim_connector")
def _(s: Star) -> DataFrame:
    x = learning.mean_impute(s.dim_connector.select("connector_id", "connector_key", "power_kw"), ["power_kw"], F.col("connector_key") % 5 < 3)
    return x.select("connector_id", F.round("power_kw", 9).alias("power_kw"))


@query("ml_14_median_imputer", "SELECT connector_id, coalesce(power_kw, (SELECT median(power_kw) FROM dim_connector WHERE connector_key % 5 < 3)) AS power_kw FROM dim_connector")
def _(s: Star) -> DataFrame:
    return learning.median_impute(s.dim_connector.select("connector_id", "connector_key", "power_kw"), ["power_kw"], F.col("connector_key") % 5 < 3).select("connector_id", "power_kw")


@query("ml_11_gated_dataset", """WITH e AS (SELECT observation_id, row_number() OVER (ORDER BY observed_at, observation_id) - 1 AS i, count(*) OVER () AS n FROM fact_observation WHERE availability_status <> 'unknown')
SELECT split, count(*) AS rows, max(observation_id) AS last_id FROM (SELECT observation_id, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.8) THEN 'valid' ELSE 'test' END AS split FROM e) GROUP BY 1""")
def _(s: Star) -> DataFrame:
    x = s.fact_observation.select("observation_id", F.col("observed_at").alias("ts"), F.when(F.col("availability_status") != "unknown", F.col("availability_status")).alias("target"))
    return learning.gated_dataset(x, [F.col("ts"), F.col("observation_id")]).groupBy("split").agg(F.count("*").alias("rows"), F.max("observation_id").alias("last_id"))


@query("ml_11_gated_dataset_closed", "SELECT observation_id FROM fact_observation WHERE false")
def _(s: Star) -> DataFrame:
    day = s.fact_observation.where("date_key = 20240105").select("observation_id", F.col("observed_at").alias("ts"), F.col("availability_status").alias("target"))
    return learning.gated_dataset(day, [F.col("ts"), F.col("observation_id")]).select("observation_id")


@query("ml_19_forecast_split", "SELECT CASE WHEN observed_at <= TIMESTAMP '2024-01-20 00:00:00' THEN 'history' ELSE 'target' END AS side, count(*) AS n FROM fact_observation WHERE observed_at <= TIMESTAMP '2024-01-20 00:00:00' + INTERVAL 24 HOUR GROUP BY 1")
def _(s: Star) -> DataFrame:
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    x = s.fact_observation.where(F.col("observed_at") <= cut + F.expr("INTERVAL 24 HOURS"))
    return x.groupBy(F.when(F.col("observed_at") <= cut, "history").otherwise("target").alias("side")).agg(F.count("*").alias("n"))


@query("ml_21_baseline_comparison", "SELECT * FROM (VALUES (1, 'beats'), (2, 'does not beat'), (3, 'undetermined'), (4, 'does not beat')) t(i, verdict)")
def _(s: Star) -> DataFrame:
    rows = s.spark.createDataFrame([(1, 0.2, 0.3), (2, 0.4, 0.3), (3, None, 0.3), (4, 0.3, 0.3)], "i int, m double, b double")
    return rows.select("i", metrics.against_baseline(F.col("m"), F.col("b")).alias("verdict"))


@query("ml_15_inference_checks", "SELECT * FROM (VALUES (1, 'READY'), (2, 'NO_APPROVED_MODEL'), (3, 'STALE_FEATURES'), (4, 'STALE_FEATURES'), (5, 'SCHEMA_MISMATCH'), (6, 'ARTEFACT_INVALID'), (7, 'NO_APPROVED_MODEL')) t(i, status)")
def _(s: Star) -> DataFrame:
    rows = s.spark.createDataFrame([(1, True, 1.0, True, True), (2, False, 1.0, True, True), (3, True, 73.0, True, True), (4, True, -1.0, True, True), (5, True, 1.0, False, True), (6, True, 1.0, True, False), (7, None, None, None, None)], "i int, a boolean, h double, c boolean, f boolean")
    return rows.select("i", learning.inference_status(*[F.col(c) for c in "ahcf"]).alias("status"))


@query("ml_03_demand_table", "SELECT observation_id, round(least(1, greatest(0, 1 - available_connectors / total_connectors::DOUBLE)), 9) AS occupancy, CAST(hour(observed_at) AS INT) AS hour, CAST(isodow(observed_at) - 1 AS INT) AS weekday, CAST(isodow(observed_at) >= 6 AS INT) AS is_weekend FROM fact_observation")
def _(s: Star) -> DataFrame:
    return learning.demand_table(s.fact_observation).select("observation_id", F.round("occupancy", 9).alias("occupancy"), "hour", "weekday", "is_weekend")


@query("ml_01_kmeans")
def _(s: Star) -> DataFrame:
    score = s.fact_observation.groupBy("station_key").agg(((1 - F.avg("available_connectors") / 4) * 100).alias("demand_score"))
    return learning.kmeans_profile(s.dim_station.join(score, "station_key"), ["latitude", "longitude", "demand_score"])


@query("ml_02_forest_chronological")
def _(s: Star) -> DataFrame:
    t = learning.demand_table(s.fact_observation)
    return learning.forest_metrics(t, ["hour", "weekday", "plugs", "is_weekend"], "occupancy", F.col("observed_at") < F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))


@query("ml_14_gated_training")
def _(s: Star) -> DataFrame:
    x = s.fact_observation.where("availability_status <> 'unknown'").select("observation_id", "observed_at", (F.col("availability_status") == "available").cast("int").alias("y"), F.hour("observed_at").alias("hour"), F.weekday("observed_at").alias("weekday"), "total_connectors", "value")
    _, report = learning.train_classifier(x, ["hour", "weekday", "total_connectors", "value"], "y", evidence(s), [F.col("observed_at"), F.col("observation_id")])
    return report


@query("ext_21_station_maturity", f"""SELECT coalesce(state, 'COLD') AS state, count(*) AS stations FROM dim_station s LEFT JOIN (SELECT station_key, CASE WHEN count(DISTINCT date_key) FILTER (WHERE observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY) >= 30 AND count(*) >= 200 THEN 'READY' WHEN count(DISTINCT date_key) FILTER (WHERE observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY) >= 7 THEN 'WARMING' ELSE 'COLD' END AS state FROM fact_observation WHERE NOT is_simulated GROUP BY 1) m USING (station_key) WHERE NOT s.is_simulated GROUP BY 1""")
def _(s: Star) -> DataFrame:
    recent = F.col("observed_at") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 90 DAYS")
    per = s.fact_observation.where("NOT is_simulated").groupBy("station_key").agg(F.count_distinct(F.when(recent, F.col("date_key"))).alias("d"), F.count("*").alias("n"))
    j = s.dim_station.where("NOT is_simulated").join(per, "station_key", "left")
    return j.groupBy(F.coalesce(learning.classify_station(F.col("d"), F.col("n")), F.lit("COLD")).alias("state")).agg(F.count("*").alias("stations"))


@query("ml_20_temporal_profile", """WITH d AS (SELECT DISTINCT CAST(observed_at AS DATE) AS day FROM fact_observation), g AS (SELECT day, day - lag(day) OVER (ORDER BY day) AS gap FROM d)
SELECT (SELECT count(*) FROM fact_observation) AS n, (SELECT CAST(date_diff('second', min(observed_at), max(observed_at)) // 86400 AS INT) FROM fact_observation) AS duration_days, count(*) AS distinct_dates, count(DISTINCT concat(strftime(day, '%Y-%m'), '-W', CAST(week(day) AS VARCHAR))) AS distinct_weeks, count(DISTINCT strftime(day, '%Y-%m')) AS distinct_months, CAST(max(gap) AS INT) AS max_gap_days FROM g""")
def _(s: Star) -> DataFrame:
    from pyspark.sql import Window as W

    o = s.fact_observation
    per = o.groupBy(F.to_date("observed_at").alias("day")).agg(F.count("*").alias("n"), F.min("observed_at").alias("a"), F.max("observed_at").alias("b"))
    g = per.withColumn("gap", F.datediff("day", F.lag("day").over(W.orderBy("day"))))  # one row a day
    week = F.concat(F.date_format("day", "yyyy-MM"), F.lit("-W"), F.weekofyear("day").cast("string"))
    seconds = F.unix_micros(F.max("b").cast("timestamp")) / 1e6 - F.unix_micros(F.min("a").cast("timestamp")) / 1e6
    return g.agg(F.sum("n").alias("n"), F.floor(seconds / 86400).cast("int").alias("duration_days"), F.count("*").alias("distinct_dates"), F.count_distinct(week).alias("distinct_weeks"), F.count_distinct(F.date_format("day", "yyyy-MM")).alias("distinct_months"), F.max("gap").alias("max_gap_days"))


@query("ml_20_missingness", """SELECT 'power_kw' AS field, count(*) AS rows, count(*) FILTER (WHERE power_kw IS NULL) AS missing, round(100.0 * count(*) FILTER (WHERE power_kw IS NULL) / nullif(count(*), 0), 2) AS pct FROM dim_connector
UNION ALL SELECT 'price_per_kwh', count(*), count(*) FILTER (WHERE price_per_kwh IS NULL), round(100.0 * count(*) FILTER (WHERE price_per_kwh IS NULL) / nullif(count(*), 0), 2) FROM dim_connector
UNION ALL SELECT 'availability', count(*), count(*) FILTER (WHERE availability_status = 'unknown'), round(100.0 * count(*) FILTER (WHERE availability_status = 'unknown') / nullif(count(*), 0), 2) FROM fact_observation""")
def _(s: Star) -> DataFrame:
    def one(df: DataFrame, field: str, missing) -> DataFrame:
        m = F.count_if(missing)
        return df.agg(F.lit(field).alias("field"), F.count("*").alias("rows"), m.alias("missing"), F.round(100.0 * m / F.nullif(F.count("*"), F.lit(0)), 2).alias("pct"))

    c = s.dim_connector
    return one(c, "power_kw", F.col("power_kw").isNull()).union(one(c, "price_per_kwh", F.col("price_per_kwh").isNull())).union(one(s.fact_observation, "availability", F.col("availability_status") == "unknown"))


@query("ml_20_target_assessment", """SELECT task, events, dates, events >= 30 AND dates >= 14 AS trainable FROM (SELECT 'availability forecasting' AS task, count(*) AS events, count(DISTINCT date_key) AS dates FROM fact_observation WHERE NOT is_simulated AND availability_status <> 'unknown'
UNION ALL SELECT 'queue prediction', count(*), count(DISTINCT date_key) FROM fact_observation WHERE NOT is_simulated AND queue_level <> 'unknown' UNION ALL SELECT 'demand forecasting', 0, 0)""")
def _(s: Star) -> DataFrame:
    real = s.fact_observation.where("NOT is_simulated")
    one = lambda df, task: df.agg(F.lit(task).alias("task"), F.count("*").alias("events"), F.count_distinct("date_key").alias("dates"))
    out = one(real.where("availability_status <> 'unknown'"), "availability forecasting").union(one(real.where("queue_level <> 'unknown'"), "queue prediction")).union(one(real.where("false"), "demand forecasting"))
    return out.withColumn("trainable", learning.split_feasible(F.col("events"), F.col("dates")))


@query("aud_geo_and_price_sections", """SELECT 'connectors' AS section, connector_type AS item, count(*) AS n FROM dim_connector GROUP BY 2 UNION ALL SELECT 'pricing', pricing_type, count(*) FROM dim_connector GROUP BY 2 UNION ALL SELECT 'status', operational_status, count(*) FROM dim_station GROUP BY 2 UNION ALL SELECT 'sources', coalesce(name, 'none'), count(*) FROM fact_observation LEFT JOIN dim_source USING (source_key) GROUP BY 2
UNION ALL SELECT 'provenance', CASE WHEN source_payload_hash IS NULL THEN 'missing' ELSE 'present' END, count(*) FROM fact_observation GROUP BY 2 UNION ALL SELECT 'queue', queue_level, count(*) FROM fact_observation GROUP BY 2 UNION ALL SELECT 'simulated', CAST(is_simulated AS VARCHAR), count(*) FROM fact_observation GROUP BY 2""")
def _(s: Star) -> DataFrame:
    from functools import reduce

    named = s.fact_observation.join(s.dim_source, "source_key", "left")
    hashed = F.when(F.col("source_payload_hash").isNull(), "missing").otherwise("present")
    parts = [("connectors", s.dim_connector, F.col("connector_type")), ("pricing", s.dim_connector, F.col("pricing_type")), ("status", s.dim_station, F.col("operational_status")), ("sources", named, F.coalesce("name", F.lit("none"))), ("provenance", s.fact_observation, hashed), ("queue", s.fact_observation, F.col("queue_level")), ("simulated", s.fact_observation, F.col("is_simulated").cast("string"))]
    return reduce(DataFrame.union, [df.groupBy(item.alias("item")).agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "item", "n") for name, df, item in parts])


@query("ext_22_dataset_summary", "SELECT station_key, round(median(n), 6) AS median_daily, count(*) AS days, round(date_diff('second', min(first), max(last)) / 86400.0::DOUBLE, 9) AS span_days FROM (SELECT o_custkey AS station_key, CAST(o_orderdate AS DATE) AS day, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1, 2) GROUP BY 1")
def _(s: Star) -> DataFrame:
    x = learning.history_summary(s.orders.select(F.col("o_custkey").alias("station_key"), F.col("o_orderdate").alias("observed_at")), "station_key")
    return x.select("station_key", F.round("median_daily", 6).alias("median_daily"), "days", F.round("span_days", 9).alias("span_days"))


@query("ext_22_observed_span", "SELECT station_key, round((epoch_us(max(observed_at)) - epoch_us(min(observed_at))) / 86.4e9, 6) AS span_days, count(DISTINCT CAST(observed_at AS DATE)) AS days FROM fact_observation GROUP BY 1")
def _(s: Star) -> DataFrame:
    return learning.history_summary(s.fact_observation, "station_key").select("station_key", "days", F.round("span_days", 6).alias("span_days"))
