"""Named warehouse queries, roll-ups and cubes, and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltmill.operators import geo, relational, warehouse
from voltmill.sources.driver_tables import Star

from .core import query
from .star_sql import CTES

CITY, STATION, AS_OF = "ASIA", "ST-7", "2024-01-31 00:00:00"


def daily(s: Star) -> DataFrame:
    return warehouse.daily_evidence(s.fact_observation, s.fact_report, s.fact_review)


def dates(s: Star) -> DataFrame:
    return F.broadcast(warehouse.calendar(s.spark))


def _percent(ratio: str, divide: str) -> str:
    """Mean of a ratio kept to four places, in percent to two, half up: whole numbers all the way, so neither the
    order of rows nor a binary fraction matters."""
    units = f"CAST(CAST({ratio} AS DECIMAL(5,4)) * 10000 AS BIGINT)"
    return f"CAST(((2 * sum({units}) + count({ratio})) {divide} nullif(2 * count({ratio}), 0)) AS DOUBLE) / 100"


def percent(ratio: str) -> Column:
    return F.expr(_percent(ratio, "div"))


def percent_sql(ratio: str) -> str:
    return _percent(ratio, "//")


@query("qry_01_stations_by_operator", "SELECT operator_name, count(*) AS station_count FROM dim_station JOIN dim_operator USING (operator_key) WHERE is_current GROUP BY 1")
def _(s: Star) -> DataFrame:
    per = s.dim_station.where("is_current").groupBy("operator_key").agg(F.count("*").alias("station_count"))
    return per.join(s.dim_operator, "operator_key").groupBy("operator_name").agg(F.sum("station_count").alias("station_count")).orderBy(F.desc("station_count"), "operator_name")


@query("qry_02_stations_by_city", "SELECT city, state, count(*) AS station_count FROM dim_station JOIN dim_location USING (location_key) WHERE is_current GROUP BY 1, 2")
def _(s: Star) -> DataFrame:
    return s.dim_station.where("is_current").join(s.dim_location, "location_key").groupBy("city", "state").agg(F.count("*").alias("station_count")).orderBy(F.desc("station_count"), "city", "state")


@query("qry_03_connector_mix", "SELECT connector_type, count(*) AS groups, CAST(sum(quantity) AS BIGINT) AS units, count(*) FILTER (WHERE power_kw IS NULL) AS unknown_power_groups FROM dim_connector GROUP BY 1")
def _(s: Star) -> DataFrame:
    return s.dim_connector.groupBy("connector_type").agg(
        F.count("*").alias("groups"), F.sum("quantity").alias("units"), F.sum(F.when(F.col("power_kw").isNull(), 1).otherwise(0)).alias("unknown_power_groups")
    ).orderBy(F.desc_nulls_last("units"), "connector_type")


@query("qry_04_observation_freshness", """SELECT s.station_id, s.station_name, epoch_us(max(o.observed_at)) AS latest_us, max(o.availability_status) AS latest_status, count(o.observation_id) AS observation_count
FROM dim_station s LEFT JOIN fact_observation o USING (station_key) WHERE s.is_current GROUP BY 1, 2""")
def _(s: Star) -> DataFrame:
    # Facts are summed before the join, so the join moves one row a station; latest_status is the greatest status by name, as the rule defines it.
    facts = s.fact_observation.groupBy("station_key").agg(F.max("observed_at").alias("t"), F.max("availability_status").alias("latest_status"), F.count("observation_id").alias("n"))
    return s.dim_station.where("is_current").join(facts, "station_key", "left").select("station_id", "station_name", F.unix_micros(F.col("t").cast("timestamp")).alias("latest_us"), "latest_status", F.coalesce("n", F.lit(0)).cast("long").alias("observation_count"))


@query("qry_04b_status_at_latest_observation", """SELECT station_key, arg_max(availability_status, (observed_at, observation_id)) AS status FROM fact_observation GROUP BY 1""")
def _(s: Star) -> DataFrame:
    return s.fact_observation.groupBy("station_key").agg(F.max_by("availability_status", F.struct("observed_at", "observation_id")).alias("status"))


@query("qry_05_daily_trend", f"""SELECT strftime(d.full_date, '%Y-%m-%d') AS full_date, f.observation_count, f.available_count, f.busy_count, f.broken_count, round(f.availability_ratio, 6) AS availability_ratio, f.report_count, f.review_count, round(f.avg_rating, 6) AS avg_rating, f.maturity
FROM fact_daily f JOIN dim_date d USING (date_key) JOIN dim_station s USING (station_key) WHERE s.station_id = '{STATION}' AND s.is_current""", **CTES)
def _(s: Star) -> DataFrame:
    one = s.dim_station.where((F.col("station_id") == STATION) & F.col("is_current")).select("station_key")
    facts = [x.join(one, "station_key", "left_semi") for x in (s.fact_observation, s.fact_report, s.fact_review)]
    d = warehouse.daily_evidence(*facts).join(dates(s), "date_key")
    return d.select(F.date_format("full_date", "yyyy-MM-dd").alias("full_date"), "observation_count", "available_count", "busy_count", "broken_count", F.round("availability_ratio", 6).alias("availability_ratio"), "report_count", "review_count", F.round("avg_rating", 6).alias("avg_rating"), "maturity").orderBy("full_date")


@query("qry_06_community_volume_daily", """SELECT strftime(d.full_date, '%Y-%m-%d') AS full_date, CAST(sum(observation_count) AS BIGINT) AS system_obs, CAST(sum(report_count) AS BIGINT) AS approved_reports, CAST(sum(review_count) AS BIGINT) AS approved_reviews
FROM fact_daily JOIN dim_date d USING (date_key) GROUP BY 1""", **CTES)
def _(s: Star) -> DataFrame:
    d = daily(s).join(dates(s), "date_key").groupBy("full_date")
    return d.agg(F.sum("observation_count").alias("system_obs"), F.sum("report_count").alias("approved_reports"), F.sum("review_count").alias("approved_reviews")).withColumn("full_date", F.date_format("full_date", "yyyy-MM-dd"))


@query("qry_07_busy_slots_by_city", f"""SELECT t.slot_15min, count(*) AS busy_obs FROM fact_observation o JOIN dim_station USING (station_key) JOIN dim_location l USING (location_key) JOIN dim_time t USING (time_key)
WHERE l.city = '{CITY}' AND o.availability_status = 'busy' GROUP BY 1""", **CTES)
def _(s: Star) -> DataFrame:
    there = s.dim_station.join(s.dim_location.where(F.col("city") == CITY), "location_key").select("station_key")
    busy = s.fact_observation.where("availability_status = 'busy'").join(there, "station_key").groupBy("time_key").agg(F.count("*").alias("busy_obs"))
    return busy.join(F.broadcast(warehouse.time_slots(s.spark)), "time_key").select("slot_15min", "busy_obs").orderBy(F.desc("busy_obs"), "slot_15min")


@query("qry_08_ingestion_health", "SELECT run_id, source_name, scope, state, epoch_us(started_at) AS started_us, records_fetched FROM ingestion_run ORDER BY started_at DESC, run_id DESC LIMIT 20")
def _(s: Star) -> DataFrame:
    return s.ingestion_run.orderBy(F.desc("started_at"), F.desc("run_id")).limit(20).select("run_id", "source_name", "scope", "state", F.unix_micros(F.col("started_at").cast("timestamp")).alias("started_us"), "records_fetched")


@query("qry_09_source_quality", "SELECT d.name, count(DISTINCT o.station_key) AS stations_observed, count(o.observation_id) AS observations FROM dim_source d LEFT JOIN fact_observation o USING (source_key) GROUP BY 1")
def _(s: Star) -> DataFrame:
    # One row per source and station first: no distinct over a whole source's rows.
    per = s.fact_observation.groupBy("source_key", "station_key").agg(F.count("*").alias("n")).groupBy("source_key").agg(F.count("*").alias("stations"), F.sum("n").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return s.dim_source.join(per, "source_key", "left").select("name", zero("stations").alias("stations_observed"), zero("n").alias("observations"))


@query("qry_10_maturity_overview", """SELECT maturity, count(*) AS stations FROM (SELECT station_key, arg_max(state, date_key) AS maturity FROM (SELECT station_key, date_key, CASE WHEN seen < 10 THEN 'cold' WHEN seen < 60 THEN 'warming' ELSE 'ready' END AS state
FROM (SELECT station_key, date_key, sum(observation_count) OVER (PARTITION BY station_key ORDER BY date_key) AS seen FROM fact_daily)) GROUP BY 1) GROUP BY 1""", **CTES)
def _(s: Star) -> DataFrame:
    seen = F.sum("observation_count").over(W.partitionBy("station_key").orderBy("date_key"))
    staged = daily(s).withColumn("maturity", F.when(seen < 10, "cold").when(seen < 60, "warming").otherwise("ready"))
    return relational.latest_values(staged, ["station_key"], ["date_key"], ["maturity"]).groupBy("maturity").agg(F.count("*").alias("stations"))


_UTIL = f"count(DISTINCT f.station_key) AS active_stations, CAST(sum(f.observation_count) AS BIGINT) AS total_ticks, {percent_sql('f.busy_ratio')} AS utilization_pct, {percent_sql('f.availability_ratio')} AS uptime_pct"


@query("olap_1a_rollup_year_month", f"""SELECT CASE WHEN grouping(d.year) = 1 THEN 'ALL YEARS' ELSE CAST(d.year AS VARCHAR) END AS year, CASE WHEN grouping(d.month) = 1 THEN 'ANNUAL TOTAL' ELSE d.month_name END AS month_name, {_UTIL}
FROM fact_daily f JOIN dim_date d USING (date_key) GROUP BY ROLLUP (d.year, (d.month, d.month_name))""", **CTES)
def _(s: Star) -> DataFrame:
    util = "count(DISTINCT station_key) AS active_stations, sum(observation_count) AS total_ticks, " + ", ".join(f"{_percent(r, 'div')} AS {n}" for r, n in (("busy_ratio", "utilization_pct"), ("availability_ratio", "uptime_pct")))
    return s.spark.sql(
        f"""SELECT IF(grouping(year) = 1, 'ALL YEARS', CAST(year AS STRING)) AS year, IF(grouping(month) = 1, 'ANNUAL TOTAL', month_name) AS month_name, {util}
        FROM {{f}} GROUP BY ROLLUP (year, (month, month_name))""",
        f=daily(s).join(dates(s), "date_key"),
    )


@query("olap_1b_rollup_month_week", f"""SELECT CASE WHEN grouping(d.month_name) = 1 THEN 'ALL MONTHS' ELSE d.month_name END AS month, CASE WHEN grouping(d.week) = 1 THEN 'MONTHLY TOTAL' ELSE CAST(d.week AS VARCHAR) END AS calendar_week, {_UTIL}
FROM fact_daily f JOIN dim_date d USING (date_key) GROUP BY ROLLUP (d.month_name, d.week)""", **CTES)
def _(s: Star) -> DataFrame:
    r = daily(s).join(dates(s), "date_key").rollup("month_name", "week").agg(
        F.grouping("month_name").alias("gm"), F.grouping("week").alias("gw"), F.count_distinct("station_key").alias("active_stations"),
        F.sum("observation_count").alias("total_ticks"), percent("busy_ratio").alias("utilization_pct"), percent("availability_ratio").alias("uptime_pct"),
    )
    month = F.when(F.col("gm") == 1, "ALL MONTHS").otherwise(F.col("month_name"))
    week = F.when(F.col("gw") == 1, "MONTHLY TOTAL").otherwise(F.col("week").cast("string"))
    return r.select(month.alias("month"), week.alias("calendar_week"), "active_stations", "total_ticks", "utilization_pct", "uptime_pct")


def _with_dims(s: Star) -> DataFrame:
    d = s.dim_station.join(s.dim_operator, "operator_key").join(s.dim_location, "location_key")
    return daily(s).join(d.select("station_key", "station_name", "operator_name", "city", "locality"), "station_key")


_DIMS = "FROM fact_daily f JOIN dim_station s USING (station_key) JOIN dim_operator o USING (operator_key) JOIN dim_location l USING (location_key)"


@query("olap_2_drill_down", f"SELECT l.city, l.locality, o.operator_name, s.station_name, {percent_sql('f.busy_ratio')} AS avg_utilization, CAST(sum(f.busy_count) AS BIGINT) AS congestion_events {_DIMS} WHERE l.city = '{CITY}' GROUP BY ALL", **CTES)
def _(s: Star) -> DataFrame:
    return _with_dims(s).where(F.col("city") == CITY).groupBy("city", "locality", "operator_name", "station_name").agg(percent("busy_ratio").alias("avg_utilization"), F.sum("busy_count").alias("congestion_events"))


@query("olap_3_slice_dice", f"""SELECT o.operator_name, l.locality, CASE WHEN d.is_weekend THEN 'Weekend' ELSE 'Weekday' END AS day_type, {percent_sql('f.busy_ratio')} AS utilization_pct, {percent_sql('f.availability_ratio')} AS uptime_pct
{_DIMS} JOIN dim_date d USING (date_key) WHERE o.operator_name IN ('NATION_1', 'NATION_4', 'NATION_15') AND l.locality IN ('Zone 0', 'Zone 1', 'Zone 2', 'Zone 3') GROUP BY ALL""", **CTES)
def _(s: Star) -> DataFrame:
    x = _with_dims(s).where(F.col("operator_name").isin("NATION_1", "NATION_4", "NATION_15") & F.col("locality").isin("Zone 0", "Zone 1", "Zone 2", "Zone 3"))
    x = x.join(dates(s).select("date_key", "is_weekend"), "date_key").groupBy("operator_name", "locality", "is_weekend").agg(percent("busy_ratio").alias("utilization_pct"), percent("availability_ratio").alias("uptime_pct"))
    return x.select("operator_name", "locality", F.when(F.col("is_weekend"), "Weekend").otherwise("Weekday").alias("day_type"), "utilization_pct", "uptime_pct")


@query("olap_4_cube", f"""SELECT CASE WHEN grouping(o.operator_name) = 1 THEN 'ALL OPERATORS' ELSE o.operator_name END AS operator, CASE WHEN grouping(l.locality) = 1 THEN 'ALL LOCALITIES' ELSE l.locality END AS locality, count(f.date_key) AS days_monitored, {percent_sql('f.busy_ratio')} AS avg_utilization
{_DIMS} GROUP BY CUBE (o.operator_name, l.locality)""", **CTES)
def _(s: Star) -> DataFrame:
    c = _with_dims(s).cube("operator_name", "locality").agg(F.grouping("operator_name").alias("go"), F.grouping("locality").alias("gl"), F.count("date_key").alias("days_monitored"), percent("busy_ratio").alias("avg_utilization"))
    return c.select(F.when(F.col("go") == 1, "ALL OPERATORS").otherwise(F.col("operator_name")).alias("operator"), F.when(F.col("gl") == 1, "ALL LOCALITIES").otherwise(F.col("locality")).alias("locality"), "days_monitored", "avg_utilization")


@query("olap_5_top3_by_operator", f"""SELECT * FROM (SELECT operator_name, station_name, utilization, dense_rank() OVER (PARTITION BY operator_name ORDER BY utilization DESC NULLS LAST) AS rank_in_network
FROM (SELECT o.operator_name, s.station_name, {percent_sql('f.busy_ratio')} AS utilization {_DIMS} GROUP BY 1, 2)) WHERE rank_in_network <= 3""", **CTES)
def _(s: Star) -> DataFrame:
    u = _with_dims(s).groupBy("operator_name", "station_name").agg(percent("busy_ratio").alias("utilization"))
    rank = F.dense_rank().over(W.partitionBy("operator_name").orderBy(F.desc_nulls_last("utilization")))
    return u.withColumn("rank_in_network", rank.cast("long")).where("rank_in_network <= 3")


def current_state(s: Star) -> DataFrame:
    """Stations with connector, review and latest-observation summaries; each is aggregated before it is joined."""
    conn = s.dim_connector.groupBy("station_key").agg(
        F.count("*").alias("connector_rows"), F.sum("quantity").alias("plugs"), F.max("power_kw").alias("max_power_kw"), F.min("price_per_kwh").alias("min_price_per_kwh"),
        F.array_sort(F.collect_set("connector_type")).alias("types"),
    )
    rev = s.review.where("moderation_status = 'approved'").groupBy("station_key").agg(F.round(F.sum("rating") / F.count("*"), 2).alias("avg_rating"), F.count("*").alias("reviews"))
    seen = s.fact_observation.where(F.col("observed_at") <= F.lit(AS_OF).cast("timestamp_ntz"))
    # Real observations before simulated ones, whole-station before connector ones, then the newest.
    order = [~F.col("is_simulated"), F.col("connector_key").isNull(), F.col("observed_at"), F.col("received_at"), F.col("observation_id")]
    obs = relational.latest_values(seen, ["station_key"], order, ["observation_id", "availability_status", "queue_level", "available_connectors", "total_connectors", "observed_at", "is_simulated"])
    obs = obs.withColumnRenamed("is_simulated", "observation_is_simulated").withColumnRenamed("operational_status", "x")
    minutes = F.round((F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.col("observed_at").cast("timestamp"))) / 60e6).cast("int")
    j = s.dim_station.join(s.dim_operator, "operator_key").join(s.dim_location, "location_key").join(conn, "station_key", "left").join(rev, "station_key", "left").join(obs, "station_key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return j.select(
        "station_id", "station_name", "operator_name", "city", "locality", "latitude", "longitude", "operational_status", zero("connector_rows").alias("total_connector_types"), zero("plugs").alias("total_plugs"),
        "max_power_kw", "min_price_per_kwh", F.array_join(F.coalesce("types", F.array().cast("array<string>")), ",").alias("connector_types"), "observation_id", "availability_status", "queue_level",
        "available_connectors", "total_connectors", minutes.alias("minutes_since_observation"), "avg_rating", zero("reviews").alias("review_count"), "is_simulated", "observation_is_simulated",
    )


_STATE = f"""SELECT s.station_id, s.station_name, o.operator_name, l.city, l.locality, s.latitude, s.longitude, s.operational_status, coalesce(c.n, 0) AS total_connector_types, CAST(coalesce(c.plugs, 0) AS BIGINT) AS total_plugs,
  c.max_power_kw, c.min_price_per_kwh, coalesce(c.types, '') AS connector_types, b.observation_id, b.availability_status, b.queue_level, b.available_connectors, b.total_connectors,
  CAST(round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(b.observed_at)) / 60e6) AS INT) AS minutes_since_observation, r.avg_rating, coalesce(r.n, 0) AS review_count, s.is_simulated, b.is_simulated AS observation_is_simulated
FROM dim_station s JOIN dim_operator o USING (operator_key) JOIN dim_location l USING (location_key)
LEFT JOIN (SELECT station_key, count(*) AS n, sum(quantity) AS plugs, max(power_kw) AS max_power_kw, min(price_per_kwh) AS min_price_per_kwh, string_agg(DISTINCT connector_type, ',' ORDER BY connector_type) AS types FROM dim_connector GROUP BY 1) c USING (station_key)
LEFT JOIN (SELECT station_key, round(avg(rating), 2) AS avg_rating, count(*) AS n FROM review WHERE moderation_status = 'approved' GROUP BY 1) r USING (station_key)
LEFT JOIN (SELECT DISTINCT ON (station_key) * FROM fact_observation WHERE observed_at <= TIMESTAMP '{AS_OF}'
  ORDER BY station_key, is_simulated ASC, (connector_key IS NULL) DESC, observed_at DESC, received_at DESC, observation_id DESC) b USING (station_key)"""


@query("qry_17_view_station_current_state", _STATE)
def _(s: Star) -> DataFrame:
    return current_state(s)


@query("qry_18_view_connectors", f"""SELECT c.connector_id, c.station_key, c.connector_type, c.power_kw, c.quantity, c.price_per_kwh, b.availability_status, b.available_connectors, epoch_us(b.observed_at) AS observed_us, b.is_simulated AS observation_is_simulated
FROM dim_connector c LEFT JOIN (SELECT DISTINCT ON (connector_key) * FROM fact_observation WHERE connector_key IS NOT NULL AND observed_at <= TIMESTAMP '{AS_OF}' ORDER BY connector_key, is_simulated ASC, observed_at DESC, received_at DESC, observation_id DESC) b USING (connector_key)""")
def _(s: Star) -> DataFrame:
    seen = s.fact_observation.where(F.col("connector_key").isNotNull() & (F.col("observed_at") <= F.lit(AS_OF).cast("timestamp_ntz")))
    top = relational.latest_values(seen, ["connector_key"], [~F.col("is_simulated"), F.col("observed_at"), F.col("received_at"), F.col("observation_id")], ["availability_status", "available_connectors", "observed_at", "is_simulated"])
    top = top.select("connector_key", "availability_status", "available_connectors", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("observed_us"), F.col("is_simulated").alias("observation_is_simulated"))
    return s.dim_connector.join(top, "connector_key", "left").select("connector_id", "station_key", "connector_type", "power_kw", "quantity", "price_per_kwh", "availability_status", "available_connectors", "observed_us", "observation_is_simulated")


@query("qry_19_view_approved_reviews", "SELECT review_id, station_key, rating, coalesce(nullif(trim(display_name), ''), 'Community member') AS author_display_name, epoch_us(created_at) AS created_us FROM review WHERE moderation_status = 'approved'")
def _(s: Star) -> DataFrame:
    author = F.coalesce(F.nullif(F.trim("display_name"), F.lit("")), F.lit("Community member"))
    return s.review.where("moderation_status = 'approved'").select("review_id", "station_key", "rating", author.alias("author_display_name"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"))


@query("qry_20_view_daily_summary", """SELECT strftime(d.full_date, '%Y-%m-%d') AS full_date, d.year, d.month, d.day_name, d.is_weekend, s.station_id, o.operator_name, f.observation_count, f.available_count, f.busy_count, f.broken_count,
round(f.availability_ratio, 6) AS availability_ratio, round(f.busy_ratio, 6) AS busy_ratio, round(f.broken_ratio, 6) AS broken_ratio, round(f.avg_queue_score, 6) AS avg_queue_score, f.peak_queue_score, f.report_count, f.review_count, round(f.avg_rating, 6) AS avg_rating, round(f.data_completeness_score, 6) AS data_completeness_score, f.source_count, f.maturity, f.has_evidence
FROM fact_daily f JOIN dim_date d USING (date_key) JOIN dim_station s USING (station_key) JOIN dim_operator o USING (operator_key)""", **CTES)
def _(s: Star) -> DataFrame:
    names = s.dim_station.join(s.dim_operator, "operator_key").select("station_key", "station_id", "operator_name")
    x = daily(s).join(names, "station_key").join(dates(s), "date_key")
    rounded = [F.round(c, 6).alias(c) for c in ("availability_ratio", "busy_ratio", "broken_ratio", "avg_queue_score", "avg_rating", "data_completeness_score")]
    return x.select(F.date_format("full_date", "yyyy-MM-dd").alias("full_date"), "year", "month", "day_name", "is_weekend", "station_id", "operator_name", "observation_count", "available_count", "busy_count", "broken_count", "peak_queue_score", "report_count", "review_count", "source_count", "maturity", "has_evidence", *rounded)


@query("qry_21_nearby_stations", """SELECT station_id, station_name, CAST(round(2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(latitude - 19.0) / 2), 2) + cos(radians(19.0)) * cos(radians(latitude)) * pow(sin(radians(longitude - 72.9) / 2), 2))))) AS BIGINT) AS distance_meters
FROM dim_station WHERE 2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(latitude - 19.0) / 2), 2) + cos(radians(19.0)) * cos(radians(latitude)) * pow(sin(radians(longitude - 72.9) / 2), 2)))) <= 25000 ORDER BY distance_meters, station_id LIMIT 50""")
def _(s: Star) -> DataFrame:
    return geo.nearby(s.dim_station, 19.0, 72.9, 25_000.0, 50).select("station_id", "station_name", "distance_meters")


_ONE = "(SELECT count(*) FROM {0}) AS {0}"


@query("qry_22_admin_warehouse_summary", "SELECT " + ", ".join(_ONE.format(t) for t in ("dim_station", "dim_operator", "dim_location", "dim_connector", "dim_source", "dim_date", "dim_time", "fact_observation", "fact_report", "fact_review", "fact_daily")) + ", (SELECT count(*) FROM dim_station WHERE is_current) AS current_stations, (SELECT count(*) FROM fact_observation WHERE is_simulated) AS simulated_observations, (SELECT max(date_key) FROM fact_daily) AS last_date_key", **CTES)
def _(s: Star) -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias(name))
    frames = [count(getattr(s, t), t) for t in ("dim_operator", "dim_location", "dim_connector", "dim_source", "fact_report", "fact_review")]
    frames += [count(warehouse.calendar(s.spark), "dim_date"), count(warehouse.time_slots(s.spark), "dim_time")]
    frames.append(s.dim_station.agg(F.count("*").alias("dim_station"), F.count_if("is_current").alias("current_stations")))
    frames.append(s.fact_observation.agg(F.count("*").alias("fact_observation"), F.count_if("is_simulated").alias("simulated_observations")))
    frames.append(daily(s).agg(F.count("*").alias("fact_daily"), F.max("date_key").alias("last_date_key")))
    return relational.one_row(*frames)


@query("qry_23_gate_evidence", """SELECT count(*) FILTER (WHERE NOT is_simulated) AS real_observations, count(DISTINCT station_key) FILTER (WHERE NOT is_simulated) AS stations, count(DISTINCT date_key) FILTER (WHERE NOT is_simulated) AS days, epoch_us(max(observed_at) FILTER (WHERE NOT is_simulated)) AS latest_us FROM fact_observation""")
def _(s: Star) -> DataFrame:
    real = s.fact_observation.where("NOT is_simulated")
    return real.agg(F.count("*").alias("real_observations"), F.count_distinct("station_key").alias("stations"), F.count_distinct("date_key").alias("days"), F.unix_micros(F.max("observed_at").cast("timestamp")).alias("latest_us"))


@query("agg_11_daily_evidence", "SELECT station_key, date_key, observation_count, report_count, review_count, available_count, busy_count, broken_count, round(availability_ratio, 8) AS availability_ratio, round(avg_queue_score, 8) AS avg_queue_score, peak_queue_score, round(avg_rating, 8) AS avg_rating, round(data_completeness_score, 8) AS data_completeness_score, source_count FROM fact_daily", **CTES)
def _(s: Star) -> DataFrame:
    rounded = [F.round(c, 8).alias(c) for c in ("availability_ratio", "avg_queue_score", "avg_rating", "data_completeness_score")]
    return daily(s).select("station_key", "date_key", "observation_count", "report_count", "review_count", "available_count", "busy_count", "broken_count", "peak_queue_score", "source_count", *rounded)


@query("src_09_calendar", "SELECT date_key, year, quarter, month, month_name, week, day, day_of_week, day_name, is_weekend FROM dim_date", **CTES)
def _(s: Star) -> DataFrame:
    return warehouse.calendar(s.spark).drop("full_date")


@query("src_09_time_slots", "SELECT * FROM dim_time", **CTES)
def _(s: Star) -> DataFrame:
    return warehouse.time_slots(s.spark)
