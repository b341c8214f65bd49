"""Source mappings over payloads built from the test tables, and persistence decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltmill.functions import station
from voltmill.operators import geo, relational
from voltmill.sources import mappings as M
from voltmill.sources.driver_tables import Star

from .core import query

RAW = """SELECT o_orderkey AS id, r, o_custkey, CASE r % 6 WHEN 0 THEN 33 WHEN 1 THEN 25 WHEN 2 THEN 2 WHEN 3 THEN 1038 WHEN 4 THEN 999 ELSE 0 END AS ctype, CASE r % 5 WHEN 0 THEN 'Mennekes plug' WHEN 1 THEN 'CCS Combo 2' WHEN 2 THEN 'Bharat DC' WHEN 3 THEN 'strange' ELSE 'CHAdeMO' END AS label,
CASE r % 7 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 WHEN 3 THEN 50 WHEN 4 THEN 200 WHEN 5 THEN 150 ELSE 77 END AS st, CASE r % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 99 ELSE 7 END AS usage_id, CASE r % 3 WHEN 0 THEN -5 WHEN 1 THEN 0 ELSE 22.5 END AS kw, CASE r % 8 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 1 END AS qty,
CASE WHEN r % 9 = 0 THEN '' ELSE 'Pune' END AS town, CASE r % 10 WHEN 0 THEN 'Free' WHEN 1 THEN 'Pay at location' ELSE 'n/a' END AS cost, CASE WHEN r % 11 = 0 THEN NULL ELSE '2024-01-05T10:00:00Z' END AS seen, CASE WHEN r % 13 = 0 THEN NULL ELSE 19.1 END AS lat FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS r FROM {orders}) x"""
C = {"raw": RAW}


def raw(s: Star) -> DataFrame:
    return s.spark.sql(RAW, orders=s.orders).withColumn("kw", F.col("kw").cast("double")).withColumn("lat", F.col("lat").cast("double"))


def poi_payloads(s: Star) -> DataFrame:
    c = F.col
    address = F.struct(F.concat(F.lit(" Site  "), c("id").cast("string")).alias("Title"), c("town").alias("Town"), c("lat").alias("Latitude"), F.lit(72.9).alias("Longitude"))
    plug = F.struct(c("ctype").alias("ConnectionTypeID"), F.struct(c("label").alias("Title")).alias("ConnectionType"), c("kw").alias("PowerKW"), c("qty").alias("Quantity"), c("st").alias("StatusTypeID"))
    p = F.struct(c("id").alias("ID"), F.struct(F.lit("Acme Power").alias("Title")).alias("OperatorInfo"), c("usage_id").alias("UsageTypeID"), c("cost").alias("UsageCost"), c("st").alias("StatusTypeID"), c("seen").alias("DateLastStatusUpdate"), address.alias("AddressInfo"), F.array(plug).alias("Connections"))
    good = raw(s).select("id", F.when(c("r") % 17 == 0, "{broken").otherwise(F.to_json(p)).alias("payload"))
    return good


_TYPE = "CASE ctype WHEN 33 THEN 'CCS2' WHEN 25 THEN 'Type 2' WHEN 2 THEN 'CHAdeMO' WHEN 1038 THEN 'GB/T' WHEN 0 THEN 'Other' ELSE CASE label WHEN 'Mennekes plug' THEN 'Type 2' WHEN 'CCS Combo 2' THEN 'CCS2' WHEN 'Bharat DC' THEN 'Bharat DC001' WHEN 'CHAdeMO' THEN 'CHAdeMO' ELSE 'Other' END END"


@query("map_01_poi_stations", f"""SELECT CAST(nullif(id, 0) AS VARCHAR) AS source_station_id, concat('Site ', CAST(id AS VARCHAR)) AS name, CASE WHEN town = '' THEN 'Mumbai' ELSE town END AS city, town = '' AS city_inferred, CASE st WHEN 10 THEN 'operational' WHEN 20 THEN 'operational' WHEN 50 THEN 'operational' WHEN 30 THEN 'temporarily_unavailable' WHEN 200 THEN 'permanently_closed' ELSE 'unknown' END AS operational_status,
usage_id <> 2 AS is_public, usage_id = 99 AS access_inferred, {_TYPE} AS connector_type, CASE WHEN kw > 0 THEN CAST(kw AS DOUBLE) END AS power_kw, CASE WHEN qty > 0 THEN qty ELSE 1 END AS quantity, CASE cost WHEN 'Free' THEN 'free' WHEN 'Pay at location' THEN 'paid' ELSE 'unknown' END AS pricing_type,
CASE WHEN seen IS NOT NULL THEN CASE st WHEN 10 THEN 'available' WHEN 20 THEN 'busy' END END AS observed FROM raw WHERE lat IS NOT NULL AND r % 17 <> 0""", **C)
def _(s: Star) -> DataFrame:
    good, _ = M.parse_records(poi_payloads(s), M.POI_SCHEMA)
    x = M.poi_stations(good)
    c = F.col("connectors")[0]
    return x.select("source_station_id", "name", "city", "city_inferred", "operational_status", "is_public", "access_inferred", c["connector_type"].alias("connector_type"), c["power_kw"].alias("power_kw"), c["quantity"].alias("quantity"), c["pricing_type"].alias("pricing_type"), F.col("observation.availability_status").alias("observed"))


@query("ext_01_unreadable_records", "SELECT id FROM raw WHERE r % 17 = 0", **C)
def _(s: Star) -> DataFrame:
    return M.parse_records(poi_payloads(s), M.POI_SCHEMA)[1].select("id")


@query("map_02_osm_connectors", """SELECT id, connector_type, power_kw, quantity FROM (SELECT id, 'Type 2' AS connector_type, CASE r % 4 WHEN 0 THEN 22.0 WHEN 1 THEN 0.05 WHEN 2 THEN NULL ELSE 7.4 END::DOUBLE AS power_kw, CASE WHEN r % 3 = 0 THEN 2 ELSE 1 END AS quantity FROM raw WHERE r % 5 <> 0
UNION ALL SELECT id, 'CCS2', 50.0::DOUBLE, 1 FROM raw WHERE r % 5 <> 0 AND r % 2 = 0 UNION ALL SELECT id, 'Other', NULL, 4 FROM raw WHERE r % 5 = 0)""", **C)
def _(s: Star) -> DataFrame:
    r = F.col("r")
    e = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    out = F.when(r % 4 == 0, "22 kW").when(r % 4 == 1, "50 W;9 kW").when(r % 4 == 2, "fast").otherwise("7.4")
    tags = F.when(r % 5 != 0, F.concat(F.array(e("socket:type2", F.when(r % 3 == 0, "2;3").otherwise("x")), e("socket:type2:output", out)), F.when(r % 2 == 0, F.array(e("socket:ccs", F.lit("1")), e("socket:ccs:output", F.lit("50 kW")), e("socket:type2_combo", F.lit("9")))).otherwise(F.array().cast("array<struct<key:string,value:string>>")))).otherwise(F.array(e("capacity", F.lit("4")), e("amenity", F.lit("charging_station"))))
    return M.osm_connectors(raw(s).select("id", F.map_from_entries(tags).alias("tags"))).select("id", "connector_type", "power_kw", "quantity")


@query("map_02_osm_pricing_and_status", "SELECT * FROM (VALUES (1, 'free', 'operational'), (2, 'paid', 'operational'), (3, 'free', 'permanently_closed'), (4, 'paid', 'permanently_closed'), (5, 'unknown', 'operational')) t(i, pricing, status)")
def _(s: Star) -> DataFrame:
    rows = [(1, {"fee": "No"}), (2, {"fee": "yes"}), (3, {"charge": "free", "disused:amenity": "x"}), (4, {"charge": "5 INR", "opening_hours": "Closed"}), (5, {"name": "a"})]
    df = s.spark.createDataFrame(rows, "i int, tags map<string, string>")
    return df.select("i", M.osm_pricing(F.col("tags")).alias("pricing"), M.osm_status(F.col("tags")).alias("status"))


@query("map_03_government_records", f"""SELECT CASE WHEN r % 6 = 0 THEN 'gov/geo/19.1/72.5' ELSE concat('gov/', CAST(id AS VARCHAR)) END AS source_station_id, 19.1::DOUBLE AS latitude, CASE WHEN town = '' THEN 'Mumbai' ELSE town END AS city, town = '' AS city_inferred,
CASE label WHEN 'Mennekes plug' THEN 'Type 2' WHEN 'CCS Combo 2' THEN 'CCS2' WHEN 'Bharat DC' THEN 'Bharat DC001' WHEN 'CHAdeMO' THEN 'CHAdeMO' ELSE 'Other' END AS connector_type, CASE WHEN kw > 0 THEN CAST(kw AS DOUBLE) END AS power_kw, CASE WHEN qty > 0 THEN qty ELSE 1 END AS quantity, CASE r % 4 WHEN 0 THEN 'operational' WHEN 1 THEN 'permanently_closed' WHEN 2 THEN 'temporarily_unavailable' ELSE 'unknown' END AS operational_status FROM raw WHERE lat IS NOT NULL""", **C)
def _(s: Star) -> DataFrame:
    c, r = F.col, F.col("r")
    t = lambda x: c(x).cast("string")
    rec = F.create_map(
        F.lit("sl_no"), F.when(r % 6 == 0, "NA").otherwise(t("id")), F.lit("lat"), F.when(c("lat").isNull(), "0.0").otherwise("19.1"), F.lit("longitude"), F.lit("72.5"), F.lit("town"), c("town"), F.lit("plug_type"), c("label"),
        F.lit("rated_power"), F.concat(t("kw"), F.lit(" kW")), F.lit("no_of_connectors"), F.concat(t("qty"), F.lit(".0")), F.lit("status"), F.when(r % 4 == 0, "Active").when(r % 4 == 1, "decommissioned").when(r % 4 == 2, "Under Maintenance").otherwise("-"),
    )
    return M.government_stations(raw(s).select(rec.alias("r"))).drop("name", "longitude")


@query("map_04_05_roaming_locations", """SELECT concat('IN/ACM/', CAST(id AS VARCHAR)) AS source_station_id, CASE r % 4 WHEN 0 THEN 'busy' WHEN 1 THEN 'available' WHEN 2 THEN 'broken' ELSE 'unknown' END AS availability, CASE WHEN r % 4 = 1 THEN 1 ELSE CASE WHEN r % 4 = 0 THEN 1 ELSE 0 END END AS available_connectors, CASE r % 4 WHEN 2 THEN 'temporarily_unavailable' ELSE 'operational' END AS operational_status,
CASE r % 5 WHEN 0 THEN 'free' WHEN 1 THEN 'paid' ELSE 'unknown' END AS pricing_type, CASE r % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 12.5 END::DOUBLE AS price_per_kwh, 2 AS connectors FROM raw WHERE lat IS NOT NULL AND r % 7 <> 0""", **C)
def _(s: Star) -> DataFrame:
    r = F.col("r")
    states = F.when(r % 4 == 0, F.array(F.lit("CHARGING"), F.lit("AVAILABLE"))).when(r % 4 == 1, F.array(F.lit("AVAILABLE"), F.lit("OUTOFORDER"))).when(r % 4 == 2, F.array(F.lit("INOPERATIVE"), F.lit("BLOCKED"))).otherwise(F.array(F.lit("PLANNED"), F.lit("OUTOFORDER")))
    evses = F.transform(states, lambda x: F.struct(x.alias("status"), F.lit("2024-01-05T10:00:00Z").alias("last_updated")))
    comp = lambda kind, v: F.struct(F.lit(kind).alias("type"), F.lit(v).alias("price"))
    parts = F.when(r % 5 == 0, F.array(comp("ENERGY", 0.0))).when(r % 5 == 1, F.array(comp("energy", 12.5))).when(r % 5 == 2, F.array(comp("TIME", 3.0))).when(r % 5 == 3, F.array(comp("ENERGY", -1.0))).otherwise(F.array(comp("ENERGY", 1.0), comp("TIME", 1.0)))
    p = F.struct(F.col("id").cast("string").alias("id"), F.lit("IN").alias("country_code"), F.lit("ACM").alias("party_id"), (r % 7 != 0).alias("publish"), F.struct(F.col("lat").cast("string").alias("latitude"), F.lit("72.9").alias("longitude")).alias("coordinates"), evses.alias("evses"), F.struct(F.lit("INR").alias("currency"), F.array(F.struct(parts.alias("price_components"))).alias("elements")).alias("tariff"))
    good, _ = M.parse_records(raw(s).select("id", F.to_json(p).alias("payload")), M.OCPI_SCHEMA)
    x = M.ocpi_stations(good)
    return x.select("source_station_id", F.col("observation.availability_status").alias("availability"), F.col("observation.available_connectors").alias("available_connectors"), "operational_status", "pricing_type", "price_per_kwh", F.size("connectors").alias("connectors"))


@query("map_06_src_08_xml_records", """SELECT concat('IN*', CAST(id AS VARCHAR)) AS source_station_id, 50.0::DOUBLE AS power_kw, CASE r % 4 WHEN 2 THEN 'temporarily_unavailable' ELSE 'operational' END AS operational_status, CASE WHEN r % 3 <> 0 THEN CASE r % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'busy' WHEN 2 THEN 'broken' ELSE 'unknown' END END AS availability_status,
CASE WHEN r % 3 <> 0 THEN CASE r % 4 WHEN 0 THEN 1 ELSE 0 END END AS available_connectors FROM raw""", **C)
def _(s: Star) -> DataFrame:
    r = F.col("r")
    state = F.when(r % 4 == 0, "Available").when(r % 4 == 1, "Occupied").when(r % 4 == 2, "OutOfService").otherwise("Unknown")
    seen = F.when(r % 3 == 0, "").otherwise("<LastUpdate>2024-01-05T10:00:00Z</LastUpdate>")
    xml = F.concat(F.lit("<Evse><EvseID>IN*"), F.col("id").cast("string"), F.lit("</EvseID><Status>"), state, F.lit("</Status>"), seen, F.lit("<Power>22</Power><Power>50</Power></Evse>"))
    return M.oicp_stations(raw(s).select(xml.alias("payload"))).drop("connector_type", "total_connectors")


CUR = "SELECT o_custkey AS k, max(o_orderdate) AS cursor FROM orders WHERE o_orderstatus = 'F' GROUP BY 1"


@query("map_08_cursor_filter", "SELECT o_orderkey FROM orders LEFT JOIN cur ON k = o_custkey WHERE cursor IS NULL OR o_orderdate > cursor", cur=CUR)
def _(s: Star) -> DataFrame:
    o = s.orders.select("o_orderkey", F.col("o_custkey").alias("k"), "o_orderdate")
    cursors = s.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("cursor"))
    return M.after_cursor(o, cursors, "k", "o_orderdate").select("o_orderkey")


@query("map_08_cursor_advance", "SELECT o_custkey AS k, epoch_us(max(o_orderdate)) AS cursor_us FROM orders GROUP BY 1", cur=CUR)
def _(s: Star) -> DataFrame:
    o = s.orders.select(F.col("o_custkey").alias("k"), "o_orderdate")
    cursors = s.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("cursor"))
    return M.advance_cursors(o, cursors, "k", "o_orderdate").select("k", F.unix_micros(F.col("cursor").cast("timestamp")).alias("cursor_us"))


@query("ext_04_08_persist_actions", "SELECT id, CASE WHEN id % 4 = 0 THEN 'INSERT' WHEN id % 4 = 1 AND id % 3 = 0 THEN 'CONFLICT' WHEN id % 5 <> 0 AND id % 6 <> 0 THEN 'UNCHANGED' ELSE 'UPDATE' END AS action FROM site")
def _(s: Star) -> DataFrame:
    key = F.md5("name")
    inc = s.site.select("id", "source_id", "source_station_id", key.alias("payload_hash"), F.when((F.col("id") % 4 == 1) & (F.col("id") % 3 == 0), F.lit("other")).otherwise(F.lit(None).cast("string")).alias("station_id"))
    links = s.site.where("id % 4 <> 0").select("source_id", "source_station_id", F.when(F.col("id") % 5 == 0, "old").otherwise(key).alias("payload_hash"), F.concat(F.lit("st"), F.col("b").cast("string")).alias("station_id"), F.when(F.col("id") % 6 == 0, 0).otherwise(2).alias("connectors"))
    return M.persist_actions(inc, links).select("id", "action")


@query("ext_06_canonical_attributes", """SELECT b AS cluster, arg_min(locality, source_id) FILTER (WHERE locality IS NOT NULL) AS locality, bool_or(id % 5 = 0) AS is_24_hours, CASE WHEN bool_or(id % 5 = 0) THEN NULL ELSE arg_min(CASE WHEN id % 2 = 0 THEN '09:00' END, source_id) FILTER (WHERE id % 2 = 0) END AS opening_time,
CASE WHEN bool_or(id % 4 <> 0) THEN 'operational' ELSE 'temporarily_unavailable' END AS operational_status, arg_min(postal_code, source_id) FILTER (WHERE postal_code IS NOT NULL) AS postal_code FROM site GROUP BY 1""")
def _(s: Star) -> DataFrame:
    none = F.lit(None).cast("string")
    m = s.site.select(F.col("b").alias("cluster"), "source_id", "locality", "postal_code", none.alias("phone"), F.when(F.col("id") % 5 == 0, True).alias("is_24_hours"), F.when(F.col("id") % 2 == 0, "09:00").alias("opening_time"), F.when(F.col("id") % 2 == 0, "21:00").alias("closing_time"), F.when(F.col("id") % 4 == 0, "temporarily_unavailable").otherwise("operational").alias("operational_status"), none.alias("verified_at"))
    return M.canonical_attributes(m).select("cluster", "locality", "is_24_hours", "opening_time", "operational_status", "postal_code")


@query("ext_10_missing_operators", "SELECT DISTINCT coalesce(operator_name, 'Unknown Operator') AS operator_name FROM site WHERE coalesce(operator_name, '') <> 'Tata 3'")
def _(s: Star) -> DataFrame:
    known = s.spark.createDataFrame([("Tata 3",)], "operator_name string")
    return M.missing_operators(s.site, known).select("operator_name")


@query("ext_20_dates_in_calendar", "SELECT count(*) AS inside FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1996")
def _(s: Star) -> DataFrame:
    from voltmill.operators import warehouse

    d = warehouse.calendar(s.spark, "1995-01-01", "1996-12-31").select("date_key")
    key, _ = warehouse.utc_keys(F.col("o_orderdate"))
    return s.orders.withColumn("date_key", key).join(F.broadcast(d), "date_key", "left_semi").agg(F.count("*").alias("inside"))


_KM = "2 * 6371 * asin(sqrt(least(1, pow(sin(radians(latitude - 19.0) / 2), 2) + cos(radians(19.0)) * cos(radians(latitude)) * pow(sin(radians(longitude - 72.9) / 2), 2))))"
_LABEL = f"CASE WHEN {_KM} < 1 THEN concat(CAST(floor({_KM} * 1000 + 0.5) AS BIGINT), ' m') WHEN {_KM} < 10 THEN concat(regexp_replace(printf('%.1f', {_KM}), '\\.0$', ''), ' km') ELSE concat(CAST(floor({_KM} + 0.5) AS BIGINT), ' km') END"


def _away(s: Star):
    return geo.haversine(19.0, 72.9, "latitude", "longitude", geo.RADIUS_KM)


@query("ext_27_distance_labels", f"SELECT station_id, {_LABEL} AS label FROM dim_station")
def _(s: Star) -> DataFrame:
    return s.dim_station.select("station_id", station.distance_label(_away(s)).alias("label"))


@query("ext_27_station_by_id", f"SELECT station_id, {_LABEL} AS label FROM dim_station WHERE station_id = 'ST-7'")
def _(s: Star) -> DataFrame:
    one = station.by_id(s.dim_station, "station_id", "ST-7", "ST-[0-9]+")
    refused = station.by_id(s.dim_station, "station_id", "ST-7' OR 1=1", "ST-[0-9]+")
    return one.union(refused).select("station_id", station.distance_label(_away(s)).alias("label"))


@query("ext_29_newest_reviews", "SELECT review_id, station_key FROM (SELECT *, row_number() OVER (PARTITION BY station_key ORDER BY created_at DESC, review_id DESC) AS rn FROM review WHERE moderation_status = 'approved') WHERE rn <= 50")
def _(s: Star) -> DataFrame:
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.partitionBy("station_key").orderBy(F.desc("created_at"), F.desc("review_id")))
    return s.review.where("moderation_status = 'approved'").withColumn("rn", rn).where("rn <= 50").select("review_id", "station_key")


@query("ext_32_input_ranges", """SELECT observation_id, CASE WHEN NOT (available_connectors * 8 <= 23 AND total_connectors BETWEEN 0 AND 6 AND coalesce(source_key, 9) IN (0, 1) AND connector_key BETWEEN 1 AND 12) OR connector_key IS NULL OR value < 10 THEN 'FEATURE_SCHEMA_MISMATCH'
WHEN queue_level = 'unknown' THEN 'STALE_FEATURES' END AS refused FROM fact_observation""")
def _(s: Star) -> DataFrame:
    c = F.col
    cutoff = F.when(c("queue_level") == "unknown", "not a time").when(c("queue_level") == "none", "").when(c("queue_level") == "short", "2024-01-05T10:00:00Z")
    refused = station.predict_input_error(c("available_connectors") * 8, c("total_connectors"), c("source_key"), c("connector_key"), c("value") - 10, cutoff)
    return s.fact_observation.select("observation_id", refused.alias("refused"))


@query("ext_32_output_ranges", "SELECT observation_id, CASE WHEN availability_status = 'unknown' OR value / 400 > 1 OR source_payload_hash IS NULL THEN 'MODEL_ARTIFACT_INVALID' END AS refused FROM fact_observation")
def _(s: Star) -> DataFrame:
    refused = station.predict_result_error(F.col("availability_status") != "unknown", F.col("value") / 400, F.col("source_payload_hash"))
    return s.fact_observation.select("observation_id", refused.alias("refused"))


@query("ext_35_greedy_capped_selection", """WITH RECURSIVE x AS (SELECT c_custkey AS id, CAST(c_nationkey % 5 AS VARCHAR) AS state, CAST(c_nationkey AS VARCHAR) AS city, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer),
scan(i, id, state, city, ok, states, cities, n) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', '', false, MAP {'': 0}, MAP {'': 0}, 0
  UNION ALL SELECT i, id, state, city, take, CASE WHEN take THEN map_from_entries(list_append(list_filter(map_entries(states), lambda e: e.key <> state), {'key': state, 'value': in_state + 1})) ELSE states END,
    CASE WHEN take THEN map_from_entries(list_append(list_filter(map_entries(cities), lambda e: e.key <> city), {'key': city, 'value': in_city + 1})) ELSE cities END, n + CAST(take AS INT)
  FROM (SELECT *, n < 550 AND in_state < 120 AND in_city < 40 AS take FROM (SELECT x.*, states, cities, n, coalesce(states[x.state], 0) AS in_state, coalesce(cities[x.city], 0) AS in_city FROM scan JOIN x ON x.i = scan.i + 1)))
SELECT id, state, city FROM scan WHERE ok""")
def _(s: Star) -> DataFrame:
    x = s.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"), (F.col("c_nationkey") % 5).cast("string").alias("state"), F.col("c_nationkey").cast("string").alias("city"))
    return M.greedy_capped(x, 120, 40, 550).select("id", "state", "city")


@query("agg_16_latest_values_map_side", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_event FROM events GROUP BY 1")
def _(s: Star) -> DataFrame:
    return relational.latest_values(s.events, ["user_id"], ["ts", "event_id"], ["event_type"]).withColumnRenamed("event_type", "last_event")
