"""Projections of source payloads onto one station shape; defaults are flagged and missing stays missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltmill.functions import text
from voltmill.functions.vocab import POI_CONNECTOR_IDS, mapping

# Status ids of the open charge map and its public and private usage ids.
POI_STATUS = {50: "operational", 10: "operational", 20: "operational", 75: "operational", 30: "temporarily_unavailable", 100: "temporarily_unavailable", 150: "unknown", 200: "permanently_closed", 0: "unknown"}
POI_PUBLIC, POI_PRIVATE = (1, 4, 5, 7), (2, 3, 6)
# Socket tags of the street map.
SOCKETS = {
    "type2": "Type 2", "type2_combo": "CCS2", "ccs": "CCS2", "ccs2": "CCS2", "ccs_combo2": "CCS2", "combo2": "CCS2", "type1": "Type 1", "type1_combo": "CCS1", "ccs1": "CCS1", "combo1": "CCS1",
    "j1772": "Type 1", "chademo": "CHAdeMO", "gbt_ac": "GB/T", "gbt_dc": "GB/T", "gb_t": "GB/T", "gb/t": "GB/T", "bharat_ac001": "Bharat AC001", "bharat_dc001": "Bharat DC001", "bharat_ac": "Bharat AC001", "bharat_dc": "Bharat DC001",
}
# Connector standards and states of the two roaming protocols.
OCPI_STANDARDS = {"chademo": "CHAdeMO", "iec_62196_t1": "Type 1", "iec_62196_t1_combo": "CCS1", "iec_62196_t2": "Type 2", "iec_62196_t2_combo": "CCS2", "gbt": "GB/T"}
OCPI_STATES = {"AVAILABLE": "available", "CHARGING": "busy", "RESERVED": "busy", "BLOCKED": "broken", "INOPERATIVE": "broken", "OUTOFORDER": "broken"}
OICP_STATES = {"Available": "available", "Reserved": "busy", "Occupied": "busy", "OutOfService": "broken"}
# Texts that mean nothing in government records, and their words for a status.
JUNK = ("", "-", "NA", "N/A", "null", "None")

POI_SCHEMA = (
    "ID long, UUID string, OperatorInfo struct<Title: string, WebsiteURL: string>, UsageTypeID int, UsageCost string, StatusTypeID int, DateLastStatusUpdate string, DateCreated string, GeneralComments string, "
    "AddressInfo struct<Title: string, AddressLine1: string, AddressLine2: string, Town: string, StateOrProvince: string, Postcode: string, Latitude: double, Longitude: double, Country: struct<Title: string, ISOCode: string>>, "
    "Connections array<struct<ID: long, ConnectionTypeID: int, ConnectionType: struct<Title: string, FormalName: string>, PowerKW: double, Voltage: double, Amps: double, Quantity: int, StatusTypeID: int>>"
)
OCPI_SCHEMA = (
    "id string, country_code string, party_id string, publish boolean, last_updated string, name string, city string, coordinates struct<latitude: string, longitude: string>, "
    "evses array<struct<uid: string, status: string, last_updated: string, connectors: array<struct<id: string, standard: string, max_electric_power: double>>>>, "
    "tariff struct<currency: string, elements: array<struct<price_components: array<struct<type: string, price: double>>>>>"
)


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def connector_by_text(label: Column) -> Column:
    """Connector type by parts of a label, for ids that no table has."""
    x = F.lower(label)
    has = lambda *p: F.coalesce(x.rlike("|".join(p)), F.lit(False))
    return (
        F.when(has("ccs") & has("2"), "CCS2").when(has("ccs") & has("1"), "CCS1").when(has("type 2", "mennekes"), "Type 2").when(has("type 1", "j1772"), "Type 1").when(has("chademo"), "CHAdeMO")
        .when(has("gb/t", "gb-t", "gbt"), "GB/T").when(has("bharat") & has("dc"), "Bharat DC001").when(has("bharat") & has("ac"), "Bharat AC001").otherwise("Other")
    )


def parse_records(raw: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Payload texts as structs p, and the rows whose payload can't be read."""
    x = raw.withColumn("p", F.from_json("payload", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("p").isNull() | F.col("p._corrupt").isNotNull()
    return x.where(~bad), x.where(bad).drop("p")


def poi_stations(parsed: DataFrame) -> DataFrame:
    """Map open charge map records p to stations with connectors and an observation only where telemetry is real."""
    p, a = F.col("p"), F.col("p.AddressInfo")
    name = _filled(F.regexp_replace(F.coalesce(_filled(a["Title"]), p["GeneralComments"], F.lit("")), r"\s+", " "))
    sid = F.coalesce(F.nullif(p["ID"].cast("string"), F.lit("0")), _filled(p["UUID"]))
    usage, st = p["UsageTypeID"], p["StatusTypeID"]
    cost = F.lower(p["UsageCost"])
    pricing = F.when(cost.contains("free") | F.trim(cost).isin("0", "0.0", "0.00", "no charge"), "free").when(cost.rlike("pay|tariff|kwh|rs|₹|inr|fee"), "paid").otherwise("unknown")
    by_id = mapping(POI_CONNECTOR_IDS)

    def connector(c: Column) -> Column:
        label = F.coalesce(c["ConnectionType"]["Title"], c["ConnectionType"]["FormalName"], F.concat(F.lit("Type-"), c["ConnectionTypeID"].cast("string")), F.lit("Unknown"))
        known = F.when(c["ConnectionTypeID"].isin(0, 3, 10, 22), "Other").otherwise(by_id[c["ConnectionTypeID"]])
        q = F.when(c["Quantity"] > 0, c["Quantity"]).otherwise(1)
        state = F.when(c["StatusTypeID"] == 10, "available").when(c["StatusTypeID"] == 20, "busy").when(c["StatusTypeID"].isin(30, 100), "broken").otherwise("unknown")
        return F.struct(
            c["ID"].cast("string").alias("id"), F.coalesce(known, connector_by_text(label)).alias("connector_type"), label.alias("raw_type"), _positive(c["PowerKW"]).alias("power_kw"), _positive(c["Voltage"]).alias("voltage_v"),
            _positive(c["Amps"]).alias("amperage_a"), q.alias("quantity"), ((q > 1) & c["ID"].isNull()).alias("is_aggregated"), pricing.alias("pricing_type"), state.alias("status"),
        )

    connectors = F.coalesce(F.transform(p["Connections"], connector), F.array().cast("array<struct<id:string,connector_type:string,raw_type:string,power_kw:double,voltage_v:double,amperage_a:double,quantity:int,is_aggregated:boolean,pricing_type:string,status:string>>"))
    seen = F.coalesce(p["DateLastStatusUpdate"], p["DateCreated"]).try_cast("timestamp")
    live = st.isin(10, 20) & seen.isNotNull()
    country = F.coalesce(_filled(a["Country"]["Title"]), _filled(a["Country"]["ISOCode"]))
    return parsed.select(
        sid.alias("source_station_id"), F.coalesce(name, F.concat(F.lit("Charging Station "), sid)).alias("name"), name.isNull().alias("name_synthesized"), a["Latitude"].alias("latitude"), a["Longitude"].alias("longitude"),
        a["AddressLine1"].alias("address_line"), a["AddressLine2"].alias("locality"), F.coalesce(_filled(a["Town"]), F.lit("Mumbai")).alias("city"), _filled(a["Town"]).isNull().alias("city_inferred"),
        F.coalesce(_filled(a["StateOrProvince"]), F.lit("Maharashtra")).alias("state"), _filled(a["StateOrProvince"]).isNull().alias("state_inferred"), _filled(a["Postcode"]).alias("postal_code"), F.coalesce(country, F.lit("India")).alias("country"), country.isNull().alias("country_inferred"),
        _filled(p["OperatorInfo"]["Title"]).alias("operator_name"), text.slug(p["OperatorInfo"]["Title"]).alias("operator_slug"), F.coalesce(mapping(POI_STATUS)[st], F.lit("unknown")).alias("operational_status"),
        (~F.coalesce(usage.isin(*POI_PRIVATE), F.lit(False))).alias("is_public"), F.when(usage.isin(*POI_PRIVATE), "Private / Restricted").when(usage.isin(*POI_PUBLIC), "Public").alias("access_type"),
        (~F.coalesce(usage.isin(*POI_PRIVATE, *POI_PUBLIC), F.lit(False))).alias("access_inferred"), connectors.alias("connectors"),
        F.when(live, F.struct(seen.alias("observed_at"), F.when(st == 10, "available").otherwise("busy").alias("availability_status"), F.size(connectors).alias("total_connectors"), F.lit(0.90).alias("confidence"))).alias("observation"),
    ).where("latitude IS NOT NULL AND longitude IS NOT NULL")


def osm_power(raw: Column) -> Column:
    """kW of the first of several values, to three places; null for anything else."""
    x = F.trim(F.split(F.lower(F.trim(raw)), ";")[0])
    p = r"^([0-9.]+)\s*(kw|w|kwh)?$"
    v = F.regexp_extract(x, p, 1).try_cast("double") / F.when(F.regexp_extract(x, p, 2) == "w", 1000).otherwise(1)
    return F.when(x.rlike(p) & (v > 0), F.bround(v, 3))


def _count(raw: Column) -> Column:
    n = F.trim(F.split(raw, ";")[0]).try_cast("int")
    return F.when(n > 0, n)


def osm_connectors(stations: DataFrame, key: str = "id", tags: str = "tags") -> DataFrame:
    """One row per station and connector type of its socket tags (first tag by name), or one Other with the capacity."""
    sockets = F.filter(F.map_entries(tags), lambda e: e["key"].startswith("socket:") & ~e["key"].rlike(":(output|voltage|amperage|current)$"))
    x = stations.select(key, tags, F.posexplode_outer(sockets).alias("pos", "e"))
    name = F.lower(F.substring(F.col("e.key"), 8, 1000))
    kind = F.when(F.col("e").isNull(), "Other").otherwise(F.coalesce(mapping(SOCKETS)[name], F.lit("Other")))
    power = osm_power(F.col(tags)[F.concat(F.col("e.key"), F.lit(":output"))])
    n = F.coalesce(F.when(F.col("e").isNull(), _count(F.col(tags)["capacity"])).otherwise(_count(F.col("e.value"))), F.lit(1))
    rows = x.select(key, "pos", kind.alias("connector_type"), F.coalesce(F.col("e.key"), F.lit("unknown")).alias("raw_type"), power.alias("power_kw"), n.alias("quantity"))
    w = W.partitionBy(key, "connector_type").orderBy(F.col("pos").asc_nulls_first())
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "pos")


def osm_pricing(tags: Column) -> Column:
    fee, charge = (F.lower(F.trim(F.coalesce(tags[k], F.lit("")))) for k in ("fee", "charge"))
    return F.when(fee.isin("no", "0", "free"), "free").when(fee == "yes", "paid").when(charge.isin("no", "free", "0"), "free").when(charge != "", "paid").otherwise("unknown")


def osm_status(tags: Column) -> Column:
    gone = tags["disused:amenity"].isNotNull() | tags["abandoned:amenity"].isNotNull() | F.lower(F.trim(F.coalesce(tags["opening_hours"], F.lit("")))).isin("closed", "permanently closed")
    return F.when(gone, "permanently_closed").otherwise("operational")


def first_of(record: Column, *keys: str) -> Column:
    """First value of a loose record that means something."""
    return F.coalesce(*[F.when(~F.trim(record[k]).isin(*JUNK), F.trim(record[k])) for k in keys])


def government_stations(records: DataFrame, record: str = "r") -> DataFrame:
    """Loose government records by alias keys; a coordinate of exactly 0 is missing there."""
    r = F.col(record)
    number = lambda *k: F.nullif(F.regexp_replace(first_of(r, *k), ",", "").try_cast("double"), F.lit(0.0))
    lat, lon = number("latitude", "lat", "Latitude"), number("longitude", "lng", "lon", "Longitude")
    own = first_of(r, "id", "_id", "station_id", "charging_station_id", "sl_no", "serial_no", "sno", "sr_no")
    sid = F.coalesce(F.concat(F.lit("gov/"), own), F.concat(F.lit("gov/geo/"), first_of(r, "latitude", "lat"), F.lit("/"), first_of(r, "longitude", "lng", "lon")))
    power = F.trim(F.regexp_replace(F.lower(first_of(r, "power_kw", "power", "capacity_kw", "rated_power")), "kw", "")).try_cast("double")
    count = first_of(r, "number_of_connectors", "no_of_connectors", "connector_count", "charger_count", "quantity").try_cast("double").try_cast("int")
    state = F.lower(first_of(r, "status", "operational_status"))
    status = F.when(state.isin("operational", "active", "live", "open"), "operational").when(state.isin("closed", "decommissioned", "removed", "permanently closed"), "permanently_closed").when(state.isin("under maintenance", "temporarily closed"), "temporarily_unavailable").otherwise("unknown")
    label = first_of(r, "connector_type", "plug_type", "charger_type", "type")
    city = first_of(r, "city", "town", "district", "City")
    return records.select(
        sid.alias("source_station_id"), first_of(r, "station_name", "charging_station_name", "name", "location", "place", "site_name").alias("name"), lat.alias("latitude"), lon.alias("longitude"),
        F.coalesce(city, F.lit("Mumbai")).alias("city"), city.isNull().alias("city_inferred"), F.when(label.isNotNull(), connector_by_text(label)).otherwise("Other").alias("connector_type"),
        _positive(power).alias("power_kw"), F.when(count > 0, count).otherwise(1).alias("quantity"), status.alias("operational_status"),
    ).where("latitude IS NOT NULL AND longitude IS NOT NULL")


def tariff(t: Column) -> Column:
    """Struct of type and price: only a single element with a single ENERGY component is a price per kWh."""
    parts = t["elements"]
    comp = F.get(F.get(parts, F.lit(0))["price_components"], F.lit(0))
    single = (F.size(parts) == 1) & (F.size(F.get(parts, F.lit(0))["price_components"]) == 1) & (F.upper(comp["type"]) == "ENERGY") & (comp["price"] >= 0)
    ok = F.coalesce(single, F.lit(False))
    return F.struct(F.when(ok & (comp["price"] == 0), "free").when(ok, "paid").otherwise("unknown").alias("type"), F.when(ok, comp["price"]).alias("price"))


def ocpi_stations(parsed: DataFrame) -> DataFrame:
    """Map roaming locations p that are published and placed; the state of a place comes from its points."""
    p = F.col("p")
    evses = F.coalesce(p["evses"], F.array().cast(parsed.schema["p"].dataType["evses"].dataType))
    states = F.transform(evses, lambda e: F.coalesce(mapping(OCPI_STATES)[F.upper(F.trim(e["status"]))], F.lit("unknown")))
    has = lambda v: F.array_contains(states, v)
    roll = F.when(has("busy"), "busy").when(has("available"), "available").when(F.forall(states, lambda s: s == "broken"), "broken").otherwise("unknown")
    newest = F.array_max(F.transform(evses, lambda e: e["last_updated"].try_cast("timestamp")))
    seen = F.coalesce(newest, p["last_updated"].try_cast("timestamp"))
    plain = F.array_distinct(F.transform(evses, lambda e: F.upper(e["status"])))
    down = F.size(F.array_except(plain, F.array(*[F.lit(x) for x in ("INOPERATIVE", "OUTOFORDER", "BLOCKED")]))) == 0
    status = F.when((F.size(evses) > 0) & down, "temporarily_unavailable").when((F.size(evses) > 0) & (F.size(F.array_except(plain, F.array(F.lit("REMOVED")))) == 0), "permanently_closed").otherwise("operational")
    each = F.flatten(F.transform(evses, lambda e: F.when(F.size(F.coalesce(e["connectors"], F.array())) > 0, F.transform(e["connectors"], lambda c: F.struct(F.coalesce(mapping(OCPI_STANDARDS)[F.lower(F.trim(c["standard"]))], F.lit("Other")).alias("connector_type"), _positive(c["max_electric_power"]).alias("power_kw")))).otherwise(F.array(F.struct(F.lit("Other").alias("connector_type"), F.lit(None).cast("double").alias("power_kw"))))))
    lat, lon = p["coordinates"]["latitude"].try_cast("double"), p["coordinates"]["longitude"].try_cast("double")
    out = parsed.where(F.coalesce(p["publish"], F.lit(True)) & lat.isNotNull() & lon.isNotNull() & p["country_code"].isNotNull() & p["party_id"].isNotNull() & p["id"].isNotNull())
    t = tariff(p["tariff"])
    return out.select(
        F.concat_ws("/", p["country_code"], p["party_id"], p["id"]).alias("source_station_id"), lat.alias("latitude"), lon.alias("longitude"), status.alias("operational_status"), each.alias("connectors"), t["type"].alias("pricing_type"), t["price"].alias("price_per_kwh"),
        F.when((F.size(evses) > 0) & seen.isNotNull(), F.struct(seen.alias("observed_at"), roll.alias("availability_status"), F.size(F.filter(states, lambda s: s == "available")).alias("available_connectors"), F.size(evses).alias("total_connectors"), F.lit(0.8).alias("confidence"))).alias("observation"),
    )


def oicp_stations(raw: DataFrame, corrected: bool = False) -> DataFrame:
    """Map XML records: one Other connector, an observation only with a time; available is 1 or 0 (corrected: null where unknown)."""
    schema = "EvseID string, OperatorID string, OperatorName string, Status string, LastUpdate string, Latitude double, Longitude double, Power array<double>"
    x = raw.withColumn("e", F.from_xml("payload", schema))
    s = F.coalesce(mapping(OICP_STATES)[F.trim(F.col("e.Status"))], F.lit("unknown"))
    available = F.when(s == "available", 1).otherwise(0)
    if corrected:
        available = F.when(s == "unknown", F.lit(None).cast("int")).otherwise(available)
    seen = F.col("e.LastUpdate").try_cast("timestamp")
    return x.where("e.EvseID IS NOT NULL").select(
        F.col("e.EvseID").alias("source_station_id"), F.lit("Other").alias("connector_type"), _positive(F.array_max("e.Power")).alias("power_kw"), F.when(s == "broken", "temporarily_unavailable").otherwise("operational").alias("operational_status"),
        F.when(seen.isNotNull(), s).alias("availability_status"), F.when(seen.isNotNull(), available).alias("available_connectors"), F.when(seen.isNotNull(), F.lit(1)).alias("total_connectors"),
    )


def after_cursor(records: DataFrame, cursors: DataFrame, key: str, at: str) -> DataFrame:
    """Records newer than their key's cursor; those without a time always pass."""
    j = records.join(cursors.select(key, F.col("cursor").alias("__c")), key, "left")
    return j.where(F.col(at).isNull() | F.col("__c").isNull() | (F.col(at) > F.col("__c"))).drop("__c")


def advance_cursors(records: DataFrame, cursors: DataFrame, key: str, at: str) -> DataFrame:
    """Cursors after a run that succeeded: the newest time of each key, never an older one."""
    new = records.groupBy(key).agg(F.max(at).alias("cursor"))
    return cursors.select(key, "cursor").unionByName(new).groupBy(key).agg(F.max("cursor").alias("cursor"))


def persist_actions(incoming: DataFrame, links: DataFrame) -> DataFrame:
    """What writing would do with each record: INSERT, UNCHANGED (equal hash and connectors exist), UPDATE or CONFLICT (another station's link)."""
    j = incoming.join(links.select("source_id", "source_station_id", F.col("payload_hash").alias("__h"), F.col("station_id").alias("__s"), F.col("connectors").alias("__n")), ["source_id", "source_station_id"], "left")
    action = F.when(F.col("__s").isNull(), "INSERT").when(F.col("station_id").isNotNull() & (F.col("station_id") != F.col("__s")), "CONFLICT").when((F.col("__h") == F.col("payload_hash")) & (F.col("__n") > 0), "UNCHANGED").otherwise("UPDATE")
    return j.withColumn("action", action).drop("__h", "__s", "__n")


def canonical_attributes(members: DataFrame) -> DataFrame:
    """Per station the first known value of each field by source, any day-long hours, and the most optimistic status."""
    rank = mapping({"operational": 3, "temporarily_unavailable": 2, "unknown": 1, "permanently_closed": 0})
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("source_id"))).alias(c)
    day = F.bool_or(F.coalesce("is_24_hours", F.lit(False)))
    g = members.groupBy("cluster").agg(first("locality"), first("phone"), first("opening_time"), first("closing_time"), day.alias("is_24_hours"), F.max_by("operational_status", rank[F.col("operational_status")]).alias("operational_status"), F.min_by("postal_code", F.when(F.trim("postal_code").rlike("^[1-9][0-9]{5}$"), F.col("source_id"))).alias("postal_code"), F.max("verified_at").alias("last_verified"))
    none = F.lit(None).cast("string")
    return g.withColumn("opening_time", F.when(F.col("is_24_hours"), none).otherwise(F.col("opening_time"))).withColumn("closing_time", F.when(F.col("is_24_hours"), none).otherwise(F.col("closing_time")))


def missing_operators(stations: DataFrame, operators: DataFrame) -> DataFrame:
    """Operators to insert: distinct new names, "Unknown Operator" for none."""
    names = stations.select(F.coalesce(_filled(F.col("operator_name")), F.lit("Unknown Operator")).alias("operator_name")).distinct()
    return names.join(operators.select("operator_name"), "operator_name", "left_anti").withColumn("slug", text.slug(F.col("operator_name")))


def greedy_capped(scored: DataFrame, per_state: int, per_city: int, total: int) -> DataFrame:
    """Accept rows by score while the caps of their state, city and the whole hold.

    A row beyond its city's cap in the order is never accepted: either those before it fill the city, or one of
    them was refused because the state or the whole is full, and it is full for this row too.  The same holds for
    the state among the rows that are left, and then for the whole, so three top-k steps equal the scan.
    """
    by = [F.col("score").desc(), F.col("id")]
    out = scored
    for keys, most in ((("state", "city"), per_city), (("state",), per_state)):
        out = out.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where(F.col("__k") <= most).drop("__k")
    return out.orderBy(*by).limit(total)


def snapshot_status(status_id: Column, title: Column, is_operational: Column) -> Column:
    """Operational state of the offline snapshot: a flag and a text that contradict each other say unknown."""
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    no = F.coalesce(~is_operational, F.lit(False))
    yes = F.coalesce(is_operational, F.lit(False))
    down = F.coalesce(status_id == 100, F.lit(False)) | no | t.contains("not operational")
    return (
        F.when(status_id.isin(50, 75) & yes, "operational").when(down, F.when(t.rlike("closed|permanently"), "permanently_closed").otherwise("temporarily_unavailable")).otherwise("unknown")
    )


def snapshot_connector(type_id: Column, label: Column) -> Column:
    """Connector type of the offline snapshot, which takes Type 2 for what it doesn't know."""
    x = connector_by_text(label)
    ccs = F.coalesce(F.lower(label).rlike("ccs.*combo|combo.*ccs"), F.lit(False))
    return F.coalesce(mapping(POI_CONNECTOR_IDS)[type_id], F.when(ccs, "CCS2").when(x == "Other", "Type 2").otherwise(x))


def snapshot_pricing(raw: Column) -> Column:
    """Struct of type, per_kwh, per_session and estimate: one of free, per kWh, per session, or an unverified number."""
    x = F.lower(F.trim(raw))
    number = r"([0-9]+(?:\.[0-9]+)?)"
    get = lambda tail: F.regexp_extract(x, number + tail, 1).try_cast("double")
    kwh, session, any_ = get(r"\s*(?:/|-|\s+per\s+)?\s*(?:kwh|unit)"), get(r"\s*(?:/|-|\s+per\s+)?\s*session"), get("")
    free = x.contains("free") | x.isin("0", "0.0", "0.00", "no charge")
    none = F.lit(None).cast("double")
    out = lambda kind, k, s, e: F.struct(F.lit(kind).alias("type"), k.alias("per_kwh"), s.alias("per_session"), e.alias("estimate"))
    return (
        F.when(free, out("free", F.lit(0.0), none, none)).when(kwh.between(1, 100), out("per_kwh", kwh, none, none)).when(session > 0, out("per_session", none, session, none))
        .when(any_.between(1, 100), out("unknown", none, none, any_)).otherwise(out("unknown", none, none, none))
    )
