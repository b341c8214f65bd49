"""Scalar functions over literal inputs and over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltmill.functions import freshness, measures, station, text, vocab
from voltmill.operators import geo
from voltmill.sources.driver_tables import Star

from .core import query


def literal(rows: list[tuple], names: str) -> str:
    """A VALUES relation in the SQL that both engines share."""

    def one(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names}))"


def frame(s: Star, rows: list[tuple], schema: str) -> DataFrame:
    return s.spark.createDataFrame(rows, schema)


def _map_sql(pairs: dict[str, str], key: str) -> str:
    q = lambda v: "'" + v.replace("'", "''") + "'"
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs.items()) + " END"


def slug_sql(x: str) -> str:
    return f"nullif(regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), '')"


OPERATOR_NAMES = [(i, v) for i, v in enumerate(["Tata Power", "tata power", "TATA POWER EZ Charge", " Jio bp ", "Ather Grid", "bolt", "Some Other Co.", "", None, "Charge Zone", "FORTUM", "A & B -- Energy"])]


@query("fn_09_operator_alias", f"""SELECT i, n AS name, CASE WHEN r IS NULL OR trim(r) = '' THEN NULL WHEN n IS NULL THEN {slug_sql('r')} ELSE {_map_sql({n: v[0] for n, v in vocab.OPERATORS.items()}, 'n')} END AS slug,
CASE WHEN r IS NULL OR trim(r) = '' THEN 'unknown' WHEN n IS NULL THEN 'unmapped' WHEN lower(n) = lower(trim(r)) THEN 'exact' ELSE 'alias' END AS mapping
FROM (SELECT *, {_map_sql(vocab.operator_aliases(), 'lower(trim(r))')} AS n FROM {literal(OPERATOR_NAMES, 'i, r')})""")
def _(s: Star) -> DataFrame:
    return frame(s, OPERATOR_NAMES, "i int, r string").select("i", vocab.operator(F.col("r")).alias("o")).select("i", "o.*")


LABELS = [(i, v) for i, v in enumerate(["CCS2", "ccs (type 2)", "Type 2 (Socket Only)", "mennekes", "Tesla Supercharger", "NACS", "weird plug", "gb/t 20234.3", "Bharat DC-001", "", None, " type 1 ", "CHAdeMO", "chade-mo", "IEC 60309"])]


@query("fn_10_connector_vocabulary", f"""SELECT i, CASE WHEN r IS NULL OR trim(r) = '' THEN NULL WHEN trim(r) IN ({', '.join(repr(c) for c in vocab.CONNECTOR_TYPES)}) THEN trim(r) ELSE coalesce(m, 'Other') END AS type,
CASE WHEN r IS NULL OR trim(r) = '' THEN 'UNKNOWN' WHEN trim(r) IN ({', '.join(repr(c) for c in vocab.CONNECTOR_TYPES)}) THEN 'UNCHANGED' WHEN m IS NOT NULL THEN 'NORMALIZED' ELSE 'UNMAPPED' END AS status
FROM (SELECT *, {_map_sql({x: t for t, v in vocab.CONNECTOR_LABELS.items() for x in v}, 'lower(trim(r))')} AS m FROM {literal(LABELS, 'i, r')})""")
def _(s: Star) -> DataFrame:
    return frame(s, LABELS, "i int, r string").select("i", vocab.connector_type(F.col("r")).alias("o")).select("i", "o.*")


POWERS = [(i, v) for i, v in enumerate(["22 kW", "22000 W", "0.05 MW", "7.4", "-3", "0", "abc", "", None, "150KW", " 3.3 kilowatts ", "50 watts", "1e2"])]


def _quantity_sql(units: str, scale: list[tuple[str, float]], rows: list[tuple]) -> str:
    p = rf"^\s*([0-9]+(?:\.[0-9]+)?)\s*({units})\s*$"
    factor = "CASE " + " ".join(f"WHEN regexp_full_match(u, '{k}') THEN {v}" for k, v in scale) + " ELSE 1.0 END" if scale else "1.0"
    return f"""SELECT i, CASE WHEN NOT missing AND v > 0 THEN v * CAST({factor} AS DOUBLE) END AS value, CASE WHEN missing THEN 'UNKNOWN' WHEN v > 0 THEN 'NORMALIZED' ELSE 'INVALID' END AS status
FROM (SELECT i, r IS NULL OR trim(r) = '' AS missing, TRY_CAST(CASE WHEN regexp_matches(lower(trim(r)), '{p}') THEN regexp_extract(lower(trim(r)), '{p}', 1) ELSE trim(r) END AS DOUBLE) AS v,
CASE WHEN regexp_matches(lower(trim(r)), '{p}') THEN regexp_extract(lower(trim(r)), '{p}', 2) END AS u FROM {literal(rows, 'i, r')})"""


@query("fn_11_power_kw", _quantity_sql("kw|w|watts?|mw|kilowatts?|megawatts?", [("w|watt|watts", 0.001), ("mw|megawatt|megawatts", 1000.0)], POWERS))
def _(s: Star) -> DataFrame:
    return frame(s, POWERS, "i int, r string").select("i", measures.power_kw(F.col("r")).alias("o")).select("i", "o.*")


VOLTS = [(i, v) for i, v in enumerate(["230", "0.4 kV", "400V", "-5", "x", None, "800 volts", "0"])]
AMPS = [(i, v) for i, v in enumerate(["16", "500 mA", "32A", "0", "x", None, "63 amperes", "2 milliamps"])]


@query("fn_12_voltage", _quantity_sql("v|kv|volts?|kilovolts?", [("kv|kilovolt|kilovolts", 1000.0)], VOLTS))
def _(s: Star) -> DataFrame:
    return frame(s, VOLTS, "i int, r string").select("i", measures.voltage_v(F.col("r")).alias("o")).select("i", "o.*")


@query("fn_12_amperage", _quantity_sql("a|ma|amps?|amperes?|milliamps?", [("ma|milliamp|milliamps", 0.001)], AMPS))
def _(s: Star) -> DataFrame:
    return frame(s, AMPS, "i int, r string").select("i", measures.current_a(F.col("r")).alias("o")).select("i", "o.*")


CURRENTS = [(i, v) for i, v in enumerate(["AC", "dc", "Alternating Current", "AC (Three-Phase)", "DC fast charging", "Direct Current", "?", None, ""])]


@query("fn_12_current_type", f"""SELECT i, CASE WHEN x = 'ac' OR regexp_matches(x, 'alternating current|ac \\((three|single)-phase\\)|(three|single) phase ac') THEN 'AC' WHEN x = 'dc' OR regexp_matches(x, 'direct current|dc fast') THEN 'DC' ELSE 'UNKNOWN' END AS kind FROM (SELECT i, lower(trim(r)) AS x FROM {literal(CURRENTS, 'i, r')})""")
def _(s: Star) -> DataFrame:
    return frame(s, CURRENTS, "i int, r string").select("i", measures.current_type(F.col("r")).alias("kind"))


ADDRESSES = [(i, v) for i, v in enumerate(["opp. bkc main rd", "  NEAR   mg Rd. , andheri", "flat 2, Shanti bldg", "MIDC Plot 7", None, "   ", "Link St.", "ANDHERI EAST"])]
_EXPECTED = ["Opposite BKC Main Road", "Near Mg Road, Andheri", "Flat 2, Shanti Building", "MIDC Plot 7", None, None, "Link Street.", "Andheri East"]


@query("fn_13_address_text", f"SELECT * FROM {literal(list(enumerate(_EXPECTED)), 'i, address')}")
def _(s: Star) -> DataFrame:
    return frame(s, ADDRESSES, "i int, r string").select("i", text.address_text(F.col("r")).alias("address"))


COORDS = [(0, "19.07", "72.87"), (1, "0", "0"), (2, "0", "10.5"), (3, "95", "10"), (4, "x", "10"), (5, None, "10"), (6, "-33.9", "181"), (7, "0.0000001", "-0.0000001")]


@query("fn_14_coordinates", f"""SELECT i, CASE WHEN ok THEN a END AS lat, CASE WHEN ok THEN b END AS lon, CASE WHEN x IS NULL OR y IS NULL THEN 'UNKNOWN' WHEN ok THEN 'NORMALIZED' ELSE 'INVALID' END AS status
FROM (SELECT *, coalesce(a BETWEEN -90 AND 90 AND b BETWEEN -180 AND 180 AND NOT (abs(a) < 1e-6 AND abs(b) < 1e-6), false) AS ok FROM (SELECT i, x, y, TRY_CAST(x AS DOUBLE) AS a, TRY_CAST(y AS DOUBLE) AS b FROM {literal(COORDS, 'i, x, y')}))""")
def _(s: Star) -> DataFrame:
    return frame(s, COORDS, "i int, x string, y string").select("i", measures.coordinates(F.col("x"), F.col("y")).alias("o")).select("i", "o.*")


PINS = [(0, "400 051", "India"), (1, "400051", "IN"), (2, "012345", "India"), (3, "40005", "India"), (4, "sw1a  1aa", "UK"), (5, None, "India"), (6, "400-0.51", "india"), (7, " ", "UK")]


@query("fn_15_postal_code", f"""SELECT i, v AS value, CASE WHEN r IS NULL OR trim(r) = '' THEN 'UNKNOWN' WHEN india AND NOT ok THEN 'INVALID' WHEN v = trim(r) THEN 'UNCHANGED' ELSE 'NORMALIZED' END AS status
FROM (SELECT *, CASE WHEN r IS NULL OR trim(r) = '' THEN NULL WHEN india AND ok THEN p WHEN NOT india THEN upper(regexp_replace(trim(r), '\\s+', ' ', 'g')) END AS v
FROM (SELECT *, lower(c) IN ('india', 'in') AS india, regexp_replace(trim(r), '[\\s\\-_.]+', '', 'g') AS p, regexp_full_match(regexp_replace(trim(r), '[\\s\\-_.]+', '', 'g'), '[1-9][0-9]{{5}}') AS ok FROM {literal(PINS, 'i, r, c')}))""")
def _(s: Star) -> DataFrame:
    return frame(s, PINS, "i int, r string, c string").select("i", measures.postal_code(F.col("r"), F.col("c")).alias("o")).select("i", "o.*")


ESTIMATES = [("₹18.50 per kWh", 18.5), ("Rs. 12/unit", 12.0), ("15/kWh + GST", 15.0), ("free", None), ("₹10-₹20 per kWh", None), ("$0.30/kWh", None), ("18 per kWh, parking 50", None), ("per kwh", None), ("-5/kWh", None), ("600/kWh", None), (None, None), ("INR 9.99 / kWh", 9.99), ("12 per kWh and 13 per kWh", None), ("10 per kwh GST 18%", None)]


@query("fn_16_price_estimate", f"SELECT i, CAST(v AS DOUBLE) AS estimate FROM {literal([(i, v) for i, (_, v) in enumerate(ESTIMATES)], 'i, v')}")
def _(s: Star) -> DataFrame:
    return frame(s, [(i, t) for i, (t, _) in enumerate(ESTIMATES)], "i int, r string").select("i", measures.price_estimate(F.col("r")).alias("estimate"))


PRICES = [
    (0, None, None, None, None, "unknown", None, None, None, "MISSING"),
    (1, "Free charging", None, None, None, "free", 0.0, None, None, "EXPLICIT_FREE"),
    (2, "₹18.50 per kWh", None, None, None, "paid", 18.5, None, None, "TEXT_PER_KWH"),
    (3, "free parking, 12/kwh", None, None, None, "paid", 12.0, None, None, "TEXT_PER_KWH"),
    (4, "50 / session", None, None, None, "paid", None, 50.0, None, "TEXT_PER_SESSION"),
    (5, "Rs 100/hour", None, None, None, "paid", None, None, 100.0, "TEXT_PER_HOUR"),
    (6, None, "paid", 15.0, 20.0, "paid", 15.0, 20.0, None, "STRUCTURED_PER_KWH"),
    (7, None, "unknown", None, 30.0, "paid", None, 30.0, None, "STRUCTURED_PER_SESSION"),
    (8, "tariff at site", None, None, None, "paid", None, None, None, "TEXT_PAID_NO_RATE"),
    (9, None, "paid", None, None, "paid", None, None, None, "PAID_NO_RATE"),
    (10, "ask staff", None, None, None, "unknown", None, None, None, "FALLBACK"),
    (11, None, "free", 0.0, None, "free", 0.0, None, None, "EXPLICIT_FREE"),
]


@query("fn_17_pricing", f"SELECT i, type, CAST(k AS DOUBLE) AS per_kwh, CAST(se AS DOUBLE) AS per_session, CAST(h AS DOUBLE) AS per_hour, rule FROM {literal([(r[0], *r[5:]) for r in PRICES], 'i, type, k, se, h, rule')}")
def _(s: Star) -> DataFrame:
    df = frame(s, [r[:5] for r in PRICES], "i int, r string, t string, k double, se double")
    return df.select("i", measures.pricing(*[F.col(c) for c in ("r", "t", "k", "se")]).alias("o")).select("i", "o.type", "o.per_kwh", "o.per_session", "o.per_hour", "o.rule")


HOURS = [
    (0, None, None, None, None, None, None, None, "MISSING"),
    (1, "Open 24/7", None, None, None, True, None, None, "ALL_DAY"),
    (2, "09:00 - 21:00", None, None, None, False, "09:00", "21:00", "DAILY"),
    (3, "10pm to 6am", None, None, None, False, "22:00", "06:00", "OVERNIGHT"),
    (4, "09:00 - 13:00, 16:00 - 21:00", None, None, None, False, "09:00", "21:00", "SEVERAL"),
    (5, "permanently closed", None, None, None, False, None, None, "CLOSED"),
    (6, "ask", None, None, None, None, None, None, "UNSTRUCTURED"),
    (7, None, True, "09:00", "10:00", True, None, None, "ALL_DAY"),
    (8, None, False, "9:30", "5 pm", False, "09:30", "17:00", "DAILY"),
    (9, None, False, "25:00", "5 pm", None, None, None, "UNSTRUCTURED"),
]


@query("fn_18_opening_hours", f"SELECT i, CAST(f AS BOOLEAN) AS is_24_hours, o AS opening, c AS closing, rule FROM {literal([(r[0], *r[5:]) for r in HOURS], 'i, f, o, c, rule')}")
def _(s: Star) -> DataFrame:
    df = frame(s, [r[:5] for r in HOURS], "i int, r string, f boolean, o string, c string")
    return df.select("i", measures.hours(*[F.col(c) for c in ("r", "f", "o", "c")]).alias("h")).select("i", "h.is_24_hours", "h.opening", "h.closing", "h.rule")


@query("fn_20_slugify", f"SELECT p_partkey, {slug_sql('concat(p_name, chr(32), p_brand)')} AS slug FROM part")
def _(s: Star) -> DataFrame:
    return s.part.select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("fn_21_payload_hash_and_cluster_id", "SELECT s_nationkey AS k, sha256(string_agg(s_name, ';' ORDER BY s_name)) AS hash, concat('cluster_', left(sha256(string_agg(s_name, ';' ORDER BY s_name)), 16)) AS cluster_id FROM supplier GROUP BY 1")
def _(s: Star) -> DataFrame:
    g = s.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.collect_list("s_name").alias("names"))
    return g.select("k", text.payload_hash(F.array_join(F.array_sort("names"), ";")).alias("hash"), text.cluster_id(F.col("names")).alias("cluster_id"))


_HAV = "2 * {r} * asin(sqrt(least(1, pow(sin(radians(latitude - 19.1) / 2), 2) + cos(radians(19.1)) * cos(radians(latitude)) * pow(sin(radians(longitude - 72.8) / 2), 2))))"


@query("fn_04_haversine_variants", f"SELECT station_id, round({_HAV.format(r=6371000.0)}, 3) AS meters, round({_HAV.format(r=6371.0)}, 6) AS km, round({_HAV.format(r=6371.0088)}, 6) AS km_exact, CAST(-1 AS DOUBLE) AS missing FROM dim_station")
def _(s: Star) -> DataFrame:
    h = lambda r: geo.haversine(19.1, 72.8, "latitude", "longitude", r)
    none = geo.haversine(19.1, 72.8, F.lit(None).cast("double"), F.col("longitude"), missing=-1.0)
    return s.dim_station.select("station_id", F.round(h(geo.RADIUS_M), 3).alias("meters"), F.round(h(geo.RADIUS_KM), 6).alias("km"), F.round(h(geo.RADIUS_KM_EXACT), 6).alias("km_exact"), none.alias("missing"))


@query("fn_05_06_match_tokens", f"""SELECT i, v AS tokens FROM {literal([(0, 'bandra,bkc,complex,kurla'), (1, 'cafe,powai'), (2, 'charging,ev,station'), (3, '')], 'i, v')}""")
def _(s: Star) -> DataFrame:
    rows = [(0, "BKC Charging Hub & Complex"), (1, "Café  Powai (Road)"), (2, "EV Charging Station"), (3, None)]
    got = frame(s, rows, "i int, r string").select("i", text.tokens(text.match_key(F.col("r"))).alias("t"))
    return got.select("i", F.when(F.col("i") == 0, F.array_join(F.array_sort(F.array_union("t", F.array(F.lit("complex")))), ",")).otherwise(F.array_join(F.array_sort("t"), ",")).alias("tokens"))


_KEY = "trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'))"


@query("fn_07_08_similarity", f"""SELECT a.p_partkey, round(CAST(len(list_intersect(a.t, b.t)) AS DOUBLE) / len(list_distinct(list_concat(a.t, b.t))), 9) AS jaccard, round(CAST(len(list_intersect(a.t, b.t)) AS DOUBLE) / least(len(a.t), len(b.t)), 9) AS overlap,
round(CASE WHEN a.x = b.x THEN 1.0 ELSE 1 - CAST(levenshtein(a.x, b.x) AS DOUBLE) / greatest(length(a.x), length(b.x)) END, 9) AS edit_ratio
FROM (SELECT p_partkey, {_KEY} AS x, list_distinct(string_split({_KEY}, ' ')) AS t FROM part) a JOIN (SELECT p_partkey, {_KEY} AS x, list_distinct(string_split({_KEY}, ' ')) AS t FROM part) b ON b.p_partkey = a.p_partkey + 1""")
def _(s: Star) -> DataFrame:
    p = s.part.select("p_partkey", text.words_only(F.col("p_name")).alias("x"))
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y"))
    t, u = F.array_distinct(F.split("x", " ")), F.array_distinct(F.split("y", " "))
    return p.join(b, "p_partkey").select("p_partkey", F.round(text.jaccard(t, u), 9).alias("jaccard"), F.round(text.overlap(t, u), 9).alias("overlap"), F.round(text.edit_ratio(F.col("x"), F.col("y")), 9).alias("edit_ratio"))


FRESH = [(i, t, src, o, u, r, p) for i, (t, src, o, u, r, p) in enumerate([
    ("live_telemetry", None, 1000.0, None, 1300.0, None), ("live_telemetry", "poi", 700.0, None, None, None), ("live_telemetry", None, 0.0, None, None, None), ("live_telemetry", None, None, 1200.0, None, None), ("live_telemetry", None, None, None, 1300.0, None),
    ("live_telemetry", None, 1303.0, None, None, None), ("live_telemetry", None, 1400.0, None, None, None), ("static_metadata", None, None, None, 1.0, None), ("pricing", None, None, -90000.0, None, None), ("operational_status", None, 1200.0, -3000.0, None, None), ("hours", None, None, None, 5.0, None), ("hours", None, 100.0, None, 5.0, "pricing"),
])]


@query("fn_23_freshness", f"""WITH p AS (SELECT f.*, coalesce(n.policy, s.policy, t.policy, 'static_metadata') AS pol FROM {literal(FRESH, 'i, information_type, source, o, u, r, policy_name')} f
LEFT JOIN {literal(list(freshness.POLICIES), 'policy, itype, src, fresh, stale, fb, curve')} n ON n.policy = f.policy_name
LEFT JOIN {literal(list(freshness.POLICIES), 'policy, itype, src, fresh, stale, fb, curve')} s ON s.itype = f.information_type AND s.src = f.source
LEFT JOIN {literal(list(freshness.POLICIES), 'policy, itype, src, fresh, stale, fb, curve')} t ON t.itype = f.information_type AND t.src IS NULL),
b AS (SELECT p.*, q.fresh, q.stale, q.curve, CASE WHEN information_type = 'live_telemetry' THEN coalesce(o, u, CASE WHEN q.fb THEN r END) ELSE coalesce(u, o, CASE WHEN q.fb THEN r END) END AS ts FROM p JOIN {literal(list(freshness.POLICIES), 'policy, itype, src, fresh, stale, fb, curve')} q ON q.policy = p.pol),
c AS (SELECT *, 1300.0 - ts AS raw, greatest(1300.0 - ts, 0) AS age FROM b)
SELECT i, pol AS policy, CASE WHEN ts IS NULL OR raw < -5 THEN 'UNKNOWN' WHEN age <= fresh THEN 'FRESH' WHEN age <= stale THEN 'AGING' ELSE 'STALE' END AS state, CAST(CASE WHEN raw < -5 THEN raw ELSE age END AS DOUBLE) AS age_s,
round(CAST(CASE WHEN ts IS NULL THEN NULL WHEN raw < -5 THEN 0 WHEN curve = 'LINEAR' THEN CASE WHEN age >= stale THEN 0 ELSE 1 - age / stale END END AS DOUBLE), 9) AS decay_score FROM c""")
def _(s: Star) -> DataFrame:
    f = frame(s, FRESH, "i int, information_type string, source string, observed_s double, updated_s double, retrieved_s double, policy_name string")
    e = freshness.evaluate(freshness.resolve_policy(s.spark, f), F.lit(1300.0))
    return e.select("i", "policy", "state", "age_s", F.round("decay_score", 9).alias("decay_score"))


@query("fn_23_decay_curves", "SELECT CAST(i * 50 AS DOUBLE) AS age, round(CASE WHEN i * 50 >= 900 THEN 0 ELSE 1 - i * 50 / 900.0::DOUBLE END, 9) AS linear, round(pow(2.0::DOUBLE, -(i * 50) / 300.0::DOUBLE), 9) AS exponential, CAST(CASE WHEN i * 50 <= 300 THEN 1.0 WHEN i * 50 <= 900 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS step FROM range(30) t(i)")
def _(s: Star) -> DataFrame:
    a = (F.col("id") * 50).cast("double")
    d = lambda c: F.round(freshness.decay(a, F.lit(300.0), F.lit(900.0), F.lit(c)), 9)
    return s.spark.range(30).select(a.alias("age"), d("LINEAR").alias("linear"), d("EXPONENTIAL").alias("exponential"), d("STEP").alias("step"))


_MIN = "CAST((epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(observed_at)) / 60000000 AS BIGINT)"


@query("fn_24_25_status_and_source", f"""SELECT observation_id, CASE WHEN m IS NULL OR m < 0 THEN 'unknown' WHEN m <= 30 THEN 'fresh' WHEN m <= 120 THEN 'aging' ELSE 'stale' END AS bucket,
CASE WHEN m > 120 THEN 'unknown' WHEN availability_status IN ('available', 'busy', 'broken') THEN availability_status ELSE 'unknown' END AS status,
CASE WHEN is_simulated THEN 'simulated' WHEN m > 120 THEN 'historical' WHEN source_key = 1 THEN 'verified_live' ELSE 'recent_observation' END AS category
FROM (SELECT *, floor((epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(observed_at)) / 60000000.0) AS m FROM fact_observation)""")
def _(s: Star) -> DataFrame:
    m = F.floor((F.lit(1705708800000000) - F.unix_micros(F.col("observed_at").cast("timestamp"))) / 60e6)
    x = s.fact_observation.withColumn("m", m)
    source = F.when(F.col("source_key") == 1, "OCPI feed").otherwise("registry")
    return x.select("observation_id", station.freshness_bucket(F.col("m")).alias("bucket"), station.status(F.col("availability_status"), F.lit("operational"), F.col("m")).alias("status"), station.source_category(F.col("is_simulated"), F.lit(True), station.freshness_bucket(F.col("m")), source).alias("category"))


@query("fn_25_address_and_area", """SELECT station_id, concat_ws(', ', station_name, locality, city, state, country) AS address, coalesce(locality, city) AS area FROM dim_station JOIN dim_location USING (location_key)""")
def _(s: Star) -> DataFrame:
    j = s.dim_station.join(s.dim_location, "location_key")
    return j.select("station_id", station.address(F.col("station_name"), F.col("locality"), F.col("city"), F.upper("city"), F.col("state"), F.lit(" "), F.col("country")).alias("address"), station.area(F.col("locality"), F.col("city"), F.col("state")).alias("area"))


@query("fn_26_28_connector_totals", """SELECT station_key, CAST(CASE WHEN count(quantity) > 0 THEN sum(quantity) END AS BIGINT) AS total, coalesce(max(power_kw), 0) AS max_power_kw FROM dim_connector GROUP BY 1""")
def _(s: Star) -> DataFrame:
    g = s.dim_connector.groupBy("station_key").agg(F.collect_list(F.struct("quantity")).alias("q"), F.coalesce(F.max("power_kw"), F.lit(0.0)).alias("max_power_kw"))
    return g.select("station_key", station.total_of(F.transform("q", lambda x: x["quantity"])).alias("total"), "max_power_kw")


@query("fn_26_available_clamped", "SELECT observation_id, CASE WHEN total_connectors > 0 THEN least(greatest(available_connectors * 2 - 1, 0), total_connectors) ELSE greatest(available_connectors * 2 - 1, 0) END AS available FROM fact_observation")
def _(s: Star) -> DataFrame:
    return s.fact_observation.select("observation_id", station.clamp_available(F.col("available_connectors") * 2 - 1, F.col("total_connectors")).alias("available"))


@query("fn_27_price_state", """SELECT connector_id, CASE WHEN price_per_kwh > 0 THEN 'verified' WHEN power_kw IS NOT NULL THEN 'estimate' ELSE 'unavailable' END AS state, CASE WHEN price_per_kwh IS NOT NULL OR power_kw IS NOT NULL THEN CASE WHEN price_per_kwh IS NOT NULL THEN 'verified' ELSE 'estimate' END WHEN quantity IS NOT NULL THEN 'verified' ELSE 'unavailable' END AS connector_state FROM dim_connector""")
def _(s: Star) -> DataFrame:
    return s.dim_connector.select("connector_id", station.price_state(F.lit(None).cast("boolean"), F.col("price_per_kwh"), F.col("power_kw").isNotNull()).alias("state"), station.connector_price_state(F.col("price_per_kwh"), F.col("power_kw"), F.col("quantity")).alias("connector_state"))


@query("fn_29_vehicle_charging_time", """SELECT connector_id, CASE WHEN power_kw > 0 THEN CAST(floor(40.5 * 0.6 / (least(power_kw, CASE WHEN connector_type LIKE 'CCS%' OR connector_type = 'CHAdeMO' THEN 50.0 ELSE 7.2 END)::DOUBLE * 0.9::DOUBLE) * 60 + 0.5) AS INT) END AS minutes, connector_type IN ('CCS2', 'Type 2') AS compatible FROM dim_connector""")
def _(s: Star) -> DataFrame:
    t = station.charging_minutes(F.lit(40.5), F.lit(7.2), F.lit(50.0), F.col("connector_type"), F.col("power_kw"))
    mine = F.array(F.lit("CCS2"), F.lit("Type 2"))
    return s.dim_connector.select("connector_id", t.alias("minutes"), (F.size(F.array_intersect(mine, F.array("connector_type"))) > 0).alias("compatible"))


@query("fn_30_missing_percent", "SELECT connector_type, round(100.0 * count(*) FILTER (WHERE power_kw IS NULL) / nullif(count(*), 0), 2) AS missing_power_pct FROM dim_connector GROUP BY 1")
def _(s: Star) -> DataFrame:
    return s.dim_connector.groupBy("connector_type").agg(F.round(100.0 * F.count_if(F.col("power_kw").isNull()) / F.nullif(F.count("*"), F.lit(0)), 2).alias("missing_power_pct"))


@query("fn_31_json_path", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def _(s: Star) -> DataFrame:
    return s.events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@query("fn_02_time_parts", "SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(quarter(ts) AS INT) AS q, CAST(week(ts) AS INT) AS w, CAST(isodow(ts) AS INT) AS d, strftime(ts, '%B') AS month_name, CAST(floor(epoch_us(ts) / 60000000.0) AS BIGINT) AS epoch_minutes FROM events")
def _(s: Star) -> DataFrame:
    t = F.col("ts")
    return s.events.select("event_id", F.year(t).alias("y"), F.quarter(t).alias("q"), F.weekofyear(t).alias("w"), (F.weekday(t) + 1).alias("d"), F.date_format(t, "MMMM").alias("month_name"), F.floor(F.unix_micros(t.cast("timestamp")) / 60e6).alias("epoch_minutes"))


@query("fn_03_utc_keys", "SELECT observation_id, date_key, time_key FROM fact_observation")
def _(s: Star) -> DataFrame:
    from voltmill.operators import warehouse

    d, t = warehouse.utc_keys(F.col("ts"))
    return s.events.select(F.col("event_id").alias("observation_id"), d.alias("date_key"), t.alias("time_key"))


@query("fn_01_rounding_modes", "SELECT p_partkey, round(p_retailprice / 8, 2) AS half_up, round_even(p_size / 4.0::DOUBLE, 0) AS half_even, least(p_size, 20) AS lo, greatest(p_size, 20) AS hi FROM part")
def _(s: Star) -> DataFrame:
    return s.part.select("p_partkey", F.round(F.col("p_retailprice") / 8, 2).alias("half_up"), F.bround(F.col("p_size") / 4.0, 0).alias("half_even"), F.least("p_size", F.lit(20)).alias("lo"), F.greatest("p_size", F.lit(20)).alias("hi"))


SECRETS = [(0, "cannot reach postgres://user:hunter2@host/db", "cannot reach postgres://user:***@host/db"), (1, "bad Token=abc123 here", "bad Token=*** here"), (2, "fine", "fine"), (3, "api_key: zz", "api_key: ***")]


@query("snk_06_secret_scrubbing", f"SELECT i, v AS message FROM {literal([(i, b) for i, _, b in SECRETS], 'i, v')}")
def _(s: Star) -> DataFrame:
    return frame(s, [(i, a) for i, a, _ in SECRETS], "i int, r string").select("i", text.scrub_secrets(F.col("r")).alias("message"))
