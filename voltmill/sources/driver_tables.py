"""The charging-network model over the generic test tables.

Each definition is one SELECT in the SQL that Spark and DuckDB share, so that queries and their oracles
start from equal rows.  Stations are suppliers, operators nations, connectors parts, observations, reports
and reviews events, runs and station versions orders.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_EVENT = """FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e CROSS JOIN (SELECT count(*) AS stations FROM {supplier}) c"""
_DATE_KEY = "year(ts) * 10000 + month(ts) * 100 + day(ts)"
_TIME_KEY = "hour(ts) * 4 + CAST(floor(minute(ts) / 15) AS INT)"

DEFINITIONS: dict[str, str] = {
    "dim_operator": """SELECT n_nationkey AS operator_key, concat('OP-', CAST(n_nationkey AS STRING)) AS operator_id, n_name AS operator_name FROM {nation}""",
    "dim_location": """SELECT CAST(k AS INT) AS location_key, r_name AS city, CASE WHEN k % 7 = 6 THEN NULL ELSE concat('Zone ', CAST(k % 7 AS STRING)) END AS locality,
        concat('State ', CAST(k % 5 AS STRING)) AS state, 'India' AS country
        FROM (SELECT DISTINCT s_suppkey % 15 AS k FROM {supplier}) x JOIN {region} ON r_regionkey = k % 5""",
    "dim_station": """SELECT CAST(s_suppkey AS INT) AS station_key, concat('ST-', CAST(s_suppkey AS STRING)) AS station_id, s_name AS station_name, s_nationkey AS operator_key,
        CAST(s_suppkey % 15 AS INT) AS location_key, CAST(18.7 AS DOUBLE) + CAST((s_suppkey * 37) % 800 AS DOUBLE) / 1000 AS latitude,
        CAST(72.7 AS DOUBLE) + CAST((s_suppkey * 53) % 600 AS DOUBLE) / 1000 AS longitude, s_suppkey % 10 <> 9 AS is_current, s_suppkey % 4 = 0 AS is_24_hours,
        CASE WHEN s_suppkey % 9 = 8 THEN 'temporarily_unavailable' ELSE 'operational' END AS operational_status, s_suppkey % 13 = 0 AS is_simulated FROM {supplier}""",
    "dim_connector": """SELECT CAST(p_partkey AS INT) AS connector_key, concat('CN-', CAST(p_partkey AS STRING)) AS connector_id, CAST(p_partkey % stations AS INT) AS station_key,
        CASE p_partkey % 6 WHEN 0 THEN 'CCS2' WHEN 1 THEN 'Type 2' WHEN 2 THEN 'CHAdeMO' WHEN 3 THEN 'GB/T' WHEN 4 THEN 'Bharat AC001' ELSE 'Other' END AS connector_type,
        CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) * 2.5 END AS power_kw, CASE WHEN p_size % 11 = 0 THEN NULL ELSE CAST(1 + p_size % 3 AS INT) END AS quantity,
        CASE WHEN p_size % 5 = 0 THEN NULL ELSE round(p_retailprice / 50, 2) END AS price_per_kwh, CASE WHEN p_size % 5 = 0 THEN 'unknown' ELSE 'paid' END AS pricing_type
        FROM {part} CROSS JOIN (SELECT count(*) AS stations FROM {supplier}) c""",
    "dim_source": """SELECT 0 AS source_key, 'open map' AS name UNION ALL SELECT 1, 'partner feed' UNION ALL SELECT 2, 'registry' UNION ALL SELECT 3, 'never used'""",
    "fact_observation": f"""SELECT event_id AS observation_id, CAST(user_id % stations AS INT) AS station_key, {_DATE_KEY} AS date_key, {_TIME_KEY} AS time_key, ts AS observed_at,
        ts + (k % 10 - 1) * INTERVAL '1' MINUTE AS received_at, CASE event_type WHEN 'view' THEN 'available' WHEN 'click' THEN 'busy' WHEN 'error' THEN 'broken' ELSE 'unknown' END AS availability_status,
        CASE k % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'short' WHEN 2 THEN 'medium' WHEN 3 THEN 'long' ELSE 'unknown' END AS queue_level,
        CAST(k % (2 + k % 4) AS INT) AS available_connectors, CAST(1 + k % 4 AS INT) AS total_connectors, CASE WHEN k % 17 = 0 THEN NULL ELSE CAST(user_id % 3 AS INT) END AS source_key,
        CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(event_id % 50 AS INT) END AS connector_key, k % 11 = 0 AS is_simulated,
        CASE WHEN k % 13 = 0 THEN NULL ELSE md5(props) END AS source_payload_hash, value {_EVENT}""",
    "user_report": f"""SELECT event_id AS report_id, CAST(user_id % stations AS INT) AS station_key, {_DATE_KEY} AS date_key, ts AS observed_at,
        CASE k % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected' ELSE 'approved' END AS moderation_status, CASE WHEN k % 5 = 0 THEN NULL ELSE ts + INTERVAL '1' HOUR END AS moderated_at,
        user_id {_EVENT} WHERE event_type = 'signup'""",
    "review": f"""SELECT event_id AS review_id, CAST(user_id % stations AS INT) AS station_key, {_DATE_KEY} AS date_key, ts AS created_at, CAST(1 + k % 5 AS INT) AS rating,
        CASE k % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected' ELSE 'approved' END AS moderation_status, CASE WHEN k % 5 = 0 THEN NULL ELSE ts + INTERVAL '1' HOUR END AS moderated_at,
        user_id, CASE WHEN k % 3 = 0 THEN '  ' WHEN k % 3 = 1 THEN NULL ELSE concat('User ', CAST(user_id AS STRING)) END AS display_name {_EVENT} WHERE event_type = 'purchase'""",
    "fact_report": """SELECT report_id, station_key, date_key, observed_at FROM {user_report} WHERE moderation_status = 'approved' AND moderated_at IS NOT NULL""",
    "fact_review": """SELECT review_id, station_key, date_key, rating, created_at FROM {review} WHERE moderation_status = 'approved' AND moderated_at IS NOT NULL""",
    "ingestion_run": """SELECT o_orderkey AS run_id, concat('feed ', CAST(o_custkey % 4 AS STRING)) AS source_name, o_orderpriority AS scope,
        CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'RUNNING' ELSE 'PARTIAL' END AS state, o_orderdate AS started_at, CAST(floor(o_totalprice) AS INT) AS records_fetched FROM {orders}""",
    "station_version": """SELECT o_custkey AS station_id, o_orderkey AS version_key, o_orderdate AS effective_from,
        lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS effective_to, o_orderpriority AS attributes FROM {orders}""",
    "raw_station": """SELECT c_custkey AS k, CASE WHEN c_custkey % 97 = 0 THEN '' ELSE concat('src', CAST(c_custkey % 3 AS STRING)) END AS source_id, CASE WHEN c_custkey % 89 = 0 THEN ' ' ELSE concat('S', CAST(c_custkey AS STRING)) END AS source_station_id,
        CASE WHEN c_custkey % 83 = 0 THEN '2.0' ELSE '1.2.0' END AS contract_version, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'zz' ELSE concat(md5(c_name), md5(c_name)) END AS raw_payload_hash,
        CASE WHEN c_custkey % 41 = 0 THEN ' X ' WHEN c_custkey % 43 = 0 THEN 'Test Station' ELSE concat('Plaza ', CAST(c_custkey % 50 AS STRING), ' Charging') END AS name,
        CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('Operator ', CAST(c_nationkey % 5 AS STRING)) END AS operator_name,
        CASE WHEN c_custkey % 53 = 0 THEN CAST(95 AS DOUBLE) WHEN c_custkey % 59 = 0 THEN CAST(0 AS DOUBLE) WHEN c_custkey % 61 = 0 THEN CAST(51.5 AS DOUBLE) ELSE CAST(18.75 AS DOUBLE) + CAST((c_custkey * 31) % 700 AS DOUBLE) / 1000 END AS latitude,
        CASE WHEN c_custkey % 59 = 0 THEN CAST(0 AS DOUBLE) WHEN c_custkey % 67 = 0 THEN CAST(200 AS DOUBLE) WHEN c_custkey % 61 = 0 THEN CAST(-0.1 AS DOUBLE) ELSE CAST(72.65 AS DOUBLE) + CAST((c_custkey * 17) % 500 AS DOUBLE) / 1000 END AS longitude,
        CASE c_custkey % 4 WHEN 0 THEN 'India' WHEN 1 THEN ' IN' WHEN 2 THEN 'Nepal' ELSE 'ind' END AS country, CASE c_custkey % 3 WHEN 0 THEN 'Mumbai' WHEN 1 THEN 'Pune' ELSE 'thane' END AS city,
        CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat(CAST(c_custkey % 90 AS STRING), ' Main Road') END AS address_line, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE concat('Zone ', CAST(c_custkey % 12 AS STRING)) END AS locality,
        CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '400051' WHEN 2 THEN '012345' WHEN 3 THEN ' 400070 ' ELSE '4000' END AS postal_code,
        CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS is_24_hours, CASE c_custkey % 8 WHEN 0 THEN '09:00' WHEN 1 THEN '25:00' ELSE NULL END AS opening_time, CASE c_custkey % 8 WHEN 0 THEN '21:00' WHEN 1 THEN '9pm' ELSE NULL END AS closing_time,
        CASE WHEN c_custkey % 19 = 0 THEN 'Permanently closed since May' ELSE 'fine' END AS comments, CASE WHEN c_custkey % 23 = 0 THEN 'temporarily_unavailable' ELSE 'operational' END AS operational_status,
        CASE WHEN c_custkey % 10 = 0 THEN '12345' ELSE NULL END AS phone, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE (c_custkey * 977) % 200000 - 600 END AS observed_age_s,
        CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 7 AS INT) END AS observed_available, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(5 AS INT) END AS observed_total FROM {customer}""",
    "raw_connector": """SELECT o_custkey AS k, o_orderkey AS n, CASE r % 7 WHEN 0 THEN 'CCS2' WHEN 1 THEN 'Type 2' WHEN 2 THEN 'CHAdeMO' WHEN 3 THEN 'plug' WHEN 4 THEN 'GB/T' WHEN 5 THEN 'Other' ELSE 'CCS2' END AS connector_type, CAST(r % 57 AS INT) AS quantity,
        CASE WHEN r % 11 = 0 THEN NULL WHEN r % 101 = 0 THEN CAST(-1 AS DOUBLE) WHEN r % 103 = 0 THEN CAST(3000 AS DOUBLE) WHEN r % 31 = 0 THEN CAST(700 AS DOUBLE) ELSE CAST(r % 150 + 1 AS DOUBLE) END AS power_kw,
        CASE WHEN r % 3 = 0 THEN NULL WHEN r % 107 = 0 THEN CAST(0 AS DOUBLE) WHEN r % 37 = 0 THEN CAST(1500 AS DOUBLE) ELSE CAST(400 AS DOUBLE) END AS voltage_v, CASE WHEN r % 3 = 1 THEN NULL WHEN r % 109 = 0 THEN CAST(-2 AS DOUBLE) WHEN r % 29 = 0 THEN CAST(2000 AS DOUBLE) ELSE CAST(32 AS DOUBLE) END AS amperage_a,
        CASE r % 5 WHEN 0 THEN 'free' WHEN 1 THEN 'unknown' ELSE 'paid' END AS pricing_type, CASE WHEN r % 4 = 0 THEN NULL WHEN r % 113 = 0 THEN CAST(-1 AS DOUBLE) WHEN r % 5 = 0 AND r % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(r % 40 AS DOUBLE) END AS price_per_kwh,
        CASE WHEN r % 127 = 0 THEN CAST(-5 AS DOUBLE) ELSE NULL END AS price_per_session, CASE WHEN r % 131 = 0 THEN 'R5' WHEN r % 137 = 0 THEN 'RUPEESANDMORE' ELSE 'INR' END AS currency FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS r FROM {orders}) x""",
    "site": """SELECT c_custkey AS id, concat('src', CAST(c_custkey % 3 AS STRING)) AS source_id, concat('R', CAST(c_custkey AS STRING)) AS source_station_id,
        concat('src', CAST(c_custkey % 3 AS STRING), ':R', CAST(c_custkey AS STRING)) AS key, b,
        CASE WHEN c_custkey % 9 = 1 THEN concat('Plaza ', CAST(b % 40 AS STRING), ' EV Charging Station') WHEN c_custkey % 9 = 5 THEN concat('Mall ', CAST(b % 30 AS STRING)) WHEN c_custkey % 9 = 7 THEN concat('Plaza-', CAST(b % 40 AS STRING), ' Hub') ELSE concat('Plaza ', CAST(b % 40 AS STRING), ' Centre') END AS name,
        CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'zeon-power' ELSE concat('tata-', CAST(b % 5 AS STRING)) END AS operator_slug, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('Tata ', CAST(b % 5 AS STRING), CASE WHEN c_custkey % 2 = 0 THEN ' Ltd' ELSE '' END) END AS operator_name,
        CAST(18.75 AS DOUBLE) + CAST((b * 31) % 700 AS DOUBLE) / 1000 + CAST(c_custkey % 3 AS DOUBLE) * CAST(0.0001 AS DOUBLE) AS latitude, CAST(72.65 AS DOUBLE) + CAST((b * 17) % 500 AS DOUBLE) / 1000 AS longitude,
        CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN '400999' ELSE concat('4000', CAST(10 + b % 80 AS STRING)) END AS postal_code, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('Zone ', CAST(b % 12 AS STRING), ' East') END AS locality, concat(CAST(b % 90 AS STRING), ' Link Road') AS address_line,
        CAST(c_custkey % 7 AS DOUBLE) / 10 AS quality, CASE WHEN c_custkey % 40 = 0 THEN 'QUARANTINE' WHEN c_custkey % 51 = 0 THEN 'REJECT' ELSE 'ACCEPT' END AS outcome, CASE WHEN c_custkey % 6 < 3 THEN c_custkey * 10 ELSE NULL END AS recency,
        CASE WHEN c_custkey % 8 = 0 THEN 'free' WHEN c_custkey % 8 = 3 THEN 'unknown' ELSE 'paid' END AS pricing_type, CASE WHEN c_custkey % 8 IN (0, 3, 4) THEN NULL ELSE CAST(10 + (b + CASE WHEN c_custkey % 8 = 7 THEN 1 ELSE 0 END) % 4 AS DOUBLE) END AS price_per_kwh
        FROM (SELECT *, c_custkey - c_custkey % 3 AS b FROM {customer}) x""",
    "site_connector": """SELECT c_custkey AS id, CASE (b + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END) % 4 WHEN 0 THEN 'CCS2' WHEN 1 THEN 'Type 2' WHEN 2 THEN 'Other' ELSE 'GB/T' END AS connector_type,
        CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 14 = 0 THEN CAST(150 AS DOUBLE) ELSE CAST(30 + b % 3 AS DOUBLE) + CAST(0.5 AS DOUBLE) END AS power_kw, CAST(1 + c_custkey % 3 AS INT) AS quantity FROM (SELECT *, CAST(c_custkey - c_custkey % 3 AS INT) AS b FROM {customer}) x WHERE c_custkey % 19 <> 0
        UNION ALL SELECT c_custkey, 'CCS2', CAST(60 AS DOUBLE), CAST(2 AS INT) FROM {customer} WHERE (c_custkey - c_custkey % 3) % 5 = 0""",
    "canon": """SELECT concat('C', CAST(id AS STRING)) AS canon_id, name, latitude, longitude FROM {site} WHERE b % 4 = 0 AND id % 3 = 0 OR id % 29 = 0""",
    "canon_link": """SELECT concat('C', CAST(id AS STRING)) AS canon_id, source_id, source_station_id FROM {site} WHERE b % 4 = 0 AND id % 3 = 0""",
    "listing": """SELECT c_custkey AS id, concat('Station ', CAST(c_custkey AS STRING)) AS name, concat('Operator ', CAST(c_nationkey AS STRING)) AS operator, c_mktsegment AS area, concat(CAST(c_custkey % 90 AS STRING), ' Link Road') AS address,
        CASE WHEN c_custkey % 37 = 0 THEN CAST(0 AS DOUBLE) WHEN c_custkey % 31 = 0 THEN NULL ELSE CAST(18.75 AS DOUBLE) + CAST((c_custkey * 31) % 700 AS DOUBLE) / 1000 END AS latitude, CASE WHEN c_custkey % 37 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(72.65 AS DOUBLE) + CAST((c_custkey * 17) % 500 AS DOUBLE) / 1000 END AS longitude,
        CASE c_custkey % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'busy' WHEN 2 THEN 'broken' ELSE 'unknown' END AS status, c_custkey % 12 = 0 AS is_free, CASE WHEN c_custkey % 12 = 0 THEN CAST(0 AS DOUBLE) WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(8 + c_custkey % 15 AS DOUBLE) END AS price_per_kwh,
        CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 50 AS DOUBLE) / 10 END AS rating, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS is_24_hours, CASE WHEN c_custkey % 5 = 1 THEN NULL WHEN c_custkey % 2 = 0 THEN '08:00' ELSE '20:30' END AS opening, CASE WHEN c_custkey % 5 = 1 THEN NULL WHEN c_custkey % 2 = 0 THEN '21:00' ELSE '06:00' END AS closing,
        CASE WHEN c_custkey % 6 = 0 THEN '17:00-19:00' WHEN c_custkey % 6 = 1 THEN '22:00-09:30' ELSE NULL END AS busy_window, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 300 AS INT) END AS minutes, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CAST(c_custkey % 3 AS INT) END AS available FROM {customer}""",
    "listing_plug": """SELECT o_custkey AS id, CASE CAST(floor(o_totalprice) AS BIGINT) % 5 WHEN 0 THEN 'CCS2' WHEN 1 THEN 'Type 2' WHEN 2 THEN 'CHAdeMO' WHEN 3 THEN 'Unknown' ELSE 'GB/T' END AS type, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 120 AS DOUBLE) END AS power_kw, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 2 AS INT) END AS quantity FROM {orders} WHERE o_orderstatus = 'P'""",
}


class Star:
    """Lazy DataFrames of the raw tables and of DEFINITIONS under one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in RAW and name not in DEFINITIONS:
            raise AttributeError(name)
        if name not in self._made:
            if name in RAW:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = DEFINITIONS[name]
                self._made[name] = self.spark.sql(text, **{n: getattr(self, n) for n in re.findall(r"\{(\w+)\}", text)})
        return self._made[name]

    @cached_property
    def stations(self) -> int:
        return self.supplier.count()


def with_star(body: str, **more: str) -> str:
    """DuckDB SQL: body after the definitions that it names, and then the CTEs in more."""
    known = DEFINITIONS | more
    needed: list[str] = []

    def visit(text: str) -> None:
        for n in known:
            if re.search(rf"\b{n}\b", text) and n not in needed and text is not known[n]:
                visit(known[n])
                if n not in needed:
                    needed.append(n)

    def bare(text: str) -> str:
        return re.sub(r"\{([a-z]\w*)\}", r"\1", text)

    visit(body)
    ctes = ",\n".join(f"{n} AS ({bare(known[n])})" for n in needed)
    if not needed:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{ctes},\n{body[len(head):]}"
    return f"WITH {ctes}\n{body}"
