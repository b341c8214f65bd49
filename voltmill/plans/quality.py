"""Warehouse rules, record rules and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltmill.operators import quality, warehouse
from voltmill.operators.graph import checkpointed
from voltmill.sources.driver_tables import Star

from .core import query
from .star_sql import CTES

AS_OF = "2024-01-20 00:00:00"


def checks(s: Star) -> DataFrame:
    tables = {
        "observation": s.fact_observation, "report": s.fact_report, "review": s.fact_review, "station": s.dim_station, "source": s.dim_source, "connector": s.dim_connector,
        "date": warehouse.calendar(s.spark), "daily": checkpointed(warehouse.daily_evidence(s.fact_observation, s.fact_report, s.fact_review)),
        "oltp_observation": s.events, "oltp_report": s.user_report, "oltp_review": s.review, "oltp_station": s.supplier, "oltp_connector": s.part,
    }
    return quality.run_checks(s.spark, quality.warehouse_checks(tables, F.lit(AS_OF).cast("timestamp_ntz")))


_N = "(SELECT count(*) FROM {0})"
_RULES = [
    *[(f"WH-RI-{n}", "CRITICAL", _N.format(f"{f} WHERE {k} IS NULL OR {k} NOT IN (SELECT {k} FROM {d})")) for n, f, k, d in (("OBS-STATION", "fact_observation", "station_key", "dim_station"), ("OBS-SOURCE", "fact_observation", "source_key", "dim_source"), ("OBS-DATE", "fact_observation", "date_key", "dim_date"), ("REP-STATION", "fact_report", "station_key", "dim_station"), ("REV-STATION", "fact_review", "station_key", "dim_station"), ("DAILY-STATION", "fact_daily", "station_key", "dim_station"))],
    *[(f"WH-DUP-{n}", "HIGH", _N.format(f"(SELECT {k} FROM {f} GROUP BY {k} HAVING count(*) > 1)")) for n, f, k in (("OBS", "fact_observation", "observation_id"), ("REP", "fact_report", "report_id"), ("REV", "fact_review", "review_id"), ("DAILY", "fact_daily", "station_key, date_key"))],
    ("WH-AGG-STATUS", "HIGH", _N.format("fact_daily WHERE available_count + busy_count + broken_count > observation_count")),
    ("WH-AGG-EVIDENCE", "HIGH", _N.format("fact_daily WHERE observation_count + report_count + review_count = 0")),
    ("WH-AGG-RATIO", "HIGH", _N.format("fact_daily WHERE availability_ratio NOT BETWEEN 0 AND 1 OR busy_ratio NOT BETWEEN 0 AND 1 OR broken_ratio NOT BETWEEN 0 AND 1")),
    ("WH-AGG-FLAG", "HIGH", _N.format("fact_daily WHERE NOT has_evidence")),
    ("WH-NULL-POWER", "HIGH", _N.format("dim_connector WHERE power_kw <= 0")),
    ("WH-NULL-AVAIL", "HIGH", _N.format("fact_observation WHERE total_connectors = 0 OR available_connectors > total_connectors")),
    ("WH-NULL-PROV", "INFO", _N.format("fact_observation WHERE source_payload_hash IS NULL")),
    ("WH-TS-FUTURE", "HIGH", _N.format(f"fact_observation WHERE observed_at > TIMESTAMP '{AS_OF}' + INTERVAL 1 HOUR")),
    ("WH-TS-CAUSAL", "CRITICAL", _N.format("fact_observation WHERE received_at < observed_at")),
    ("WH-REC-OBS", "CRITICAL", f"abs({_N.format('events')} - {_N.format('fact_observation')})"),
    ("WH-REC-REP", "CRITICAL", "abs((SELECT count(*) FROM user_report WHERE moderation_status = 'approved' AND moderated_at IS NOT NULL) - (SELECT count(*) FROM fact_report))"),
    ("WH-REC-REV", "CRITICAL", "abs((SELECT count(*) FROM review WHERE moderation_status = 'approved' AND moderated_at IS NOT NULL) - (SELECT count(*) FROM fact_review))"),
    ("WH-REC-STATION", "HIGH", f"abs({_N.format('supplier')} - (SELECT count(DISTINCT station_id) FROM dim_station))"),
    ("WH-REC-CONN", "HIGH", f"abs({_N.format('part')} - {_N.format('dim_connector')})"),
]


@query("dqw_warehouse_rules", "SELECT rule, severity, offending, severity = 'INFO' OR offending = 0 AS passed FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, '{v}' AS severity, {n} AS offending" for r, v, n in _RULES) + ")", **CTES)
def _(s: Star) -> DataFrame:
    return checks(s)


def raw_records(s: Star) -> DataFrame:
    """Stations with their connectors nested."""
    cols = [c for c in s.raw_connector.columns if c not in ("k",)]
    nested = s.raw_connector.groupBy("k").agg(F.collect_list(F.struct(*cols)).alias("connectors"))
    empty = F.array().cast(nested.schema["connectors"].dataType)
    return s.raw_station.join(nested, "k", "left").withColumn("connectors", F.coalesce("connectors", empty))


def validated(s: Star) -> DataFrame:
    return quality.validate_records(raw_records(s), F.col("observed_age_s"))


_IN = "lower(trim(country)) IN ('india', 'ind', 'in')"
_STATION = [
    ("DQ-PROV-001", "E", "trim(source_id) = ''"), ("DQ-PROV-002", "E", "trim(source_station_id) = ''"), ("DQ-PROV-003", "E", "contract_version NOT LIKE '1.%'"), ("DQ-PROV-004", "W", "NOT regexp_full_match(raw_payload_hash, '[a-fA-F0-9]{64}')"),
    ("DQ-NAME-001", "E", "length(trim(name)) < 2"), ("DQ-NAME-002", "W", "lower(trim(name)) IN ('test', 'test station', 'demo')"), ("DQ-OP-001", "I", "operator_name IS NULL"),
    ("DQ-GEO-001", "E", "latitude NOT BETWEEN -90 AND 90"), ("DQ-GEO-002", "E", "longitude NOT BETWEEN -180 AND 180"), ("DQ-GEO-003", "E", "abs(latitude) < 1e-6 AND abs(longitude) < 1e-6"),
    ("DQ-GEO-004", "Q", f"{_IN} AND NOT (latitude BETWEEN 6 AND 38 AND longitude BETWEEN 68 AND 98)"), ("DQ-GEO-005", "W", f"{_IN} AND lower(city) IN ('mumbai', 'thane') AND NOT (latitude BETWEEN 18.7 AND 19.5 AND longitude BETWEEN 72.7 AND 73.3)"),
    ("DQ-ADDR-001", "W", "address_line IS NULL AND locality IS NULL"), ("DQ-ADDR-002", "W", f"postal_code IS NOT NULL AND {_IN} AND NOT regexp_full_match(trim(postal_code), '[1-9][0-9][0-9][0-9][0-9][0-9]')"),
    ("DQ-HOURS-001", "W", "is_24_hours AND (opening_time IS NOT NULL OR closing_time IS NOT NULL)"), ("DQ-HOURS-003", "Q", "is_24_hours AND (lower(comments) LIKE '%permanently closed%' OR operational_status = 'temporarily_unavailable')"),
    ("DQ-HOURS-002", "E", "NOT is_24_hours AND NOT regexp_full_match(opening_time, '([01][0-9]|2[0-3]):[0-5][0-9]')"), ("DQ-HOURS-002", "E", "NOT is_24_hours AND NOT regexp_full_match(closing_time, '([01][0-9]|2[0-3]):[0-5][0-9]')"),
    ("DQ-CONN-001", "W", "k NOT IN (SELECT k FROM raw_connector)"), ("DQ-OBS-001", "E", "observed_age_s < -300"), ("DQ-OBS-002", "W", "observed_age_s > 86400"), ("DQ-OBS-003", "E", "observed_available > observed_total"),
]
_CONN = [
    ("DQ-CONN-003", "W", "connector_type = 'plug'"), ("DQ-CONN-002", "E", "quantity < 1"), ("DQ-CONN-004", "W", "quantity > 50"), ("DQ-ELEC-001", "E", "power_kw <= 0"), ("DQ-ELEC-002", "Q", "power_kw > 2000"),
    ("DQ-ELEC-003", "W", "power_kw > 0 AND power_kw <= 2000 AND (power_kw < 1 OR power_kw > 500)"), ("DQ-ELEC-008", "W", "power_kw IS NULL"), ("DQ-ELEC-004", "E", "voltage_v <= 0"), ("DQ-ELEC-005", "W", "voltage_v > 1000"),
    ("DQ-ELEC-006", "E", "amperage_a <= 0"), ("DQ-ELEC-007", "W", "amperage_a > 1000"), ("DQ-PRICE-001", "E", "price_per_kwh < 0"), ("DQ-PRICE-001", "E", "price_per_session < 0"),
    ("DQ-PRICE-002", "Q", "pricing_type = 'free' AND price_per_kwh > 0"), ("DQ-PRICE-003", "W", "price_per_kwh IS NULL AND price_per_session IS NULL AND pricing_type = 'unknown'"),
    ("DQ-PRICE-004", "E", "currency = 'R5'"), ("DQ-PRICE-004", "W", "currency = 'RUPEESANDMORE'"),
]
FINDING = " UNION ALL ".join([f"SELECT k, '{r}' AS rule, '{b}' AS bucket FROM raw_station WHERE {e}" for r, b, e in _STATION] + [f"SELECT k, '{r}', '{b}' FROM raw_connector WHERE {e} AND k IN (SELECT k FROM raw_station)" for r, b, e in _CONN])
OUTCOME = "SELECT k, CASE WHEN count(*) FILTER (WHERE bucket = 'E') > 0 THEN 'REJECT' WHEN count(*) FILTER (WHERE bucket = 'Q') > 0 THEN 'QUARANTINE' WHEN count(*) FILTER (WHERE bucket = 'W') > 0 THEN 'ACCEPT_WITH_WARNINGS' ELSE 'ACCEPT' END AS outcome, count(*) FILTER (WHERE bucket = 'W') AS warnings FROM raw_station LEFT JOIN finding USING (k) GROUP BY 1"


@query("dq_findings_by_rule", "SELECT source_id, rule, bucket, count(*) AS n FROM finding JOIN raw_station USING (k) GROUP BY ALL", finding=FINDING)
def _(s: Star) -> DataFrame:
    return quality.batch_report(validated(s))


@query("dq_outcomes_and_score", """SELECT k, outcome, CASE WHEN outcome = 'REJECT' THEN 0.0 ELSE greatest(10, least(100, 40 + CASE WHEN operator_name IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN locality IS NOT NULL OR address_line IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN postal_code IS NOT NULL THEN 5 ELSE 0 END
+ CASE WHEN c.n > 0 THEN 10 ELSE 0 END + CASE WHEN c.p > 0 THEN 5 ELSE 0 END + CASE WHEN is_24_hours IS NOT NULL OR (opening_time IS NOT NULL AND closing_time IS NOT NULL) THEN 5 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN observed_age_s IS NOT NULL THEN 10 ELSE 0 END - least(20, 4 * warnings))) / 100.0::DOUBLE END AS quality_score
FROM outcome_of JOIN raw_station USING (k) LEFT JOIN (SELECT k, count(*) AS n, count(power_kw) AS p FROM raw_connector GROUP BY 1) c USING (k)""", finding=FINDING, outcome_of=OUTCOME)
def _(s: Star) -> DataFrame:
    return validated(s).select("k", "outcome", "quality_score")


@query("dq_quarantine_ledger", "SELECT source_id, source_station_id, name, string_agg(DISTINCT rule, ',' ORDER BY rule) AS failed_rules FROM outcome_of JOIN raw_station USING (k) JOIN finding USING (k) WHERE outcome = 'QUARANTINE' GROUP BY k, 1, 2, 3", finding=FINDING, outcome_of=OUTCOME)
def _(s: Star) -> DataFrame:
    return quality.quarantine_ledger(validated(s)).withColumn("failed_rules", F.array_join("failed_rules", ","))


@query("agg_19_completeness_rates", "SELECT source_id, count(*) AS n, round(100.0 * count(operator_name) / count(*), 4) AS operator_pct, round(100.0 * count(postal_code) / count(*), 4) AS postal_pct, round(100.0 * count(is_24_hours) / count(*), 4) AS hours_pct FROM raw_station GROUP BY 1")
def _(s: Star) -> DataFrame:
    pct = lambda c: F.round(100.0 * F.count(c) / F.count("*"), 4)
    return s.raw_station.groupBy("source_id").agg(F.count("*").alias("n"), pct("operator_name").alias("operator_pct"), pct("postal_code").alias("postal_pct"), pct("is_24_hours").alias("hours_pct"))


@query("ext_34_dataset_validator", "SELECT 'pk' AS rule, count(*) AS n FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'fk', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'coordinates', count(*) FROM raw_station WHERE latitude NOT BETWEEN -90 AND 90 OR longitude NOT BETWEEN -180 AND 180 OR (latitude = 0 AND longitude = 0) UNION ALL SELECT 'time order', count(*) FROM fact_observation WHERE received_at < observed_at UNION ALL SELECT 'pricing', count(*) FROM raw_connector WHERE pricing_type = 'free' AND price_per_kwh > 0")
def _(s: Star) -> DataFrame:
    from voltmill.operators import geo

    n = lambda rule, df: df.agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))
    out = n("pk", s.part.groupBy("p_partkey").agg(F.count("*").alias("c")).where("c > 1"))
    out = out.union(n("fk", s.orders.join(s.customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti")))
    out = out.union(n("coordinates", s.raw_station.where(~geo.valid_coordinate(F.col("latitude"), F.col("longitude")))))
    out = out.union(n("time order", s.fact_observation.where("received_at < observed_at")))
    return out.union(n("pricing", s.raw_connector.where("pricing_type = 'free' AND price_per_kwh > 0")))
