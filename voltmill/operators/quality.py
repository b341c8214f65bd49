"""Data-quality rules over the warehouse and over raw station records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Boxes (lat_min, lat_max, lon_min, lon_max), plausible power, placeholder names, vocabulary.
INDIA, METRO = (6.0, 38.0, 68.0, 98.0), (18.70, 19.50, 72.70, 73.30)
PLAUSIBLE_KW = (1.0, 500.0)
PLACEHOLDERS = ("test", "test station", "demo", "demo station", "dummy", "unknown", "unknown station", "sample", "temp", "temporary")
METRO_CITIES = ("mumbai", "bombay", "navi mumbai", "thane")
CONNECTORS = ("CCS2", "CCS1", "CHAdeMO", "Type 2", "Type 1", "GB/T", "Bharat AC001", "Bharat DC001", "Other")


def _box(lat: Column, lon: Column, b: tuple[float, float, float, float]) -> Column:
    return lat.between(b[0], b[1]) & lon.between(b[2], b[3])


def station_rules(as_of_offset_s: Column, bare: Column | None = None) -> list[tuple[str, str, Column]]:
    """(rule, bucket, holds) over station columns: E rejects, Q quarantines, W warns, I only informs.

    as_of_offset_s is the observation's age in seconds, negative in the future; bare is whether a station has no
    connectors, by default whether its array of them is empty.
    """
    c = F.col
    blank = lambda x: F.coalesce(F.trim(c(x)), F.lit("")) == ""
    lat, lon = c("latitude"), c("longitude")
    country, city = F.lower(F.trim("country")), F.lower(F.trim("city"))
    india = country.isin("india", "ind", "in")
    day = F.coalesce(c("is_24_hours"), F.lit(False))
    not_day = F.coalesce(~c("is_24_hours"), F.lit(False))
    clock = r"^([01][0-9]|2[0-3]):[0-5][0-9]$"
    bad_time = lambda x: F.coalesce((c(x) != "") & ~c(x).rlike(clock), F.lit(False))
    name = F.trim(F.coalesce("name", F.lit("")))
    closed = F.lower(F.coalesce("comments", F.lit(""))).rlike("permanently closed|shut down") | c("operational_status").isin("permanently_closed", "temporarily_unavailable")
    return [
        ("DQ-PROV-001", "E", blank("source_id")), ("DQ-PROV-002", "E", blank("source_station_id")),
        ("DQ-PROV-003", "E", ~F.coalesce(c("contract_version").startswith("1."), F.lit(False))),
        ("DQ-PROV-004", "W", c("raw_payload_hash").isNotNull() & ~c("raw_payload_hash").rlike("^[a-fA-F0-9]{64}$")),
        ("DQ-NAME-001", "E", F.length(name) < 2), ("DQ-NAME-002", "W", (F.length(name) >= 2) & F.lower(name).isin(*PLACEHOLDERS)),
        ("DQ-OP-001", "I", F.coalesce("operator_name", F.lit("")) == ""),
        ("DQ-GEO-001", "E", ~lat.between(-90, 90)), ("DQ-GEO-002", "E", ~lon.between(-180, 180)),
        ("DQ-GEO-003", "E", (F.abs(lat) < 1e-6) & (F.abs(lon) < 1e-6)),
        ("DQ-GEO-004", "Q", india & ~_box(lat, lon, INDIA)), ("DQ-GEO-005", "W", india & city.isin(*METRO_CITIES) & ~_box(lat, lon, METRO)),
        ("DQ-ADDR-001", "W", (F.coalesce("address_line", F.lit("")) == "") & (F.coalesce("locality", F.lit("")) == "")),
        ("DQ-ADDR-002", "W", F.coalesce((c("postal_code") != "") & india & ~F.trim("postal_code").rlike("^[1-9][0-9]{5}$"), F.lit(False))),
        ("DQ-HOURS-001", "W", day & ((F.coalesce("opening_time", F.lit("")) != "") | (F.coalesce("closing_time", F.lit("")) != ""))),
        ("DQ-HOURS-003", "Q", day & closed), ("DQ-HOURS-002", "E", not_day & bad_time("opening_time")), ("DQ-HOURS-002", "E", not_day & bad_time("closing_time")),
        ("DQ-CONN-001", "W", F.size("connectors") == 0 if bare is None else bare),
        ("DQ-OBS-001", "E", F.coalesce(as_of_offset_s < -300, F.lit(False))), ("DQ-OBS-002", "W", F.coalesce(as_of_offset_s > 86400, F.lit(False))),
        ("DQ-OBS-003", "E", F.coalesce(c("observed_available") > c("observed_total"), F.lit(False))),
    ]


def connector_rules(x: Column) -> list[tuple[str, str, Column]]:
    """(rule, bucket, holds) over one connector."""
    p, v, a, kwh, ses, cur = (x[k] for k in ("power_kw", "voltage_v", "amperage_a", "price_per_kwh", "price_per_session", "currency"))
    no = lambda e: F.coalesce(e, F.lit(False))
    money = F.trim(F.coalesce(cur, F.lit("")))
    return [
        ("DQ-CONN-003", "W", ~x["connector_type"].isin(*CONNECTORS)), ("DQ-CONN-002", "E", no(x["quantity"] < 1)), ("DQ-CONN-004", "W", no(x["quantity"] > 50)),
        ("DQ-ELEC-001", "E", no(p <= 0)), ("DQ-ELEC-002", "Q", no(p > 2000)), ("DQ-ELEC-003", "W", no((p > 0) & (p <= 2000) & ~p.between(*PLAUSIBLE_KW))), ("DQ-ELEC-008", "W", p.isNull()),
        ("DQ-ELEC-004", "E", no(v <= 0)), ("DQ-ELEC-005", "W", no(v > 1000)), ("DQ-ELEC-006", "E", no(a <= 0)), ("DQ-ELEC-007", "W", no(a > 1000)),
        ("DQ-PRICE-001", "E", no(kwh < 0)), ("DQ-PRICE-001", "E", no(ses < 0)), ("DQ-PRICE-002", "Q", no((x["pricing_type"] == "free") & (kwh > 0))),
        ("DQ-PRICE-003", "W", kwh.isNull() & ses.isNull() & (F.coalesce(x["pricing_type"], F.lit("unknown")) == "unknown")),
        ("DQ-PRICE-004", "E", (money != "") & ~money.rlike("^[A-Za-z]+$")), ("DQ-PRICE-004", "W", money.rlike("^[A-Za-z]{11,}$")),
    ]


def _hits(rules: list[tuple[str, str, Column]]) -> Column:
    """Array of (rule, bucket) of the rules that hold."""
    found = F.array(*[F.when(holds, F.struct(F.lit(rule).alias("rule"), F.lit(bucket).alias("bucket"))) for rule, bucket, holds in rules])
    return F.filter(found, lambda x: x.isNotNull())


def validate_records(stations: DataFrame, age_s: Column) -> DataFrame:
    """Add findings (array of rule and bucket), outcome and quality_score; one pass, no explode."""
    own = _hits(station_rules(age_s))
    each = F.flatten(F.transform("connectors", lambda c: _hits(connector_rules(c))))
    x = stations.withColumn("findings", F.concat(own, each))
    has = lambda b: F.exists("findings", lambda f: f["bucket"] == b)
    outcome = F.when(has("E"), "REJECT").when(has("Q"), "QUARANTINE").when(has("W"), "ACCEPT_WITH_WARNINGS").otherwise("ACCEPT")
    return x.withColumn("outcome", outcome).withColumn("quality_score", quality_score(has("E")))


#: Outcomes by the gravest bucket.
OUTCOMES = {"E": "REJECT", "Q": "QUARANTINE", "W": "ACCEPT_WITH_WARNINGS"}


def _level(rules: list[tuple[str, str, Column]]) -> Column:
    """The gravest bucket of the rules that hold: 3 for E, 2 for Q, 1 for W, else 0."""
    grave = {b: len(OUTCOMES) - i for i, b in enumerate(OUTCOMES)}
    return F.greatest(F.lit(0), F.lit(0), *[F.when(holds, F.lit(grave[bucket])) for _, bucket, holds in rules if bucket in grave])


def record_outcomes(stations: DataFrame, connectors: DataFrame, age_s: Column, key: str = "k") -> DataFrame:
    """(key, outcome) as by validate_records, with connectors as rows of their own: they are summed up, not gathered."""
    worst = connectors.groupBy(key).agg(F.max(_level(connector_rules(F.struct(*[c for c in connectors.columns if c != key])))).alias("worst"))
    own = stations.select(key, *[_level(station_rules(age_s, F.lit(bare))).alias(name) for name, bare in (("own", False), ("bare", True))])
    level = F.when(F.col("worst").isNull(), F.col("bare")).otherwise(F.greatest("own", "worst"))
    outcome = F.lit("ACCEPT")
    for i, o in enumerate(reversed(OUTCOMES.values()), 1):
        outcome = F.when(level == i, o).otherwise(outcome)
    return own.join(worst, key, "left").select(key, outcome.alias("outcome"))


def quality_score(rejected: Column) -> Column:
    """Completeness less 0.04 a warning (0.20 at most), between 0.1 and 1, to two places; 0 for rejected records."""
    c = F.col
    filled = lambda x: F.coalesce(c(x), F.lit("")) != ""
    part = lambda e, w: F.when(e, F.lit(w)).otherwise(F.lit(0))  # noqa: E731  hundredths, so that sums are exact
    points = (
        F.lit(40) + part(filled("operator_name"), 10) + part(filled("locality") | filled("address_line"), 10) + part(filled("postal_code"), 5)
        + part(F.size("connectors") > 0, 10) + part(F.exists("connectors", lambda x: x["power_kw"].isNotNull()), 5)
        + part(c("is_24_hours").isNotNull() | (filled("opening_time") & filled("closing_time")), 5) + part(filled("phone"), 5) + part(c("observed_age_s").isNotNull(), 10)
    )
    warnings = F.size(F.filter("findings", lambda f: f["bucket"] == "W"))
    net = F.least(F.lit(100), points - F.least(F.lit(20), warnings * 4))
    return F.when(rejected, F.lit(0.0)).otherwise(F.greatest(F.lit(10), net) / 100)


def batch_report(validated: DataFrame) -> DataFrame:
    """Findings by rule, bucket and source."""
    return validated.select("source_id", F.explode("findings").alias("f")).groupBy("source_id", "f.rule", "f.bucket").agg(F.count("*").alias("n"))


def quarantine_ledger(validated: DataFrame) -> DataFrame:
    """A row for each quarantined record with its rules."""
    rules = F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["rule"])))
    return validated.where("outcome = 'QUARANTINE'").select("source_id", "source_station_id", "name", rules.alias("failed_rules"))


#: A rule's id and severity, and which of the rows are wrong.
Rule = tuple[str, str, Column]
#: One pass: its rules' ids and severities, and a frame of one row with a count for each id.
Check = tuple[list[tuple[str, str]], Callable[[], DataFrame]]


def in_one_pass(frame: Callable[[], DataFrame], rules: list[Rule]) -> Check:
    """Count the offending rows of several rules in one scan."""
    return [(r, v) for r, v, _ in rules], lambda: frame().agg(*[F.count_if(F.coalesce(e, F.lit(False))).alias(r) for r, _, e in rules])


def warehouse_checks(t: dict[str, DataFrame], as_of: Column) -> list[Check]:
    """The 24 rules: each table is scanned once for its row rules and dimension keys, once for its grain."""
    c = F.col

    def with_dims(fact: str, *dims: tuple[str, str]) -> Callable[[], DataFrame]:
        """Facts with a flag for each dimension key that exists."""

        def run() -> DataFrame:
            x = t[fact]
            for dim, key in dims:
                x = x.join(t[dim].select(key, F.lit(True).alias(f"has_{dim}")).dropDuplicates([key]), key, "left")
            return x

        return run

    def grain(rule: str, fact: str, *key: str) -> Check:
        return [(rule, "HIGH")], lambda: t[fact].groupBy(*key).agg(F.count("*").alias("c")).agg(F.count_if(c("c") > 1).alias(rule))

    def differ(rule: str, severity: str, a: str, b: str, eligible: str = "true", distinct: str | None = None) -> Check:
        def run() -> DataFrame:
            left = t[a].where(eligible).agg(F.count("*").alias("l"))
            right = t[b].agg((F.count_distinct(distinct) if distinct else F.count("*")).alias("r"))
            return left.crossJoin(right).select(F.abs(c("l") - c("r")).alias(rule))

        return [(rule, severity)], run

    lost = lambda dim: c(f"has_{dim}").isNull()
    ratio = reduce(lambda a, b: a | b, [F.coalesce((c(f"{x}_ratio") < 0) | (c(f"{x}_ratio") > 1), F.lit(False)) for x in ("availability", "busy", "broken")])
    approved = "moderation_status = 'approved' AND moderated_at IS NOT NULL"
    return [
        in_one_pass(with_dims("observation", ("station", "station_key"), ("source", "source_key"), ("date", "date_key")), [
            ("WH-RI-OBS-STATION", "CRITICAL", lost("station")), ("WH-RI-OBS-SOURCE", "CRITICAL", lost("source")), ("WH-RI-OBS-DATE", "CRITICAL", lost("date")),
            ("WH-NULL-AVAIL", "HIGH", c("available_connectors").isNotNull() & ((c("total_connectors") == 0) | (c("available_connectors") > c("total_connectors")))),
            ("WH-NULL-PROV", "INFO", c("source_payload_hash").isNull()),
            ("WH-TS-FUTURE", "HIGH", c("observed_at") > as_of + F.expr("INTERVAL 1 HOUR")), ("WH-TS-CAUSAL", "CRITICAL", c("received_at") < c("observed_at")),
        ]),
        in_one_pass(with_dims("report", ("station", "station_key")), [("WH-RI-REP-STATION", "CRITICAL", lost("station"))]),
        in_one_pass(with_dims("review", ("station", "station_key")), [("WH-RI-REV-STATION", "CRITICAL", lost("station"))]),
        in_one_pass(with_dims("daily", ("station", "station_key")), [
            ("WH-RI-DAILY-STATION", "CRITICAL", lost("station")), ("WH-AGG-STATUS", "HIGH", c("available_count") + c("busy_count") + c("broken_count") > c("observation_count")),
            ("WH-AGG-EVIDENCE", "HIGH", (c("observation_count") == 0) & (c("report_count") == 0) & (c("review_count") == 0)),
            ("WH-AGG-RATIO", "HIGH", ratio), ("WH-AGG-FLAG", "HIGH", ~F.coalesce(c("has_evidence"), F.lit(False))),
        ]),
        in_one_pass(lambda: t["connector"], [("WH-NULL-POWER", "HIGH", c("power_kw") <= 0)]),
        grain("WH-DUP-OBS", "observation", "observation_id"), grain("WH-DUP-REP", "report", "report_id"), grain("WH-DUP-REV", "review", "review_id"), grain("WH-DUP-DAILY", "daily", "station_key", "date_key"),
        differ("WH-REC-OBS", "CRITICAL", "oltp_observation", "observation"), differ("WH-REC-REP", "CRITICAL", "oltp_report", "report", approved), differ("WH-REC-REV", "CRITICAL", "oltp_review", "review", approved),
        differ("WH-REC-STATION", "HIGH", "oltp_station", "station", distinct="station_key"), differ("WH-REC-CONN", "HIGH", "oltp_connector", "connector"),
    ]


def run_checks(spark: SparkSession, checks: list[Check]) -> DataFrame:
    """One row per rule: rule, severity, offending, passed; informing rules never fail.

    All passes run as one job.  Where that fails, in planning or at run time, each pass runs alone, and a pass of
    several rules that fails rule by rule, so that only the rules that can't run become warnings.
    """
    schema = "rule string, severity string, offending long"

    def rows_of(some: list[Check]) -> list[tuple]:
        frames = []
        for rules, build in some:
            rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("severity"), F.col(f"`{r}`").cast("long").alias("offending")) for r, v in rules])
            frames.append(build().select(F.inline(rows)))
        return [tuple(x) for x in reduce(DataFrame.union, frames).collect()] if frames else []  # a row a rule

    def attempt(some: list[Check]) -> list[tuple]:
        try:
            return rows_of(some)
        except (PySparkException, Py4JJavaError):  # an error of analysis, or of a cast or an overflow at run time
            if len(some) > 1:
                return [x for one in some for x in attempt([one])]
            rules, build = some[0]
            if len(rules) > 1:
                return [x for r in rules for x in attempt([([r], build)])]
            return [(rules[0][0], "WARNING", None)]

    out = spark.createDataFrame(attempt(checks), schema)
    return out.withColumn("passed", F.when(F.col("severity") == "INFO", True).when(F.col("severity") == "WARNING", False).otherwise(F.col("offending") == 0))
