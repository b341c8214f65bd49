"""Coverage audit and maturity report as long tables (section, metric, value); a text report of them.

Every section is one aggregate over one input, or counts of one column, so sections run side by side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Power brackets in kW, and live telemetry's limits in seconds.
BRACKETS = ((22.0, "up to 22"), (50.0, "22 to 50"), (100.0, "50 to 100"), (None, "over 100"))
FRESH_S, AGING_S = 300.0, 900.0


def _stack(section: str, one: DataFrame) -> DataFrame:
    """The columns of a one-row table as metrics."""
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in one.columns])
    return one.select(F.lit(section).alias("section"), F.inline(rows))


def _by(section: str, prefix: str, df: DataFrame, of: Column) -> DataFrame:
    counts = df.groupBy(of.cast("string").alias("k")).agg(F.count("*").cast("double").alias("value"))
    return counts.select(F.lit(section).alias("section"), F.concat(F.lit(f"{prefix}:"), "k").alias("metric"), "value")


def _filled(c: str) -> Column:
    return F.coalesce(F.length(F.trim(F.col(c).cast("string"))) > 0, F.lit(False))


def freshness_state(age_s: Column) -> Column:
    """Of live telemetry: no time or one in the future is unknown; stale never means unavailable."""
    return F.when(age_s.isNull() | (age_s < -5), "UNKNOWN").when(age_s <= FRESH_S, "FRESH").when(age_s <= AGING_S, "AGING").otherwise("STALE")


def coverage_audit(stations: DataFrame, connectors: DataFrame, observations: DataFrame, links: DataFrame, sources: DataFrame, runs: DataFrame, box: tuple[float, float, float, float], cell: float, as_of_s: Column) -> DataFrame:
    """Geography, sources, entity resolution, connectors, pricing, status, observations, completeness, data quality, provenance, readiness and capabilities.

    stations has id, name, operator, address_line, locality, city, postal_code, latitude, longitude, opening_time,
    is_24_hours, operational_status; connectors id, connector_type, power_kw, quantity, price_per_kwh, pricing_type;
    observations id, availability_status, observed_s; links id, source_id, source_station_id, payload_hash; sources
    source_id, name; runs parsed, accepted, warned, quarantined, rejected.  id is the station's.
    """
    lat0, lat1, lon0, lon1 = box
    rows, cols = round((lat1 - lat0) / cell), round((lon1 - lon0) / cell)
    lat, lon = F.col("latitude"), F.col("longitude")
    known = lat.isNotNull() & lon.isNotNull()
    sound = known & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    inside = sound & lat.between(lat0, lat1) & lon.between(lon0, lon1)
    place = F.struct(F.least(F.floor((lat - lat0) / cell), F.lit(rows - 1)), F.least(F.floor((lon - lon0) / cell), F.lit(cols - 1)))
    n = F.count("*").alias
    ok = F.count_if
    geo = stations.agg(
        n("total"), ok(~known).alias("missing_coords"), ok(known & ~sound).alias("invalid_coords"), ok(inside).alias("in_pilot"), ok(sound & ~inside).alias("outside_pilot"),
        F.count_distinct(F.when(inside, place)).alias("occupied_cells"),
    ).withColumn("empty_cells", F.lit(rows * cols) - F.col("occupied_cells"))
    per = links.groupBy("id").agg(F.count_distinct("source_id").alias("sources"), F.min("source_id").alias("only"))
    er = per.agg(F.count_if(F.col("sources") == 1).alias("single_source_stations"), F.count_if(F.col("sources") > 1).alias("multi_source_stations"), F.count("*").alias("linked"))
    total = stations.agg(n("n"))
    src = links.agg(n("total_links")).crossJoin(sources.agg(n("registered_sources"))).crossJoin(runs.agg(n("ingestion_runs")))
    named = links.join(sources, "source_id", "left")
    power, priced = F.col("power_kw"), F.col("price_per_kwh").isNotNull() | F.col("pricing_type").isNotNull()
    free = priced & (F.coalesce(F.col("pricing_type") == "free", F.lit(False)) | F.coalesce(F.col("price_per_kwh") == 0, F.lit(False)))
    bracket = F.lit(BRACKETS[-1][1])
    for most, label in reversed(BRACKETS[:-1]):
        bracket = F.when(power <= most, F.lit(label)).otherwise(bracket)
    at = connectors.groupBy("id").agg(F.count("*").alias("c"), F.bool_or(priced).alias("priced"))
    some = at.agg(n("stations_with_connectors"), F.count_if("priced").alias("stations_with_pricing"))
    conn = connectors.agg(n("records"), F.count("power_kw").alias("power_present"), ok(power.isNull()).alias("power_missing"), F.count("quantity").alias("quantity_present"))
    conn = conn.crossJoin(some.select("stations_with_connectors")).crossJoin(total)
    conn = conn.withColumn("stations_no_connectors", F.col("n") - F.col("stations_with_connectors")).withColumn("avg_per_station", F.round(F.try_divide("records", "n"), 2)).drop("n")
    price = connectors.agg(ok(priced).alias("with_pricing"), ok(~priced).alias("missing_pricing"), ok(free).alias("explicit_free"), ok(priced & ~free).alias("explicit_paid"))
    price = price.crossJoin(some.select("stations_with_pricing")).crossJoin(total).withColumn("stations_missing_pricing", F.col("n") - F.col("stations_with_pricing")).drop("n")
    age = as_of_s - F.col("observed_s")
    seen = observations.groupBy("id").agg(F.count("*").alias("c"))
    obs = observations.agg(n("total"), F.round((F.max("observed_s") - F.min("observed_s")) / 3600, 2).alias("span_hours"), F.round(F.min(age) / 86400, 1).alias("freshest_age_days"), F.round(F.max(age) / 86400, 1).alias("oldest_age_days"))
    obs = obs.crossJoin(seen.agg(n("stations_with_obs"), F.count_if(F.col("c") > 1).alias("stations_with_repeated_obs"))).crossJoin(total)
    obs = obs.withColumn("stations_without_obs", F.col("n") - F.col("stations_with_obs")).drop("n")
    pct = lambda c: F.round(100.0 * F.try_divide(F.count_if(c), F.count("*")), 4)
    own = stations.agg(
        *[pct(_filled(c)).alias(c) for c in ("name", "address_line", "locality", "city", "postal_code", "operator", "operational_status")], pct(known).alias("coordinates"),
        pct(_filled("opening_time") | F.coalesce("is_24_hours", F.lit(False))).alias("opening_hours"),
    )
    share = lambda c: F.round(100.0 * F.try_divide(F.col(c), F.col("n")), 4)
    linked = total.crossJoin(er).crossJoin(some).crossJoin(seen.agg(n("observed"))).select(share("linked").alias("source_link"), share("stations_with_connectors").alias("connector_records"), share("stations_with_pricing").alias("pricing"), share("observed").alias("live_observation"))
    full = own.crossJoin(linked).crossJoin(connectors.agg(pct(power.isNotNull()).alias("power_kw")))
    dq = runs.agg(n("runs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("parsed", "accepted", "warned", "quarantined", "rejected")])
    hashed, named_id = _filled("payload_hash"), _filled("source_station_id")
    prov = links.agg(n("total_links"), ok(hashed).alias("with_payload_hash"), ok(named_id).alias("with_source_station_id"), ok(~hashed).alias("broken"))
    ml = obs.select(F.col("total").alias("observation_volume"), F.col("stations_with_obs").alias("stations_observed"), F.col("stations_with_repeated_obs").alias("repeated_observation_stations"), F.round(F.col("span_hours") / 24, 2).alias("span_days"))
    able = geo.select("in_pilot").crossJoin(conn.select("records", "power_present")).crossJoin(price.select("stations_with_pricing")).crossJoin(obs.select(F.col("total").alias("seen"), "stations_with_repeated_obs"))
    yes = lambda c: F.when(c, 1).otherwise(0)
    caps = able.select(
        yes(F.col("in_pilot") > 0).alias("map"), yes(F.col("records") > 0).alias("connector_filter"), yes(F.col("power_present") > 0).alias("power_filter"), yes(F.col("stations_with_pricing") > 0).alias("price_display"),
        yes(F.col("seen") > 0).alias("freshness"), yes(F.col("stations_with_repeated_obs") > 0).alias("prediction"),
    )
    word = lambda c, none: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(none))
    return reduce(DataFrame.unionByName, [
        _stack("geography", geo), _by("geography", "city", stations.where(sound), word("city", "Unknown")), _by("geography", "locality", stations.where(sound), word("locality", "Unspecified")),
        _stack("sources", src), _by("sources", "links", named, F.coalesce("name", "source_id")), _by("sources", "unique", per.where("sources = 1").select(F.col("only").alias("source_id")).join(sources, "source_id", "left"), F.coalesce("name", "source_id")),
        _stack("entity_resolution", er.crossJoin(total.withColumnRenamed("n", "canonical_stations"))), _stack("connectors", conn), _by("connectors", "type", connectors, word("connector_type", "Unknown")), _by("connectors", "power", connectors.where(power.isNotNull()), bracket),
        _stack("pricing", price), _by("status", "is", stations, word("operational_status", "unknown")), _stack("observations", obs), _by("observations", "availability", observations, word("availability_status", "unknown")), _by("observations", "freshness", observations, freshness_state(age)),
        _stack("completeness", full), _stack("data_quality", dq), _stack("provenance", prov), _stack("readiness", ml), _stack("capabilities", caps),
    ])


def maturity_report(stations: DataFrame, connectors: DataFrame, observations: DataFrame, reports: DataFrame, reviews: DataFrame, sources: DataFrame, runs: DataFrame, enough: int = 10) -> DataFrame:
    """Coverage of stations, connectors, prices, behaviour, missing values, sources, runs, targets and what they make possible."""
    from .learning import split_feasible

    n = F.count("*").alias
    real = observations.where("NOT is_simulated")
    per = real.groupBy("station_key").agg(F.count("*").alias("c"))
    cover = stations.where("NOT is_simulated").agg(n("total_current")).crossJoin(per.agg(n("with_ge_1_obs"), F.count_if(F.col("c") >= enough).alias(f"with_ge_{enough}_obs")))
    unknown = F.count_if(F.col("power_kw").isNull())
    kinds = connectors.groupBy("connector_type").agg(F.count("*").alias("groups"), F.coalesce(F.sum("quantity"), F.lit(0)).alias("units"), unknown.alias("unknown_power"))
    kinds = kinds.select(F.lit("connector_coverage").alias("section"), F.inline(F.array(*[F.struct(F.concat("connector_type", F.lit(f":{m}")).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("groups", "units", "unknown_power")])))
    price = connectors.agg(n("connectors"), F.count("price_per_kwh").alias("known_price"), F.count_if(F.col("price_per_kwh") == 0).alias("explicit_free"), F.count_if(F.col("price_per_kwh").isNull()).alias("unknown_price"))
    behaviour = reports.agg(n("reports")).crossJoin(reviews.agg(n("reviews")))
    pct = lambda c: F.round(100.0 * F.try_divide(F.count_if(c), F.count("*")), 2)
    missing = connectors.agg(pct(F.col("power_kw").isNull()).alias("power_kw"), pct(F.col("price_per_kwh").isNull()).alias("price_per_kwh")).crossJoin(observations.agg(pct(F.col("availability_status") == "unknown").alias("availability")))
    by = observations.groupBy("source_key").agg(F.count("*").alias("observations"), F.count_distinct("station_key").alias("stations"))
    each = sources.join(by, "source_key", "left").select(F.lit("source_coverage").alias("section"), F.inline(F.array(*[F.struct(F.concat("name", F.lit(f":{m}")).alias("metric"), F.coalesce(F.col(m), F.lit(0)).cast("double").alias("value")) for m in ("observations", "stations")])))
    work = runs.agg(n("ingestion_runs"), F.coalesce(F.sum("records_fetched"), F.lit(0)).alias("records_fetched"))
    label = lambda c: (F.count_if(F.col(c) != "unknown"), F.count_distinct(F.when(F.col(c) != "unknown", F.col("date_key"))))
    a, q = label("availability_status"), label("queue_level")
    targets = real.agg(a[0].alias("availability:events"), a[1].alias("availability:dates"), q[0].alias("queue:events"), q[1].alias("queue:dates"))
    can = lambda t: split_feasible(F.col(f"`{t}:events`"), F.col(f"`{t}:dates`")).cast("int")
    able = targets.select(
        can("availability").alias("availability forecasting"), can("queue").alias("queue prediction"), F.lit(0).alias("demand forecasting"),
        can("availability").alias("reliability analysis"), (F.col("`availability:dates`") > 0).cast("int").alias("anomaly detection"), F.lit(1).alias("descriptive analytics"),
    )
    parts = [_stack(s, df) for s, df in (("station_coverage", cover), ("price_profile", price), ("behaviour", behaviour), ("missingness_pct", missing), ("ingestion", work), ("targets", targets), ("capabilities", able))]
    return reduce(DataFrame.unionByName, [*parts, kinds, each])


def as_text(report: DataFrame) -> DataFrame:
    """One line of text a section, metrics in order of their name."""
    number = F.regexp_replace(F.format_string("%.4f", F.col("value")), r"\.?0+$", "")
    item = F.concat(F.col("metric"), F.lit("="), F.coalesce(number, F.lit("unknown")))
    return report.groupBy("section").agg(F.array_join(F.array_sort(F.collect_list(item)), "; ").alias("line"))
