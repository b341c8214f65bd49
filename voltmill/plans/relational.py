"""Joins, windows, aggregates, set operations and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltmill.operators import geo, metrics, relational, warehouse
from voltmill.sources.driver_tables import Star

from .core import query
from .star_sql import CTES

_SHIP = "SELECT l.l_shipdate AS at, o.o_custkey AS station_id FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey"


def shipments(s: Star) -> DataFrame:
    o = s.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("station_id"))
    return s.lineitem.select("l_orderkey", F.col("l_shipdate").alias("at")).join(o, "l_orderkey").drop("l_orderkey")


@query("join_04_anti_join_orphans", "SELECT count(*) AS orphans FROM dim_connector c LEFT JOIN fact_observation o ON o.connector_key = c.connector_key WHERE o.connector_key IS NULL")
def _(s: Star) -> DataFrame:
    seen = s.fact_observation.where("connector_key IS NOT NULL").select("connector_key").distinct()
    return s.dim_connector.join(seen, "connector_key", "left_anti").agg(F.count("*").alias("orphans"))


@query("join_05_point_in_time", f"SELECT v.version_key, count(*) AS events FROM ({_SHIP}) e LEFT JOIN station_version v ON v.station_id = e.station_id AND v.effective_from <= e.at AND (v.effective_to IS NULL OR v.effective_to > e.at) GROUP BY 1")
def _(s: Star) -> DataFrame:
    return relational.valid_at(shipments(s), s.station_version, "station_id", "at").groupBy("version_key").agg(F.count("*").alias("events"))


@query("join_05_asof_window", "SELECT v.o_orderkey AS version_key, count(*) AS events FROM (" + _SHIP + ") e ASOF LEFT JOIN (SELECT o_custkey AS station_id, o_orderdate AS since, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) v ON v.station_id = e.station_id AND v.since <= e.at GROUP BY 1")
def _(s: Star) -> DataFrame:
    versions = s.orders.select(F.col("o_custkey").alias("station_id"), F.col("o_orderdate").alias("since"), F.col("o_orderkey").alias("version_key"))
    return relational.asof_last(shipments(s), versions, "station_id", "at", "version_key", "since").groupBy("version_key").agg(F.count("*").alias("events"))


@query("join_10_count_reconciliation", "SELECT (SELECT count(*) FROM events) AS source_rows, (SELECT count(*) FROM fact_observation) AS fact_rows, (SELECT count(*) FROM user_report WHERE moderation_status = 'approved' AND moderated_at IS NOT NULL) AS eligible_reports, (SELECT count(*) FROM fact_report) AS report_rows")
def _(s: Star) -> DataFrame:
    n = lambda df, c: df.agg(F.count("*").alias(c))
    ok = (F.col("moderation_status") == "approved") & F.col("moderated_at").isNotNull()
    return relational.one_row(n(s.events, "source_rows"), n(s.fact_observation, "fact_rows"), n(s.user_report.where(ok), "eligible_reports"), n(s.fact_report, "report_rows"))


@query("join_11_semi_join", "SELECT c_mktsegment, count(*) AS buyers FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') GROUP BY 1")
def _(s: Star) -> DataFrame:
    return s.customer.join(s.orders.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("buyers"))


@query("join_12_composite_ownership", "SELECT o.observation_id FROM fact_observation o WHERE o.connector_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dim_connector c WHERE c.station_key = o.station_key AND c.connector_key = o.connector_key)")
def _(s: Star) -> DataFrame:
    return s.fact_observation.where("connector_key IS NOT NULL").join(s.dim_connector.select("station_key", "connector_key"), ["station_key", "connector_key"], "left_anti").select("observation_id")


@query("win_02_latest_per_station", "SELECT DISTINCT ON (station_key) station_key, observation_id, availability_status FROM fact_observation ORDER BY station_key, (connector_key IS NULL) DESC, observed_at DESC, received_at DESC, observation_id DESC")
def _(s: Star) -> DataFrame:
    return relational.latest_values(s.fact_observation, ["station_key"], [F.col("connector_key").isNull(), F.col("observed_at"), F.col("received_at"), F.col("observation_id")], ["observation_id", "availability_status"])


_FLAG = "CASE WHEN availability_status = 'broken' THEN 'out of order' ELSE 'in order' END"


@query("win_05_state_changes_after_stable_runs", f"""WITH x AS (SELECT station_key, observed_at, observation_id, {_FLAG} AS st, lag({_FLAG}) OVER w AS p, row_number() OVER w AS n FROM fact_observation WINDOW w AS (PARTITION BY station_key ORDER BY observed_at, observation_id)),
r AS (SELECT *, sum(CASE WHEN n > 1 AND st IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY station_key ORDER BY observed_at, observation_id) AS run FROM x),
l AS (SELECT station_key, run, count(*) AS len, any_value(st) AS st, min(n) AS first_n FROM r GROUP BY 1, 2)
SELECT b.station_key, b.first_n - 1 AS idx, a.st AS from_state, b.st AS to_state, a.len AS stable_run FROM l a JOIN l b ON a.station_key = b.station_key AND b.run = a.run + 1 WHERE a.len >= 10""")
def _(s: Star) -> DataFrame:
    flag = F.when(F.col("availability_status") == "broken", "out of order").otherwise("in order")
    x = s.fact_observation.select("station_key", "observed_at", "observation_id", flag.alias("st"))
    return relational.state_changes(x, ["station_key"], [F.col("observed_at"), F.col("observation_id")], "st")


@query("win_06_agg_18_gap_profile", """WITH d AS (SELECT DISTINCT station_key, CAST(observed_at AS DATE) AS day FROM fact_observation), g AS (SELECT station_key, day, day - lag(day) OVER (PARTITION BY station_key ORDER BY day) AS gap FROM d)
SELECT station_key, count(*) AS days, CAST(max(gap) AS INT) AS max_gap, CAST(median(gap) AS DOUBLE) AS median_gap, CASE WHEN max(gap) IS NULL THEN 'single' WHEN max(gap) <= 1 THEN 'daily' WHEN median(gap) <= 2 THEN 'regular' ELSE 'irregular' END AS regularity FROM g GROUP BY 1""")
def _(s: Star) -> DataFrame:
    d = s.fact_observation.select("station_key", F.to_date("observed_at").alias("day")).distinct()
    g = d.withColumn("gap", F.datediff("day", F.lag("day").over(W.partitionBy("station_key").orderBy("day"))))
    regular = F.when(F.max("gap").isNull(), "single").when(F.max("gap") <= 1, "daily").when(F.median("gap") <= 2, "regular").otherwise("irregular")
    return g.groupBy("station_key").agg(F.count("*").alias("days"), F.max("gap").alias("max_gap"), F.median("gap").alias("median_gap"), regular.alias("regularity"))


@query("win_07_trailing_week", """SELECT observation_id, count(*) OVER (PARTITION BY station_key ORDER BY observed_at RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS obs_count_7d, last_value(availability_status) OVER (PARTITION BY station_key ORDER BY observed_at, observation_id) AS recent_availability FROM fact_observation""")
def _(s: Star) -> DataFrame:
    t = F.unix_micros(F.col("observed_at").cast("timestamp"))
    week = W.partitionBy("station_key").orderBy(t).rangeBetween(-7 * 86400 * 1_000_000, 0)
    last = W.partitionBy("station_key").orderBy("observed_at", "observation_id")
    return s.fact_observation.select("observation_id", F.count("*").over(week).alias("obs_count_7d"), F.last("availability_status").over(last).alias("recent_availability"))


@query("win_08_trailing_90_days", "SELECT station_key, count(DISTINCT date_key) AS days FROM fact_observation WHERE observed_at > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 90 DAY AND observed_at <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def _(s: Star) -> DataFrame:
    t = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return s.fact_observation.where((F.col("observed_at") > t - F.expr("INTERVAL 90 DAYS")) & (F.col("observed_at") <= t)).groupBy("station_key").agg(F.count_distinct("date_key").alias("days"))


@query("win_09_seasonal_naive", "SELECT station_key, date_key, observation_count, lag(observation_count, 7) OVER (PARTITION BY station_key ORDER BY date_key) AS week_ago FROM fact_daily", **CTES)
def _(s: Star) -> DataFrame:
    d = warehouse.daily_evidence(s.fact_observation, s.fact_report, s.fact_review)
    return d.select("station_key", "date_key", "observation_count", F.lag("observation_count", 7).over(W.partitionBy("station_key").orderBy("date_key")).alias("week_ago"))


@query("win_10_last_known", "SELECT station_key, arg_max(value, (observed_at, observation_id)) AS last_value FROM fact_observation GROUP BY 1")
def _(s: Star) -> DataFrame:
    return s.fact_observation.groupBy("station_key").agg(F.max_by("value", F.struct("observed_at", "observation_id")).alias("last_value"))


def _split_sql(cuts: list[tuple[float, str]], last: str) -> str:
    arms = " ".join(f"WHEN i < floor(n * {c}) THEN '{name}'" for c, name in cuts)
    return f"SELECT split, count(*) AS n, min(observation_id) AS first_id, max(observation_id) AS last_id FROM (SELECT observation_id, CASE {arms} ELSE '{last}' END AS split FROM (SELECT observation_id, row_number() OVER (ORDER BY observed_at, observation_id) - 1 AS i, count(*) OVER () AS n FROM fact_observation)) GROUP BY 1"


for _name, _shares, _names in (("win_12_split_60_20_20", (0.6, 0.2, 0.2), ("train", "valid", "test")), ("win_12_split_70_15_15", (0.7, 0.15, 0.15), ("train", "valid", "test")), ("win_12_split_80_20", (0.8, 0.2), ("train", "test"))):
    _cuts = [(round(sum(_shares[: i + 1]), 6), n) for i, n in enumerate(_names[:-1])]

    @query(_name, _split_sql(_cuts, _names[-1]))
    def _(s: Star, shares=_shares, names=_names) -> DataFrame:
        x = relational.chronological_split(s.fact_observation.select("observed_at", "observation_id"), [F.col("observed_at"), F.col("observation_id")], shares, names)
        return x.groupBy("split").agg(F.count("*").alias("n"), F.min("observation_id").alias("first_id"), F.max("observation_id").alias("last_id"))


@query("win_13_first_occurrence", "SELECT station_key, date_key, min(observation_id) AS observation_id FROM fact_observation GROUP BY 1, 2")
def _(s: Star) -> DataFrame:
    return s.fact_observation.groupBy("station_key", "date_key").agg(F.min("observation_id").alias("observation_id"))


@query("agg_05_array_agg_distinct", "SELECT station_key, string_agg(DISTINCT connector_type, ',' ORDER BY connector_type) AS types FROM dim_connector GROUP BY 1")
def _(s: Star) -> DataFrame:
    return s.dim_connector.groupBy("station_key").agg(F.array_join(F.array_sort(F.collect_set("connector_type")), ",").alias("types"))


@query("agg_03_filter_and_having", "SELECT station_key, count(*) FILTER (WHERE availability_status = 'busy') AS busy, count(*) AS n FROM fact_observation WHERE NOT is_simulated GROUP BY 1 HAVING count(*) FILTER (WHERE availability_status = 'busy') > 15")
def _(s: Star) -> DataFrame:
    return s.fact_observation.where("NOT is_simulated").groupBy("station_key").agg(F.count_if(F.col("availability_status") == "busy").alias("busy"), F.count("*").alias("n")).where("busy > 15")


@query("agg_12_offline_daily", """SELECT station_key, date_key, count(*) AS total_observations, round_even(100.0 * count(*) FILTER (WHERE availability_status = 'busy') / count(*)::DOUBLE, 2) AS utilization_pct, round_even(100.0 * (count(*) - count(*) FILTER (WHERE availability_status = 'broken')) / count(*)::DOUBLE, 2) AS uptime_pct FROM fact_observation GROUP BY 1, 2""")
def _(s: Star) -> DataFrame:
    n, hit = F.count("*"), lambda v: F.count_if(F.col("availability_status") == v)
    return s.fact_observation.groupBy("station_key", "date_key").agg(n.alias("total_observations"), F.bround(100.0 * hit("busy") / n, 2).alias("utilization_pct"), F.bround(100.0 * (n - hit("broken")) / n, 2).alias("uptime_pct"))


@query("agg_13_demand_score", "SELECT station_key, round((1 - avg(available_connectors) / 4) * 100, 6) AS demand_score FROM fact_observation GROUP BY 1")
def _(s: Star) -> DataFrame:
    return s.fact_observation.groupBy("station_key").agg(F.round((1 - F.avg("available_connectors") / 4) * 100, 6).alias("demand_score"))


@query("agg_15_group_median_with_fallback", """WITH m AS (SELECT hour(observed_at) AS h, isodow(observed_at) AS d, median(value) AS med FROM fact_observation WHERE availability_status = 'busy' AND source_key = 0 GROUP BY 1, 2)
SELECT CAST(h.range AS INT) AS h, CAST(d.range AS INT) AS d, round(coalesce(m.med, (SELECT median(value) FROM fact_observation WHERE availability_status = 'busy' AND source_key = 0)), 6) AS prediction FROM range(24) h CROSS JOIN range(1, 8) d LEFT JOIN m ON m.h = h.range AND m.d = d.range""")
def _(s: Star) -> DataFrame:
    x = s.fact_observation.where("availability_status = 'busy' AND source_key = 0")
    per = x.groupBy(F.hour("observed_at").alias("h"), (F.weekday("observed_at") + 1).alias("d")).agg(F.median("value").alias("med"))
    grid = s.spark.range(24 * 7).select(F.expr("id div 7").cast("int").alias("h"), (F.col("id") % 7 + 1).cast("int").alias("d"))
    every = x.agg(F.median("value").alias("all"))
    return grid.join(F.broadcast(per), ["h", "d"], "left").crossJoin(F.broadcast(every)).select("h", "d", F.round(F.coalesce("med", "all"), 6).alias("prediction"))


@query("agg_14_hour_mean", "SELECT hour(observed_at) AS h, round(avg(available_connectors), 9) AS mean_available FROM fact_observation GROUP BY 1")
def _(s: Star) -> DataFrame:
    return s.fact_observation.groupBy(F.hour("observed_at").cast("long").alias("h")).agg(F.round(F.avg("available_connectors"), 9).alias("mean_available"))


@query("agg_16_majority_label", "SELECT station_key, arg_max(availability_status, (n, -f)) AS label FROM (SELECT station_key, availability_status, count(*) AS n, min(observation_id) AS f FROM fact_observation GROUP BY 1, 2) GROUP BY 1")
def _(s: Star) -> DataFrame:
    c = s.fact_observation.groupBy("station_key", "availability_status").agg(F.count("*").alias("n"), F.min("observation_id").alias("f"))
    return c.groupBy("station_key").agg(F.max_by("availability_status", F.struct("n", -F.col("f"))).alias("label"))


@query("agg_17_median_and_population_std", "SELECT station_key, round(median(value), 6) AS med, round(stddev_pop(value), 6) AS sd FROM fact_observation GROUP BY 1")
def _(s: Star) -> DataFrame:
    return s.fact_observation.groupBy("station_key").agg(F.round(F.median("value"), 6).alias("med"), F.round(F.stddev_pop("value"), 6).alias("sd"))


@query("agg_20_power_brackets", "SELECT CASE WHEN power_kw IS NULL THEN 'unknown' WHEN power_kw <= 22 THEN '<=22' WHEN power_kw <= 50 THEN '<=50' WHEN power_kw <= 100 THEN '<=100' ELSE '>100' END AS bracket, count(*) AS n FROM dim_connector GROUP BY 1")
def _(s: Star) -> DataFrame:
    p = F.col("power_kw")
    b = F.when(p.isNull(), "unknown").when(p <= 22, "<=22").when(p <= 50, "<=50").when(p <= 100, "<=100").otherwise(">100")
    return s.dim_connector.groupBy(b.alias("bracket")).agg(F.count("*").alias("n"))


@query("agg_21_grid_occupancy", """SELECT CAST(r.range AS INT) AS cell_row, CAST(c.range AS INT) AS cell_col, count(s.station_key) AS points FROM range(8) r CROSS JOIN range(6) c
LEFT JOIN dim_station s ON s.latitude BETWEEN 18.7 AND 19.5 AND s.longitude BETWEEN 72.7 AND 73.3 AND least(floor((s.latitude - 18.7::DOUBLE) / 0.1::DOUBLE), 7) = r.range AND least(floor((s.longitude - 72.7::DOUBLE) / 0.1::DOUBLE), 5) = c.range GROUP BY 1, 2""")
def _(s: Star) -> DataFrame:
    return geo.grid_occupancy(s.dim_station, (18.7, 19.5, 72.7, 73.3), 0.1)


@query("agg_22_max_of_sums", "SELECT station_key, connector_type, p, CAST(max(q) AS BIGINT) AS quantity FROM (SELECT station_key, connector_type, round_even(coalesce(power_kw, 0), 0) AS p, connector_key % 3 AS source, sum(coalesce(quantity, 1)) AS q FROM dim_connector GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3")
def _(s: Star) -> DataFrame:
    per = s.dim_connector.groupBy("station_key", "connector_type", F.bround(F.coalesce("power_kw", F.lit(0.0)), 0).alias("p"), (F.col("connector_key") % 3).alias("source")).agg(F.sum(F.coalesce("quantity", F.lit(1))).alias("q"))
    return per.groupBy("station_key", "connector_type", "p").agg(F.max("q").alias("quantity"))


@query("agg_24_classification_metrics", """WITH x AS (SELECT availability_status AS y, CASE queue_level WHEN 'none' THEN 'available' WHEN 'long' THEN 'busy' WHEN 'medium' THEN 'broken' ELSE 'unknown' END AS p FROM fact_observation),
l AS (SELECT y AS label FROM x UNION SELECT p FROM x), t AS (SELECT label, (SELECT count(*) FROM x WHERE y = label AND p = label) AS tp, (SELECT count(*) FROM x WHERE y <> label AND p = label) AS fp, (SELECT count(*) FROM x WHERE y = label AND p <> label) AS fn FROM l)
SELECT label, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM t""")
def _(s: Star) -> DataFrame:
    q = F.col("queue_level")
    p = F.when(q == "none", "available").when(q == "long", "busy").when(q == "medium", "broken").otherwise("unknown")
    return metrics.per_label(s.fact_observation.select(F.col("availability_status").alias("y"), p.alias("p")), "y", "p")


_XP = "(SELECT availability_status AS y, CASE queue_level WHEN 'none' THEN 'available' WHEN 'long' THEN 'busy' WHEN 'medium' THEN 'broken' ELSE 'unknown' END AS p FROM fact_observation)"


@query("agg_24_accuracy_and_macro_f1", f"""WITH x AS {_XP}, l AS (SELECT y AS label FROM x UNION SELECT p FROM x),
t AS (SELECT label, (SELECT count(*) FROM x WHERE y = label AND p = label) AS tp, (SELECT count(*) FROM x WHERE y = label) AS actual, (SELECT count(*) FROM x WHERE p = label) AS said FROM l)
SELECT round((SELECT avg(CAST(y = p AS INT)) FROM x), 9) AS accuracy, round(avg(CASE WHEN actual + said > 0 THEN 2.0::DOUBLE * tp / (actual + said) ELSE 0 END), 6) AS macro_f1 FROM t""")
def _(s: Star) -> DataFrame:
    q = F.col("queue_level")
    p = F.when(q == "none", "available").when(q == "long", "busy").when(q == "medium", "broken").otherwise("unknown")
    m = metrics.classification(s.fact_observation.select(F.col("availability_status").alias("y"), p.alias("p")), "y", "p")
    return m.select(F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query("agg_24_regression_metrics", """SELECT round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(median(abs(y - p)), 6) AS median_ae, CASE WHEN bool_or(y = 0) THEN NULL ELSE round(avg(abs((y - p) / y)) * 100, 6) END AS mape FROM (SELECT value AS y, CAST(total_connectors * 10 AS DOUBLE) AS p FROM fact_observation)""")
def _(s: Star) -> DataFrame:
    x = s.fact_observation.select(F.col("value").alias("y"), (F.col("total_connectors") * 10.0).alias("p"))
    m = metrics.regression(x, "y", "p")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("agg_24_mase", """WITH d AS (SELECT date_key, count(*)::DOUBLE AS y FROM fact_observation GROUP BY 1), l AS (SELECT *, lag(y, 7) OVER (ORDER BY date_key) AS naive FROM d), s AS (SELECT avg(abs(y - naive)) AS scale FROM l WHERE date_key <= 20240121), t AS (SELECT avg(abs(y - naive)) AS err FROM l WHERE date_key > 20240121) SELECT round(err / nullif(scale, 0), 6) AS mase FROM s, t""")
def _(s: Star) -> DataFrame:
    d = s.fact_observation.groupBy("date_key").agg(F.count("*").cast("double").alias("y"))
    return metrics.mase(d, "date_key", "y", 7, F.col("date_key") <= 20240121).select(F.round("mase", 6).alias("mase"))


@query("agg_25_duplicate_grains", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(s: Star) -> DataFrame:
    return s.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("set_01_distinct", "SELECT DISTINCT connector_type, pricing_type FROM dim_connector")
def _(s: Star) -> DataFrame:
    return s.dim_connector.select("connector_type", "pricing_type").distinct()


@query("set_02_union_of_fact_keys", "SELECT station_key, date_key FROM fact_observation UNION SELECT station_key, date_key FROM fact_report UNION SELECT station_key, date_key FROM fact_review")
def _(s: Star) -> DataFrame:
    k = lambda df: df.select("station_key", "date_key")
    return k(s.fact_observation).unionByName(k(s.fact_report)).unionByName(k(s.fact_review)).distinct()


@query("set_03_set_algebra", "SELECT station_key, list_aggregate(list_sort(list_intersect(t, ['CCS2', 'Type 2', 'GB/T'])), 'string_agg', ',') AS shared, len(list_distinct(list_concat(t, ['CCS2', 'Type 2', 'GB/T']))) AS all_types, list_has_all(['CCS2', 'CHAdeMO', 'Type 2', 'GB/T', 'Other'], t) AS inside, list_has_any(t, ['CCS1']) AS meets FROM (SELECT station_key, list(DISTINCT connector_type) AS t FROM dim_connector GROUP BY 1)")
def _(s: Star) -> DataFrame:
    t = s.dim_connector.groupBy("station_key").agg(F.collect_set("connector_type").alias("t"))
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    shared = F.array_sort(F.array_intersect("t", a("CCS2", "Type 2", "GB/T")))
    return t.select(
        "station_key", F.when(F.size(shared) > 0, F.array_join(shared, ",")).alias("shared"), F.size(F.array_union("t", a("CCS2", "Type 2", "GB/T"))).cast("long").alias("all_types"),
        (F.size(F.array_except("t", a("CCS2", "CHAdeMO", "Type 2", "GB/T", "Other"))) == 0).alias("inside"), F.arrays_overlap("t", a("CCS1")).alias("meets"),
    )


@query("snk_01_append_absent_twice", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH'")
def _(s: Star) -> DataFrame:
    keys = ["o_orderkey"]
    target = s.orders.where("o_orderstatus = 'F'").select("o_orderkey")
    new = s.orders.where("o_orderpriority = '2-HIGH'").select("o_orderkey")
    once = relational.append_absent(target, new.union(new), keys)
    return relational.append_absent(once, new, keys)


@query("snk_02_upsert", "SELECT station_key, date_key, observation_count, CASE WHEN date_key = 20240105 THEN 'ready' ELSE maturity END AS maturity FROM fact_daily", **CTES)
def _(s: Star) -> DataFrame:
    d = warehouse.daily_evidence(s.fact_observation, s.fact_report, s.fact_review).select("station_key", "date_key", "observation_count", "maturity")
    again = warehouse.daily_evidence(s.fact_observation, s.fact_report, s.fact_review, 20240105).select("station_key", "date_key", "observation_count", F.lit("ready").alias("maturity"))
    return relational.upsert(relational.upsert(d, again, ["station_key", "date_key"]), again, ["station_key", "date_key"])


@query("scd_01_versions_after_sync", """SELECT station_id, version, is_current, closed FROM (
  SELECT s_suppkey AS station_id, 1 AS version, NOT (s_acctbal < 0 OR s_nationkey = 3) AS is_current, s_acctbal < 0 OR s_nationkey = 3 AS closed FROM supplier
  UNION ALL SELECT s_suppkey, 2, true, false FROM supplier WHERE s_acctbal < 0 OR s_nationkey = 3
  UNION ALL SELECT s_suppkey + 1000000, 1, true, false FROM supplier WHERE s_nationkey = 5)""")
def _(s: Star) -> DataFrame:
    first, now = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")
    base = s.supplier.select(F.col("s_suppkey").alias("station_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("operator"))
    current = base.select("*", F.lit(1).alias("version"), first.alias("effective_from"), F.lit(None).cast("timestamp").alias("effective_to"), F.lit(True).alias("is_current"))
    moved = base.select("station_id", F.when(F.col("balance") < 0, F.concat("name", F.lit(" B"))).otherwise(F.col("name")).alias("name"), (F.col("balance") + 1e-6).alias("balance"), F.when(F.col("operator") == 3, 99).otherwise(F.col("operator")).alias("operator"))
    new = base.where("operator = 5").withColumn("station_id", F.col("station_id") + 1000000)
    incoming = moved.unionByName(new)
    tracked = ["name", "balance", "operator"]
    once = warehouse.scd2_sync(current, incoming, "station_id", tracked, now)
    twice = warehouse.scd2_sync(once, incoming, "station_id", tracked, now)
    return twice.select("station_id", "version", "is_current", F.col("effective_to").isNotNull().alias("closed"))


@query("scd_02_type1_latest_wins", "SELECT o_custkey AS k, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY 1")
def _(s: Star) -> DataFrame:
    new = relational.latest_values(s.orders.withColumnRenamed("o_custkey", "k"), ["k"], ["o_orderdate", "o_orderkey"], ["o_totalprice"]).withColumnRenamed("o_totalprice", "v")
    old = s.customer.select(F.col("c_custkey").alias("k"), F.lit(0.0).alias("v")).join(new.select("k"), "k", "left_semi")
    return relational.upsert(old, new, ["k"])


_LOAD = f"FROM (SELECT e.*, row_number() OVER () AS rid FROM ({_SHIP}) e) e LEFT JOIN station_version v ON v.station_id = e.station_id AND v.effective_from <= e.at AND (v.effective_to IS NULL OR v.effective_to > e.at)"


@query("scd_03_fact_load_and_rejects", f"SELECT CASE WHEN v.version_key IS NULL THEN 'no version at event time' ELSE 'loaded' END AS outcome, count(*) AS n {_LOAD} GROUP BY 1")
def _(s: Star) -> DataFrame:
    dates = warehouse.calendar(s.spark, "1990-01-01", "2010-12-31")
    loaded, rejected = warehouse.load_facts(shipments(s), s.station_version, dates, "station_id", "at")
    return loaded.select(F.lit("loaded").alias("outcome")).unionByName(rejected.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query("scd_04_observation_load_current_key", """SELECT o.observation_id, o.station_key, least(greatest(o.available_connectors * 2, 0), o.total_connectors) AS available_connectors, epoch_us(greatest(o.observed_at, o.received_at)) AS received_us FROM (SELECT DISTINCT ON (station_key, observed_at, source_payload_hash) * FROM fact_observation ORDER BY station_key, observed_at, source_payload_hash, observation_id) o JOIN dim_station s USING (station_key) WHERE s.is_current""")
def _(s: Star) -> DataFrame:
    current = s.dim_station.where("is_current").select("station_key")
    once = relational.latest_by(s.fact_observation, ["station_key", "observed_at", "source_payload_hash"], [F.col("observation_id").asc()])
    available = F.least(F.greatest(F.col("available_connectors") * 2, F.lit(0)), F.col("total_connectors"))
    return once.join(current, "station_key", "left_semi").select("observation_id", "station_key", available.alias("available_connectors"), F.unix_micros(F.greatest("observed_at", "received_at").cast("timestamp")).alias("received_us"))


@query("scd_06_first_seen_keys", "SELECT o_orderpriority AS value, row_number() OVER (ORDER BY min(o_orderkey)) AS key FROM orders GROUP BY 1")
def _(s: Star) -> DataFrame:
    return relational.first_seen_keys(s.orders.withColumnRenamed("o_orderpriority", "value"), "value", F.col("o_orderkey"), "key").withColumn("key", F.col("key").cast("long"))


@query("scd_07_demo_daily_ratio", "SELECT station_key, date_key, round_even(count(*) FILTER (WHERE availability_status = 'busy') / count(*)::DOUBLE, 4) AS busy_ratio, 'ready' AS maturity FROM fact_observation GROUP BY 1, 2")
def _(s: Star) -> DataFrame:
    return s.fact_observation.groupBy("station_key", "date_key").agg(F.bround(F.count_if(F.col("availability_status") == "busy") / F.count("*"), 4).alias("busy_ratio"), F.lit("ready").alias("maturity"))


@query("flt_12_pagination", "SELECT station_id, (SELECT count(*) FROM dim_station) AS total, (SELECT count(*) FROM dim_station) > 40 AS has_more FROM dim_station ORDER BY station_id LIMIT 20 OFFSET 20")
def _(s: Star) -> DataFrame:
    total = s.dim_station.agg(F.count("*").alias("total"))
    page = s.dim_station.select("station_id").orderBy("station_id").offset(20).limit(20)
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > 40)


@query("flt_06_bounding_box", "SELECT station_id FROM dim_station WHERE latitude BETWEEN 18.9 AND 19.2 AND longitude BETWEEN 72.8 AND 73.0")
def _(s: Star) -> DataFrame:
    return s.dim_station.where(F.col("latitude").between(18.9, 19.2) & F.col("longitude").between(72.8, 73.0)).select("station_id")


@query("flt_14_parameterised_query", "SELECT date_key, count(*) AS n FROM fact_observation WHERE station_key = 7 GROUP BY 1")
def _(s: Star) -> DataFrame:
    return s.spark.sql("SELECT date_key, count(*) AS n FROM {o} WHERE station_key = :station GROUP BY date_key", args={"station": 7}, o=s.fact_observation)


@query("snk_07_geojson", """SELECT station_id, concat('{"type":"Feature","geometry":{"type":"Point","coordinates":[', printf('%.3f', longitude), ',', printf('%.3f', latitude), ']},"properties":{"id":"', station_id, '"}}') AS feature FROM dim_station""")
def _(s: Star) -> DataFrame:
    return geojson(s.dim_station)


def geojson(stations: DataFrame) -> DataFrame:
    ok = stations.where(geo.valid_coordinate(F.col("latitude"), F.col("longitude")))
    d = lambda c: F.col(c).cast("decimal(9,3)")
    shape = F.struct(F.lit("Point").alias("type"), F.array(d("longitude"), d("latitude")).alias("coordinates"))
    return ok.select("station_id", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(F.col("station_id").alias("id")).alias("properties"))).alias("feature"))
