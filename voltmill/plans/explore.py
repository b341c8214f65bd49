"""Search filters, orders, recommenders, and geography."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltmill.operators import geo, search
from voltmill.operators.graph import connected_components
from voltmill.operators.search import Filters
from voltmill.sources.driver_tables import Star

from .core import query

HERE, MINUTE = (19.1, 72.85), 8 * 60 + 45


def listing(s: Star) -> DataFrame:
    plugs = s.listing_plug.groupBy("id").agg(F.collect_list(F.struct("type", "power_kw", "quantity")).alias("p"))
    j = s.listing.join(plugs, "id", "left")
    p = F.coalesce("p", F.array().cast(plugs.schema["p"].dataType))
    windows = F.when(F.col("busy_window").isNotNull(), F.array("busy_window")).otherwise(F.array().cast("array<string>"))
    return j.select(*s.listing.columns, F.transform(p, lambda x: x["type"]).alias("types"), F.transform(p, lambda x: x["power_kw"]).alias("powers"), F.transform(p, lambda x: x["quantity"]).alias("quantities"), windows.alias("busy_windows"))


_D = "CASE WHEN latitude IS NOT NULL THEN 2 * 6371 * asin(sqrt(least(1, pow(sin(radians(latitude - 19.1) / 2), 2) + cos(radians(19.1)) * cos(radians(latitude)) * pow(sin(radians(longitude - 72.85) / 2), 2)))) END"
L = {"lst": f"SELECT l.*, {_D} AS d, coalesce(p.kw, 0) AS kw, p.nkw, p.types, coalesce(p.n, 0) AS n, p.q, p.known FROM listing l LEFT JOIN (SELECT id, max(power_kw) AS kw, count(power_kw) AS nkw, list(type) AS types, count(*) AS n, sum(quantity) AS q, count(*) FILTER (WHERE type <> 'Unknown') AS known FROM listing_plug GROUP BY 1) p USING (id)"}
_OPEN = "(is_24_hours OR (opening = '08:00' AND 525 >= 480 AND 525 < 1260) OR (opening = '20:30' AND (525 >= 1230 OR 525 < 360)))"
_CASES = {
    "text": (Filters(query=" OPERATOR 3"), "(lower(name) LIKE '%operator 3%' OR lower(operator) LIKE '%operator 3%' OR lower(area) LIKE '%operator 3%' OR lower(address) LIKE '%operator 3%')"),
    "connectors": (Filters(connector_types=("CCS2", "GB/T")), "list_has_any(types, ['CCS2', 'GB/T'])"),
    "power_and_fast": (Filters(min_power_kw=30, fast=True), "kw >= 50"),
    "open_now": (Filters(open_now=True), f"coalesce({_OPEN}, false)"),
    "available_cheap": (Filters(available_only=True, max_price=15), "status = 'available' AND price_per_kwh <= 15"),
    "free": (Filters(free_only=True), "is_free"),
    "chargers": (Filters(min_chargers=3), "q >= 3"),
    "less_busy": (Filters(less_busy=True), "CASE WHEN busy_window IS NULL THEN status = 'available' ELSE busy_window <> '22:00-09:30' AND status NOT IN ('busy', 'broken') END"),
    "radius": (Filters(radius_km=8), "d <= 8"),
    "all": (Filters(query="station", connector_types=("CCS2", "Type 2"), min_power_kw=11, open_now=True, radius_km=40), f"list_has_any(types, ['CCS2', 'Type 2']) AND kw >= 11 AND coalesce({_OPEN}, false) AND d <= 40"),
}
for _name, (_f, _where) in _CASES.items():

    @query(f"flt_07_11_search_{_name}", f"SELECT id FROM lst WHERE {_where}", **L)
    def _(s: Star, f=_f) -> DataFrame:
        return search.search(listing(s), f, MINUTE, HERE).select("id")


_RANK = "CASE status WHEN 'available' THEN 0 WHEN 'busy' THEN 1 WHEN 'broken' THEN 2 ELSE 3 END"
for _name, _order in {"nearest": "coalesce(d, 1e300), id", "available": f"{_RANK}, id", "speed": "kw DESC, id", "price": "coalesce(price_per_kwh, 1e300), id", "default": f"{_RANK}, coalesce(rating, 0) DESC, id"}.items():

    @query(f"ord_03_{_name}", f"SELECT id, row_number() OVER (ORDER BY {_order}) AS place FROM lst ORDER BY place LIMIT 50", **L)
    def _(s: Star, kind=_name) -> DataFrame:
        order = search.order_by(kind, HERE)
        top = listing(s).orderBy(*order).limit(50)
        return top.select("id", F.row_number().over(W.orderBy(*order)).cast("long").alias("place"))


_ELIG = "(latitude IS NOT NULL AND NOT (latitude = 0 AND longitude = 0) AND status <> 'broken' AND (coalesce(known, 0) > 0 OR coalesce(nkw, 0) > 0 OR price_per_kwh IS NOT NULL OR is_free))"
SCORE = f"""SELECT *, {_ELIG} AS eligible, {_ELIG} AND status = 'available' AND coalesce(available, 0) > 0 AND NOT coalesce(minutes > 120, false) AS now_ok FROM lst"""
SCORE2 = """SELECT id, eligible, now_ok, d, CASE WHEN eligible THEN CASE WHEN coalesce(known, 0) > 0 THEN 2 ELSE 0 END + CASE WHEN coalesce(nkw, 0) > 0 THEN 2 ELSE 0 END + CASE WHEN price_per_kwh IS NOT NULL OR is_free THEN 1 ELSE 0 END + CASE WHEN now_ok THEN 2 ELSE 0 END + CASE WHEN d <= 5 THEN greatest(0, 2 - d / 5) ELSE 0 END ELSE 0 END AS score FROM sc"""


@query("ml_18_recommender_audit", "SELECT id, eligible, round(CAST(score AS DOUBLE), 6) AS score, CASE WHEN eligible THEN row_number() OVER (PARTITION BY eligible ORDER BY round(score, 9) DESC, round(d, 9) NULLS LAST, id) END AS rank FROM sc2", **L, sc=SCORE, sc2=SCORE2)
def _(s: Star) -> DataFrame:
    return search.recommend_scores(listing(s), HERE).select("id", "eligible", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_REASONS = """concat_ws(',', CASE WHEN list_has_any(types, ['CCS2']) THEN 'matchConnector' END, CASE WHEN nkw > 0 THEN 'knownPower' END, CASE WHEN price_per_kwh IS NOT NULL OR is_free THEN 'priceAvailable' END,
CASE WHEN d <= 5 THEN 'nearby' END, CASE WHEN now_ok THEN 'availableNow' WHEN status = 'unknown' THEN 'availabilityUnknown' END)"""
_PARTS = """CASE WHEN eligible AND coalesce(known, 0) > 0 THEN 2.0 ELSE 0.0 END AS connector_points, CASE WHEN eligible AND coalesce(nkw, 0) > 0 THEN 2.0 ELSE 0.0 END AS power_points, CASE WHEN eligible AND (price_per_kwh IS NOT NULL OR is_free) THEN 1.0 ELSE 0.0 END AS price_points,
CASE WHEN eligible AND now_ok THEN 2.0 ELSE 0.0 END AS availability_points, round(CASE WHEN eligible AND d <= 5 THEN greatest(0, 2 - d / 5) ELSE 0 END, 6)::DOUBLE AS proximity_points"""


@query("ml_18_contributions", f"""SELECT id, {_PARTS}, CASE WHEN eligible THEN NULL WHEN latitude IS NULL OR (latitude = 0 AND longitude = 0) THEN 'coordinates' WHEN status = 'broken' THEN 'broken' ELSE 'no evidence' END AS excluded FROM sc""", **L, sc=SCORE)
def _(s: Star) -> DataFrame:
    x = search.recommend_scores(listing(s), HERE)
    return x.select("id", "excluded", *[F.round(c, 6).alias(c) for c in search.CONTRIBUTIONS])


@query("ml_18_top_three", f"SELECT id, {_REASONS} AS reasons FROM sc JOIN (SELECT id, score FROM sc2) USING (id) WHERE eligible ORDER BY round(score, 9) DESC, round(d, 9) NULLS LAST, id LIMIT 3", **L, sc=SCORE, sc2=SCORE2)
def _(s: Star) -> DataFrame:
    return search.top_recommendations(search.recommend_scores(listing(s), HERE), 5, ("CCS2",)).select("id", F.array_join("reasons", ",").alias("reasons"))


@query("ml_18_reasons_of_all", f"SELECT id, {_REASONS} AS reasons FROM sc WHERE eligible", **L, sc=SCORE)
def _(s: Star) -> DataFrame:
    x = search.recommend_scores(listing(s), HERE).where("eligible")
    return x.select("id", F.array_join(search.reasons(("CCS2",)), ",").alias("reasons"))


@query("ml_17_additive_recommender", "SELECT id, round(CAST(CASE WHEN d IS NULL THEN 0 ELSE greatest(0, 10 - d) END + CASE WHEN n = 0 THEN 0 WHEN list_contains(types, 'CCS2') THEN 5 ELSE -5 END + CASE WHEN nkw > 0 AND kw >= 50 THEN 3 WHEN nkw > 0 THEN -3 ELSE 0 END AS DOUBLE), 6) AS score FROM lst WHERE d IS NULL OR d <= 30", **L)
def _(s: Star) -> DataFrame:
    return search.additive_scores(listing(s), HERE, "CCS2", True, 30.0).select("id", F.round("score", 6).alias("score"))


POINTS = "SELECT s_suppkey AS id, CAST(18.9 AS DOUBLE) + CAST((s_suppkey * 7919) % 997 AS DOUBLE) / 3000 AS latitude, CAST(72.8 AS DOUBLE) + CAST((s_suppkey * 104729) % 991 AS DOUBLE) / 3000 AS longitude FROM supplier"
PD = "2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))))"


def points(s: Star) -> DataFrame:
    y, x = ((F.col("s_suppkey") * k % m).cast("double") / 3000 for k, m in ((7919, 997), (104729, 991)))
    return s.supplier.select(F.col("s_suppkey").alias("id"), (18.9 + y).alias("latitude"), (72.8 + x).alias("longitude"))


_AT_SITE = "(SELECT id, latitude, longitude FROM site)"

for _r in (15, 40, 50, 1000, 2000, 5000):
    # Short radii over sites, which lie a few metres apart, the others over scattered points.
    _sites = _r <= 1000
    _from = f"{_AT_SITE} a JOIN {_AT_SITE} b" if _sites else "pts a JOIN pts b"

    @query(f"join_06_pairs_within_{_r}_m", f"SELECT a.id AS id_a, b.id AS id_b, round({PD}, 3) AS distance FROM {_from} ON a.id < b.id WHERE {PD} <= {_r}", pts=POINTS)
    def _(s: Star, r=_r, sites=_sites) -> DataFrame:
        p = s.site.select("id", "latitude", "longitude") if sites else points(s)
        return geo.pairs_within(p, p, float(r)).where("id_a < id_b").select("id_a", "id_b", F.round("distance", 3).alias("distance"))


NEAREST = f"SELECT id, arg_min(o, (dd, o)) AS neighbour, min(dd) AS distance FROM (SELECT a.id, b.id AS o, {PD} AS dd FROM pts a JOIN pts b ON a.id <> b.id) GROUP BY 1"


@query("join_07_nearest_neighbour", "SELECT id, neighbour, round(distance, 3) AS distance FROM nn", pts=POINTS, nn=NEAREST)
def _(s: Star) -> DataFrame:
    return geo.nearest_other(points(s)).select(F.col("id_a").alias("id"), "neighbour", F.round("distance", 3).alias("distance"))


@query("ml_05_coverage_gaps", "SELECT id, round(distance / 1000, 6) AS gap_km FROM nn WHERE distance >= 3500", pts=POINTS, nn=NEAREST)
def _(s: Star) -> DataFrame:
    return geo.nearest_other(points(s)).where("distance >= 3500").select(F.col("id_a").alias("id"), F.round(F.col("distance") / 1000, 6).alias("gap_km"))


@query("ord_04_most_isolated", "SELECT id, round(distance, 3) AS distance FROM nn ORDER BY round(distance, 3) DESC, id LIMIT 25", pts=POINTS, nn=NEAREST)
def _(s: Star) -> DataFrame:
    return geo.nearest_other(points(s)).orderBy(F.round("distance", 3).desc(), "id_a").limit(25).select(F.col("id_a").alias("id"), F.round("distance", 3).alias("distance"))


EPS = 3500
DB = {
    "pts": POINTS,
    "near": f"SELECT a.id, b.id AS o FROM pts a JOIN pts b ON {PD} <= {EPS}",
    "core": "SELECT id FROM near GROUP BY 1 HAVING count(*) >= 3",
    "edge": "SELECT n.id, n.o FROM near n JOIN core a ON a.id = n.id JOIN core b ON b.id = n.o",
    "lab": "SELECT id, min(o) AS cluster FROM reach GROUP BY 1",
}
_DB_SQL = "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in list(DB.items())[:4]) + ", reach(id, o) AS (SELECT id, id FROM core UNION SELECT r.id, e.o FROM reach r JOIN edge e ON e.id = r.o), lab AS (" + DB["lab"] + """), bor AS (SELECT n.id, min(l.cluster) AS c FROM near n JOIN lab l ON l.id = n.o GROUP BY 1)
SELECT p.id, coalesce(l.cluster, b.c, -1) AS cluster, l.id IS NOT NULL AS is_core FROM pts p LEFT JOIN lab l ON l.id = p.id LEFT JOIN bor b ON b.id = p.id"""


@query("ml_04_dbscan", _DB_SQL)
def _(s: Star) -> DataFrame:
    return geo.dbscan(points(s), float(EPS), 3, connected_components)


@query("ml_04_dbscan_profile", _DB_SQL.replace("SELECT p.id, coalesce(l.cluster, b.c, -1) AS cluster, l.id IS NOT NULL AS is_core FROM pts p", "SELECT coalesce(l.cluster, b.c) AS cluster, count(*) AS size, min(p.latitude) AS lat_min, max(p.latitude) AS lat_max, min(p.longitude) AS lon_min, max(p.longitude) AS lon_max, round(avg(p.latitude), 9) AS lat_c, round(avg(p.longitude), 9) AS lon_c FROM pts p") + " WHERE coalesce(l.cluster, b.c) IS NOT NULL GROUP BY 1")
def _(s: Star) -> DataFrame:
    p = points(s)
    c = geo.cluster_profile(p, geo.dbscan(p, float(EPS), 3, connected_components))
    return c.select("cluster", "size", "lat_min", "lat_max", "lon_min", "lon_max", F.round("lat_c", 9).alias("lat_c"), F.round("lon_c", 9).alias("lon_c"))


@query("flt_10_valid_coordinates", "SELECT id, latitude IS NOT NULL AND longitude IS NOT NULL AND latitude BETWEEN -90 AND 90 AND NOT (latitude = 0 AND longitude = 0) AS valid FROM listing")
def _(s: Star) -> DataFrame:
    return s.listing.select("id", geo.valid_coordinate(F.col("latitude"), F.col("longitude")).alias("valid"))


@query("win_11_rank_with_ineligible_null", "SELECT id, CASE WHEN d IS NOT NULL THEN row_number() OVER (ORDER BY d NULLS LAST, id) END AS rank FROM lst", **L)
def _(s: Star) -> DataFrame:
    return geo.rank_nearest(s.listing, *HERE, "id").select("id", F.col("rank").cast("long").alias("rank"))
