"""Geography without a spatial extension: great-circle distance, grid joins, neighbours, density clusters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed
from .relational import numbered

#: Earth radii of the distance variants.
RADIUS_M, RADIUS_KM, RADIUS_KM_EXACT = 6371000.0, 6371.0, 6371.0088


def haversine(lat1, lon1, lat2, lon2, radius: float = RADIUS_M, missing: float | None = None) -> Column:
    """Great-circle distance; missing is the result where a coordinate is null or NaN (null by default)."""
    a, b, c, d = (x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(c - a) / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(F.radians(d - b) / 2), 2)
    known = h.isNotNull() & ~F.isnan(h)
    h = F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))
    return F.when(known, 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h)) * radius).otherwise(F.lit(missing).cast("double"))


def valid_coordinate(lat: Column, lon: Column) -> Column:
    """In range, a number, and not exactly 0, 0; null counts as invalid."""
    ok = lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon) & ~((lat == 0) & (lon == 0))
    return F.coalesce(ok, F.lit(False))


def nearby(stations: DataFrame, lat: float, lon: float, radius_m: float, most: int) -> DataFrame:
    """Rows within a radius (200 km at most) by distance, at most 100; a box filter comes first and reaches the scan."""
    if not (-90 <= lat <= 90 and -180 <= lon <= 180 and radius_m > 0):
        return stations.withColumn("distance_meters", F.lit(None).cast("long")).limit(0)
    radius_m = min(radius_m, 200_000.0)
    dlat = math.degrees(radius_m / RADIUS_M) * 1.0001
    box = F.col("latitude").between(lat - dlat, lat + dlat)
    dlon = _lon_reach(radius_m, abs(lat) + dlat)
    if dlon < 180:  # a box over the 180th meridian has a part on its other side
        x = F.col("longitude")
        box &= x.between(lon - dlon, lon + dlon) | (x >= lon - dlon + 360) | (x <= lon + dlon - 360)
    d = stations.where(box).withColumn("d", haversine("latitude", "longitude", lat, lon)).where(F.col("d") <= radius_m)
    return d.withColumn("distance_meters", F.round("d").cast("long")).drop("d").orderBy("distance_meters", "station_id").limit(min(max(most, 1), 100))


def _lon_reach(radius_m: float, max_lat: float) -> float:
    """The most degrees of longitude between two points within a radius whose |latitude| is at most max_lat."""
    half = math.sin(min(math.pi / 2, radius_m / (2 * RADIUS_M)))
    if max_lat >= 90 or half >= math.cos(math.radians(max_lat)):
        return 180.0
    return math.degrees(2 * math.asin(half / math.cos(math.radians(max_lat)))) * 1.0001


def _cells(band: Column, dlat: float, radius_m: float) -> Column:
    """Number of equal cells around a latitude band: each as wide as the radius reaches from that band, one near a pole."""
    edge = F.radians(F.least(F.lit(90.0), F.greatest(F.abs((band - 1) * dlat), F.abs((band + 2) * dlat))))
    sine = F.lit(math.sin(min(math.pi / 2, radius_m / (2 * RADIUS_M)))) / F.greatest(F.cos(edge), F.lit(1e-12))
    reach = F.degrees(2 * F.asin(F.least(F.lit(1.0), sine))) * 1.0001
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) / reach))


def pairs_within(left: DataFrame, right: DataFrame, radius_m: float, id_col: str = "id", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Pairs (id_a, id_b, distance) within a radius: an equi-join on grid cells, then the exact distance.

    Latitude bands are as high as the radius; each band's circle is cut into as many cells as its latitude allows,
    so cells wrap at the 180th meridian and one cell lies around a pole.  Only the right side goes to its neighbouring
    cells in three bands; a pair meets in exactly one cell, so nothing has to be made distinct.
    """
    dlat = math.degrees(radius_m / RADIUS_M) * 1.001
    known = F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.where(known).select(F.col(id_col).alias(f"id_{s}"), F.col(lat).alias(f"lat_{s}"), F.col(lon).alias(f"lon_{s}"), F.floor(F.col(lat) / dlat).alias("cy"), F.pmod(F.col(lon) + 180, F.lit(360.0)).alias("turn"))

    at = F.floor(F.col("turn") * F.col("n") / 360)  # turn < 360, so at < n but for rounding, which pmod mends
    a = side(left, "a").withColumn("n", _cells(F.col("cy"), dlat, radius_m)).withColumn("cx", F.pmod(at, F.col("n"))).drop("n", "turn")
    b = side(right, "b").withColumn("cy", F.explode(F.array(*[F.col("cy") + i for i in (-1, 0, 1)]))).withColumn("n", _cells(F.col("cy"), dlat, radius_m))
    around = F.array_distinct(F.array(*[F.pmod(at + i, F.col("n")) for i in (-1, 0, 1)]))
    b = b.withColumn("cx", F.explode(around)).drop("n", "turn")
    return a.join(b, ["cy", "cx"]).withColumn("distance", haversine("lat_a", "lon_a", "lat_b", "lon_b")).where(F.col("distance") <= radius_m).select("id_a", "id_b", "distance")


def nearest_other(points: DataFrame, id_col: str = "id", start_m: float = 1000.0) -> DataFrame:
    """Each point's nearest other point (ties: least id); a lone point, or one without coordinates, has null.

    Points are matched within a radius that grows fourfold for those that found none, so most points are
    compared with few others; a pass only carries the points that are still open.
    """
    none = [F.lit(None).cast(points.schema[id_col].dataType).alias("neighbour"), F.lit(None).cast("double").alias("distance")]
    done, left, radius = points.select(F.col(id_col).alias("id_a"), *none).limit(0), points, start_m
    while True:
        found = pairs_within(left, points, radius, id_col).where("id_a <> id_b")
        best = found.groupBy("id_a").agg(F.min(F.struct("distance", "id_b")).alias("m"))
        best = checkpointed(best.select("id_a", F.col("m.id_b").alias("neighbour"), F.col("m.distance").alias("distance")))
        done = done.unionByName(best)
        left = left.join(best.select(F.col("id_a").alias(id_col)), id_col, "left_anti")
        if radius > 2.1e7 or left.isEmpty():
            return done.unionByName(left.select(F.col(id_col).alias("id_a"), *none))
        radius *= 4


def grid_occupancy(points: DataFrame, box: tuple[float, float, float, float], cell: float, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Points of each cell of a box (lat_min, lat_max, lon_min, lon_max), empty cells with 0; border points go to the last cell."""
    lat0, lat1, lon0, lon1 = box
    rows, cols = math.ceil(round((lat1 - lat0) / cell, 9)), math.ceil(round((lon1 - lon0) / cell, 9))
    inside = points.where(F.col(lat).between(lat0, lat1) & F.col(lon).between(lon0, lon1))
    r = F.least(F.floor((F.col(lat) - lat0) / cell), F.lit(rows - 1)).cast("int")
    c = F.least(F.floor((F.col(lon) - lon0) / cell), F.lit(cols - 1)).cast("int")
    counts = inside.groupBy(r.alias("cell_row"), c.alias("cell_col")).agg(F.count("*").alias("n"))
    spine = points.sparkSession.range(rows * cols).select(F.expr(f"id div {cols}").cast("int").alias("cell_row"), (F.col("id") % cols).cast("int").alias("cell_col"))
    return spine.join(F.broadcast(counts), ["cell_row", "cell_col"], "left").select("cell_row", "cell_col", F.coalesce("n", F.lit(0)).cast("long").alias("points"))


def dbscan(points: DataFrame, eps_m: float, min_points: int, components, id_col: str = "id") -> DataFrame:
    """Density clusters (id, cluster, is_core): cluster is the least core id of the cluster, -1 for noise.

    Neighbours come from a grid join, core points from their counts (a point counts itself), clusters from
    components(links) over core neighbours; a border point joins its least neighbouring core cluster.
    """
    near = pairs_within(points, points, eps_m, id_col)
    core = near.groupBy("id_a").agg(F.count("*").alias("n")).where(F.col("n") >= min_points).select(F.col("id_a").alias("core"))
    links = near.join(core.withColumnRenamed("core", "id_a"), "id_a", "left_semi").join(core.withColumnRenamed("core", "id_b"), "id_b", "left_semi")
    labels = components(links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    of_core = core.join(labels, F.col("core") == F.col("node"), "left").select("core", F.coalesce("root", "core").alias("cluster"))
    border = near.join(of_core, F.col("id_b") == F.col("core")).groupBy("id_a").agg(F.min("cluster").alias("near_cluster"))
    out = points.select(F.col(id_col).alias("id")).join(of_core, F.col("id") == F.col("core"), "left").join(border, F.col("id") == F.col("id_a"), "left")
    return out.select("id", F.coalesce("cluster", "near_cluster", F.lit(-1)).cast("long").alias("cluster"), F.col("core").isNotNull().alias("is_core"))


def cluster_profile(points: DataFrame, clusters: DataFrame, id_col: str = "id", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Size, box, centroid and radius (largest distance to the centroid, m) of each cluster."""
    j = points.join(clusters.withColumnRenamed("id", id_col), id_col).where("cluster <> -1")
    box = j.groupBy("cluster").agg(F.count("*").alias("size"), F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"), F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max"), F.avg(lat).alias("lat_c"), F.avg(lon).alias("lon_c"))
    far = j.join(box, "cluster").groupBy("cluster").agg(F.max(haversine(lat, lon, "lat_c", "lon_c")).alias("radius_m"))
    return box.join(far, "cluster")


def rank_nearest(points: DataFrame, lat: float, lon: float, id_col: str) -> DataFrame:
    """Rank 1.. by distance and id; rows without coordinates have no rank."""
    ranked = numbered(points.withColumn("distance", haversine("latitude", "longitude", lat, lon)), [F.col("distance").asc_nulls_last(), F.col(id_col)], "rank")
    return ranked.withColumn("rank", F.when(F.col("distance").isNotNull(), F.col("rank") + 1))
