"""Station search: filters, orders and two additive recommenders, as composed columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltmill.functions import station

from . import geo
from .relational import numbered


@dataclass(frozen=True)
class Filters:
    """What a search asks for; the defaults ask for nothing."""

    query: str = ""
    connector_types: tuple[str, ...] = ()
    min_power_kw: float = 0
    open_now: bool = False
    available_only: bool = False
    fast: bool = False
    free_only: bool = False
    max_price: float = 0
    min_chargers: int = 0
    less_busy: bool = False
    radius_km: float = 0


def search(stations: DataFrame, f: Filters, minute: int, here: tuple[float, float] | None = None) -> DataFrame:
    """Rows that meet every filter; a missing value meets none.

    stations has name, operator, area, address, status, is_free, price_per_kwh, types and powers (arrays),
    quantities (array), is_24_hours, opening, closing, busy_windows (array), latitude, longitude.
    """
    tests: list[Column] = []
    q = f.query.strip().lower()
    if q:
        text = [F.lower(F.coalesce(c, F.lit(""))).contains(q) for c in ("name", "operator", "area", "address")]
        tests.append(text[0] | text[1] | text[2] | text[3])
    power = F.coalesce(F.array_max("powers"), F.lit(0.0))
    if f.connector_types:
        tests.append(F.arrays_overlap("types", F.array(*[F.lit(t) for t in f.connector_types])))
    if f.min_power_kw > 0:
        tests.append(power >= f.min_power_kw)
    now = F.lit(minute)
    if f.open_now:
        tests.append(station.open_now(F.col("is_24_hours"), F.col("opening"), F.col("closing"), now))
    if f.available_only:
        tests.append(F.col("status") == "available")
    if f.fast:
        tests.append(power >= 50)
    if f.free_only:
        tests.append(F.col("is_free"))
    if f.max_price > 0:
        tests.append(F.col("price_per_kwh") <= f.max_price)
    if f.min_chargers > 0:
        tests.append(station.total_of(F.col("quantities")) >= f.min_chargers)
    if f.less_busy:
        known = F.size(F.coalesce("busy_windows", F.array().cast("array<string>"))) > 0
        calm = ~station.in_busy_window(F.col("busy_windows"), now) & ~F.col("status").isin("busy", "broken")
        tests.append(F.when(known, calm).otherwise(F.col("status") == "available"))
    if f.radius_km > 0 and here:
        tests.append(geo.haversine(here[0], here[1], "latitude", "longitude", geo.RADIUS_KM, float("inf")) <= f.radius_km)
    out = stations
    for t in tests:
        out = out.where(F.coalesce(t, F.lit(False)))
    return out


def order_by(kind: str, here: tuple[float, float] | None = None) -> list[Column]:
    """Sort columns of a search, with the id last so that the order is total."""
    rank = station.availability_rank(F.col("status"))
    price = F.coalesce("price_per_kwh", F.lit(float("inf")))
    power = F.coalesce(F.array_max("powers"), F.lit(0.0))
    by = {
        "available": [rank], "speed": [power.desc()], "price": [price.asc()],
        "nearest": [geo.haversine(here[0], here[1], "latitude", "longitude", geo.RADIUS_KM, float("inf")).asc()] if here else [],
    }.get(kind) or [rank, F.coalesce("rating", F.lit(0.0)).desc()]
    return [*by, F.col("id").asc()]


#: Columns of what each criterion adds to a score.
CONTRIBUTIONS = ("connector_points", "power_points", "price_points", "availability_points", "proximity_points")


def recommend_scores(stations: DataFrame, here: tuple[float, float] | None) -> DataFrame:
    """Eligibility, contributions, their sum, rank and reason of exclusion of every station.

    Two points each for a known connector type and a known power, one for a verified price, two for
    availability that is fresh and counted, and 2 - d/5 within 5 km.
    """
    known_type = F.exists("types", lambda t: t != "Unknown")
    known_power = F.size(F.filter("powers", lambda p: p.isNotNull())) > 0
    priced = F.col("price_per_kwh").isNotNull() | F.coalesce("is_free", F.lit(False))
    valid, broken = geo.valid_coordinate(F.col("latitude"), F.col("longitude")), F.coalesce(F.col("status") == "broken", F.lit(False))
    eligible = valid & ~broken & (known_type | known_power | priced)
    excluded = F.when(~valid, "coordinates").when(broken, "broken").when(~eligible, "no evidence")
    fresh = ~F.coalesce(F.col("minutes") > 120, F.lit(False))
    here_now = eligible & (F.col("status") == "available") & (F.coalesce("available", F.lit(0)) > 0) & fresh
    d = geo.haversine(here[0], here[1], "latitude", "longitude", geo.RADIUS_KM) if here else F.lit(None).cast("double")
    b = lambda e, w: F.when(eligible & e, F.lit(w)).otherwise(F.lit(0.0))
    near = F.when(eligible & (d <= 5), F.greatest(F.lit(0.0), 2 - d / 5)).otherwise(0.0)
    x = stations.withColumns({"eligible": eligible, "excluded": excluded, "distance_km": d, "available_now": here_now})
    x = x.withColumns(dict(zip(CONTRIBUTIONS, (b(known_type, 2.0), b(known_power, 2.0), b(priced, 1.0), b(here_now, 2.0), near), strict=True)))
    x = x.withColumn("score", sum((F.col(c) for c in CONTRIBUTIONS[1:]), F.col(CONTRIBUTIONS[0])))
    ranked = numbered(x, [F.col("eligible").desc(), F.round("score", 9).desc(), F.round("distance_km", 9).asc_nulls_last(), F.col("id")], "rank")
    return ranked.withColumn("rank", F.when(F.col("eligible"), F.col("rank") + 1))


def reasons(wanted: tuple[str, ...] = ()) -> Column:
    """What a scored station's data say for it, in order."""
    want = F.arrays_overlap("types", F.array(*[F.lit(t) for t in wanted])) if wanted else F.lit(False)
    return F.array_compact(F.array(
        F.when(want, "matchConnector"), F.when(F.size(F.filter("powers", lambda p: p.isNotNull())) > 0, "knownPower"),
        F.when(F.col("price_per_kwh").isNotNull() | F.coalesce("is_free", F.lit(False)), "priceAvailable"), F.when(F.col("distance_km") <= 5, "nearby"),
        F.when(F.col("available_now"), "availableNow").when(F.col("status") == "unknown", "availabilityUnknown"),
    ))


def top_recommendations(scored: DataFrame, count: int, wanted: tuple[str, ...] = ()) -> DataFrame:
    """The best one to three with the reasons that their data give."""
    top = scored.where("eligible").orderBy(F.round("score", 9).desc(), F.round("distance_km", 9).asc_nulls_last(), "id").limit(min(3, max(1, count)))
    return top.withColumn("reasons", reasons(wanted))


def additive_scores(stations: DataFrame, here: tuple[float, float] | None, connector: str | None, fast_only: bool, max_km: float | None) -> DataFrame:
    """The server-side score: 10 - d above 0, 5 for a wanted connector and -5 for known others, 3 for 50 kW and -3 below it if fast is asked for."""
    d = geo.haversine(here[0], here[1], "latitude", "longitude", geo.RADIUS_KM) if here else F.lit(None).cast("double")
    near = F.when(d.isNotNull(), F.greatest(F.lit(0.0), 10 - d)).otherwise(0.0)
    has, none = F.array_contains("types", connector or ""), F.size("types") == 0
    plug = F.when(F.lit(connector is None) | none, 0.0).when(has, 5.0).otherwise(-5.0) if connector else F.lit(0.0)
    kw = F.array_max("powers")
    speed = F.when(kw >= 50, 3.0).when(kw.isNotNull() & F.lit(fast_only), -3.0).otherwise(0.0)
    out = stations.withColumn("distance_km", d).withColumn("score", near + plug + speed)
    return out.where(F.col("distance_km").isNull() | (F.col("distance_km") <= max_km)) if max_km is not None else out
