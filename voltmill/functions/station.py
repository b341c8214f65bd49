"""Derived attributes of a station as search and display use them; unknown is never zero, free or unavailable."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .freshness import bucket

_DOWN = ("temporarily_unavailable", "decommissioned", "out_of_service")


def status(availability: Column, operational: Column, minutes: Column, stale_after: float = 120) -> Column:
    """available, busy, broken or unknown: old evidence counts only where the operator says that the place is down."""
    a, o = F.lower(F.trim(availability)), F.lower(F.trim(F.coalesce(operational, F.lit(""))))
    down = F.when(o.isin(*_DOWN), "broken").otherwise("unknown")
    live = F.when(a == "available", "available").when(a.isin("busy", "in_use", "occupied"), "busy").when(a.isin("broken", "out_of_service", "offline", "faulted"), "broken").otherwise("unknown")
    return F.when(minutes > stale_after, down).when(F.coalesce(availability, F.lit("")) != "", live).otherwise(down)


def source_category(simulated: Column, observed: Column, freshness: Column, source: Column) -> Column:
    live = F.coalesce(F.lower(source).rlike("cpo|ocpi|oicp|live|verified"), F.lit(False))
    return F.when(F.coalesce(simulated, F.lit(False)), "simulated").when(~observed, "unknown").when(freshness == "stale", "historical").when(live, "verified_live").otherwise("recent_observation")


def address(*parts: Column) -> Column:
    """Parts joined by commas, each once whatever its case."""
    clean = F.filter(F.transform(F.array(*parts), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    seen = lambda i: F.slice(F.transform(clean, lambda y: F.lower(y)), F.lit(1), i)
    once = F.filter(clean, lambda x, i: ~F.array_contains(seen(i), F.lower(x)))
    return F.when(F.size(once) > 0, F.array_join(once, ", ")).otherwise("Address unavailable")


def area(*parts: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(p), F.lit("")) for p in parts], F.lit("Area unknown"))


def clamp_available(available: Column, total: Column) -> Column:
    """Between 0 and the known total; null where nothing was observed."""
    low = F.greatest(available, F.lit(0))
    return F.when(available.isNull(), None).when(total > 0, F.least(low, total)).otherwise(low)


def price_state(is_free: Column, per_kwh: Column, has_estimate: Column) -> Column:
    finite = per_kwh.isNotNull() & ~F.isnan(per_kwh)
    return F.when(F.coalesce(is_free, F.lit(False)) | (finite & (per_kwh == 0)), "free").when(finite, "verified").when(F.coalesce(has_estimate, F.lit(False)), "estimate").otherwise("unavailable")


def connector_price_state(per_kwh: Column, estimate: Column, per_session: Column) -> Column:
    return F.when(per_kwh.isNotNull(), "verified").when(estimate.isNotNull(), "estimate").when(per_session.isNotNull(), "verified").otherwise("unavailable")


def total_of(quantities: Column) -> Column:
    """Sum of known numbers: 0 for no connectors at all, null where all are unknown."""
    known = F.filter(quantities, lambda q: q.isNotNull())
    total = F.aggregate(known, F.lit(0).cast("long"), lambda a, q: a + q)
    return F.when(F.size(quantities) == 0, F.lit(0).cast("long")).when(F.size(known) > 0, total)


def minute_of_day(clock: Column) -> Column:
    return F.split(clock, ":")[0].try_cast("int") * 60 + F.split(clock, ":")[1].try_cast("int")


def within(now: Column, start: Column, end: Column) -> Column:
    """Half-open span of minutes of a day; one that doesn't end after it starts runs over midnight."""
    return F.coalesce(F.when(end <= start, (now >= start) | (now < end)).otherwise((now >= start) & (now < end)), F.lit(False))


def open_now(all_day: Column, opening: Column, closing: Column, now: Column) -> Column:
    """Unknown hours count as not open."""
    return F.coalesce(all_day, F.lit(False)) | within(now, minute_of_day(opening), minute_of_day(closing))


def in_busy_window(windows: Column, now: Column) -> Column:
    """Whether one of the texts "HH:MM-HH:MM" holds the minute; unreadable ones are passed over."""
    side = lambda w, k: minute_of_day(F.trim(F.get(F.split(w, "-"), F.lit(k))))
    return F.coalesce(F.exists(windows, lambda w: within(now, side(w, 0), side(w, 1))), F.lit(False))


def availability_rank(status_: Column) -> Column:
    return F.when(status_ == "available", 0).when(status_ == "busy", 1).when(status_ == "broken", 2).otherwise(3)


def charging_minutes(usable_kwh: Column, max_ac: Column, max_dc: Column, connector: Column, charger_kw: Column, start: int = 20, target: int = 80) -> Column:
    """Minutes from one state of charge to another with the weaker of vehicle and charger, at 90 per cent efficiency."""
    dc = connector.startswith("CCS") | (connector == "CHAdeMO")
    power = F.least(charger_kw, F.coalesce(F.when(dc, max_dc).otherwise(max_ac), charger_kw))
    energy = usable_kwh * (max(0, target - start) / 100)
    return F.when(charger_kw > 0, F.floor(energy / (power * 0.9) * 60 + 0.5).cast("int"))


def freshness_bucket(minutes: Column) -> Column:
    return bucket(minutes)


#: Fixed value: the form of a station's id.
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def by_id(stations: DataFrame, id_col: str, wanted: str, form: str = UUID) -> DataFrame:
    """The station of an id; an id that hasn't the form finds nothing and is never put to the source."""
    if not re.fullmatch(form, wanted or ""):
        return stations.limit(0)
    return stations.where(F.col(id_col) == F.lit(wanted))


def distance_label(km: Column) -> Column:
    """Metres below one kilometre, one decimal below ten (none where it is 0), whole kilometres from there on."""
    whole = lambda x: F.floor(x + 0.5).cast("long").cast("string")
    short = F.regexp_replace(F.format_string("%.1f", km), r"\.0$", "")
    return F.when(km < 1, F.concat(whole(km * 1000), F.lit(" m"))).when(km < 10, F.concat(short, F.lit(" km"))).when(km.isNotNull(), F.concat(whole(km), F.lit(" km")))


def predict_input_error(hour: Column, weekday: Column, weekend: Column, month: Column, connectors: Column, cutoff: Column) -> Column:
    """Why a request for a prediction is refused, or null: time features out of range or missing, a negative count, a cut-off that is no time."""
    inside = lambda c, lo, hi: F.coalesce(c.between(lo, hi), F.lit(False))
    times = inside(hour, 0, 23) & inside(weekday, 0, 6) & F.coalesce(weekend.isin(0, 1), F.lit(False)) & inside(month, 1, 12)
    number = F.coalesce(connectors >= 0, F.lit(True)) & ~F.coalesce(F.isnan(connectors), F.lit(False))
    bad_time = (F.length(F.coalesce(cutoff, F.lit(""))) > 0) & cutoff.try_cast("timestamp").isNull()
    return F.when(~times | ~number, "FEATURE_SCHEMA_MISMATCH").when(bad_time, "STALE_FEATURES")


def predict_result_error(success: Column, probability: Column, version: Column) -> Column:
    """MODEL_ARTIFACT_INVALID unless a prediction succeeded with a probability of 0 to 1 and names its model."""
    sound = F.coalesce(success, F.lit(False)) & F.coalesce(probability.between(0.0, 1.0) & ~F.isnan(probability), F.lit(False)) & (F.length(F.coalesce(version, F.lit(""))) > 0)
    return F.when(~sound, "MODEL_ARTIFACT_INVALID")
