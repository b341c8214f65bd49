"""Parsers of power, voltage, current, coordinates, postal codes, prices and opening hours.

Each gives a struct with a status: UNKNOWN for missing input, INVALID for what can't be, UNMAPPED for
what isn't understood, else NORMALIZED.  Missing never becomes zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*"
_NULL = lambda kind="double": F.lit(None).cast(kind)


def _quantity(raw: Column, units: str, scale: dict[str, float]) -> Column:
    """Positive number with an optional unit; scale gives factors by unit pattern."""
    clean = F.trim(raw)
    pattern = rf"(?i){_NUMBER}({units})\s*$"
    with_unit = clean.rlike(pattern)
    value = F.when(with_unit, F.regexp_extract(clean, pattern, 1).try_cast("double")).otherwise(clean.try_cast("double"))
    unit = F.lower(F.regexp_extract(clean, pattern, 2))
    factor = F.lit(1.0)
    for p, k in scale.items():
        factor = F.when(with_unit & unit.rlike(f"^({p})$"), F.lit(k)).otherwise(factor)
    missing = raw.isNull() | (clean == "")
    ok = value.isNotNull() & (value > 0) & ~F.isnan(value)
    status = F.when(missing, "UNKNOWN").when(ok, "NORMALIZED").otherwise("INVALID")
    return F.struct(F.when(ok & ~missing, value * factor).alias("value"), status.alias("status"))


def power_kw(raw: Column) -> Column:
    return _quantity(raw, "kw|w|watts?|mw|kilowatts?|megawatts?", {"w|watt|watts": 0.001, "mw|megawatt|megawatts": 1000.0})


def voltage_v(raw: Column) -> Column:
    return _quantity(raw, "v|kv|volts?|kilovolts?", {"kv|kilovolt|kilovolts": 1000.0})


def current_a(raw: Column) -> Column:
    return _quantity(raw, "a|ma|amps?|amperes?|milliamps?", {"ma|milliamp|milliamps": 0.001})


def current_type(raw: Column) -> Column:
    x = F.lower(F.trim(raw))
    ac = (x == "ac") | x.rlike("alternating current|ac \\((three|single)-phase\\)|(three|single) phase ac")
    dc = (x == "dc") | x.rlike("direct current|dc fast")
    return F.when(ac, "AC").when(dc, "DC").otherwise("UNKNOWN")


def postal_code(raw: Column, country: Column) -> Column:
    """Six-digit code for India, upper case without extra spaces elsewhere."""
    from .text import squeeze

    india = F.lower(country).isin("india", "in")
    pin = F.regexp_replace(F.trim(raw), r"[\s\-_.]+", "")
    ok = pin.rlike("^[1-9][0-9]{5}$")
    missing = raw.isNull() | (F.trim(raw) == "")
    value = F.when(missing, None).when(india & ok, pin).when(~india, F.upper(squeeze(raw)))
    return F.struct(value.alias("value"), F.when(missing, "UNKNOWN").when(india & ~ok, "INVALID").when(value == F.trim(raw), "UNCHANGED").otherwise("NORMALIZED").alias("status"))


def coordinates(lat: Column, lon: Column) -> Column:
    """WGS 84 degrees from texts; 0, 0 is no place."""
    a, b = lat.try_cast("double"), lon.try_cast("double")
    missing = lat.isNull() | lon.isNull()
    ok = a.between(-90, 90) & b.between(-180, 180) & ~((F.abs(a) < 1e-6) & (F.abs(b) < 1e-6)) & ~F.isnan(a) & ~F.isnan(b)
    ok = F.coalesce(ok, F.lit(False))
    status = F.when(missing, "UNKNOWN").when(ok, "NORMALIZED").otherwise("INVALID")
    return F.struct(F.when(ok, a).alias("lat"), F.when(ok, b).alias("lon"), status.alias("status"))


#: What makes a text no single price per unit of energy.
NO_ESTIMATE = (
    r"\b(free|no charge|complimentary|zero cost)\b",
    r"\b(parking|session|connection fee|per\s*(hour|hr|minute|min|day|month))\b|/\s*(hour|hr|minute|min|session)\b",
    r"\b(usd|eur|gbp|aed|cad|aud|jpy|cny)\b|[$€£¥]",
    r"\b(from|between)\s+[0-9]|[0-9]\s*(-|–|—|to)\s*(₹|rs\.?\s*|inr\s*)?[0-9]",
    r"-\s*(₹|rs\.?|inr)?\s*[0-9]",
)
ESTIMATE = r"((?:₹|rs\.?|inr)?\s*)([0-9]+(?:\.[0-9]{1,2})?)\s*(?:/\s*|per\s+)(?:kwh|unit)\b"


def price_estimate(raw: Column) -> Column:
    """The one price per kWh that a text states, at most 500; null where it says anything else with a number."""
    x = F.lower(F.trim(raw))
    bad = F.length(x) > 500
    for p in NO_ESTIMATE:
        bad = bad | x.rlike(p)
    one = F.regexp_count(x, F.lit(ESTIMATE)) == 1
    markers = F.regexp_count(x, F.lit(r"₹|\brs\.?|\binr\b")) <= 1
    residue = F.regexp_replace(x, ESTIMATE, "")
    rate = F.regexp_extract(x, ESTIMATE, 2).try_cast("double")
    ok = ~bad & one & markers & ~residue.rlike("[0-9]") & (rate > 0) & (rate <= 500)
    return F.when(ok, F.bround(rate, 2))


_RATE = r"([0-9]+(?:\.[0-9]+)?)\s*(?:₹|rs\.?|inr)?\s*(?:/|\bper\b)\s*"


def pricing(raw: Column, kind: Column, per_kwh: Column, per_session: Column) -> Column:
    """Struct of type, per_kwh, per_session, per_hour, basis and rule from a text and structured fields.

    In order: nothing known, free (only without any rate), structured rates, rates in the text, paid
    without a rate, unknown.
    """
    x = F.coalesce(F.lower(F.trim(raw)), F.lit(""))
    rate = lambda unit: F.regexp_extract(x, _RATE + unit, 1).try_cast("double")
    t_kwh, t_session, t_hour = rate("(?:kwh|unit)"), rate("(?:session|connection)"), rate("(?:hr|hour)")
    s_kwh, s_session = F.coalesce(per_kwh > 0, F.lit(False)), F.coalesce(per_session > 0, F.lit(False))
    known = (x != "") | F.coalesce(kind != "unknown", F.lit(False)) | per_kwh.isNotNull() | per_session.isNotNull()
    any_rate = t_kwh.isNotNull() | t_session.isNotNull() | t_hour.isNotNull() | s_kwh | s_session
    free = ~any_rate & (F.coalesce(kind == "free", F.lit(False)) | x.rlike(NO_ESTIMATE[0]))
    paid = x.rlike("pay|tariff|paid|commercial|rates apply|metered")

    def out(type_: str, rule: str, basis: str, k=None, s=None, h=None) -> Column:
        return F.struct(
            F.lit(type_).alias("type"), (k if k is not None else _NULL()).alias("per_kwh"), (s if s is not None else _NULL()).alias("per_session"),
            (h if h is not None else _NULL()).alias("per_hour"), F.lit(basis).alias("basis"), F.lit(rule).alias("rule"),
        )

    return (
        F.when(~known, out("unknown", "MISSING", "unknown"))
        .when(free, out("free", "EXPLICIT_FREE", "flat", F.lit(0.0)))
        .when(s_kwh, out("paid", "STRUCTURED_PER_KWH", "per_kwh", per_kwh, per_session))
        .when(s_session, out("paid", "STRUCTURED_PER_SESSION", "per_session", None, per_session))
        .when(t_kwh.isNotNull(), out("paid", "TEXT_PER_KWH", "per_kwh", t_kwh))
        .when(t_session.isNotNull(), out("paid", "TEXT_PER_SESSION", "per_session", None, t_session))
        .when(t_hour.isNotNull(), out("paid", "TEXT_PER_HOUR", "per_hour", None, None, t_hour))
        .when((x != "") & paid, out("paid", "TEXT_PAID_NO_RATE", "unknown"))
        .when(kind == "paid", out("paid", "PAID_NO_RATE", "unknown"))
        .otherwise(out("unknown", "FALLBACK", "unknown"))
    )


def clock(raw: Column) -> Column:
    """HH:MM of a time in 24- or 12-hour form, else null."""
    x = F.lower(F.trim(raw))
    p24, p12 = r"^([01]?[0-9]|2[0-3]):([0-5][0-9])$", r"^(0?[1-9]|1[0-2])(?::([0-5][0-9]))?\s*(am|pm)$"
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    h12 = F.regexp_extract(x, p12, 1).try_cast("int") % 12 + F.when(x.endswith("pm"), 12).otherwise(0)
    m12 = F.coalesce(F.nullif(F.regexp_extract(x, p12, 2), F.lit("")), F.lit("00"))
    t24 = F.concat(pad(F.regexp_extract(x, p24, 1)), F.lit(":"), F.regexp_extract(x, p24, 2))
    return F.when(x.rlike(p24), t24).when(x.rlike(p12), F.concat(pad(h12), F.lit(":"), m12))


_SPAN = r"([0-9:apm\s]+)\s*(?:-|to)\s*([0-9:apm\s]+)"


def hours(raw: Column, all_day: Column, opening: Column, closing: Column) -> Column:
    """Struct of is_24_hours, opening, closing, intervals, overnight and rule; a day-long station has no times."""
    x = F.coalesce(F.lower(F.trim(raw)), F.lit(""))
    day_long = F.coalesce(all_day, F.lit(False)) | x.rlike("24/7|24x7|24 hours|always open|24 hrs")
    closed = x.contains("closed") | x.contains("not operational")
    spans = F.transform(F.split(x, ","), lambda p: F.struct(clock(F.regexp_extract(p, _SPAN, 1)).alias("open"), clock(F.regexp_extract(p, _SPAN, 2)).alias("close")))
    good = F.filter(spans, lambda s: s["open"].isNotNull() & s["close"].isNotNull())
    several = x.contains(",") & (F.size(good) > 0)
    o, c = clock(opening), clock(closing)
    both = o.isNotNull() & c.isNotNull()
    o1 = F.when(both, o).otherwise(clock(F.regexp_extract(x, _SPAN, 1)))
    c1 = F.when(both, c).otherwise(clock(F.regexp_extract(x, _SPAN, 2)))
    missing = (x == "") & all_day.isNull() & opening.isNull() & closing.isNull()

    def out(flag, a, b, n, rule) -> Column:
        over = F.coalesce(b < a, F.lit(False)) if a is not None else F.lit(False)
        s = lambda v: (v if v is not None else _NULL("string"))
        return F.struct(F.lit(flag).cast("boolean").alias("is_24_hours"), s(a).alias("opening"), s(b).alias("closing"), n.alias("intervals"), over.alias("overnight"), rule.alias("rule"))

    zero, one = F.lit(0), F.lit(1)
    return (
        F.when(missing, out(None, None, None, zero, F.lit("MISSING")))
        .when(day_long, out(True, None, None, zero, F.lit("ALL_DAY")))
        .when(closed, out(False, None, None, zero, F.lit("CLOSED")))
        .when(several, out(False, F.get(good, F.lit(0))["open"], F.element_at(F.when(F.size(good) > 0, good), -1)["close"], F.size(good), F.lit("SEVERAL")))
        .when(o1.isNotNull() & c1.isNotNull(), out(False, o1, c1, one, F.when(c1 < o1, "OVERNIGHT").otherwise("DAILY")))
        .otherwise(out(None, None, None, zero, F.lit("UNSTRUCTURED")))
    )
