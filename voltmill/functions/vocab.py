"""Controlled vocabularies and lookups into them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enum domains.
AVAILABILITY = ("available", "busy", "broken", "unknown")
CONNECTOR_TYPES = ("CCS2", "CCS1", "CHAdeMO", "Type 2", "Type 1", "GB/T", "Bharat AC001", "Bharat DC001", "Other")

# Operators, their slugs and aliases.
OPERATORS = {
    "Tata Power": ("tata-power", ("tata power", "tata power ez charge", "tata power ev charging")),
    "Jio-bp pulse": ("jio-bp", ("jio-bp pulse", "jio-bp", "jio bp", "jio bp pulse")),
    "Ather Energy": ("ather-energy", ("ather energy", "ather grid", "ather")),
    "Fortum Charge & Drive": ("fortum", ("fortum charge & drive", "fortum", "fortum charge and drive")),
    "ChargeZone": ("chargezone", ("chargezone", "charge zone")),
    "Statiq": ("statiq", ("statiq",)),
    "Magenta ChargeGrid": ("magenta-chargegrid", ("magenta chargegrid", "magenta", "chargegrid")),
    "Bolt.Earth": ("bolt-earth", ("bolt.earth", "bolt earth", "bolt")),
    "Zeon Charging": ("zeon-charging", ("zeon charging", "zeon")),
    "Kazam": ("kazam", ("kazam",)),
    "Lithion Power": ("lithion-power", ("lithion power", "lithion")),
    "Stilt Mobility": ("stilt-mobility", ("stilt mobility", "stilt")),
}

# Labels of connector types.
CONNECTOR_LABELS = {
    "CCS2": ("ccs2", "ccs 2", "ccs-2", "ccs (type 2)", "ccs type 2", "ccs combo 2", "ccs combo type 2", "combined charging system 2", "combined charging system type 2", "iec 62196-3 configuration ff", "type 2 combo", "combo 2"),
    "CCS1": ("ccs1", "ccs 1", "ccs-1", "ccs (type 1)", "ccs type 1", "ccs combo 1", "ccs combo type 1", "combined charging system 1", "iec 62196-3 configuration ee", "type 1 combo", "combo 1"),
    "Type 2": ("type 2", "type-2", "type2", "iec 62196 type 2", "iec 62196-2", "iec 62196-2 type 2", "mennekes", "type 2 (socket only)", "type 2 (tethered connector)", "iec 62196-2 mennekes"),
    "Type 1": ("type 1", "type-1", "type1", "j1772", "sae j1772", "type 1 (j1772)", "iec 62196-2 type 1"),
    "CHAdeMO": ("chademo", "chade-mo", "iec 62196-3 configuration aa"),
    "GB/T": ("gb/t", "gb-t", "gbt", "gb/t (ac)", "gb/t (dc)", "gb/t 20234", "gb-t 20234", "gb/t 20234.2", "gb/t 20234.3"),
    "Bharat AC001": ("bharat ac001", "bharat ac-001", "bharat ac 001", "ac001", "iec 60309"),
    "Bharat DC001": ("bharat dc001", "bharat dc-001", "bharat dc 001", "dc001"),
}

# Connector type ids of the open charge point map.
POI_CONNECTOR_IDS = {33: "CCS2", 32: "CCS1", 25: "Type 2", 1036: "Type 2", 1: "Type 1", 2: "CHAdeMO", 1038: "GB/T", 1039: "GB/T", 1040: "GB/T", 34: "Bharat AC001"}


def mapping(pairs: dict) -> Column:
    """A constant map column."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def operator_aliases() -> dict[str, str]:
    return {alias: name for name, (_, aliases) in OPERATORS.items() for alias in (name.lower(), *aliases)}


def operator(raw: Column) -> Column:
    """Struct of name, slug, mapping (exact, alias, unmapped, unknown) of an operator's raw name."""
    from .text import slug

    clean = F.trim(raw)
    name = mapping(operator_aliases())[F.lower(clean)]
    slugs = mapping({n: s for n, (s, _) in OPERATORS.items()})
    kind = F.when(raw.isNull() | (clean == ""), "unknown").when(name.isNull(), "unmapped").when(F.lower(name) == F.lower(clean), "exact").otherwise("alias")
    return F.struct(name.alias("name"), F.when(kind == "unknown", None).otherwise(F.coalesce(slugs[name], slug(clean))).alias("slug"), kind.alias("mapping"))


def connector_type(raw: Column) -> Column:
    """Struct of type and status of a connector label: exact names, then labels, then Other."""
    clean = F.trim(raw)
    label = mapping({x: t for t, labels in CONNECTOR_LABELS.items() for x in labels})[F.lower(clean)]
    missing, exact = raw.isNull() | (clean == ""), clean.isin(*CONNECTOR_TYPES)
    kind = F.when(missing, F.lit(None).cast("string")).when(exact, clean).otherwise(F.coalesce(label, F.lit("Other")))
    status = F.when(missing, "UNKNOWN").when(exact, "UNCHANGED").when(label.isNotNull(), "NORMALIZED").otherwise("UNMAPPED")
    return F.struct(kind.alias("type"), status.alias("status"))


def display_connector(raw: Column) -> Column:
    """The coarse connector name of list views, by the first matching part of the label."""
    x = F.lower(F.coalesce(raw, F.lit("")))
    rules = (("ccs2", "CCS2"), ("ccs 2", "CCS2"), ("ccs1", "CCS1"), ("chademo", "CHAdeMO"), ("type 2", "Type 2"), ("type2", "Type 2"), ("type 1", "Type 1"), ("gb", "GB/T"), ("bharat", "Bharat AC001"))
    out = F.lit("Other")
    for part, name in reversed(rules):
        out = F.when(x.contains(part), name).otherwise(out)
    return out
