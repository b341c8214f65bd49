"""Text normalisation and similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Words that tell stations apart poorly, and local acronyms.
STOP_WORDS = ("ev", "charging", "station", "charger", "point", "hub", "charge", "limited", "ltd", "pvt", "private", "the", "and", "at", "in", "near", "opp", "opposite", "behind", "road", "rd", "street", "st", "lane", "nagar", "complex")
ACRONYMS = {
    "bkc": ("bandra", "kurla", "complex"),
    "weh": ("western", "express", "highway"),
    "eeh": ("eastern", "express", "highway"),
    "jvlr": ("jogeshwari", "vikhroli", "link", "road"),
    "sclr": ("santacruz", "chembur", "link", "road"),
}
# Address abbreviations and words that stay in capitals.
ABBREVIATIONS = {"rd": "Road", "st": "Street", "ave": "Avenue", "bldg": "Building", "apt": "Apartment", "flr": "Floor", "opp": "Opposite", "nr": "Near", "hwy": "Highway"}
CAPITALS = ("BKC", "MIDC", "SEZ", "CIDCO", "BEST", "MSRTC", "BMC", "MMRDA", "NH", "SH", "EV", "CPO", "MCA")


@pandas_udf(StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    """NFKD without what ASCII lacks; Spark has no built-in for it."""
    return s.map(lambda x: x, na_action="ignore").str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def words_only(folded: Column) -> Column:
    """Lower case letters and digits with single spaces between them; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(folded, F.lit(""))), r"[^a-z0-9]+", " "))


def match_key(raw: Column) -> Column:
    return words_only(fold_accents(raw))


def tokens(key: Column) -> Column:
    """Distinct telling words of a match key with acronyms spelled out; of a key without any, its words of two letters or more."""
    raw = F.filter(F.split(key, " "), lambda t: F.length(t) > 1)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    spelled = F.create_map(*[x for k, v in ACRONYMS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v if w not in STOP_WORDS]))])
    telling = F.filter(raw, lambda t: ~F.array_contains(stop, t))
    none = F.array().cast("array<string>")
    out = F.array_distinct(F.concat(telling, F.flatten(F.transform(telling, lambda t: F.coalesce(spelled[t], none)))))
    return F.when(F.size(out) > 0, out).otherwise(F.array_distinct(raw))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are alike, an empty and another one are not."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Shared part of the smaller set."""
    small = F.least(F.size(a), F.size(b))
    return F.when(F.size(F.array_union(a, b)) == 0, F.lit(1.0)).when(small == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / small)


def edit_ratio(a: Column, b: Column) -> Column:
    """One less edit distance over the longer length; 1 for equal texts, 0 where one is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def sorted_words(set_: Column) -> Column:
    return F.array_join(F.array_sort(set_), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    order = lambda x: F.array_join(F.array_sort(F.filter(F.split(x, r"\s+"), lambda t: t != "")), " ")
    return edit_ratio(order(a), order(b))


def name_similarity(key_a: Column, key_b: Column) -> Column:
    """Blend of sorted-word edit ratio, Jaccard and overlap; a name inside the other scores 0.85 at least."""
    return blended_similarity(key_a, key_b, tokens(key_a), tokens(key_b), token_text(key_a), token_text(key_b))


def token_text(key: Column) -> Column:
    """The telling words of a key in order, or the key itself where it has none."""
    t = tokens(key)
    return F.when(F.size(t) > 0, sorted_words(t)).otherwise(key)


def blended_similarity(key_a: Column, key_b: Column, ta: Column, tb: Column, sa: Column, sb: Column) -> Column:
    """name_similarity where tokens and their texts are at hand."""
    blend = 0.35 * edit_ratio(sa, sb) + 0.35 * jaccard(ta, tb) + 0.30 * overlap(ta, tb)
    inside = (key_a != "") & (key_b != "") & (key_a.contains(key_b) | key_b.contains(key_a))
    return F.when((key_a == key_b) & (key_a != ""), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.when(inside, F.greatest(blend, F.lit(0.85))).otherwise(blend)))


def slug(raw: Column) -> Column:
    """Lower case with dashes for anything but letters, digits, dash and underscore; null where nothing is left."""
    s = F.regexp_replace(F.lower(F.trim(raw)), r"[^a-z0-9_-]+", "-")
    return F.nullif(F.regexp_replace(s, r"^-+|-+$", ""), F.lit(""))


def squeeze(raw: Column) -> Column:
    """Single spaces, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), "​", ""), r"[\s ]+", " "))


def address_text(raw: Column) -> Column:
    """Spell out abbreviations, keep known capitals, give single-case words a capital; null for an empty text."""
    from .vocab import mapping

    clean = F.regexp_replace(squeeze(raw), r"\s+([,.:;])", "$1")
    words = F.split(clean, " ")
    table, capitals = mapping(ABBREVIATIONS), F.array(*[F.lit(c) for c in CAPITALS])

    def one(t: Column, i: Column) -> Column:
        base = F.regexp_replace(t, r"[,.]+$", "")
        end = F.when(t.endswith(","), ",").when(t.endswith("."), ".").otherwise("")
        spelled = table[F.lower(base)]
        end_spelled = F.when(t.endswith(","), ",").when(t.endswith(".") & (i == F.size(words) - 1), ".").otherwise("")
        letters = base.rlike("[A-Za-z]")
        upper = letters & (F.upper(base) == base) & (F.length(base) > 1)
        lower = letters & (F.lower(base) == base)
        return (
            F.when(spelled.isNotNull(), F.concat(spelled, end_spelled))
            .when(F.array_contains(capitals, F.upper(base)), F.concat(F.upper(base), end))
            .when(upper | lower, F.concat(F.initcap(base), end))
            .otherwise(t)
        )

    return F.when(clean == "", F.lit(None).cast("string")).otherwise(F.array_join(F.transform(words, one), " "))


def scrub_secrets(raw: Column) -> Column:
    """Hide passwords in URLs and values of secret-like keys in error texts."""
    s = F.regexp_replace(raw, r"(\w+://[^:/\s]+:)[^@\s]+@", "$1***@")
    return F.regexp_replace(s, r"(?i)\b(password|token|secret|api[_-]?key)(\s*[=:]\s*)\S+", "$1$2***")


def payload_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)


def cluster_id(sources: Column) -> Column:
    """Name of a group of source:id strings, whatever their order."""
    return F.concat(F.lit("cluster_"), F.substring(F.sha2(F.array_join(F.array_sort(sources), ";"), 256), 1, 16))
