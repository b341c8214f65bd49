"""Freshness of a fact against an explicit reference time; a fact's status is never changed by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Policy, information type, source, fresh and stale seconds, retrieval time as fallback, decay curve.
POLICIES = (
    ("live_telemetry", "live_telemetry", None, 300.0, 900.0, False, "LINEAR"),
    ("operational_status", "operational_status", None, 3600.0, 86400.0, False, "LINEAR"),
    ("static_metadata", "static_metadata", None, 604800.0, 2592000.0, True, "NONE"),
    ("pricing", "pricing", None, 86400.0, 604800.0, False, "NONE"),
    ("poi_live_telemetry", "live_telemetry", "poi", 300.0, 900.0, False, "LINEAR"),
    ("poi_static_metadata", "static_metadata", "poi", 604800.0, 2592000.0, True, "NONE"),
)
FUTURE_TOLERANCE_S = 5.0


def policy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(POLICIES), "policy string, information_type string, source string, fresh_s double, stale_s double, fallback boolean, curve string")


def decay(age_s: Column, fresh_s: Column, stale_s: Column, curve: Column, half_life_s: Column | None = None) -> Column:
    """Score from 1 to 0 by curve; the linear one falls from age 0 on, NONE has no score."""
    age = F.greatest(age_s, F.lit(0.0))
    half = F.coalesce(half_life_s if half_life_s is not None else F.lit(None).cast("double"), F.nullif(fresh_s, F.lit(0.0)), F.lit(300.0))
    return (
        F.when(curve == "LINEAR", F.when((stale_s <= 0) | (age >= stale_s), F.lit(0.0)).otherwise(1 - age / stale_s))
        .when(curve == "EXPONENTIAL", F.pow(F.lit(2.0), -age / half))
        .when(curve == "STEP", F.when(age <= fresh_s, 1.0).when(age <= stale_s, 0.5).otherwise(0.0))
    )


def resolve_policy(spark: SparkSession, facts: DataFrame) -> DataFrame:
    """Add the policy columns: explicit name, then source and type, then type, then static metadata."""
    p = policy_table(spark)
    cols = ["policy", "fresh_s", "stale_s", "fallback", "curve"]

    def pick(prefix: str, where: Column, on: list[tuple[str, str]]) -> DataFrame:
        t = p.where(where).select(*[F.col(k).alias(f"{prefix}_{k}") for k in {*cols, *(b for _, b in on)}])
        return t

    x = facts
    named = pick("n", F.lit(True), [("policy_name", "policy")])
    x = x.join(F.broadcast(named), x["policy_name"] == named["n_policy"], "left")
    bound = pick("s", F.col("source").isNotNull(), [("information_type", "information_type"), ("source", "source")])
    x = x.join(F.broadcast(bound), (x["information_type"] == bound["s_information_type"]) & (x["source"] == bound["s_source"]), "left")
    typed = pick("t", F.col("source").isNull(), [("information_type", "information_type")])
    x = x.join(F.broadcast(typed), x["information_type"] == typed["t_information_type"], "left")
    base = dict(zip(("policy", "information_type", "source", "fresh_s", "stale_s", "fallback", "curve"), POLICIES[2], strict=True))
    return x.select(*[facts[c] for c in facts.columns], *[F.coalesce(f"n_{c}", f"s_{c}", f"t_{c}", F.lit(base[c])).alias(c) for c in cols])


def evaluate(facts: DataFrame, as_of: Column) -> DataFrame:
    """Add basis, state, age_s, decay_score and is_future to rows with policy columns and epoch seconds observed_s, updated_s, retrieved_s."""
    live = F.col("information_type") == "live_telemetry"
    first = F.when(live, F.col("observed_s")).otherwise(F.col("updated_s"))
    second = F.when(live, F.col("updated_s")).otherwise(F.col("observed_s"))
    names = (F.when(live, "OBSERVATION_TIME").otherwise("SOURCE_UPDATED_AT"), F.when(live, "SOURCE_UPDATED_AT").otherwise("OBSERVATION_TIME"))
    third = F.when(F.col("fallback"), F.col("retrieved_s"))
    t = F.coalesce(first, second, third)
    basis = F.when(first.isNotNull(), names[0]).when(second.isNotNull(), names[1]).when(third.isNotNull(), "RETRIEVED_AT").otherwise("UNKNOWN")
    raw = as_of - t
    future = F.coalesce(raw < -FUTURE_TOLERANCE_S, F.lit(False))
    age = F.when(future, raw).otherwise(F.greatest(raw, F.lit(0.0)))
    state = F.when(t.isNull() | future, "UNKNOWN").when(age <= F.col("fresh_s"), "FRESH").when(age <= F.col("stale_s"), "AGING").otherwise("STALE")
    score = F.when(t.isNull(), None).when(future, F.lit(0.0)).otherwise(decay(age, F.col("fresh_s"), F.col("stale_s"), F.col("curve")))
    return facts.withColumns({"basis": basis, "state": state, "age_s": age, "decay_score": score, "is_future": future})


def live_usable(state: Column) -> Column:
    """Whether a fact may be shown as live: fresh or aging, never stale or unknown."""
    return F.coalesce(state.isin("FRESH", "AGING"), F.lit(False))


def record_facets(spark: SparkSession, records: DataFrame, as_of: Column) -> DataFrame:
    """Freshness of each record's live observation and of its profile, one not touching the other.

    records has source, observed_s, date_last_status_update and date_created (texts), retrieved_s; the profile's
    time is the first of the two texts that is filled in, where it can be read.  Adds live_state, live_age_s,
    has_live, live_usable, profile_state, profile_basis and profile_age_s; a record without observation has no live state.
    """
    none, no_s = F.lit(None).cast("string"), F.lit(None).cast("double")
    keep = records.columns
    base = records.withColumn("__n", F.struct(*keep)).withColumn("policy_name", none)

    def facet(kind: str, observed: Column, changed: Column, retrieved: Column, prefix: str, before: DataFrame, carry: list[str]) -> DataFrame:
        facts = before.select("__n", "policy_name", "source", *carry, F.lit(kind).alias("information_type"), observed.alias("observed_s"), changed.alias("updated_s"), retrieved.alias("retrieved_s"))
        x = evaluate(resolve_policy(spark, facts), as_of)
        return x.select("__n", "policy_name", "source", *carry, F.col("state").alias(f"{prefix}_state"), F.col("age_s").alias(f"{prefix}_age_s"), F.col("basis").alias(f"{prefix}_basis"))

    n = lambda c: F.col("__n")[c]
    live = facet("live_telemetry", n("observed_s").cast("double"), no_s, no_s, "live", base, [])
    done = ["live_state", "live_age_s", "live_basis"]
    changed = F.unix_micros(F.coalesce(F.nullif(n("date_last_status_update"), F.lit("")), F.nullif(n("date_created"), F.lit(""))).try_cast("timestamp")) / 1e6
    both = facet("static_metadata", no_s, changed, n("retrieved_s").cast("double"), "profile", live, done)
    has = n("observed_s").isNotNull()
    return both.select("__n.*", has.alias("has_live"), F.when(has, F.col("live_state")).alias("live_state"), F.when(has, F.col("live_age_s")).alias("live_age_s"), (has & live_usable(F.col("live_state"))).alias("live_usable"), "profile_state", "profile_basis", "profile_age_s")


def bucket(minutes: Column, stale_after: float = 120) -> Column:
    """The coarse state of list views: fresh to 30 minutes, aging, stale; negative or missing is unknown."""
    return F.when(minutes.isNull() | (minutes < 0), "unknown").when(minutes <= 30, "fresh").when(minutes <= stale_after, "aging").otherwise("stale")
