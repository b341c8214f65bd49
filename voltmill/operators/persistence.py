"""Writing decided clusters to stations, links, connectors and observations, as frames; a dry run only counts.

Decisions that are blocked or to be reviewed write nothing.  Each write is idempotent: the same batch again is
UNCHANGED throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed

# Fixed value: the source of estimates that a fresh reading replaces or clears.
ESTIMATE_SOURCE = "ocm_usage_cost"
SKIPPED = ("BLOCKED_SKIPPED", "REVIEW_SKIPPED", "FAILED")


def cluster_status(decisions: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """Per cluster: status, station_id (the one it is or will be) and its numbers of records and links.

    decisions has cluster, state, canon_id, blocked; members cluster, source_id, source_station_id, payload_hash;
    links source_id, source_station_id, station_id, payload_hash, connectors.  Links of one cluster to two stations,
    or to another one than the decision names, are an error of that cluster alone.
    """
    key = ["source_id", "source_station_id"]
    held = links.select(*key, "station_id", F.col("payload_hash").alias("held_hash"), F.col("connectors").alias("held_connectors"))
    same = F.coalesce((F.col("held_hash") == F.col("payload_hash")) & (F.col("held_connectors") > 0), F.lit(False))
    per = members.join(held, key, "left").groupBy("cluster").agg(
        F.count("*").alias("records"), F.count("station_id").alias("linked"), F.min("station_id").alias("lo"), F.max("station_id").alias("hi"), F.bool_and(same).alias("same"),
    )
    d = decisions.join(per, "cluster", "left")
    conflict = F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)) | F.coalesce((F.col("state") == "LINK") & (F.col("lo") != F.col("canon_id")), F.lit(False))
    status = (
        F.when(F.col("blocked"), "BLOCKED_SKIPPED").when(F.col("state") == "REVIEW", "REVIEW_SKIPPED").when(conflict, "FAILED")
        .when(F.coalesce("same", F.lit(False)), "UNCHANGED").when(F.col("state") == "LINK", "LINKED").when(F.col("linked") > 0, "UPDATED").otherwise("INSERTED")
    )
    new = F.concat(F.lit("station-"), F.col("cluster").cast("string"))
    station = F.coalesce(F.when(F.col("state") == "LINK", F.col("canon_id")), F.col("lo"), new)
    out = d.withColumn("status", status)
    return out.select("cluster", "status", F.when(~out["status"].isin(*SKIPPED), station).alias("station_id"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("linked", F.lit(0)).alias("linked"))


def persist(decisions: DataFrame, members: DataFrame, stations: DataFrame, links: DataFrame, observations: DataFrame, now: Column, dry_run: bool = False) -> dict[str, DataFrame]:
    """New stations, links and observations, rejects with a reason, statuses, and one row of counters.

    members also has name, connectors (their number), and observed_at, availability_status (null without an
    observation); stations has station_id, name, updated_at; links also last_seen; observations station_id,
    source_id, payload_hash, observed_at, availability_status.
    """
    key = ["source_id", "source_station_id"]
    status = checkpointed(cluster_status(decisions, members, links))
    done = members.join(status.where(~F.col("status").isin(*SKIPPED)).select("cluster", "status", "station_id"), "cluster")
    seen = done.where("observed_at IS NOT NULL").select("station_id", "source_id", "payload_hash", "observed_at", "availability_status").dropDuplicates(["station_id", "source_id", "payload_hash"])
    known = ["station_id", "source_id", "payload_hash"]
    fresh = checkpointed(seen.join(observations.select(*known), known, "left_anti"))
    n = lambda s: F.count_if(F.col("status") == s)
    counters = status.agg(
        n("INSERTED").alias("stations_persisted"), n("UPDATED").alias("stations_updated"), n("UNCHANGED").alias("stations_unchanged"), n("LINKED").alias("stations_linked"),
        n("REVIEW_SKIPPED").alias("records_review_skipped"), n("BLOCKED_SKIPPED").alias("records_blocked"), n("FAILED").alias("failed"),
    ).crossJoin(fresh.agg(F.count("*").alias("observations_persisted")))
    rejects = status.where("status = 'FAILED'").select("cluster", F.lit("links name another station").alias("reason"))
    out = {"status": status, "counters": counters, "rejects": rejects}
    if dry_run:
        return out | {"stations": stations, "links": links, "observations": observations}
    written = done.where("status <> 'UNCHANGED'")
    named = written.groupBy("station_id").agg(F.max_by("name", F.struct(F.length(F.trim("name")), *key)).alias("name")).select("station_id", "name", now.alias("updated_at"))
    linked = done.select(*key, "station_id", "payload_hash", F.greatest("connectors", F.lit(1)).alias("connectors"), now.alias("last_seen"))  # a link that is unchanged is seen again
    return out | {
        "stations": stations.join(named.select("station_id"), "station_id", "left_anti").unionByName(named),
        "links": links.join(linked.select(*key), key, "left_anti").unionByName(linked.dropDuplicates(key)),
        "observations": observations.unionByName(fresh),
    }


def estimate_after(old: Column, value: Column, verified_per_kwh: Column, pricing_type: Column, source: Column, estimate: Column) -> Column:
    """A field of an unverified price estimate after an update: a verified tariff or "free" clears it, a new reading of its own
    source replaces or clears it, and any other source without a price keeps it.  value is that field of the new reading."""
    verified = verified_per_kwh.isNotNull() | F.coalesce(pricing_type == "free", F.lit(False))
    own = F.coalesce(source == ESTIMATE_SOURCE, F.lit(False))
    return F.when(verified, F.lit(None)).when(own & estimate.isNotNull(), value).when(own, F.lit(None)).otherwise(old)


def run_state(counters: DataFrame) -> DataFrame:
    """Add the state of a run: PARTIAL where nothing was fetched, or rows were rejected, quarantined or failed."""
    bad = (F.col("fetched") == 0) | (F.col("rejected") > 0) | (F.col("quarantined") > 0) | (F.col("failed") > 0)
    return counters.withColumn("state", F.when(bad, "PARTIAL").otherwise("SUCCEEDED"))
