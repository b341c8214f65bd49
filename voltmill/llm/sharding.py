"""Sharding (10): balanced label propagation of linked documents under exact row quotas.

Documents with equal texts are linked.  Rows start on a shard by keyed hash.  In each round every group of
linked rows learns which shard most of its rows are on, and its rows elsewhere want to move there; a round's
moves into a shard are let through as far as its quota and the rows that leave it allow; in the last rounds what a
full shard can't take gathers elsewhere.  Rows of one group on one shard are alike, so the state is one count per
group and shard: a group of any size is a few rows.  A shard that is still over its quota then gives up whole
groups, the smallest first and one of them in part, and these fill the room on other shards in one piece but where
a shard's room ends.  Rows take the shards of their group's counts, and unlinked rows, which cut no edge anywhere,
fill every shard to its exact quota: row counts differ by one at most (law `rows`).

Defined results: a null text has no bytes and is equal to the empty text; repeated rows are rows; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, dense_index, files_for, running_sums, unit

SHARDS, ROUNDS, LATE, SEED = 8, 8, 4, 5


def propagate(state: DataFrame, quota: list[int], files: int, rounds: int = ROUNDS) -> DataFrame:
    """Move the counts n of groups g between shards s, towards each group's largest count.

    Only 8 x 8 sums of a round come to the driver.
    """
    shards = len(quota)
    for r in range(rounds):
        best = F.struct("n", F.xxhash64("g", "s"))
        want = state.groupBy("g").agg(F.max_by("s", best).alias("to"))
        if r >= rounds - LATE:
            # What is left of groups that are larger than the room on their shard gathers on the next best one.
            held = {x["s"]: x["n"] for x in state.groupBy("s").agg(F.sum("n").alias("n")).collect()}
            full = F.col("s").isin([t for t in range(shards) if held.get(t, 0) >= 0.95 * quota[t]])
            want = state.groupBy("g").agg(F.max_by("s", best).alias("top"), F.max_by("s", F.when(~full, best)).alias("next"))
            wish = state.join(want, "g").withColumn("to", F.when(full & (F.col("s") == F.col("top")), F.col("s")).otherwise(F.coalesce("next", "s"))).drop("top", "next")
        else:
            wish = state.join(want, "g")
        wish = cut(wish, files)
        flow = [[0] * shards for _ in range(shards)]
        for x in wish.groupBy("s", "to").agg(F.sum("n").alias("n")).collect():
            flow[x["s"]][x["to"]] = x["n"]
        here = [sum(row) for row in flow]
        moving = sum(here) - sum(flow[s][s] for s in range(shards))
        if not moving:
            if r >= rounds - LATE:
                return state
            continue
        share = [1.0] * shards
        for _ in range(20):  # what a shard lets in depends on what the others let out of it
            for t in range(shards):
                inflow = sum(flow[s][t] for s in range(shards) if s != t)
                outflow = sum(flow[t][u] * share[u] for u in range(shards) if u != t)
                share[t] = min(1.0, max(0.0, (quota[t] - here[t] + outflow) / inflow)) if inflow else 1.0
        let = F.element_at(F.array(*[F.lit(x) for x in share]), F.col("to") + 1)
        # A large block moves in part, a small one as a whole or not at all.
        part = F.when(F.col("n") * let >= 64, F.floor(F.col("n") * let)).when(unit(F.lit(SEED + r), "g", "s") < let, F.col("n")).otherwise(0)
        moved = wish.withColumn("go", F.when(F.col("s") == F.col("to"), F.lit(0)).otherwise(part).cast("long"))
        halves = F.array(F.struct(F.col("s").alias("s"), (F.col("n") - F.col("go")).alias("n")), F.struct(F.col("to").alias("s"), F.col("go").alias("n")))
        state = moved.select("g", F.inline(halves)).where("n > 0").groupBy("g", "s").agg(F.sum("n").alias("n"))
    return state


def settle(state: DataFrame, quota: list[int]) -> tuple[DataFrame, list[int]]:
    """Counts that hold no shard over its quota, and the rows on each shard."""
    shards = len(quota)
    per_shard = lambda df: {x["s"]: x["n"] for x in df.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    held = per_shard(state)
    held = [held.get(s, 0) for s in range(shards)]
    if all(h <= q for h, q in zip(held, quota, strict=True)):
        return state, held
    of = lambda values: F.element_at(F.array(*[F.lit(x).cast("long") for x in values]), F.col("s") + 1)
    ranked = running_sums(state, [F.col("s"), F.col("n"), F.col("g")], {"before": "n"})
    before = F.col("before") - of([sum(held[:s]) for s in range(shards)])
    surplus = of([max(0, h - q) for h, q in zip(held, quota, strict=True)])
    ranked = cut(ranked.select("g", "s", "n", F.least(F.col("n"), F.greatest(F.lit(0).cast("long"), surplus - before)).alias("out")))
    kept = ranked.select("g", "s", (F.col("n") - F.col("out")).alias("n")).where("n > 0")
    held = [min(h, q) for h, q in zip(held, quota, strict=True)]
    loose = ranked.where("out > 0").groupBy("g").agg(F.sum("out").alias("n"))
    loose = running_sums(loose, [F.col("n").desc(), F.col("g")], {"a": "n"})
    lo, spans = 0, []
    for s in range(shards):
        hi = lo + quota[s] - held[s]
        spans.append(F.struct(F.lit(s).alias("s"), F.greatest(F.lit(0).cast("long"), F.least(F.col("a") + F.col("n"), F.lit(hi)) - F.greatest(F.col("a"), F.lit(lo))).alias("m")))
        lo = hi
    put = loose.select("g", F.inline(F.array(*spans))).where("m > 0").select("g", "s", F.col("m").alias("n"))
    out = cut(kept.unionByName(put).groupBy("g", "s").agg(F.sum("n").alias("n")))
    held = per_shard(out)
    return out, [held.get(s, 0) for s in range(shards)]


def group_rows(rows: DataFrame, state: DataFrame, files: int) -> DataFrame:
    """Give the rows of each group the shards of its counts, in order of a keyed hash."""
    numbered = _index_in_group(rows)
    before = W.partitionBy("g").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    spans = state.withColumn("lo", F.coalesce(F.sum("n").over(before), F.lit(0)))
    spans = cut(spans.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("lo", "s"))).alias("spans")), files)  # SHARDS at most
    last = F.element_at(F.filter("spans", lambda x: x["lo"] <= F.col("i")), -1)["s"]
    return numbered.join(spans, "g").withColumn("shard", last).drop("spans", "i")


def _index_in_group(rows: DataFrame) -> DataFrame:
    """Number each group's rows from 0; a group is dealt over many tasks by a salt."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(256)).cast("int"))
    counts = salted.groupBy("g", "salt").agg(F.count("*").alias("m"))
    before = W.partitionBy("g").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    shift = counts.select("g", "salt", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("b"))
    at = F.row_number().over(W.partitionBy("g", "salt").orderBy("doc_id")) - 1
    return salted.withColumn("at", at).join(shift, ["g", "salt"]).withColumn("i", F.col("b") + F.col("at")).drop("b", "at", "salt")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("g"),
    )
    rows = cut(rows)
    total = rows.count()
    files = files_for(total)
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    linked_groups = cut(rows.groupBy("g").agg(F.count("*").alias("of")).where("of > 1").select("g"), files)  # cut, so that a join with a large group can be split
    start = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "size"), F.lit(shards)).cast("int")
    linked = cut(rows.join(linked_groups, "g"), files)
    state = linked.groupBy("g", start.alias("s")).agg(F.count("*").alias("n"))
    state, held = settle(propagate(cut(state, files), quota, files), quota)
    placed = group_rows(linked, state, files)

    filled = dense_index(rows.join(linked_groups, "g", "left_anti"), [], [F.col("g"), F.col("doc_id")], "k")
    lo, shard = 0, F.lit(None).cast("int")
    for s in range(shards):
        shard = F.when((F.col("k") >= lo) & (F.col("k") < lo + quota[s] - held[s]), F.lit(s)).otherwise(shard)
        lo += quota[s] - held[s]
    every = cut(placed.unionByName(filled.withColumn("shard", shard).drop("k")), files)
    out = dense_index(every, ["shard"], [F.col("g"), F.col("doc_id")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_edges(assigned: DataFrame) -> DataFrame:
    """Edges of a star of each group of equal texts, and those whose ends are on two shards."""
    g = assigned.groupBy("size", "text_crc32", "shard").agg(F.count("*").alias("n")).groupBy("size", "text_crc32").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    return g.agg(F.sum(F.col("n") - 1).alias("edges"), F.sum(F.col("n") - F.col("top")).alias("cut"))
