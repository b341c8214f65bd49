"""Exact dedup (9): binary-fuse filters of immutable snapshots screen the digests of incoming rows.

A snapshot is a table of distinct digests with their largest id and row count, dealt into buckets; each
bucket has a static binary-fuse filter (Graf and Lemire 2022).  Incoming rows are grouped by digest
among themselves; their distinct digests are screened by the filters, and only positives join the exact
buckets.  Digests that occur twice or more then go through a byte check: their texts are grouped as
bytes, so a digest that stood for two texts would be split and not merged.

Defined results: null text counts as empty; of equal texts the row with the largest id stays, null ids
being smallest; of repeated rows (same id, same text) one stays; an empty table gives no rows; extra columns
pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import mix64
from .shared import cut, files_for, fresh, named

#: Distinct digests of a bucket, about; one filter of 9/8 bytes a digest covers it.
BUCKET_ROWS = 1 << 18


def fuse_build(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """A 3-wise binary-fuse filter of distinct 64-bit keys: seed, segment length, segment count, fingerprints.

    Keys are peeled in rounds: all slots that hold one key at the start of a round are taken at once.
    """
    n = len(keys)
    segment = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    segment = min(segment, 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    count = max(1, -(-int(n * factor) // segment) - 2)
    for seed in range(1, 200):
        slots = fuse_slots(keys, seed, segment, count)
        size = (count + 2) * segment
        degree = np.bincount(slots.ravel(), minlength=size)
        which = np.zeros(size, np.int64)
        for k in range(3):
            np.bitwise_xor.at(which, slots[k], np.arange(n))
        order: list[tuple[np.ndarray, np.ndarray]] = []
        left = np.ones(n, bool)
        single = np.flatnonzero(degree == 1)
        while len(single):
            key, first = np.unique(which[single], return_index=True)
            at = single[first]
            order.append((key, at))
            left[key] = False
            for k in range(3):
                np.subtract.at(degree, slots[k][key], 1)
                np.bitwise_xor.at(which, slots[k][key], key)
            touched = np.unique(slots[:, key])
            single = touched[degree[touched] == 1]
        if not left.any():
            table = np.zeros(size, np.uint8)
            mark = fuse_mark(keys, seed)
            for key, at in reversed(order):
                s = slots[:, key]
                table[at] = 0
                table[at] = mark[key] ^ table[s[0]] ^ table[s[1]] ^ table[s[2]]
            return seed, segment, count, table
        if seed % 20 == 0:
            count += max(1, count // 8)
    raise ValueError("no seed separates the keys; are they distinct?")


def fuse_mark(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(keys + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(56)).astype(np.uint8)


def fuse_slots(keys: np.ndarray, seed: int, segment: int, count: int) -> np.ndarray:
    """The three slots of each key, in three consecutive segments."""
    with np.errstate(over="ignore"):
        h = mix64(mix64(keys ^ np.uint64(seed * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)))
        base = (h >> np.uint64(32)) % np.uint64(count)
        low = np.uint64(segment - 1)
        parts = [h & low, (h >> np.uint64(14)) & low, mix64(h) & low]
        return np.stack([((base + np.uint64(k)) * np.uint64(segment) + parts[k]).astype(np.int64) for k in range(3)])


def fuse_has(keys: np.ndarray, seed: int, segment: int, count: int, table: np.ndarray) -> np.ndarray:
    """True for every member; for one in about 256 others too."""
    s = fuse_slots(keys, seed, segment, count)
    return (table[s[0]] ^ table[s[1]] ^ table[s[2]]) == fuse_mark(keys, seed)


def _keys(digests: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.array([d[:8] for d in digests.to_pylist()], dtype="S8").view(np.uint64) if len(digests) else np.zeros(0, np.uint64)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def grouped(rows: DataFrame, buckets: int) -> DataFrame:
    """One row for each digest: bucket, digest, largest id, number of rows."""
    b = F.pmod(F.hash("digest"), F.lit(buckets))
    return rows.groupBy("digest").agg(F.max("doc_id").alias("top"), F.count("*").alias("n")).select(b.alias("bucket"), "digest", "top", "n")


def snapshot_filters(snapshot: DataFrame) -> DataFrame:
    """The filter of each bucket of a snapshot (bucket, digest, ...)."""

    def build(t: pa.Table) -> pa.Table:
        keys = np.unique(_keys(t["digest"]))
        seed, segment, count, table = fuse_build(keys)
        return pa.table({"bucket": t["bucket"][:1], "seed": [seed], "segment": [segment], "count": [count], "table": pa.array([table.tobytes()], pa.binary())})

    return snapshot.select("bucket", "digest").groupBy("bucket").applyInArrow(build, "bucket int, seed long, segment long, count long, table binary")


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """The incoming digests that a filter of their bucket can't rule out."""

    def probe(a: pa.Table, f: pa.Table) -> pa.Table:
        if not len(f):
            return a.slice(0, 0)
        r = f.slice(0, 1).to_pylist()[0]
        has = fuse_has(_keys(a["digest"]), r["seed"], r["segment"], r["count"], np.frombuffer(r["table"], np.uint8))
        return a.filter(pa.array(has))

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in incoming.schema.fields)
    return incoming.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(probe, schema)


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """Digests of two or more rows, checked by bytes: digest, mark, top (largest id), n.

    Half of the ids, by hash, are the snapshot; the other half comes in as a new batch.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"), (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("old"))
    total = rows.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    files = files_for(total)
    snapshot = cut(grouped(rows.where("old"), buckets), files)
    batch = cut(grouped(rows.where(~F.col("old")), buckets), files)
    seen = screen(batch, snapshot_filters(snapshot))
    both = seen.select("digest").join(snapshot.select("digest"), "digest", "left_semi")
    within = snapshot.where("n > 1").select("digest").union(batch.where("n > 1").select("digest"))
    again = cut(both.union(within).distinct(), files)
    # Byte check: texts of these digests only, combined on each side of the exchange.
    texts = docs.select("doc_id", text.alias("text")).withColumn("digest", digest(F.col("text")))
    same = texts.join(again.hint("shuffle_hash"), "digest", "left_semi").groupBy("text").agg(F.max("doc_id").alias("top"), F.count("*").alias("n"))
    return same.select(digest(F.col("text")).alias("digest"), F.xxhash64("text").alias("mark"), "top", "n").where("n > 1")


def decide(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = cut(duplicate_groups(docs.select("doc_id", "text")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.xxhash64(text).alias("mark"))
    # Repeated rows are counted on the way, so that one of them stays.
    rows = rows.groupBy("doc_id", "digest", "mark").agg(F.count("*").alias("copies"))
    out = rows.join(groups, ["digest", "mark"], "left")
    first = F.posexplode(F.sequence(F.lit(1), F.col("copies"))).alias("nth", "__x")
    out = out.select("*", first)
    return out.select(
        "doc_id",
        F.coalesce("top", "doc_id").alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        ((F.col("nth") == 0) & F.coalesce("top", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_rows(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    groups = cut(duplicate_groups(docs.select("doc_id", "text")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own, own_mark, code, mark, top, n, key = fresh(docs, "own_digest", "own_mark", "g_digest", "g_mark", "g_top", "g_n", "g_key")
    tagged = docs.withColumn(own, F.unhex(F.sha2(text, 256))).withColumn(own_mark, F.xxhash64(text))
    g = groups.select(F.col("digest").alias(code), F.col("mark").alias(mark), F.col("top").alias(top), F.col("n").alias(n))
    joined = tagged.join(g, (F.col(own) == F.col(code)) & (F.col(own_mark) == F.col(mark)), "left").where(F.col(n).isNull() | F.col(top).eqNullSafe(F.col("doc_id")))
    single = joined.where(F.col(n).isNull()).withColumn(key, F.lit(None).cast("string"))
    # Of each group the top row is left, and more than one only where that row itself is repeated.
    # By another key than the join's, so that the join with a large group can be split.
    several = joined.where(F.col(n).isNotNull()).withColumn(key, F.hex(own)).dropDuplicates([key])
    return single.unionByName(several).select(*[named(c) for c in docs.columns])
