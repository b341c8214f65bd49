"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltmill.session import shared_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the cluster's shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _fingerprint(edges: DataFrame) -> tuple:
    """Number of edges and two sums of their hashes: equal sets have equal ones."""
    h = [F.sum(F.xxhash64(F.lit(k), "u", "v").cast("decimal(38,0)")) for k in (0, 1)]
    return tuple(edges.agg(F.count("*"), *h).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of edges (a, b) reaches; nodes are the ends of edges.

    Alternating star steps: every node hands its larger neighbours, then its smaller ones, to the least node
    it knows, until the edges are stars.  Sums are per node with map-side minima, so hubs don't gather rows.
    """
    e = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    was = _fingerprint(e)
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").where("v <> m").select("v", "m").toDF("u", "v").union(small_low.toDF("u", "v"))
        nxt = checkpointed(small.where("u <> v").distinct())
        e, now = nxt, _fingerprint(nxt)
        if now == was:
            break
        was = now
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    stars = e.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(stars, F.col("node") == F.col("u"), "left").select("node", F.coalesce("root", "node").alias("root"))
