"""Clusters of many records at one place: results and what they write."""

import os
import random

import pytest
from oracle import TABLES, assert_equal, connect
from pyspark.sql import functions as F

from voltmill.operators import identity
from voltmill.plans import identity as plans
from voltmill.plans import registry
from voltmill.sources.driver_tables import Star


@pytest.fixture(scope="module")
def crowd(sf, spark, tmp_path_factory):
    """Test tables whose customers are 300 sites of one place (44,850 pairs) and 600 of others."""
    d = tmp_path_factory.mktemp("crowd")
    for t in TABLES:
        if t != "customer":
            os.symlink(f"{sf}/{t}.parquet", d / f"{t}.parquet")
    n = F.col("id")
    key = F.when(n < 300, 10500 * (1 + F.floor(n / 3)) + n % 3).otherwise(n)
    spark.range(900).select(key.alias("c_custkey"), F.concat(F.lit("Customer "), n.cast("string")).alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment")).coalesce(1).write.parquet(str(d / "customer.parquet"))
    return str(d)


def kept(spark):
    """Bytes in the checkpoint folder."""
    root = spark.sparkContext._jsc.sc().getCheckpointDir()
    top = root.get().removeprefix("file:") if root.isDefined() else None
    return sum(os.path.getsize(os.path.join(p, f)) for p, _, names in os.walk(top) for f in names) if top else 0


@pytest.mark.parametrize("name", ["dd_02_08_decisions", "dd_09_12_field_survivors", "dd_09_coordinates", "ext_04_09_written_status", "ext_14_rerun_changes_nothing", "ext_14_run_accounting", "dd_13_connector_conflicts", "dd_13_connector_inventory"])
def test_pairs_of_a_crowded_place_are_not_kept(spark, crowd, name):
    was = kept(spark)
    df = registry.QUERIES[name](spark, crowd)
    assert_equal(df, connect(crowd), registry.SQL[name])
    assert kept(spark) - was < 2_000_000


def test_clusters_and_agreement_equal_those_of_all_pairs(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        g = i % 60
        alike = g < 30  # groups that agree but for a rare field, and groups of all kinds
        pick = lambda xs: xs[0] if alike and rng.random() < 0.98 else rng.choice(xs)
        lat = None if i % 97 == 0 else float("nan") if i % 89 == 0 else 19.0 + g * 0.01 + pick([0.0, 0.0001, 0.0003, 0.0006])
        rows.append((i, lat, 72.0, rng.choice(["Plaza Alpha", "Plaza Alpha North"]) if alike else pick(["Plaza 1 Hub", "Plaza 1", "Mall", "", None]), pick(["tata", "tata-power", None, "zeon"]), rng.choice([["CCS2"], ["CCS2", "Type 2"]]) if alike else pick([["CCS2"], ["Type 2", "Other"], []]), pick(["400051", None, "400999"]), pick(["Zone 1", None, "Zone 2 East"]), pick(["1 Link Road", "2 Main Road", None])))
    names = ("Orchid Mall", "Orchid Mall Garden Bazaar Arcade", "Orchid Mall Riverside Tower Five")  # the others match the first one, not each other
    rows += [(1000 + i, 21.0, 72.0, x, "tata", ["CCS2"], "400051", "Zone 1", "1 Link Road") for i, x in enumerate(names)]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double, name string, operator_slug string, types array<string>, postal_code string, locality string, address_line string").withColumn("powers", F.array().cast("array<double>")).withColumn("source_id", F.lit("s")).cache()
    e = identity.pair_evidence(df).cache()
    c = identity.clusters(df, e).cache()
    placed = identity.place_clusters(df).cache()
    assert sorted(map(tuple, placed.collect())) == sorted(map(tuple, c.collect()))
    of, size, good = {r.id: r.cluster for r in c.collect()}, {}, {}
    for x in of.values():
        size[x] = size.get(x, 0) + 1
    for r in e.collect():
        good[of[r.id_a]] = good.get(of[r.id_a], 0) + (r.state == "MATCH")
    want = {x: good.get(x, 0) == n * (n - 1) // 2 for x, n in size.items() if n > 1}
    got = {r.cluster: r.agreed for r in identity.agreement(df, placed).collect()}
    assert got == want and {True, False} <= set(want.values()) and good[1000] == 2
    agreed = [x for x, ok in want.items() if ok]
    assert max(len({str(rows[i][1:]) for i, y in of.items() if y == x}) for x in agreed) > 2  # rows besides the first one meet too


@pytest.fixture(scope="module")
def copies(sf, spark, tmp_path_factory):
    """Test tables whose 9,000 customers are sites of 150 places, 60 each, with six orders each."""
    d = tmp_path_factory.mktemp("copies")
    for t in TABLES:
        if t not in ("customer", "orders"):
            os.symlink(f"{sf}/{t}.parquet", d / f"{t}.parquet")
    n, k = F.col("id"), 10500 * F.floor(F.col("id") / 150) + F.col("id") % 150
    spark.range(9000).select(k.alias("c_custkey"), F.concat(F.lit("Customer "), n.cast("string")).alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment")).coalesce(1).write.parquet(str(d / "customer.parquet"))
    orders = spark.range(54000).select(n.alias("o_orderkey"), (10500 * F.floor(n / 900) + n % 150).alias("o_custkey"), ((n * 7919) % 90000).cast("double").alias("o_totalprice"), F.lit("O").alias("o_orderstatus"), F.lit("1-URGENT").alias("o_orderpriority"), F.lit("2024-01-01").cast("date").alias("o_orderdate"))
    orders.coalesce(1).write.parquet(str(d / "orders.parquet"))
    return str(d)


def shuffled(spark, since=-1):
    """(last stage, bytes written to shuffles by the stages after since)."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    stages = [found.apply(i) for i in range(found.size())]
    return max((x.stageId() for x in stages), default=-1), sum(x.shuffleWriteBytes() for x in stages if x.stageId() > since)


@pytest.mark.parametrize(("name", "most"), [("ext_04_09_written_status", 270), ("ext_14_rerun_changes_nothing", 300), ("ext_14_run_accounting", 400)])
def test_sites_are_dealt_out_once(spark, copies, name, most):
    since, _ = shuffled(spark)
    was, small = kept(spark), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(small, "-1")
    try:
        assert_equal(registry.QUERIES[name](spark, copies), connect(copies), registry.SQL[name])
    finally:
        spark.conf.unset(small)
    assert shuffled(spark, since)[1] + kept(spark) - was < most * 9000


@pytest.fixture(scope="module")
def twins(sf, spark, tmp_path_factory):
    """Test tables whose 600 customers are sites in twos of like names."""
    d = tmp_path_factory.mktemp("twins")
    for t in TABLES:
        if t != "customer":
            os.symlink(f"{sf}/{t}.parquet", d / f"{t}.parquet")
    k = F.col("id")
    rows = spark.range(900).where((k % 3 == 0) | (k % 9).isin(2, 4, 8)).select(k.alias("c_custkey"), F.concat(F.lit("Customer "), k.cast("string")).alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"))
    rows.coalesce(1).write.parquet(str(d / "customer.parquet"))
    return str(d)


@pytest.mark.parametrize("few", [10_000, 0])
def test_undecided_clusters_are_compared(spark, twins, monkeypatch, few):
    monkeypatch.setattr(plans, "FEW", few)
    s = Star(spark, twins)
    got = {r.cluster: (r.n, r.state, r.blocked) for r in plans.decided(s, plans.placed(s)).collect()}
    want = {r[0]: tuple(r[1:]) for r in connect(twins).execute(f"SELECT cluster, n, state, blocked FROM ({registry.SQL['dd_02_08_decisions']})").fetchall()}
    assert got == want and {"MERGE", "LINK", "REVIEW"} <= {x[1] for x in got.values() if x[0] > 1}
