"""Operators on small inputs with known results."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from voltmill.functions import measures, station, text
from voltmill.operators import geo, learning, relational, warehouse
from voltmill.operators.graph import connected_components
from voltmill.sources import mappings, readers


def test_daily_evidence_of_three_observations(spark):
    obs = spark.createDataFrame([(1, 20261005, "available", "short", 2, 0), (1, 20261005, "busy", "long", 2, 0), (1, 20261005, "unknown", "unknown", 2, 1)], "station_key int, date_key int, availability_status string, queue_level string, total_connectors int, source_key int")
    rep = spark.createDataFrame([(2, 20261005)], "station_key int, date_key int")
    rev = spark.createDataFrame([], "station_key int, date_key int, rating int")
    rows = {r.station_key: r for r in warehouse.daily_evidence(obs, rep, rev).collect()}
    assert abs(rows[1].availability_ratio - 1 / 3) < 1e-12 and abs(rows[1].avg_queue_score - (0.33 + 1) / 2) < 1e-12
    assert rows[1].source_count == 2 and abs(rows[1].data_completeness_score - 2 / 3) < 1e-12
    assert rows[2].availability_ratio is None and rows[2].avg_rating is None and rows[2].report_count == 1


def test_utc_keys_at_midnight(spark):
    df = spark.createDataFrame([("2026-10-05 23:59:00",), ("2026-10-06 00:01:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    d, k = warehouse.utc_keys(F.col("t"))
    assert [tuple(r) for r in df.select(d, k).collect()] == [(20261005, 95), (20261006, 0)]


def test_scd2_is_idempotent(spark):
    cols = "id int, name string, version int, effective_from timestamp, effective_to timestamp, is_current boolean"
    first = F.lit("2024-01-01").cast("timestamp")
    current = spark.createDataFrame([(1, "a", 1, None, None, True), (2, None, 1, None, None, True)], cols).withColumn("effective_from", first)
    new = spark.createDataFrame([(1, "b"), (2, ""), (3, "c")], "id int, name string")
    once = warehouse.scd2_sync(current, new, "id", ["name"], F.lit("2024-02-01").cast("timestamp"))
    twice = warehouse.scd2_sync(once, new, "id", ["name"], F.lit("2024-03-01").cast("timestamp"))
    got = sorted((r.id, r.name, r.version, r.is_current) for r in twice.collect())
    assert got == [(1, "a", 1, False), (1, "b", 2, True), (2, None, 1, True), (3, "c", 1, True)] or sorted(map(str, got)) == sorted(map(str, [(1, "a", 1, False), (1, "b", 2, True), (2, None, 1, True), (3, "c", 1, True)]))


def test_islands_and_asof(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate("aabbba")], "k int, t int, s string")
    runs = relational.islands(df, ["k"], [F.col("t")], "s").groupBy("run").count().orderBy("run").collect()
    assert [r["count"] for r in runs] == [2, 3, 1]
    v = spark.createDataFrame([(1, 0, "x"), (1, 3, "y")], "k int, since int, v string")
    e = spark.createDataFrame([(1, -1), (1, 0), (1, 2), (1, 3), (1, 9)], "k int, at int")
    assert [r.v for r in relational.asof_last(e, v, "k", "at", "v", "since").orderBy("at").collect()] == [None, "x", "x", "y", "y"]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 9)] + [(200, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 109)) and got[200] == 200


def test_grid_join_equals_all_pairs(spark):
    rng = random.Random(1)
    pts = [(i, 19 + rng.random() / 50, 72.8 + rng.random() / 50) for i in range(80)]
    df = spark.createDataFrame(pts, "id int, latitude double, longitude double")
    got = {(r.id_a, r.id_b) for r in geo.pairs_within(df, df, 300.0).collect()}
    a, b = df.toDF("a", "la", "lo"), df.toDF("b", "lb", "lc")
    want = {(r.a, r.b) for r in a.crossJoin(b).where(geo.haversine("la", "lo", "lb", "lc") <= 300).collect()}
    assert got == want and len(want) > 80


def _distance(a, b):
    p, q, dl = math.radians(a[1]), math.radians(b[1]), math.radians(b[2] - a[2])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(dl / 2) ** 2
    return 2 * geo.RADIUS_M * math.atan2(math.sqrt(min(1, h)), math.sqrt(max(0, 1 - h)))


@pytest.mark.parametrize("place,radius", [((70, 20), 3000.0), ((19, 180), 200.0), ((-70, -179.99), 3000.0), ((89.995, 0), 3000.0), ((-89.99, 90), 200.0)])
def test_pairs_and_neighbours_anywhere(spark, place, radius):
    """At high latitudes, over the 180th meridian and around the poles."""
    rng = random.Random(radius)
    lat, lon = place
    reach = radius / 30_000
    pts = []
    for i in range(60):
        y = max(-90.0, min(90.0, lat + rng.uniform(-1, 1) * reach))
        x = lon + rng.uniform(-1, 1) * min(180.0, reach / max(1e-3, math.cos(math.radians(y))))
        pts.append((i, y, (x + 180) % 360 - 180))
    df = spark.createDataFrame(pts, "id int, latitude double, longitude double")
    got = {(r.id_a, r.id_b) for r in geo.pairs_within(df, df, radius).collect()}
    near = {(a[0], b[0]) for a in pts for b in pts if _distance(a, b) <= radius}
    assert got == near and len(near) > 60
    best = {r.id_a: r for r in geo.nearest_other(df, start_m=radius / 4).collect()}
    for a in pts:
        want = min(_distance(a, b) for b in pts if b[0] != a[0])
        assert abs(best[a[0]].distance - want) < 1e-3
    here = geo.nearby(df.withColumnRenamed("id", "station_id"), lat, lon, radius, 100).collect()
    assert {r.station_id for r in here} == {p[0] for p in pts if _distance((0, lat, lon), p) <= radius}


def test_far_points_and_points_without_coordinates(spark):
    df = spark.createDataFrame([(1, 10.0, 10.0), (2, -10.0, -170.0), (3, None, 5.0)], "id int, latitude double, longitude double")
    got = {r.id_a: (r.neighbour, r.distance) for r in geo.nearest_other(df).collect()}
    assert got[1][0] == 2 and got[2][0] == 1 and abs(got[1][1] - math.pi * geo.RADIUS_M) < 1 and got[3] == (None, None)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_split_of_many_wide_rows(spark, adaptive):
    """Rows in equal rows out and the cuts are exact, whatever adaptive execution makes of the ranges."""
    n = 400_000
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        x = spark.range(0, n, 1, 16).select((F.col("id") * 7919 % n).alias("t"), F.sha2(F.col("id").cast("string"), 512).alias("a"), F.repeat(F.md5(F.col("id").cast("string")), 4).alias("b"))
        got = relational.chronological_split(x, [F.col("t")], (0.6, 0.2, 0.2), ("train", "valid", "test"))
        rows = {r.split: (r.n, r.lo, r.hi) for r in got.groupBy("split").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).collect()}
        assert rows == {"train": (240_000, 0, 239_999), "valid": (80_000, 240_000, 319_999), "test": (80_000, 320_000, 399_999)}
        assert relational.numbered(x, [F.col("t").desc()], "i").where("i <> 399999 - t").count() == 0
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_split_of_nothing(spark):
    assert relational.chronological_split(spark.range(0), [F.col("id")], (0.8, 0.2), ("a", "b")).count() == 0


def test_equal_events_load_as_often_as_they_come(spark):
    """Two versions that start together, a gap, and a date outside the calendar."""
    t = "timestamp_ntz"
    events = spark.createDataFrame([(1, "2024-01-05"), (1, "2024-01-05"), (1, "2024-02-01"), (1, "2023-12-31"), (2, "2024-01-05"), (1, "2030-01-01")], "k int, d string").select("k", F.col("d").cast(t).alias("at"))
    versions = spark.createDataFrame([(1, 10, "2024-01-01", "2024-01-01"), (1, 11, "2024-01-01", "2024-01-10"), (1, 12, "2024-01-03", "2024-01-04"), (1, 13, "2024-01-31", None)], "k int, version_key int, a string, b string")
    versions = versions.select("k", "version_key", F.col("a").cast(t).alias("effective_from"), F.col("b").cast(t).alias("effective_to"))
    loaded, rejected = warehouse.load_facts(events, versions, warehouse.calendar(spark, "2024-01-01", "2024-12-31"), "k", "at")
    assert sorted((r.k, str(r.at)[:10], r.version_key) for r in loaded.collect()) == [(1, "2024-01-05", 11), (1, "2024-01-05", 11), (1, "2024-02-01", 13)]
    assert sorted((r.k, str(r.at)[:10], r.reason) for r in rejected.collect()) == [(1, "2023-12-31", "date outside calendar"), (1, "2030-01-01", "date outside calendar"), (2, "2024-01-05", "no version at event time")]


def test_spans_in_days_over_a_month_end(spark):
    x = spark.createDataFrame([(1, "2024-01-31 00:00:00"), (1, "2024-02-01 12:00:00"), (2, "2024-01-31 00:00:00")], "k int, t string").select("k", F.col("t").cast("timestamp").alias("observed_at"))
    got = {r.k: (r.days, r.span_days) for r in learning.history_summary(x, "k").collect()}
    assert got == {1: (2, 1.5), 2: (1, 0.0)}


def test_upsert_takes_one_of_equal_new_keys(spark):
    t, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in relational.upsert(t, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_sudden_changes_need_a_run_of_ten(spark):
    states = "a" * 10 + "b" + "a" * 9 + "b" * 11 + "a"
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(states)], "k int, t int, s string")
    got = [(r.idx, r.from_state, r.to_state, r.stable_run) for r in relational.state_changes(df, ["k"], [F.col("t")], "s").orderBy("idx").collect()]
    assert got == [(10, "a", "b", 10), (31, "b", "a", 11)]


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    """A session that isn't local and has no spark.checkpoint.dir gets an error, not a folder of the driver."""
    from unittest.mock import MagicMock

    from voltmill.session import shared_folder

    s = MagicMock()
    scala = s.sparkContext._jsc.sc.return_value
    scala.getCheckpointDir.return_value.isDefined.return_value = False
    scala.isLocal.return_value = False
    s.conf.get.return_value = None
    with pytest.raises(RuntimeError):
        shared_folder(s)
    s.conf.get.return_value = "hdfs:///shared"
    shared_folder(s)
    s.sparkContext.setCheckpointDir.assert_called_once_with("hdfs:///shared")


def test_missing_coordinates_are_not_near(spark):
    df = spark.createDataFrame([(1, None, 72.0), (2, float("nan"), 72.0), (3, 19.0, 72.0)], "id int, a double, b double")
    got = {r.id: r.d for r in df.select("id", geo.haversine(19.0, 72.0, "a", "b").alias("d")).collect()}
    assert got[1] is None and got[2] is None and got[3] == 0.0


def test_lone_point_has_no_neighbour(spark):
    one = spark.createDataFrame([(1, 19.0, 72.0)], "id int, latitude double, longitude double")
    assert [r.neighbour for r in geo.nearest_other(one).collect()] == [None]


def test_gate_is_cold_without_rows(spark):
    none = spark.createDataFrame([], "station_key int, observed_at timestamp, is_simulated boolean")
    row = learning.gate_state(learning.maturity_evidence(none, F.lit("2024-01-01"))).first()
    assert row.state == "COLD" and "freshness" in row.failed


def test_open_hours_over_midnight(spark):
    df = spark.createDataFrame([("22:00", "06:00", 23 * 60), ("22:00", "06:00", 60), ("22:00", "06:00", 700), (None, None, 60)], "o string, c string, m int")
    assert [r[0] for r in df.select(station.open_now(F.lit(False), F.col("o"), F.col("c"), F.col("m"))).collect()] == [True, True, False, False]


def test_text_keys(spark):
    df = spark.createDataFrame([("Café — BKC #2",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.match_key(F.col("t"))).collect()] == ["cafe bkc 2", "", ""]


def test_estimates_and_hours(spark):
    df = spark.createDataFrame([("₹ 18 per kWh",), ("free",)], "t string")
    assert [r[0] for r in df.select(measures.price_estimate(F.col("t"))).collect()] == [18.0, None]


def test_greedy_caps_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, float(rng.randint(0, 50)), f"s{rng.randint(0, 3)}", f"c{rng.randint(0, 9)}") for i in range(300)]
    got = {r.id for r in mappings.greedy_capped(spark.createDataFrame(rows, "id int, score double, state string, city string"), 30, 6, 70).collect()}
    want, states, cities = set(), {}, {}
    for i, _, st, ct in sorted(rows, key=lambda r: (-r[1], r[0])):
        if len(want) < 70 and states.get(st, 0) < 30 and cities.get((st, ct), 0) < 6:
            want.add(i)
            states[st] = states.get(st, 0) + 1
            cities[(st, ct)] = cities.get((st, ct), 0) + 1
    assert got == want


def test_readers_and_sinks(spark, tmp_path):
    stations = [{"id": "a", "name": "A", "latitude": 19.0, "longitude": 72.0, "connectors": [{"id": "c1", "connector_type": "CCS2", "power_kw": 50.0, "quantity": 2}]}, {"id": "b", "name": "B"}]
    (tmp_path / "s.json").write_text(json.dumps(stations, indent=1))
    df = readers.read_station_json(spark, str(tmp_path / "s.json"))
    assert df.count() == 2 and readers.connectors_of(df).first().connector_type == "CCS2"
    (tmp_path / "s.csv").write_text("id,latitude,longitude\n1,19,72\n2,x,72\n3,,1\n")
    csv = readers.read_station_csv(spark, str(tmp_path / "s.csv"))
    assert [r.id for r in csv.collect()] == ["1"]
    readers.write_csv(csv, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1


def test_landed_pages(spark, tmp_path):
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    for i in range(3):
        (tmp_path / f"page_{i * 2}.json").write_text(json.dumps([{"id": i * 2 + k, "last_updated": f"2024-01-0{i + 1}"} for k in range(2)]))
    (tmp_path / "page_6.json").write_text('[{"id": 9}]')
    rows = readers.read_landed_pages(spark, str(tmp_path), "2024-01-02").collect()
    assert sorted((r.offset, json.loads(r.payload)["id"]) for r in rows) == [(2, 2), (2, 3), (4, 4), (4, 5), (6, 9)]
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.read_landed_pages(spark, str(tmp_path / "nothing")).collect()
    (tmp_path / "page_8.json").write_text("[{")
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.read_landed_pages(spark, str(tmp_path)).collect()


def test_run_record_hides_secrets(spark):
    row = readers.run_record(spark, "x", readers.run_state(0, 0, 0), {"fetched": 0}, "postgres://u:secret@h failed").first()
    assert row.state == "PARTIAL" and "secret" not in row.error


def test_stream_drops_replays_and_future_rows(spark, tmp_path):
    from voltmill.streaming import ingest

    src = tmp_path / "in"
    src.mkdir()
    row = {"observation_id": 1, "station_key": 1, "observed_at": "2024-01-01T10:00:00Z", "received_at": "2024-01-01T10:00:05Z", "availability_status": "busy", "source_payload_hash": "h"}
    future = row | {"observation_id": 3, "observed_at": "2024-01-01T11:00:00Z"}
    (src / "a.json").write_text("\n".join(json.dumps(r) for r in (row, row | {"observation_id": 2}, future)))
    q = ingest.append_batches(ingest.observations(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_greedy_thinning_equals_brute_force(spark):
    from voltmill.operators import ingestion

    rng = random.Random(4)
    pts = [(i, 19 + rng.random() / 200, 72.8 + rng.random() / 200) for i in range(120)]
    df = spark.createDataFrame(pts, "place long, latitude double, longitude double")
    got = {r.place: r.duplicate_of for r in ingestion.keep_first_apart(df, 60.0).collect()}
    a, b = df.toDF("a", "la", "lo"), df.toDF("b", "lb", "lc")
    near = {(r.a, r.b) for r in a.crossJoin(b).where("a < b").where(geo.haversine("la", "lo", "lb", "lc") < 60).collect()}
    kept = []
    for i, _, _ in pts:
        hits = [k for k in kept if (k, i) in near]
        assert got[i] == (hits[0] if hits else None)
        if not hits:
            kept.append(i)
    assert len(kept) < 110


def test_control_functions():
    from voltmill.operators import control as c

    assert [c.backoff_seconds(i) for i in (1, 2, 3, 20)] == [1.0, 2.0, 4.0, 60.0]
    assert c.backoff_seconds(1, retry_after=7) == 7.0 and c.backoff_seconds(2, uniform=lambda: 0.0) == 1.6
    assert [c.classify_failure(e) for e in (TimeoutError(), ValueError(), RuntimeError("HTTP 503"), RuntimeError("?"), RuntimeError("Unauthorized"))] == ["TRANSIENT", "PERMANENT", "TRANSIENT", "UNKNOWN", "PERMANENT"]
    assert [c.classify_failure(RuntimeError(m)) for m in ("HTTP 404", "got a 429", "status 400 from x", "connection closed", "missing API key")] == ["PERMANENT", "TRANSIENT", "PERMANENT", "TRANSIENT", "PERMANENT"] and c.classify_failure(None) == "UNKNOWN"
    w = c.FixedWindow(2, 10)
    assert [w.allow("k", t)[0] for t in (0, 1, 2, 11)] == [True, True, False, True]
    out = c.run_jobs([("a", lambda: {"skipped": 1}), ("b", lambda: 1 / 0), ("c", dict)])
    assert [x["state"] for x in out] == ["PARTIAL", "FAILED"]


def test_model_registry(tmp_path):
    from voltmill.operators.control import ModelRegistry, RegistryError

    r = ModelRegistry(str(tmp_path), ["a", "b"])
    r.save("v1", b"one", beats_baseline=True)
    r.save("v2", b"two", beats_baseline=False)
    r.save("v3", b"three", beats_baseline=True, synthetic=True)
    assert r.active() is None and r.approve("v1", "me")["approved"]
    for version in ("v2", "v3", "nope", "../x"):
        with pytest.raises(RegistryError):
            r.approve(version, "me")
    r.approve("v2", "me", reason="needed")
    assert r.active()["version"] == "v2" and r.roll_back("me")["version"] == "v1" and r.active()["version"] == "v1"
    (tmp_path / "v1.model").write_bytes(b"tampered")
    assert r.active() is None


def test_a_check_that_cannot_run_is_a_warning(spark):
    from voltmill.operators import quality

    t = spark.createDataFrame([(1, -2.0), (2, None)], "id int, power_kw double")
    good = quality.in_one_pass(lambda: t, [("R-1", "HIGH", F.col("power_kw") <= 0), ("R-2", "INFO", F.col("power_kw").isNull())])
    bad = quality.in_one_pass(lambda: t.select("nothing"), [("R-3", "HIGH", F.lit(True))])
    late = quality.in_one_pass(lambda: t, [("R-4", "HIGH", F.col("power_kw") <= 0), ("R-5", "HIGH", F.concat(F.lit("x"), F.col("id").cast("string")).cast("int") > 0)])
    got = {r.rule: (r.severity, r.offending, r.passed) for r in quality.run_checks(spark, [good, bad, late]).collect()}
    assert got == {"R-1": ("HIGH", 1, False), "R-2": ("INFO", 1, True), "R-3": ("WARNING", None, False), "R-4": ("HIGH", 1, False), "R-5": ("WARNING", None, False)}


def test_quarter_hour_counts_of_a_stream(spark, tmp_path):
    from voltmill.streaming import ingest

    src = tmp_path / "in"
    src.mkdir()
    row = {"observation_id": 1, "station_key": 1, "observed_at": "2024-01-01T10:01:00Z", "received_at": "2024-01-01T10:01:05Z", "availability_status": "busy", "source_payload_hash": "h"}
    rows = [row, row | {"observed_at": "2024-01-01T10:14:59Z", "received_at": "2024-01-01T10:15:00Z"}, row | {"observed_at": "2024-01-01T10:15:00Z", "received_at": "2024-01-01T10:15:00Z"}]
    (src / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    q = ingest.slot_counts(ingest.observations(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("slots").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.slot.start.minute, r.n) for r in spark.table("slots").collect()) == [(0, 2), (15, 1)]


def test_coordinates_that_survive(spark):
    """A lone record, equal places, close ones by quality then key, and a spread over 50 m in a chain."""
    rows = [
        (1, 10, "b", 19.0, 72.0, 0.1), (2, 20, "b", 19.0, 72.0, 0.9), (2, 21, "a", 19.0, 72.0, 0.1), (3, 30, "a", 19.0, 72.0, 0.1), (3, 31, "b", 19.0001, 72.0, 0.9), (3, 32, "c", 19.0001, 72.0, 0.9),
        (4, 40, "a", 19.0, 72.0, 0.9), (4, 41, "b", 19.0004, 72.0, 0.1), (4, 42, "c", 19.0008, 72.0, 0.1),
    ]
    from voltmill.operators import identity

    df = spark.createDataFrame(rows, "cluster int, id int, key string, latitude double, longitude double, quality double")
    got = {r.cluster: (r.strategy, r.coordinate_from, r.conflict) for r in identity.coordinate_survivors(df).collect()}
    assert got == {1: ("SINGLE_REPORTING_SOURCE", 10, False), 2: ("UNANIMOUS_AGREEMENT", 21, False), 3: ("HIGHEST_QUALITY", 31, False), 4: ("CONFLICT_UNRESOLVED", None, True)}


def test_a_dry_run_writes_nothing(spark):
    from voltmill.operators import persistence

    d = spark.createDataFrame([(1, "MERGE", None, False), (2, "LINK", "C", False), (3, "REVIEW", None, False), (4, "KEEP_SEPARATE", None, True), (5, "LINK", "C", False)], "cluster int, state string, canon_id string, blocked boolean")
    m = spark.createDataFrame([(1, "s", "1", "h1", "One", 1, "2024-01-01", "busy"), (1, "t", "1", "h1", "One A", 1, None, None), (2, "s", "2", "h2", "Two", 1, None, None), (3, "s", "3", "h3", "x", 1, "2024-01-01", "busy"), (5, "s", "5", "h5", "y", 1, None, None)], "cluster int, source_id string, source_station_id string, payload_hash string, name string, connectors int, observed_at string, availability_status string")
    links = spark.createDataFrame([("s", "5", "other", "h5", 1, "2023")], "source_id string, source_station_id string, station_id string, payload_hash string, connectors int, last_seen string")
    stations = spark.createDataFrame([("C", "Canon", "2023"), ("other", "Other", "2023")], "station_id string, name string, updated_at string")
    obs = spark.createDataFrame([], "station_id string, source_id string, payload_hash string, observed_at string, availability_status string")
    dry = persistence.persist(d, m, stations, links, obs, F.lit("2024"), dry_run=True)
    wet = persistence.persist(d, m, stations, links, obs, F.lit("2024"))
    assert dry["counters"].collect() == wet["counters"].collect() and dry["counters"].first().asDict() == {"stations_persisted": 1, "stations_updated": 0, "stations_unchanged": 0, "stations_linked": 1, "records_review_skipped": 1, "records_blocked": 1, "failed": 1, "observations_persisted": 1}
    assert dry["stations"].count() == 2 and dry["links"].count() == 1 and dry["observations"].count() == 0
    assert sorted(tuple(r) for r in wet["stations"].collect()) == [("C", "Two", "2024"), ("other", "Other", "2023"), ("station-1", "One A", "2024")]
    assert sorted((r.source_id, r.source_station_id, r.station_id, r.last_seen) for r in wet["links"].collect()) == [("s", "1", "station-1", "2024"), ("s", "2", "C", "2024"), ("s", "5", "other", "2023"), ("t", "1", "station-1", "2024")]
    assert [r.cluster for r in wet["rejects"].collect()] == [5] and wet["observations"].count() == 1
    again = persistence.persist(d, m, wet["stations"], wet["links"], wet["observations"], F.lit("2025"))
    assert again["counters"].first().stations_unchanged == 2 and again["counters"].first().observations_persisted == 0 and sorted(tuple(r) for r in again["stations"].collect()) == sorted(tuple(r) for r in wet["stations"].collect())
