"""Operators that compare documents with each other: brute force, invariants, edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from voltmill.llm import exact_dedup, line_dedup, mixing, ngram_join, sharding
from voltmill.llm.shared import dense_index, join_groups, running_sums

SCHEMA = "doc_id long, text string"


# 1: n-gram Jaccard join


def shingles(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(seed, groups=14, size=9, words=70):
    rng = random.Random(seed)
    rows, passage = [], [f"p{i}" for i in range(50)]
    for g in range(groups):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(rng.randint(3, words))]
        if g % 3 == 0:
            base = base + passage
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = f"n{rng.randint(0, 10**6)}"
            rows.append((rng.randint(0, 10**6), " ".join(w) if rng.random() > 0.2 else " ".join(w).upper()))
    return list({d: (d, t) for d, t in rows}.values())


@pytest.mark.parametrize("unit,heavy", [(1 << 21, 64), (300, 64), (300, 3), (1 << 21, 3)])
def test_components_equal_brute_force(spark, monkeypatch, unit, heavy):
    """Also with buckets in many blocks and with most shingles put last in the order."""
    monkeypatch.setattr(ngram_join, "UNIT_TOKENS", unit)
    monkeypatch.setattr(ngram_join, "HEAVY_DF", heavy)
    rows = near_copies(unit % 97 + heavy)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


def test_components_on_edge_rows(docs, empty):
    got = ngram_join.jaccard_components(docs).collect()
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert ngram_join.jaccard_components(empty).count() == 0
    kept = ngram_join.keep_rows(docs)
    assert kept.columns == docs.columns and {r["a.b"] for r in kept.collect()} == {"own"}
    assert ngram_join.keep_rows(empty).count() == 0


def test_sets_that_share_a_class(spark, monkeypatch):
    """With a first name of three bits nearly all sets share theirs; links and kept rows stay the same."""
    names = ngram_join.set_names
    monkeypatch.setattr(ngram_join, "set_names", lambda s: (names(s)[0] & 7, names(s)[1]))
    rows = near_copies(11, groups=8, size=5)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_components(rows)
    got = ngram_join.jaccard_components(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert {r.doc_id for r in ngram_join.keep_rows(df).collect()} == {c for _, _, c in want}


def test_hot_groups_are_joined_apart(spark):
    """Keys with many rows, with few, without a group, and without a key."""
    rows = [(i, 1) for i in range(9000)] + [(i, i) for i in range(20_000, 20_040)] + [(5, 77), (6, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, root long")
    groups = df.where("root <> 77").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("m"))
    got = Counter((r.doc_id, r.root, r.least) for r in join_groups(df, groups, "root", "m", ["least"], F.col("doc_id"), len(rows)).collect())
    assert got == Counter((d, r, {1: 0, 77: None, None: None}.get(r, r)) for d, r in rows)


def test_running_sums(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 7)
    got = running_sums(df.repartition(9), [F.col("id").desc()], {"before": "v"}, place="i").collect()
    assert len(got) == 500 and all(r.i == 499 - r.id and r.before == sum(k % 7 for k in range(r.id + 1, 500)) for r in got)
    assert running_sums(df.limit(0), [F.col("id")], {"before": "v"}).count() == 0


def test_memberships_of_frequent_shingles_go_to_many_parts():
    """Also where a batch has few; equal ones meet, and none is lost."""
    seen, rng = [], random.Random(2)
    rows = sorted({(rng.randrange(-9, 9), rng.randrange(-(1 << 63), 1 << 63), rng.randrange(1, 99)) for _ in range(3000)})
    for some in (rows, rows[::2]):
        part, keys, *packed = ngram_join._dealt(some, 5)
        assert keys.null_count == len(part) and len(set(part.to_pylist())) == len(part) == 32 and max(part.to_pylist()) == -1
        cols = [[ngram_join.unpack(x, kind).tolist() for x in p.to_pylist()] for p, kind in zip(packed, (np.int64, np.int64, np.uint32), strict=True)]
        seen.append({(p, *r) for p, *c in zip(part.to_pylist(), *cols, strict=True) for r in zip(*c, strict=True)})
        assert sorted(r[1:] for r in seen[-1]) == some
    assert seen[1] <= seen[0]
    assert max(Counter(r[0] for r in seen[0]).values()) < len(rows) / 8


def test_keep_rows_goes_by_id_and_class(spark):
    """Linked and unlinked rows of null ids, one id on several texts, and repeated rows."""
    text = lambda name, *last: " ".join([f"{name}{i}" for i in range(40)] + list(last))
    rows = [
        (None, text("a")), (1, text("a", "x")), (None, text("b")), (None, text("b", "y")), (None, text("c")), (None, None), (None, ""),
        (5, text("d")), (5, text("e")), (3, text("d", "z")), (7, text("f")), (7, text("f")), (7, text("F")), (8, text("f", "q")),
        (9, text("g")), (9, text("g", "r")), (9, text("h")), (2, text("i")), (2, text("j")), (4, text("i", "s")), (4, None), (4, None),
    ]
    got = Counter(ngram_join.keep_rows(spark.createDataFrame(rows, SCHEMA)).collect())
    heads = Counter((r.doc_id, (r.text or "-")[0].lower()) for r in got.elements())
    want = [(1, "a"), (None, "b"), (None, "c"), (None, "-"), (None, "-"), (5, "e"), (3, "d"), (7, "f"), (9, "g"), (9, "h"), (2, "i"), (2, "j"), (4, "-"), (4, "-")]
    assert heads == Counter(want)
    assert all(n <= Counter(rows)[tuple(r)] for r, n in got.items())


@pytest.mark.parametrize("seed", range(4))
def test_unit_links_every_pair(seed):
    """A hundred sets of mixed sizes: the trees find the components of all pairs."""
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(40):
        base = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64))
        for _ in range(rng.integers(1, 5)):
            keep = base[rng.random(len(base)) > rng.choice([0.0, 0.05, 0.2, 0.3])]
            sets.append(np.unique(np.concatenate((keep, rng.integers(0, 1 << 63, rng.integers(0, 5)).astype(np.uint64), base[:1]))))
    order = rng.permutation(len(sets))
    sets = [sets[i] for i in order]

    def roots(links):
        r = list(range(len(sets)))
        for a, b in links:
            x, y = r[a], r[b]
            r = [min(x, y) if v in (x, y) else v for v in r]
        return r

    py = [set(s.tolist()) for s in sets]
    true = [(i, j) for i in range(len(sets)) for j in range(i) if (o := len(py[i] & py[j])) and 100 * o >= 75 * (len(py[i]) + len(py[j]) - o)]
    assert roots(ngram_join.Unit(sets).join()) == roots(true)
    n = np.array([len(s) for s in sets])
    alive = ngram_join.alive(n, [ngram_join.signature(s) for s in sets], np.array([int(s[0] >> np.uint64(1)) for s in sets]))
    assert all(alive[i] and alive[j] for i, j in true)
    half = len(sets) // 2
    cross = ngram_join.Unit(sets, np.arange(len(sets)), half).join()
    assert roots(cross) == roots([(i, j) for i, j in true if (i < half) != (j < half)])


def test_units_give_stars():
    """Each linked class, or label, once with the least one of its component in the unit."""
    base = np.arange(100, 200, dtype=np.uint64)
    sets = {-5: base, 3: base[:-1], 8: base[1:], 20: base + np.uint64(1000), 21: base[:-2] + np.uint64(1000), 40: base + np.uint64(5000)}

    def stars(rows):
        cols = zip(*[(1, 0, probe, label, c, sets[c].tobytes()) for c, label, probe in rows], strict=True)
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["bucket", "block", "probe", "label", "class", "set"])
        return sorted(tuple(r.values()) for out in ngram_join._join_units(iter([batch])) for r in out.to_pylist())

    assert stars([(c, None, False) for c in sets]) == [(3, -5), (8, -5), (21, 20)]
    # Base rows of labels 7 and 9, probes of labels 2 and 4; 40 links with nothing.
    assert stars([(-5, 9, False), (20, 7, False), (3, 2, True), (8, 2, True), (21, 4, True), (40, 40, True)]) == [(7, 4), (9, 2)]


# 9: exact dedup


def brute_dedup(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for t, ids in groups.items():
        top = max((d for d in ids if d is not None), default=None)
        first = True
        for d in sorted(ids, key=str):
            keep = d == top and first
            first = first and not keep
            out.append((d, top, len(ids), keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_dedup_equals_brute_force(spark, docs, empty):
    rng = random.Random(5)
    rows = [(rng.randint(0, 300), rng.choice([None, "", "a", "b ", " b", "A", "long " * 500] + [f"t{i}" for i in range(60)])) for _ in range(400)] + [(None, "a"), (None, None)]
    for r in (rows, [(x.doc_id, x.text) for x in docs.collect()]):
        got = exact_dedup.decide(spark.createDataFrame(r, SCHEMA)).collect()
        assert sorted(((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in got), key=str) == brute_dedup(r)
    assert exact_dedup.decide(empty).count() == 0
    kept = exact_dedup.keep_rows(docs)
    assert kept.columns == docs.columns and kept.count() == docs.selectExpr("coalesce(text, '') t").distinct().count()
    assert {(r["__n"], r["a.b"]) for r in kept.collect()} == {("own", "own")} and exact_dedup.keep_rows(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 100, 5000, 60000])
def test_binary_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    f = exact_dedup.fuse_build(keys)
    assert exact_dedup.fuse_has(keys, *f).all()
    others = np.setdiff1d(rng.integers(0, 1 << 63, 20000).astype(np.uint64), keys)
    assert exact_dedup.fuse_has(others, *f).mean() < 0.01
    if n > 10000:
        assert len(f[3]) < 1.3 * n


# 3: line dedup


def edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return int(a != b) if a[i + 1 :] == b[i + 1 :] else 2
    return 1 if a[i:] == b[i + 1 :] else 2


def text_mark(text):
    """Spark's xxhash64 of a text."""
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def brute_lines(rows):
    """Dropped line numbers by id and text; rows of equal id and text count once."""
    order = sorted({(-1 if d is None else d, text_mark(t), t) for d, t in rows if t is not None})
    lines = [(d, t, i, x) for d, _, t in order for i, x in enumerate(t.split("\n")) if x.strip(" ")]
    want = defaultdict(list)
    for k, (d, t, i, x) in enumerate(lines):
        if any(edits(x, y) <= 1 for _, _, _, y in lines[:k]):
            want[(None if d < 0 else d, t)].append(i)
    return dict(want)


def check_lines(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_lines(rows)
    got = Counter((r.doc_id, r.n_lines, tuple(r.dropped)) for r in line_dedup.report(df).collect())
    assert got == Counter((d, sum(bool(x.strip(" ")) for x in (t or "").split("\n")), tuple(want.get((d, t), ()))) for d, t in rows)
    stripped = Counter(tuple(r) for r in line_dedup.strip_lines(df, line_dedup.dropped_lines(df)).collect())
    assert stripped == Counter((d, t if (d, t) not in want else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[(d, t)])) for d, t in rows)


@pytest.mark.parametrize("seed,shortest,longest", [(0, 1, 6), (1, 12, 20), (2, 14, 40)])
def test_lines_equal_brute_force(spark, seed, shortest, longest):
    """Lines of any length: one code point, around the number of blocks, and above it."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(shortest, longest))) for _ in range(12)]
    rows = []
    for d in range(50):
        lines = []
        for _ in range(rng.randint(0, 6)):
            s = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p, r = rng.randrange(len(s) + 1), rng.random()
                s = s[:p] + s[p + 1 :] if r < 0.3 else s[:p] + rng.choice("abxé") + (s[p:] if r < 0.6 else s[p + 1 :])
            lines.append(s)
        rows.append((d, "\n".join(lines) if lines else None))
    check_lines(spark, rows)


def test_lines_around_the_number_of_blocks(spark):
    """Fifteen and sixteen code points go the same way."""
    check_lines(spark, [(0, "hello brave one\nhello brave onf"), (1, "Hello brave ones\nHello brave onez"), (2, "a\nbc\nbcd\n\n   \nzz")])


def test_lines_of_equal_ids(spark):
    """No line goes that nothing equals; repeated rows are one document; null ids come first."""
    check_lines(spark, [(0, "line of B"), (1, "another, A"), (1, "line of B"), (1, "line of B"), (None, "first of all"), (None, "something else"), (2, "first of all!\nown"), (None, None)])


def test_lines_on_edge_rows(docs, empty):
    rows = {r.doc_id: r for r in line_dedup.report(docs).collect()}
    assert rows[4].n_lines == 0 and rows[9].n_lines == 30 and rows[9].n_dropped == 29 and rows[3].n_dropped == 0
    assert line_dedup.report(docs).count() == 15 and line_dedup.report(empty).count() == 0
    left = line_dedup.strip_lines(docs, line_dedup.dropped_lines(docs))
    assert left.columns == docs.columns and left.count() == 15 and {r["__gone"] for r in left.collect()} == {"own"}
    assert sorted(r.text for r in left.where("doc_id = 12").collect()) == ["one id, that text", "one id, this text"]
    assert line_dedup.strip_lines(empty, line_dedup.dropped_lines(empty)).count() == 0


# 7: mixing


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rng = random.Random(seed)
    sources = [f"s{i}" for i in range(7)] + [None]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 90])), rng.choices(sources, [60, 1, 1, 5, 5, 20, 5, 3])[0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    again = {r.doc_id: r for r in mixing.mix(df.repartition(7)).collect()}
    assert len(got) == 3000 and got == again
    sizes, taken, largest = Counter(), Counter(), Counter()
    for i, t, s in rows:
        n = len(t.split())
        r = got[i]
        assert r.size == n and r.taken <= 3 * n and (n == 0 or r.taken % n == 0)
        sizes[s] += n
        taken[s] += r.taken
        largest[s] = max(largest[s], n)
    want = brute_targets(sizes)
    for i, _, s in rows:
        assert got[i].source_size == sizes[s] and abs(got[i].target - want[s]) < 1e-6 * max(1, want[s])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_pivotal_expectation(spark):
    """Over many documents and some seeds a document's copies average to its share."""
    n, seeds = 400, 4
    rows = [(i, i % 5 + 1, "a") for i in range(n)] + [(1000 + i, 3, "b") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, size long, source string")
    total = Counter()
    for seed in range(seeds):
        for r in mixing.copies(df, seed)[1].collect():
            total[r.source] += r.copies / seeds / n
    t = brute_targets(Counter({"a": sum(r[1] for r in rows[:n]), "b": 3 * n}))
    assert abs(total["b"] - t["b"] / (3 * n)) < 0.05 and abs(total["a"] - t["a"] / (3 * n)) < 0.15


def test_targets_of_many_sources(spark):
    """As many sources as hosts: the level is found in ranges."""
    rng = random.Random(9)
    sizes = Counter({f"host{i:04d}": rng.choice([1, 2, 30, 700]) for i in range(1500)} | {None: 50})
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df.repartition(7)).collect()}
    want = brute_targets(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mix_on_edge_rows(docs, empty):
    assert mixing.mix(docs).count() == 15 and mixing.mix(empty).count() == 0
    assert mixing.mix(docs.where("doc_id IN (4, 5)")).count() == 2
    assert mixing.repeat_rows(empty).count() == 0
    out = mixing.repeat_rows(docs)
    assert out.columns == docs.columns and {r["m_k"] for r in out.collect()} == {"own"}
    assert sum(len((r.text or "").split()) for r in out.collect()) == sum(r.taken for r in mixing.mix(docs).collect())


def test_copies_are_numbered(spark):
    rows = [(i // 2 if i < 10 else i, "w " * 5 + str(i), "ab"[i % 7 == 0]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.repeat_rows(df, copy="copy").collect()
    assert len({(r.doc_id, r.source, r.copy) for r in out}) == len(out) > len({r.doc_id for r in out})
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in mixing.repeat_rows(df).collect())


# 10: sharding


def check_shards(rows, texts, shards=8):
    n = Counter(r.shard for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    counts = [n[s] for s in range(shards)]
    assert len(rows) == len(texts) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    return rows


def test_shards(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([f"t{rng.randint(0, 60)}", f"u{i}", f"u{i}é"])) for i in range(900)] + [(5000 + i, "hot") for i in range(500)]
    got = check_shards(sharding.assign(spark.createDataFrame(rows, SCHEMA)).collect(), rows)
    where = defaultdict(Counter)
    for r in got:
        where[(r.size, r.text_crc32)][r.shard] += 1
    cut = sum(sum(c.values()) - max(c.values()) for k, c in where.items() if sum(c.values()) < 100)
    edges = sum(sum(c.values()) - 1 for c in where.values() if sum(c.values()) < 100)
    assert cut < 0.15 * edges  # random shards cut about seven of eight
    assert max(where[(4, zlib.crc32(b"hot"))].values()) > 150


def spark_hash(*parts):
    """Spark's xxhash64 of ints (four bytes) and bytes."""
    h = 42
    for x in parts:
        h = xxhash.xxh64(x.to_bytes(4, "little", signed=True) if isinstance(x, int) else bytes(x), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def plain_propagation(state, quota, rounds=sharding.ROUNDS):
    """The rounds of label propagation over {(g, s): n}, one group at a time."""
    shards = len(quota)
    for r in range(rounds):
        late = r >= rounds - sharding.LATE
        held = [sum(n for (_, s), n in state.items() if s == t) for t in range(shards)]
        full = {t for t in range(shards) if late and held[t] >= 0.95 * quota[t]}
        rank = lambda g, s: (state[(g, s)], spark_hash(g, s))
        on = defaultdict(list)
        for g, s in state:
            on[g].append(s)
        to = {}
        for g, ss in on.items():
            top = max(ss, key=lambda s, g=g: rank(g, s))
            free = [s for s in ss if s not in full]
            nxt = max(free, key=lambda s, g=g: rank(g, s)) if free else None
            for s in ss:
                to[(g, s)] = top if not late else s if s in full and s == top else s if nxt is None else nxt
        flow = [[sum(n for (g, s), n in state.items() if s == a and to[(g, s)] == b) for b in range(shards)] for a in range(shards)]
        if not sum(flow[a][b] for a in range(shards) for b in range(shards) if a != b):
            if late:
                return state
            continue
        share = [1.0] * shards
        for _ in range(20):
            for t in range(shards):
                inflow = sum(flow[a][t] for a in range(shards) if a != t)
                outflow = sum(flow[t][u] * share[u] for u in range(shards) if u != t)
                share[t] = min(1.0, max(0.0, (quota[t] - held[t] + outflow) / inflow)) if inflow else 1.0
        new = Counter()
        for (g, s), n in state.items():
            t = to[(g, s)]
            let = share[t]
            u = spark_hash(sharding.SEED + r, g, s) % (1 << 52) / float(1 << 52)
            go = 0 if s == t else int(n * let) if n * let >= 64 else n if u < let else 0
            new[(g, s)] += n - go
            new[(g, t)] += go
        state = {k: n for k, n in new.items() if n}
    return state


@pytest.mark.parametrize("seed", range(2))
def test_propagation_equals_a_plain_one(spark, seed):
    rng = random.Random(seed)
    state = {}
    for k in range(60):
        g = hashlib.sha256(f"{seed} {k}".encode()).digest()
        for s in rng.sample(range(4), rng.randint(1, 4)):
            state[(g, s)] = rng.choice([1, 1, 2, 3, 9, 150 if k < 3 else 4])
    total = sum(state.values()) + 40
    quota = [total // 4 + (s < total % 4) for s in range(4)]
    df = spark.createDataFrame([(bytearray(g), s, n) for (g, s), n in state.items()], "g binary, s int, n long")
    moved = sharding.propagate(df, quota, 2)
    got = {(bytes(r.g), r.s): r.n for r in moved.collect()}
    assert got == plain_propagation(dict(state), quota)
    settled, held = sharding.settle(moved, quota)
    rows = {(bytes(r.g), r.s): r.n for r in settled.collect()}
    assert Counter(g for (g, _), n in rows.items() for _ in range(n)) == Counter(g for (g, _), n in state.items() for _ in range(n))
    assert held == [sum(n for (_, s), n in rows.items() if s == t) for t in range(4)] and all(h <= q for h, q in zip(held, quota, strict=True))


def test_settling_cuts_few_groups(spark):
    """All groups on one shard: the others are filled with whole groups but at their bounds."""
    rows = [(f"g{i:03d}".encode(), 0, 1 + i % 6) for i in range(200)]
    total = sum(n for _, _, n in rows)
    quota = [total // 4 + (s < total % 4) for s in range(4)]
    settled, held = sharding.settle(spark.createDataFrame(rows, "g binary, s int, n long"), quota)
    parts = Counter(bytes(r.g) for r in settled.collect())
    assert held == quota and sum(n > 1 for n in parts.values()) <= 4


def test_one_group_larger_than_all_shards(spark):
    rows = [(i, "same") for i in range(403)]
    check_shards(sharding.assign(spark.createDataFrame(rows, SCHEMA)).collect(), rows)


def test_shards_on_edge_rows(docs, empty):
    rows = sharding.assign(docs).collect()
    n = Counter(r.shard for r in rows)
    assert len(rows) == 15 and max(n.values()) == 2 and {r.law for r in rows} == {"rows"}
    assert sharding.assign(empty).count() == 0


def test_dense_index(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 700, F.lit("a")))
    rows = dense_index(df, ["g"], [F.col("id")], "i", 50).collect()
    assert sorted(r.i for r in rows if r.g == "a") == list(range(700)) and sorted(r.i for r in rows if r.g is None) == list(range(300))
