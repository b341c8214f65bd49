"""N-gram Jaccard join (1): exact links between shingle sets by signature trees.

How a link is found.  Shingles have one global order, frequent ones last and by hash within; two sets that
meet the threshold share a shingle among the first n - ceil(t n) + 1 of each (prefix filter).  Every list of
sets that share such a shingle is given to the bucket of its smallest set, so any linking pair meets in at
least one bucket, while a group of near copies, which shares hundreds of shingles, fills few buckets.

Each bucket's sets make a signature tree: a node holds the OR of its sets' token bitmaps, their range of
sizes and the largest number of tokens that share bits.  A dual traversal drops pairs of nodes whose largest
possible overlap is too small or whose sizes can't match.  The bitmaps alone first tell which sets can link
at all; only those sets travel.  Then trees of the sets themselves find the pairs to count exactly, skipping
nodes whose sets are linked to each other already.

A set goes to one of its buckets first; after the components of those links are known, only buckets that
still hold several components are joined in full: their largest component's sets, dealt into blocks of
about UNIT_TOKENS, with the sets outside it, which go to every block.

A set's class is a 64-bit name.  Each set has a second one, so two sets of one class show, and all but one of
them take a new class before anything is joined: a name stands for 128 bits.

Defined results: a null or empty text has an empty set and is linked with nothing; a text shorter than a
shingle counts as one shingle; equal sets link; repeated rows and equal ids are linked by their texts; a
null id never names a component that has another id; an empty table gives no rows; extra columns pass through
keep_rows, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import kernels as K
from .shared import cut, fresh, join_groups, named, parts

WIDTH = 5
NUM, DEN = 75, 100
#: A shingle in at least this many texts may be put last in the order.  At most HEAVY_KEYS of them are, or one for each
#: HEAVY_BYTES of a larger corpus, or MOST_HEAVY (8 MB, broadcast).  The bound shapes the order only; any order is exact.
HEAVY_DF, HEAVY_KEYS, HEAVY_BYTES, MOST_HEAVY = 64, 1 << 17, 1 << 18, 1 << 20
#: Most sets that share their class with another set; of 10^11 sets some hundreds are expected to.
MOST_RENAMED = 1 << 20
#: Tokens of a join unit, about: 16 MB of sets.
UNIT_TOKENS = 1 << 21
#: Bytes of text whose shingles one partition of the counting and prefix steps receives.
PART_BYTES = 24 << 20
FLUSH = 1 << 21


def shingle_sets(texts: pa.Array | pa.ChunkedArray, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text in turn."""
    for c in K.chunks(texts, fold=True):
        start, end, text = c.spans(K.SPACED)
        words = K.hash_spans(c.b, start, end)
        gram, first = K.ngrams(words, text, width)
        owner = text[first]
        edge = np.searchsorted(owner, np.arange(c.n + 1))
        n_words = np.bincount(text, minlength=c.n)
        word_edge = np.concatenate(([0], np.cumsum(n_words)))
        for i in range(c.n):
            if 0 < n_words[i] < width:
                a, b = word_edge[i], word_edge[i + 1]
                yield K.ngrams(words[a:b], text[a:b], int(b - a))[0]
                continue
            s = np.sort(gram[edge[i] : edge[i + 1]])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def set_class(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return set_names(s)[0]


def set_names(s: np.ndarray) -> tuple[int, int]:
    """Class and mark of a set: two signed 64-bit names that only together stand for the set."""
    with np.errstate(over="ignore"):
        a = s.sum(dtype=np.uint64)
        b = K.mix64(s + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        x = np.array([a ^ K.mix64(np.array([b]) + np.uint64(len(s)))[0], b ^ K.mix64(np.array([a]) + np.uint64(0x14057B7EF767814F))[0]])
        return tuple(K.mix64(x).view(np.int64).tolist())


def class_of(s: np.ndarray, renamed: dict[int, dict[int, int]]) -> int:
    """The class of a set after those that other sets share are given anew."""
    c = set_class(s)
    return renamed[c].get(set_names(s)[1], c) if c in renamed else c


def shared_classes(sets: DataFrame) -> dict[int, dict[int, int]]:
    """New classes, by class and mark, of all but one of the sets (class, mark) of each class that several sets have."""
    twice = sets.groupBy("class").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo < hi")
    if twice.isEmpty():
        return {}
    rows = sets.join(twice, "class").where("mark > lo").select("class", "mark").distinct().limit(MOST_RENAMED + 1).collect()
    if len(rows) > MOST_RENAMED:
        raise RuntimeError("more sets share a class than a good hash lets expect")
    out: dict[int, dict[int, int]] = {}
    for c, m in rows:
        x = K.mix64(np.array([c, m], np.int64).view(np.uint64))
        out.setdefault(c, {})[m] = int((x[:1] ^ (x[1:] >> np.uint64(1))).view(np.int64)[0])
    return out


def pack(a: np.ndarray) -> bytes:
    """The bytes of an array by place value, so that a compressor finds the leading ones alike."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _split(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition (the first bits) and key (the next 32 bits) of hashes."""
    part = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    return part, ((h >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _slices(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of equal values in an ascending array."""
    if len(part):
        head = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        for a, b in zip(head, np.append(head[1:], len(part)), strict=True):
            yield int(part[a]), int(a), int(b)


def heavy_shingles(texts: DataFrame, bits: int, most: int) -> np.ndarray:
    """The most frequent shingles, by their first 32 + bits bits, sorted; counted over all texts."""
    low, shift = HEAVY_DF, np.uint64(32 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            h = np.sort(np.concatenate(held) >> shift)
            head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            n = np.diff(np.append(head, len(h))).astype(np.uint32)
            part, key = _split(h[head] << shift, bits)
            rows = [(p, pack(key[a:b]), pack(n[a:b])) for p, a, b in _slices(part)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], ["part", "keys", "counts"])

        for batch in batches:
            held, total = [], 0
            for s in shingle_sets(batch.column(0)):
                if len(s):
                    held.append(s)
                    total += len(s)
                if total > FLUSH:
                    yield flush(held)
                    held, total = [], 0
            if held:
                yield flush(held)

    def add(t: pa.Table) -> pa.Table:
        key = np.concatenate([unpack(x, np.uint32) for x in t["keys"].to_pylist()])
        n = np.concatenate([unpack(x, np.uint32) for x in t["counts"].to_pylist()])
        order, head = K.runs(key)
        total = np.add.reduceat(n[order].astype(np.int64), head)
        often = total >= low
        k = (np.int64(t["part"][0].as_py()) << np.int64(32)) | key[order][head][often].astype(np.int64)
        return pa.table({"key": k, "df": total[often]})

    counted = texts.mapInArrow(K.tidy(count), "part int, keys binary, counts binary").groupBy("part").applyInArrow(add, "key long, df long")
    top = counted.orderBy(F.desc("df"), "key").limit(most).toArrow()
    return np.sort(top["key"].to_numpy().astype(np.uint64))


def prefix(s: np.ndarray, heavy: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(t n) + 1 shingles of a set in the global order: those that aren't heavy, and heavy ones."""
    p = len(s) - -(-NUM * len(s) // DEN) + 1
    if not len(heavy):
        return s[:p], s[:0]
    k = s >> np.uint64(32 - bits)
    at = np.searchsorted(heavy, k)
    is_heavy = heavy[np.minimum(at, len(heavy) - 1)] == k
    light = s[~is_heavy][:p]
    return light, s[is_heavy][: p - len(light)]


def documents_and_leaders(docs: DataFrame, heavy, bits: int) -> DataFrame:
    """Rows (doc_id, class, mark, n, map) of the documents, and rows (key, class) with the least class seen with a heavy prefix shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = heavy.value
        for batch in batches:
            cls, mark, n, key, least, maps = [], [], [], [], [], []
            for s in shingle_sets(batch.column(1)):
                c, m = set_names(s) if len(s) else (0, 0)
                cls.append(c)
                mark.append(m)
                n.append(len(s))
                maps.append(signature(s) if len(s) else b"")
                _, h = prefix(s, rare, bits) if len(s) else (s, s)
                key.append(h)
                least.append(np.full(len(h), cls[-1], np.int64))
            m = len(cls)
            k, c = np.concatenate([np.zeros(0, np.uint64), *key]) >> np.uint64(32 - bits), np.concatenate([np.zeros(0, np.int64), *least])
            order, head = K.runs(k)
            if len(head):
                k, c = k[order][head], np.minimum.reduceat(c[order], head)
            w = len(k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column(0), pa.nulls(w, pa.int64())]),
                    pa.concat_arrays([pa.array(cls, pa.int64()), pa.array(c, pa.int64())]),
                    pa.concat_arrays([pa.array(mark, pa.int64()), pa.nulls(w, pa.int64())]),
                    pa.concat_arrays([pa.array(n, pa.int32()), pa.nulls(w, pa.int32())]),
                    pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(k.astype(np.int64))]),
                    pa.concat_arrays([pa.array(maps, pa.binary()), pa.nulls(w, pa.binary())]),
                ],
                ["doc_id", "class", "mark", "n", "key", "map"],
            )

    return docs.mapInArrow(K.tidy(run), "doc_id long, class long, mark long, n int, key long, map binary")


def _dealt(rows: list[tuple[int, int, int]], bits: int) -> list[pa.Array]:
    """Memberships (bucket, class, n) as columns part, no keys, and packed ones.

    Parts are below 0 and dealt by class, as many as those of the other shingles, so that no one gathers all;
    equal memberships meet in one part.
    """
    b, c, n = (np.array([r[k] for r in rows], kind) for k, kind in ((0, np.int64), (1, np.int64), (2, np.uint32)))
    salt = -1 - _split(K.mix64(c.view(np.uint64)), bits)[0]
    order = np.argsort(salt, kind="stable")
    runs = list(_slices(salt[order]))
    packed = [pa.array([pack(x[order[i:j]]) for _, i, j in runs], pa.binary()) for x in (b, c, n)]
    return [pa.array([p for p, _, _ in runs], pa.int32()), pa.nulls(len(runs), pa.binary()), *packed]


def members(texts: DataFrame, heavy, leaders, renamed, bits: int) -> DataFrame:
    """Distinct (bucket, class, n): every set of a list of sets that share a prefix shingle, in the bucket of its least set."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, lead, new = heavy.value, leaders.value, renamed.value
        names = ["part", "keys", "at", "classes", "sizes"]

        def flush(keys: list, at: list, cls: list, sizes: list) -> pa.RecordBatch:
            h, i = np.concatenate(keys), np.concatenate(at)
            order = np.argsort(h)
            h, i = h[order], i[order]
            part, key = _split(h, bits)
            c, n, rows = np.array(cls, np.int64), np.array(sizes, np.uint32), []
            for p, a, b in _slices(part):
                own, place = np.unique(i[a:b], return_inverse=True)
                rows.append((p, pack(key[a:b]), pack(place.astype(np.uint32)), pack(c[own]), pack(n[own])))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5))], names)

        for batch in batches:
            keys, at, cls, sizes, total, own = [], [], [], [], 0, set()
            for s in shingle_sets(batch.column(0)):
                if not len(s):
                    continue
                light, h = prefix(s, rare, bits)
                c = class_of(s, new)
                if len(h):
                    own |= {(int(b), c, len(s)) for b in np.unique(lead[np.searchsorted(rare, h >> np.uint64(32 - bits))])}
                if len(light):
                    keys.append(light)
                    at.append(np.full(len(light), len(cls), np.uint32))
                    cls.append(c)
                    sizes.append(len(s))
                    total += len(light)
                if total > FLUSH:
                    yield flush(keys, at, cls, sizes)
                    keys, at, cls, sizes, total = [], [], [], [], 0
            if keys:
                yield flush(keys, at, cls, sizes)
            if own:  # of heavy shingles the bucket is known here
                yield pa.RecordBatch.from_arrays(_dealt(sorted(own), bits), names)

    def gather(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        if rows[0]["keys"] is None:
            b, c, n = (np.concatenate([unpack(r[k], kind) for r in rows]) for k, kind in (("at", np.int64), ("classes", np.int64), ("sizes", np.uint32)))
        else:
            key = np.concatenate([unpack(r["keys"], np.uint32) for r in rows])
            c = np.concatenate([unpack(r["classes"], np.int64)[unpack(r["at"], np.uint32)] for r in rows])
            n = np.concatenate([unpack(r["sizes"], np.uint32)[unpack(r["at"], np.uint32)] for r in rows])
            order, head = K.runs(key)
            shared = np.repeat(np.diff(np.append(head, len(key))) > 1, np.diff(np.append(head, len(key))))
            order = order[shared]
            key, c, n = key[order], c[order], n[order]
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else head[:0]
            size = np.diff(np.append(head, len(key)))
            low = np.minimum.reduceat(c, head) if len(head) else c
            mixed = np.repeat(low != (np.maximum.reduceat(c, head) if len(head) else c), size)
            b = np.repeat(low, size)[mixed]
            c, n = c[mixed], n[mixed]
        both = np.unique(np.stack((b, c, n.astype(np.int64))), axis=1)
        return pa.table({"bucket": both[0], "class": both[1], "n": both[2]})

    blobs = texts.mapInArrow(K.tidy(emit), "part int, keys binary, at binary, classes binary, sizes binary")
    return blobs.groupBy("part").applyInArrow(gather, "bucket long, class long, n long").distinct()


def signature(s: np.ndarray) -> bytes:
    """Token bitmap of a set: one bit for each hash value modulo the first power of two from n on."""
    bits = 1 << int(np.clip(int(len(s) - 1).bit_length(), 6, 16))
    on = np.zeros(bits, bool)
    on[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(on, bitorder="little").tobytes()


def needs(a, b):
    """Least overlap of linking sets of sizes a and b."""
    return -(-NUM * (a + b) // (NUM + DEN))


def build_tree(ids: np.ndarray, n: np.ndarray, maps: np.ndarray, near: np.ndarray) -> list[dict]:
    """Levels from leaves to the root; node k of a level has nodes 8k to 8k + 7 of the one below.

    Leaves lie by size, and by near within like sizes.
    """
    order = np.lexsort((near, np.floor(np.log(n) / np.log(DEN / NUM) * 2)))
    n, maps = n[order], maps[order]
    levels = [{"map": maps, "lo": n, "hi": n, "spare": n - np.bitwise_count(maps).sum(axis=1, dtype=np.int64), "ids": ids[order]}]
    while len(levels[-1]["lo"]) > 1:
        x = levels[-1]
        head = np.arange(0, len(x["lo"]), 8)
        levels.append({"map": np.bitwise_or.reduceat(x["map"], head), "lo": np.minimum.reduceat(x["lo"], head), "hi": np.maximum.reduceat(x["hi"], head), "spare": np.maximum.reduceat(x["spare"], head)})
    return levels


def spread(levels: list[dict], value: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Least and greatest value below each node."""
    out = [(value[levels[0]["ids"]],) * 2]
    for _ in levels[1:]:
        head = np.arange(0, len(out[-1][0]), 8)
        out.append((np.minimum.reduceat(out[-1][0], head), np.maximum.reduceat(out[-1][1], head)))
    return out


def dual(a: list[dict], b: list[dict] | None, value: np.ndarray, done, leaves) -> None:
    """Visit the pairs of leaves of two trees (or of one with itself, b None) that may link.

    done(lo_i, hi_i, lo_j, hi_j) tells from the values below two nodes that no pair is needed; leaves(i, j)
    gets ids and may change value, in place, and returns whether it did.
    """
    self_join = b is None
    b = a if b is None else b
    a, b = a + [a[-1]] * (len(b) - len(a)), b + [b[-1]] * (len(a) - len(b))
    na, nb = [len(x["lo"]) for x in a], [len(x["lo"]) for x in b]

    def spreads() -> tuple[list, list]:
        return tuple((v := spread([y for k, y in enumerate(x) if not k or y is not x[k - 1]], value)) + [v[-1]] * (len(x) - len(v)) for x in (a, b))

    sa, sb = spreads()
    stack = [(len(a) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        x, y = a[level], b[level]
        ok = (DEN * x["hi"][i] >= NUM * y["lo"][j]) & (DEN * y["hi"][j] >= NUM * x["lo"][i])
        ok &= ~done(sa[level][0][i], sa[level][1][i], sb[level][0][j], sb[level][1][j])
        i, j = i[ok], j[ok]
        most = np.bitwise_count(x["map"][i] & y["map"][j]).sum(axis=1, dtype=np.int64) + np.minimum(x["spare"][i], y["spare"][j])
        ok = most >= needs(x["lo"][i], y["lo"][j])
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if level == 0:
            if self_join:
                i, j = i[i < j], j[i < j]
            if len(i) and leaves(x["ids"][i], y["ids"][j]):
                sa, sb = spreads()
            continue
        for at, (node, n_now, n_below, up) in enumerate(((i, na[level], na[level - 1], a[level] is a[level - 1]), (j, nb[level], nb[level - 1], b[level] is b[level - 1]))):
            child = node[:, None] if up else node[:, None] * 8 + np.arange(8)
            if at == 0:
                left, left_ok = child, child < n_below
            else:
                right, right_ok = child, child < n_below
        ni = np.broadcast_to(left[:, :, None], (len(i), left.shape[1], right.shape[1])).ravel()
        nj = np.broadcast_to(right[:, None, :], (len(i), left.shape[1], right.shape[1])).ravel()
        ok = (left_ok[:, :, None] & right_ok[:, None, :]).ravel()
        if self_join:
            ok &= ni <= nj
        ni, nj = ni[ok], nj[ok]
        step = max(64, (1 << 19) // max(1, x["map"].shape[1]))
        for k in range(0, len(ni), step):
            stack.append((level - 1, ni[k : k + step], nj[k : k + step]))


def alive(n: np.ndarray, maps: list[bytes], near: np.ndarray) -> np.ndarray:
    """Which sets may link with another one, as far as their bitmaps tell."""
    m, out = len(n), np.zeros(len(n), bool)
    if m <= 12:
        bits = [8 * len(x) for x in maps]
        value = [int.from_bytes(x, "little") for x in maps]
        spare = [int(n[i]) - value[i].bit_count() for i in range(m)]
        for i in range(m):
            for j in range(i + 1, m):
                if out[i] and out[j] or DEN * min(n[i], n[j]) < NUM * max(n[i], n[j]):
                    continue
                x, y, w = value[i], value[j], min(bits[i], bits[j])
                if bits[i] > w:
                    x = (x | x >> w) & (1 << w) - 1
                if bits[j] > w:
                    y = (y | y >> w) & (1 << w) - 1
                most = (x & y).bit_count() + (min(spare[i], spare[j]) if bits[i] == bits[j] else min(int(n[i]) - x.bit_count(), int(n[j]) - y.bit_count()))
                if most >= needs(int(n[i]), int(n[j])):
                    out[i] = out[j] = True
        return out
    # Sets that may link have bitmaps of equal or neighbouring widths; a wider one is folded.
    value = np.zeros(m, np.int64)

    def leaves(i: np.ndarray, j: np.ndarray) -> bool:
        value[i] = 1
        value[j] = 1
        return True

    def done(lo_i, _hi_i, lo_j, _hi_j):
        return (lo_i == 1) & (lo_j == 1)

    width = np.array([len(x) // 8 for x in maps])
    tree = {}
    for w in np.unique(width):
        ids = np.flatnonzero(width == w)
        own = np.stack([np.frombuffer(maps[i], np.uint64) for i in ids])
        tree[w] = build_tree(ids, n[ids], own, near[ids])
        dual(tree[w], None, value, done, leaves)
        if w // 2 in tree and w > 1:
            folded = own[:, : w // 2] | own[:, w // 2 :]
            dual(tree[w // 2], build_tree(ids, n[ids], folded, near[ids]), value, done, leaves)
    return value == 1


class Unit:
    """Sets to be joined with each other, or the first ones (bases) with the others (probes)."""

    def __init__(self, sets: list[np.ndarray], label: np.ndarray | None = None, bases: int | None = None):
        self.n = np.array([len(s) for s in sets], np.int64)
        self.sets, self.bases = sets, bases
        self.root = np.arange(len(sets))
        self.links: list[tuple[int, int]] = []
        if label is not None:
            _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
            self.root = first[inverse.ravel()]

    def overlaps(self, i: int, many: np.ndarray) -> np.ndarray:
        flat = np.concatenate([self.sets[j] for j in many])
        one = self.sets[i]
        at = np.searchsorted(one, flat)
        hit = one[np.minimum(at, len(one) - 1)] == flat
        return np.add.reduceat(hit, np.concatenate(([0], np.cumsum(self.n[many])[:-1])), dtype=np.int64)

    def compare(self, i: int, many: np.ndarray) -> bool:
        """Count the overlap of set i with each of many that isn't linked to it yet, and link."""
        known = len(self.links)
        many = many[self.root[many] != self.root[i]]
        many = many[DEN * np.minimum(self.n[many], self.n[i]) >= NUM * np.maximum(self.n[many], self.n[i])]
        if len(many):
            hit = many[self.overlaps(i, many) >= needs(self.n[i], self.n[many])]
            if len(hit):
                merged, first = np.unique(self.root[hit], return_index=True)
                self.links += [(i, int(j)) for j in hit[first]]
                merged = np.append(merged, self.root[i])
                self.root[np.isin(self.root, merged)] = merged.min()
        return len(self.links) > known

    def join(self) -> list[tuple[int, int]]:
        m = len(self.sets)
        if m < 2:
            return []
        if self.bases is None:
            if m <= 12:
                for i in range(m - 1):
                    self.compare(i, np.arange(i + 1, m))
                return self.links
            for _ in range(3):  # a few stars link most of a group of near copies
                ids, size = np.unique(self.root, return_counts=True)
                alone = ids[size == 1]
                if len(alone):
                    self.compare(int(alone[len(alone) // 2]), np.arange(m))
            dual(self.tree(np.arange(m)), None, self.root, self._linked, self._leaves)
        elif 0 < self.bases < m:
            dual(self.tree(np.arange(self.bases)), self.tree(np.arange(self.bases, m)), self.root, self._linked, self._leaves)
        return self.links

    @staticmethod
    def _linked(lo_i, hi_i, lo_j, hi_j):
        return (lo_i == hi_i) & (lo_j == hi_j) & (lo_i == lo_j)

    def _leaves(self, i: np.ndarray, j: np.ndarray) -> bool:
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        return any([self.compare(v, j[p:q]) for v, p, q in _slices(i)])

    def tree(self, ids: np.ndarray) -> list[dict]:
        bits = 1 << int(np.clip(np.ceil(np.log2(max(2, np.median(self.n) * 2))), 8, 13))
        maps = np.zeros((len(ids), bits // 64), np.uint64)
        for r, i in enumerate(ids):
            at = np.unique(self.sets[i] & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(maps[r], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        return build_tree(ids, self.n[ids], maps, np.array([self.sets[i][0] for i in ids]))


def _by_unit(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[list[dict]]:
    """Runs of rows of equal key; rows come sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(held[0][k] != row[k] for k in key):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _join_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each unit's components as stars: every class, or label where given, with the least one linked to it.  Bases come before probes."""
    for rows in _by_unit(batches, ("bucket", "block")):
        if len(rows) < 2:
            continue
        label = np.array([r["label"] for r in rows], np.int64) if rows[0]["label"] is not None else None
        unit = Unit([np.frombuffer(r["set"], np.uint64) for r in rows], label, None if label is None else sum(not r["probe"] for r in rows))
        if unit.join():
            name = np.array([r["class"] for r in rows], np.int64) if label is None else label
            least = name.copy()
            np.minimum.at(least, unit.root, name)
            star = np.unique(np.stack([name, least[unit.root]], 1)[name != least[unit.root]], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(star[:, 0]), pa.array(star[:, 1])], ["a", "b"])


def _links(rows: DataFrame) -> DataFrame:
    """Stars (a, b) of the units of rows (bucket, block, probe, label, class, set)."""
    dealt = rows.repartition(parts(rows), "bucket", "block").sortWithinPartitions("bucket", "block", "probe", "class")
    return dealt.mapInArrow(K.tidy(_join_units), "a long, b long")


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each bucket that its signature tree leaves."""
    out: list[tuple[int, int, int]] = []
    for rows in _by_unit(batches, ("bucket",)):
        if len(rows) > 1:
            n = np.array([r["n"] for r in rows], np.int64)
            stay = alive(n, [r["map"] for r in rows], np.array([r["class"] for r in rows]))
            out += [(rows[i]["bucket"], rows[i]["class"], rows[i]["n"]) for i in np.flatnonzero(stay)]
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["bucket", "class", "n"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["bucket", "class", "n"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of a table of links (a, b): the least node that it reaches.

    Labels move to neighbours and then jump to their label's label until none changes.
    """
    both = cut(links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.where("a <> b").select("b", "a")).distinct())
    label = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l"))
    label = cut(label)
    while True:
        near = both.join(label.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        step = label.join(near, "u").select("u", F.least("l", "m").alias("l"), F.col("l").alias("old"))
        jump = step.join(label.select(F.col("u").alias("l"), F.col("l").alias("ll")), "l", "left")
        new = cut(jump.select("u", F.least("l", F.coalesce("ll", "l")).alias("l"), "old"))
        if new.where("l < old").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("l").alias("root"))
        label = new.select("u", "l")


def link_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame, dict[int, dict[int, int]]]:
    """Documents (doc_id, class, n), the components (node, root) of linked classes, and renamed classes, of docs (doc_id, text).

    A class that is its component's root may be missing from the components.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = docs.select("text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(20, max(total / PART_BYTES, parts(docs) / 4, 1).__ceil__().bit_length())
    top = heavy_shingles(texts, bits, max(HEAVY_KEYS, min(MOST_HEAVY, total // HEAVY_BYTES)))
    heavy = spark.sparkContext.broadcast(top)
    found = cut(documents_and_leaders(docs, heavy, bits))
    sets_of = found.where("n IS NOT NULL")
    new = shared_classes(sets_of.where("n > 0").select("class", "mark"))
    renamed = spark.sparkContext.broadcast(new)
    if new:
        entries = [(c, m, x) for c, by in new.items() for m, x in by.items()]
        given = F.broadcast(spark.createDataFrame(entries, "class long, mark long, given long"))  # at most MOST_RENAMED rows
        sets_of = cut(sets_of.join(given, ["class", "mark"], "left").withColumn("class", F.coalesce("given", "class")).drop("given"))
    table = sets_of.select("doc_id", "class", "n")
    lead = found.where("n IS NULL").groupBy("key").agg(F.min("class").alias("class")).toArrow()  # as many rows as heavy shingles at most
    led = np.zeros(len(top), np.int64)
    led[np.searchsorted(top, lead["key"].to_numpy().astype(np.uint64))] = lead["class"].to_numpy()
    leaders = spark.sparkContext.broadcast(led)
    member = cut(members(texts, heavy, leaders, renamed, bits))

    # Signature trees drop what can't link.  A bucket too large for one tree keeps all its members.
    bucket = member.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("tokens")).where("m > 1")
    member = cut(member.join(bucket, "bucket"))
    fits = F.col("tokens") <= F.lit(32 * UNIT_TOKENS)
    one = sets_of.where("n > 0").select("class", "map").groupBy("class").agg(F.min("map").alias("map"))
    small = member.where(fits).select("bucket", "class", "n").join(one, "class")
    small = small.repartition(parts(docs), "bucket").sortWithinPartitions("bucket", "class").mapInArrow(K.tidy(_prune), "bucket long, class long, n long")
    member = cut(small.union(member.where(~fits).select("bucket", "class", F.col("n").cast("long"))))

    # Of each class that is left one text is read again; its set is kept.
    live = member.select("class").distinct()
    chosen = table.where("n > 0").join(live, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("id"))
    again = docs.join(chosen.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id"))).select("class", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task's share of the classes
        given = renamed.value
        for batch in batches:
            cls, sets = [], []
            for want, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                if len(s) and want not in seen and class_of(s, given) == want:
                    seen.add(want)
                    cls.append(want)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], ["class", "set"])

    sets = cut(again.mapInArrow(K.tidy(encode), "class long, set binary"))
    weight = member.groupBy("bucket").agg(F.sum("n").alias("tokens")).select("bucket", F.ceil(F.col("tokens") / F.lit(UNIT_TOKENS)).cast("int").alias("blocks"))
    member = cut(member.join(weight, "bucket").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")))

    # First each set in one of its buckets only; then buckets that still hold several components, in full.
    home = member.groupBy("class").agg(F.min(F.struct("bucket", "block")).alias("h")).select("class", "h.*")
    first = home.select("bucket", "block", F.lit(False).alias("probe"), F.lit(None).cast("long").alias("label"), "class")
    # Those units share no class, so their stars are whole components.
    reach = cut(_links(first.join(sets, "class"))).toDF("node", "root")
    labelled = member.join(reach.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("label", F.coalesce("root", "class")).drop("root")
    sides = labelled.groupBy("bucket", "label").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.count("*").alias("sides"))
    labelled = cut(labelled.join(sides.where("sides > 1"), "bucket"))
    base = labelled.select("bucket", "block", F.lit(False).alias("probe"), "label", "class")
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    probes = labelled.where("label <> main").select("bucket", F.explode(blocks).alias("block"), F.lit(True).alias("probe"), "label", "class")
    more = cut(_links(base.union(probes).join(sets, "class")))
    if more.isEmpty():
        return table, reach, new
    # Labels that met are joined in a graph of labels only; members follow their label.
    merged = components(more)
    moved = reach.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return table, cut(moved.union(merged)), new


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least id reached by links)."""
    table, reach, _ = link_documents(docs)
    rows = table.join(reach, table["class"] == reach["node"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "class").alias("root"))
    least = rows.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("m"))
    # A row without shingles joins nothing, by a key of its own.
    dealt = rows.withColumn("root", F.when(F.col("n_shingles") > 0, F.col("root")))
    out = join_groups(dealt, least, "root", "m", ["component_id"], F.col("doc_id"), table.count())
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_rows(docs: DataFrame) -> DataFrame:
    """One row of each component, one of those with the least id, with all columns; texts without words all stay.

    Rows go by id and class, so a row that only shares its id, or null, with a linked one stays.  A component
    of null ids only keeps one of them.
    """
    table, reach, new = link_documents(docs)
    renamed = docs.sparkSession.sparkContext.broadcast(new)

    @F.arrow_udf(LongType())
    def name(text: pa.Array) -> pa.Array:
        """The class of each text's set, as link_documents names it."""
        return pa.array([class_of(s, renamed.value) if len(s) else 0 for s in shingle_sets(text)], pa.int64())

    rows = table.where("n > 0").join(reach, table["class"] == reach["node"], "left").select("doc_id", "class", F.coalesce("root", "class").alias("root"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")
    best = rows.groupBy("root").agg(F.min(place).alias("best"), F.count("*").alias("m")).where("m > 1")
    own, id_, code, nth = fresh(docs, "own_class", "drop_id", "drop_class", "nth")
    linked = join_groups(rows, best, "root", "m", ["best"], F.col("doc_id"), table.count()).where("best IS NOT NULL")
    linked = linked.groupBy(F.col("doc_id").alias(id_), F.col("class").alias(code)).agg(F.max(place == F.col("best")).alias("first"), F.count("*").alias("times"))
    linked = cut(linked.where("NOT first OR times > 1"), max(1, parts(docs) // 8))
    tagged = docs.withColumn(own, name(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(code))
    cols = [named(c) for c in docs.columns]
    out = tagged.join(linked.select(id_, code).hint("shuffle_hash"), same, "left_anti").select(*cols)
    several = linked.where("first").select(id_, code)
    if several.isEmpty():
        return out
    order = F.row_number().over(W.partitionBy(id_, code).orderBy("text"))
    one = tagged.join(several.hint("shuffle_hash"), same).withColumn(nth, order).where(F.col(nth) == 1)
    return out.union(one.select(*cols))
