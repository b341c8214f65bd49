"""SentencePiece encoding and decoding (6): seeded merge-dropout over a BPE piece model.

A text is cut into units, each a run of spaces with what follows it; no piece crosses a unit.  In each unit
the agenda repeatedly takes the candidate merge of the best score (the leftmost of equals) and skips it for
good where a keyed hash of seed, document, copy, place, unit and the merge's span says so, so every occurrence
of a unit draws its own skips.  The hash doesn't depend on when the agenda gets to a candidate, so it is taken
when the candidate is made.  All units of a chunk run in step, in numpy.  Equal units are merged once without
skips; an occurrence that skips none of the merges made there has the same pieces, as a skipped candidate that
is never the best changes nothing.  The other occurrences run on their own.

Characters without a piece become byte pieces; so does U+2581 itself, which else would decode as a space.
Decoding therefore gives every text back.  With dropout 0 ids equal those of the sentencepiece library.

Defined results: null is encoded like the empty text, to no ids; repeated rows of equal copy number give equal
ids; texts of any length are read whole, in segments that end before a space; an empty table gives no rows; other
columns pass through where asked for, whatever their names; one called ids, n_ids or lossless gets kept_ before it.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import mix64, tidy
from .shared import fields, named

DROPOUT, SEED = 0.1, 1234
CHUNK_CHARS = 1 << 17
LONG_UNIT = 256
_SPACE = 0x20
_NEVER = np.iinfo(np.int64).max
_BASE = 0xD6E8FEB86659FD93


def default_model() -> str:
    """Where the installed public tokenizers keep the BPE piece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Pieces:
    """A piece model's vocabulary and the tables that encoding needs."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    ready: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        plain = [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in range(n)]
        byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls([p if ok else "" for p, ok in zip(pieces, plain, strict=True)], [m.get_score(i) for i in range(n)], byte_ids)

    def tables(self) -> dict:
        """Piece of each code point, merges of pairs of pieces, rank of each merge, bytes of each piece."""
        if self.ready:
            return self.ready
        n = len(self.pieces)
        at = {p: i for i, p in enumerate(self.pieces) if p}
        chars = np.full(0x110000, -1, np.int32)
        for p, i in at.items():
            if len(p) == 1 and p != "▁":
                chars[ord(p)] = i
        chars[_SPACE] = at["▁"]
        pairs, made = [], []
        for p, i in at.items():
            for k in range(1, len(p)):
                a, b = at.get(p[:k]), at.get(p[k:])
                if a is not None and b is not None:
                    pairs.append(a * n + b)
                    made.append(i)
        size = 1 << (4 * len(pairs) - 1).bit_length()
        keys, values = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        left_key, left_value = np.array(pairs, np.int64), np.array(made, np.int32)
        slot = self.slot(left_key, size)
        while len(left_key):
            _, first = np.unique(slot, return_index=True)
            free = first[keys[slot[first]] < 0]
            keys[slot[free]], values[slot[free]] = left_key[free], left_value[free]
            rest = np.ones(len(left_key), bool)
            rest[free] = False
            left_key, left_value, slot = left_key[rest], left_value[rest], (slot[rest] + 1) % size
        _, rank = np.unique(-np.array(self.scores), return_inverse=True)
        raw = [p.replace("▁", " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        length = np.array([len(x) for x in raw], np.int64)
        byte_of = np.array(self.byte_ids, np.int32)
        self.ready.update(n=n, chars=chars, keys=keys, values=values, rank=rank.astype(np.int64), raw=np.frombuffer(b"".join(raw), np.uint8), length=length, begin=np.concatenate(([0], np.cumsum(length)[:-1])), byte_of=byte_of)
        return self.ready

    @staticmethod
    def slot(key: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            return (h >> np.uint64(65 - size.bit_length())).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two neighbouring pieces make, or -1."""
        t = self.tables()
        key = a.astype(np.int64) * t["n"] + b
        slot = self.slot(key, len(t["keys"]))
        out = np.full(len(key), -1, np.int32)
        todo = np.arange(len(key))
        while len(todo):
            found = t["keys"][slot]
            hit = found == key[todo]
            out[todo[hit]] = t["values"][slot[hit]]
            on = ~hit & (found >= 0)
            todo, slot = todo[on], (slot[on] + 1) % len(t["keys"])
        return out


def skipped(key: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the keyed hash skips each candidate merge of [start, mid) and [mid, end)."""
    if dropout <= 0:
        return np.zeros(len(start), bool)
    with np.errstate(over="ignore"):
        x = start.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7) + mid.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + end.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        return (mix64(key ^ x) >> np.uint64(11)).astype(np.float64) < dropout * float(1 << 53)


def run_agendas(model: Pieces, ids: np.ndarray, begin: np.ndarray, key: np.ndarray, dropout: float, log: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of each unit; begin has n + 1 bounds.  Returns ids in place of first symbols, and which stay.

    The merges made in units of up to LONG_UNIT symbols are added to log as arrays (unit, start, mid, end).
    """
    t = model.tables()
    rank, total = t["rank"], len(ids)
    stay, final = np.ones(total, bool), ids.astype(np.int32).copy()
    sizes = np.diff(begin)
    for u in np.flatnonzero(sizes > LONG_UNIT):
        _long_agenda(model, final, stay, int(begin[u]), int(begin[u + 1]), key[u], dropout)
    units = np.flatnonzero((sizes > 1) & (sizes <= LONG_UNIT))

    def flat(units: np.ndarray):
        """Symbols that still stand in these units, as dense arrays."""
        size = sizes[units]
        at = np.repeat(begin[units] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        owner = np.repeat(np.arange(len(units)), size)
        on = stay[at]
        return at[on], owner[on]

    while len(units):
        at, owner = flat(units)
        m = len(at)
        head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        sym, base = final[at].copy(), begin[units][owner]
        pos = at - base  # start of the symbol in its unit
        unit_end = (begin[units + 1] - begin[units])[owner]
        last = np.concatenate((owner[1:] != owner[:-1], [True]))
        after = np.where(last, m, np.arange(1, m + 1))
        before = np.where(np.concatenate(([True], owner[1:] != owner[:-1])), m, np.arange(-1, m - 1))
        stop = np.where(last, unit_end, np.append(pos[1:], 0))
        after, before = np.append(after, m), np.append(before, m)
        k = key[units][owner]
        code, made = np.full(m, _NEVER), np.full(m, -1, np.int32)
        live = np.ones(m, bool)

        def candidates(i: np.ndarray) -> None:
            j = after[i]
            code[i] = _NEVER
            i, j = i[j < m], j[j < m]
            p = model.merged(sym[i], sym[j])
            ok = p >= 0
            i, j, p = i[ok], j[ok], p[ok]
            ok = ~skipped(k[i], pos[i], pos[j], stop[j], dropout)
            i, p = i[ok], p[ok]
            made[i] = p
            code[i] = (rank[p] << 32) | i

        candidates(np.arange(m))
        todo = len(units)
        while True:
            best = np.minimum.reduceat(code, head)
            on = best != _NEVER
            n_on = int(on.sum())
            if n_on == 0 or n_on < 0.5 * todo and n_on > 64:
                break
            i = (best[on] & 0xFFFFFFFF).astype(np.int64)
            j = after[i]
            if log is not None:
                log.append((units[owner[i]], pos[i], pos[j], stop[j]))
            sym[i], stop[i], live[j], code[j] = made[i], stop[j], False, _NEVER
            after[i] = after[j]
            near = after[i]
            before[near] = i
            before[m] = m
            prev = before[i]
            candidates(np.concatenate((i, prev[prev < m])))
        final[at], stay[at] = sym, live
        units = units[on] if n_on else units[:0]
    return final, stay


def _long_agenda(model: Pieces, final: np.ndarray, stay: np.ndarray, lo: int, hi: int, key: np.uint64, dropout: float) -> None:
    """The same agenda for one long unit, as a heap."""
    n, rank = hi - lo, model.tables()["rank"]
    sym = final[lo:hi].tolist()
    after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive, heap = [True] * n, []

    def offer(i: np.ndarray) -> None:
        j = np.array([after[x] for x in i], np.int64)
        p = model.merged(np.array([sym[x] for x in i]), np.array([sym[x] for x in j]))
        end = np.array([stop[x] for x in j], np.int64)
        ok = (p >= 0) & ~skipped(np.full(len(i), key), i, j, end, dropout)
        for x, y, z, e in zip(i[ok].tolist(), j[ok].tolist(), p[ok].tolist(), end[ok].tolist(), strict=True):
            heapq.heappush(heap, (int(rank[z]), x, y, e, z))

    offer(np.arange(n - 1))
    while heap:
        _, i, j, e, p = heapq.heappop(heap)
        if not alive[i] or after[i] != j or not alive[j] or stop[j] != e:
            continue
        sym[i], stop[i], alive[j], after[i] = p, e, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        again = [x for x in (i, before[i]) if x >= 0 and after[x] < n]
        if again:
            offer(np.array(again, np.int64))
    final[lo:hi], stay[lo:hi] = sym, alive


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, CHUNK_CHARS + 1), base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def _skips_any(log: list[tuple[np.ndarray, ...]], which: np.ndarray, n: int, key: np.ndarray, dropout: float) -> np.ndarray:
    """Whether each occurrence, of unit which and with its own key, skips any of the merges that log has of its unit."""
    if not log:
        return np.zeros(len(which), bool)
    unit, *spans = (np.concatenate(x) for x in zip(*log, strict=True))
    order = np.argsort(unit, kind="stable")
    spans = [x[order] for x in spans]
    count = np.bincount(unit, minlength=n)
    times = count[which]
    at = np.repeat(np.cumsum(count)[which] - np.cumsum(times), times) + np.arange(times.sum())
    occurrence = np.repeat(np.arange(len(which)), times)
    out = np.zeros(len(which), bool)
    out[occurrence[skipped(key[occurrence], *[x[at] for x in spans], dropout)]] = True
    return out


def encode_chunk(model: Pieces, points: np.ndarray, fresh: np.ndarray, place: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a run of code points, and the first point of each id.  fresh marks where a text or segment begins."""
    t = model.tables()
    n = len(points)
    sym = t["chars"][points]
    space, odd = points == _SPACE, sym < 0
    cut = fresh | odd
    cut[1:] |= odd[:-1] | space[1:] & ~space[:-1]
    start = np.flatnonzero(cut)
    begin = np.append(start, n)
    size = np.diff(begin)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(points.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        word = mix64((total[begin[1:]] - total[start]) * down[start] + size.astype(np.uint64))
        key = mix64(word ^ mix64(mix64(place[start]) + np.uint64(seed & (1 << 63) - 1)))
    _, first, which = np.unique(word, return_index=True, return_inverse=True)
    # A unit that only shares the hash of the first of its kind is kept apart.
    rep = first[which]
    differs = size != size[rep]
    shift = np.repeat(start[rep] - start, np.where(differs, 0, size))
    inside = np.repeat(~differs, size)
    at = np.flatnonzero(inside)
    wrong = points[at] != points[at + shift]
    if wrong.any() or differs.any():
        owner = np.repeat(np.arange(len(start)), size)
        differs[np.unique(owner[at[wrong]])] = True
        lone = np.flatnonzero(differs)
        which[lone] = len(first) + np.arange(len(lone))
        first = np.append(first, lone)

    def run(units: np.ndarray, dropout: float, log: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bounds = np.concatenate(([0], np.cumsum(size[units])))
        src = np.repeat(start[units] - bounds[:-1], size[units]) + np.arange(bounds[-1])
        return src, *run_agendas(model, sym[src], bounds, key[units], dropout, log)

    if dropout <= 0:
        src, final, stay = run(first, 0.0)
    else:
        log: list[tuple[np.ndarray, ...]] = []
        src, final, stay = run(first, 0.0, log)
        own = np.flatnonzero(_skips_any(log, which, len(first), key, dropout) | (size > LONG_UNIT))
        which[own] = len(first) + np.arange(len(own))
        first = np.append(first, own)
        src, final, stay = (np.concatenate(x) for x in zip((src, final, stay), run(own, dropout), strict=True))
    width = size[first]
    # Units of one point without a piece become the bytes of its UTF-8 form.
    unit_of = np.repeat(np.arange(len(first)), width)[stay]
    ids, at_point = final[stay], (src[stay] - start[first][unit_of])
    bare = np.flatnonzero(ids < 0)
    if len(bare):
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in points[src[stay][bare]].tolist()]
        times = np.ones(len(ids), np.int64)
        times[bare] = [len(x) for x in raw]
        where = np.repeat(np.arange(len(ids)), times)
        mine = np.flatnonzero(np.isin(where, bare)) if len(bare) < len(ids) else np.arange(len(where))
        ids, at_point, unit_of = ids[where], at_point[where], unit_of[where]
        ids[mine] = t["byte_of"][np.frombuffer(b"".join(raw), np.uint8)]
    n_of = np.bincount(unit_of, minlength=len(first))
    o_begin = np.concatenate(([0], np.cumsum(n_of)))
    count = n_of[which]
    bounds = np.concatenate(([0], np.cumsum(count)))
    pick = np.repeat(o_begin[which] - bounds[:-1], count) + np.arange(bounds[-1])
    return ids[pick], at_point[pick] + np.repeat(start, count)


_CUT = re.compile(r"(?<! ) ")


def segments(text: str) -> Iterator[str]:
    """A text with its added first space, in pieces that each begin with a space run."""
    text, a = " " + text, 0
    while len(text) - a > CHUNK_CHARS:
        m = _CUT.search(text, a + CHUNK_CHARS)
        if m is None:
            break
        yield text[a : m.start()]
        a = m.start()
    yield text[a:]


def encode(model: Pieces, texts: list[str | None], names: list[int | None], dropout: float = DROPOUT, seed: int = SEED, copies: list[int | None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and n + 1 bounds.  Texts of equal name draw other skips where copies differ."""
    out: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    held: list[tuple[int, int, str]] = []

    def flush() -> None:
        joined = "".join(x[2] for x in held)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(x[2]) for x in held])
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        fresh = np.zeros(len(points), bool)
        fresh[begin] = True
        with np.errstate(over="ignore"):
            own = mix64(np.array([(names[i] or 0) & (1 << 64) - 1 for i, _, _ in held], np.uint64))
            if copies is not None:
                own = mix64(own + np.array([(copies[i] or 0) & (1 << 64) - 1 for i, _, _ in held], np.uint64))
            own += np.array([o for _, o, _ in held], np.uint64)
            place = np.repeat(own, size) + (np.arange(len(points)) - np.repeat(begin, size)).astype(np.uint64)
        ids, at = encode_chunk(model, points, fresh, place, dropout, seed)
        counts_here = np.diff(np.append(np.searchsorted(at, begin), len(at)))
        np.add.at(counts, [i for i, _, _ in held], counts_here)
        out.append(ids)
        held.clear()

    total = 0
    for i, text in enumerate(texts):
        if text:
            offset = 0
            for s in segments(text):
                held.append((i, offset, s))
                offset += len(s)
                total += len(s)
                if total >= CHUNK_CHARS:
                    flush()
                    total = 0
    if held:
        flush()
    return np.concatenate([np.zeros(0, np.int32), *out]), np.concatenate(([0], np.cumsum(counts)))


def decode(model: Pieces, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The UTF-8 bytes of each text, without the space that encoding adds."""
    t = model.tables()
    out = []
    for a in range(0, len(bounds) - 1, 256):
        b = min(a + 256, len(bounds) - 1)
        own = ids[bounds[a] : bounds[b]]
        size = t["length"][own]
        end = np.concatenate(([0], np.cumsum(size)))
        flat = t["raw"][np.repeat(t["begin"][own] - end[:-1], size) + np.arange(end[-1])].tobytes()
        edge = end[bounds[a : b + 1] - bounds[a]]
        out += [flat[x + 1 : y] if y > x else b"" for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return out


def encode_documents(docs: DataFrame, model_path: str | None = None, keep: tuple[str, ...] = ("doc_id",), dropout: float = DROPOUT, seed: int = SEED, copy: str | None = None) -> DataFrame:
    """Columns keep, ids, n_ids and lossless (decoding the ids gives the text back).

    Column copy numbers the rows that stand for one document, so that each draws its own skips.
    """
    loaded = Pieces.load(model_path or default_model())
    shipped = docs.sparkSession.sparkContext.broadcast((loaded.pieces, loaded.scores, loaded.byte_ids))
    names = [f"kept_{c}" if c.lower() in ("ids", "n_ids", "lossless") else c for c in keep]
    # By place, as names may clash with the helpers' or hold dots.
    kept = [f"c{i}" for i in range(len(keep))]
    number = F.lit(0) if copy is None else named(copy)
    source = docs.select(*[named(c).alias(k) for c, k in zip(keep, kept, strict=True)], F.col("doc_id").cast("long").alias("name"), F.col("text").cast("string").alias("text"), number.cast("long").alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(*shipped.value)
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                texts = batch.column(len(kept) + 1).to_pylist()
                ids, bounds = encode(model, texts, batch.column(len(kept)).to_pylist(), dropout, seed, None if copy is None else batch.column(len(kept) + 2).to_pylist())
                same = [x == (y or "").encode("utf-8", "surrogatepass") for x, y in zip(decode(model, ids, bounds), texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [lists, pa.array(np.diff(bounds)), pa.array(same)], [*kept, "ids", "n_ids", "lossless"])

    own = fields(source.select(*kept).schema)
    out = source.mapInArrow(tidy(run), ", ".join(x for x in (own, "ids array<int>, n_ids long, lossless boolean") if x))
    return out.toDF(*names, "ids", "n_ids", "lossless")
