"""Numpy kernels over the bytes of many texts at once: word spans, rolling hashes, duplicates.

A chunk is a run of whole texts of about CHUNK_BYTES, each followed by one line feed, so a word or
line never crosses two texts.  A longer text makes a chunk of its own; its working memory is about
ten times its bytes, since hashes are taken in segments.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
SEGMENT = 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def tidy(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step over batches that gives freed memory back to the system in the end, as workers stay for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            return

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        with np.errstate(over="ignore"):
            _TABLES["byte"] = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                p = np.full(SEGMENT + 1, base, dtype=np.uint64)
                p[0] = 1
                _TABLES[name] = np.multiply.accumulate(p)
    return _TABLES


def byte_set(keep) -> np.ndarray:
    """A lookup table of 256 booleans."""
    return np.array([bool(keep(i)) for i in range(256)])


SPACED = byte_set(lambda c: not (c == 0x20 or 0x09 <= c <= 0x0D))
ALNUM = byte_set(lambda c: 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or 0x41 <= c <= 0x5A or c >= 0x80)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def string_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, col.offset * 8)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


class Chunk:
    """Texts i0 to i1 of a column: their bytes with a line feed after each, and where each begins."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, i0: int, i1: int, fold: bool):
        lens = np.diff(off[i0 : i1 + 1])
        self.i0, self.i1, self.n = i0, i1, i1 - i0
        self.begin = np.zeros(self.n + 1, np.int64)
        np.cumsum(lens + 1, out=self.begin[1:])
        self.b = np.full(int(self.begin[-1]), 10, np.uint8)
        for k in range(self.n):
            self.b[self.begin[k] : self.begin[k + 1] - 1] = raw[off[i0 + k] : off[i0 + k + 1]]
        if fold:
            self.b = LOWER[self.b]

    def spans(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each maximal run of the bytes that word has."""
        inside = word[self.b]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(self.b) and inside[0]:
            edge = np.concatenate(([0], edge))
        start, end = edge[0::2], edge[1::2]
        return start, end, np.searchsorted(self.begin, start, side="right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each line."""
        end = np.flatnonzero(self.b == 10)
        start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
        return start, end, np.searchsorted(self.begin, start, side="right") - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a byte-wise array in each text."""
        if not self.n:
            return np.zeros(0, np.int64)
        return np.add.reduceat(flags, self.begin[:-1], dtype=np.int64)


def chunks(col: pa.Array | pa.ChunkedArray, fold: bool) -> Iterator[Chunk]:
    """A column's texts in chunks; fold lower-cases A-Z."""
    raw, off = string_buffers(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, side="right")) - 1)
        j = min(j, i + 50_000, n)
        yield Chunk(raw, off, i, j, fold)
        i = j


def hash_spans(b: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit polynomial hash of each span b[start:end]; spans are ascending and disjoint."""
    t = _tables()
    out = np.empty(len(start), np.uint64)
    i, n = 0, len(start)
    with np.errstate(over="ignore"):
        while i < n:
            lo = int(start[i])
            j = int(np.searchsorted(end, lo + SEGMENT, side="right"))
            if j <= i:
                out[i] = _long_hash(b, lo, int(end[i]))
                i += 1
                continue
            part = b[lo : int(end[j - 1])]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(t["byte"][part] * t["power"][: len(part)], out=total[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            out[i:j] = (total[e] - total[s]) * t["inverse"][s]
            i = j
        return mix64(out ^ mix64((end - start).astype(np.uint64) * _ODD + np.uint64(seed)))


def _long_hash(b: np.ndarray, lo: int, hi: int) -> np.uint64:
    t, h, step = _tables(), 0, pow(_BASE, SEGMENT, 1 << 64)
    scale = 1
    for at in range(lo, hi, SEGMENT):
        part = b[at : min(hi, at + SEGMENT)]
        h = (h + int((t["byte"][part] * t["power"][: len(part)]).sum(dtype=np.uint64)) * scale) & _MASK
        scale = scale * step & _MASK
    return np.uint64(h)


def ngrams(words: np.ndarray, text: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each window of n words within one text, and each window's first word."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h += words[k : k + m] * np.uint64(pow(_BASE, k + 1, 1 << 64))
        at = np.flatnonzero(text[:m] == text[n - 1 :])
        return mix64(h[at] ^ np.uint64((n * 0x9E37 + seed) & _MASK)), at


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts key, and where each run of equal values begins in it."""
    order = np.argsort(key)
    s = key[order]
    return order, np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)


def repeated(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: does its key stand twice or more in its text, and is it not the first."""
    with np.errstate(over="ignore"):
        order, head = runs(mix64(key ^ (text.astype(np.uint64) + np.uint64(1)) * _ODD))
    often, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    if len(head):
        size = np.diff(np.concatenate((head, [len(key)])))
        often[order] = np.repeat(size > 1, size)
        later[:] = often
        later[np.minimum.reduceat(order, head)] = False
    return often, later


def covered(n_words: int, first: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in one of the windows of n words that begin at first."""
    d = np.zeros(n_words + 1, np.int32)
    np.add.at(d, first, 1) if len(first) < 64 else np.add(d, np.bincount(first, minlength=n_words + 1), out=d, casting="unsafe")
    ends = first + n
    d -= np.bincount(ends, minlength=n_words + 1)[: n_words + 1].astype(np.int32)
    return np.cumsum(d[:-1]) > 0
