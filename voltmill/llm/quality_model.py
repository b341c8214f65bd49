"""Quality classifier (4): a factorisation machine over hashed words, structure statistics and metadata.

The score of x is sigmoid(w0 + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise
interactions, in time linear in x.  It learns from at most TRAIN_ROWS labelled ids, those with the
smallest keyed hash among the ids that are not held out, one document an id; everything else reads all rows.
The only metadata read is n_chars where that column exists; labels, lang, source and doc_id are never inputs.

Defined results: null and empty texts get the score of an empty text; without labels of both kinds every
score is the share of label 1, or 0.5 without any label; an id with both labels has none; of several documents
of an id the one with the least text hash is learned from; repeated rows are scored one by one; a null id is not
held out and has no label; an empty table gives no rows; other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

BUCKETS, FACTORS, TRAIN_ROWS, SEED = 2048, 8, 8000, 11
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.01, 1e-4
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:?", "!", "#*$%&", "|<>", "()[]{}=_/\\", "\"'-", "@")
_KIND = np.full(256, len(_CLASSES), np.uint8)
for _k, _cs in enumerate(_CLASSES):
    _KIND[[ord(c) for c in _cs]] = _k
DENSE = len(_CLASSES) + 10


def features(texts: pa.Array | pa.ChunkedArray, n_chars: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of at most 256 texts: number of the first one, matrix of hashed words and dense statistics."""
    for c in K.chunks(texts, fold=False):
        start, end, text = c.spans(K.SPACED)
        low = K.LOWER[c.b]
        bucket = (K.hash_spans(low, start, end) & np.uint64(BUCKETS - 1)).astype(np.int64)
        n_words = np.bincount(text, minlength=c.n)
        size = np.diff(c.begin) - 1
        kinds = np.stack([c.per_text(_KIND[c.b] == k) for k in range(len(_CLASSES))], axis=1) if c.n else np.zeros((0, len(_CLASSES)))
        l_start, l_end, l_text = c.lines()
        n_lines = np.bincount(l_text, minlength=c.n)
        full = l_end > l_start
        _, dup_line = K.repeated(K.hash_spans(c.b, l_start[full], l_end[full]), l_text[full])
        gram, first = K.ngrams(K.hash_spans(c.b, start, end), text, 3)
        _, dup_gram = K.repeated(gram, text[first])
        length = (end - start).astype(float)
        some = np.maximum(n_words, 1)
        mean = np.bincount(text, length, c.n) / some
        spread = np.sqrt(np.maximum(np.bincount(text, length**2, c.n) / some - mean**2, 0))
        stated = size if n_chars is None else n_chars[c.i0 : c.i1]
        dense = np.column_stack([
            kinds / np.maximum(size, 1)[:, None],
            np.log1p(n_words), np.log1p(n_lines), mean, spread, n_words / np.maximum(n_lines, 1),
            np.bincount(l_text[full][dup_line], minlength=c.n) / np.maximum(n_lines, 1),
            np.bincount(text[first][dup_gram], minlength=c.n) / some,
            np.log1p(np.maximum(stated, 0)), n_words == 0, np.bincount(text, length > 20, c.n) / some,
        ])
        edge = np.searchsorted(text, np.arange(c.n + 1))
        for a in range(0, c.n, 256):
            b = min(a + 256, c.n)
            at = slice(edge[a], edge[b])
            m = np.bincount((text[at] - a) * BUCKETS + bucket[at], minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS)
            words = np.sqrt(m.astype(np.float32))
            words /= np.maximum(np.sqrt((words**2).sum(axis=1, keepdims=True)), 1e-6)
            yield c.i0 + a, np.hstack([words, dense[a:b].astype(np.float32)])


class Machine:
    """A trained factorisation machine."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.constant = 0.5 if not len(y) else float(np.mean(y))
        self.flat = len(np.unique(y)) < 2
        if self.flat:
            return
        d = x[:, BUCKETS:]
        self.mean, self.scale = d.mean(axis=0), np.maximum(d.std(axis=0), 1e-3)
        x = self.ready(x)
        rng = np.random.default_rng(SEED)
        p = [np.array([np.log(self.constant / (1 - self.constant))]), np.zeros(x.shape[1]), rng.normal(0, 0.02, (x.shape[1], FACTORS))]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(y))
            for k in range(0, len(y), BATCH):
                at = order[k : k + BATCH]
                b, t = x[at], y[at]
                s = b @ p[2]
                score = p[0] + b @ p[1] + 0.5 * (s**2 - (b**2) @ (p[2] ** 2)).sum(axis=1)
                e = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - t) / len(at)
                grads = [e.sum(keepdims=True), b.T @ e + DECAY * p[1], b.T @ (e[:, None] * s) - p[2] * ((b**2).T @ e)[:, None] + DECAY * p[2]]
                step += 1
                rate = RATE * (1 - 0.9 * epoch / EPOCHS)
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g**2
                    p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.w0, self.w, self.v = float(p[0][0]), p[1].astype(np.float32), p[2].astype(np.float32)

    def ready(self, x: np.ndarray) -> np.ndarray:
        d = np.clip((x[:, BUCKETS:] - self.mean) / self.scale, -5, 5) * 0.5
        return np.hstack([x[:, :BUCKETS], d]).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), self.constant)
        x = self.ready(x)
        s = x @ self.v
        z = self.w0 + x @ self.w + 0.5 * (s**2 - (x**2) @ (self.v**2)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _source(docs: DataFrame) -> DataFrame:
    stated = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), stated.cast("long").alias("n_chars"))


def _stated(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return batch.column(at).fill_null(0).to_numpy(zero_copy_only=False)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = TRAIN_ROWS) -> Machine:
    """Fit on the sample; only its feature rows come to the driver, one an id."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    ids = one.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [m for _, m in features(batch.column(1), _stated(batch, 2))]
            flat = [r.astype(np.float16).tobytes() for m in x for r in m]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(flat, pa.binary())], ["doc_id", "y", "x"])

    found = _source(docs).join(F.broadcast(ids), "doc_id")  # at most `rows` ids are broadcast
    place = F.struct(F.xxhash64("text"), F.col("n_chars"))
    first = found.groupBy("doc_id").agg(F.min_by(F.struct("text", "n_chars", "y"), place).alias("d")).select("doc_id", "d.*")
    sample = first.mapInArrow(run, "doc_id long, y int, x binary").toArrow()
    order = np.lexsort((sample["y"].to_numpy(), sample["doc_id"].to_numpy()))
    x = np.zeros((len(order), BUCKETS + DENSE), np.float32)
    column = sample["x"]
    for r, i in enumerate(order):
        x[r] = np.frombuffer(column[int(i)].as_py(), np.float16)
    return Machine(x, sample["y"].to_numpy()[order].astype(np.float32))


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shipped = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = Machine.__new__(Machine)
        fm.__dict__.update(shipped.value)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, x in features(batch.column(1), _stated(batch, 2)):
                out[a : a + len(x)] = fm.score(x.astype(np.float16).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return _source(docs).withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
