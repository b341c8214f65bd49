"""Quality rules (5): characters inside duplicated n-grams and lines, from rolling hashes in numpy.

Defined results: a null or empty text has no words and fails the base rule; repeated rows and equal
doc_ids are judged one by one; extra columns, whatever their names, pass through annotate() unchanged, and its
own columns replace equal names; an empty table gives no rows.  Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .shared import fields, named

#: Largest share of a text's word characters inside later copies of an n-gram, by n.  A short text that
#: says one line twice stays below; the published rules for long web pages (0.15 to 0.11) would drop it.
COVERAGE = {5: 0.25, 7: 0.22, 9: 0.20}
#: Largest share of lines, and of characters in lines, that repeat an earlier line.
DUP_LINES, DUP_LINE_CHARS = 0.40, 0.20
MIN_WORDS = 50
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = K.byte_set(lambda c: chr(c) in "#*$%&|<>")


def measure(texts: pa.Array | pa.ChunkedArray) -> dict[str, np.ndarray]:
    """The figures of each text and its highest shares of repetition."""
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in FIGURES}
    out |= {f"cover_{k}": np.zeros(n) for k in COVERAGE} | {"dup_line_share": np.zeros(n), "dup_line_char_share": np.zeros(n)}
    for c in K.chunks(texts, fold=False):
        at = slice(c.i0, c.i1)
        start, end, text = c.spans(K.SPACED)
        points = (c.b & 0xC0) != 0x80
        before = np.zeros(len(c.b) + 1, np.int64)
        np.cumsum(points, out=before[1:])
        chars = before[end] - before[start]
        words = K.hash_spans(c.b, start, end)
        word_chars = np.bincount(text, chars, c.n)
        out["n_words"][at] = np.bincount(text, minlength=c.n)
        out["word_chars"][at] = word_chars
        out["n_symbols"][at] = c.per_text(_SYMBOL[c.b])
        safe = np.maximum(word_chars, 1)
        gram, first = K.ngrams(words, text, 3)
        often, _ = K.repeated(gram, text[first])
        out["n_repeat_words"][at] = np.bincount(text[K.covered(len(words), first[often], 3)], minlength=c.n)
        for k in COVERAGE:
            gram, first = K.ngrams(words, text, k)
            _, later = K.repeated(gram, text[first])
            inside = K.covered(len(words), first[later], k)
            out[f"cover_{k}"][at] = np.bincount(text[inside], chars[inside], c.n) / safe
        start, end, text = c.lines()
        n_at = np.searchsorted(c.spans(K.SPACED)[0], np.stack((start, end)))
        full = n_at[1] > n_at[0]
        start, end, text = start[full], end[full], text[full]
        _, later = K.repeated(K.hash_spans(c.b, start, end), text)
        chars = before[end] - before[start]
        lines = np.bincount(text, minlength=c.n)
        dup = np.bincount(text[later], minlength=c.n)
        out["n_dup_lines"][at] = dup
        out["dup_line_share"][at] = dup / np.maximum(lines, 1)
        out["dup_line_char_share"][at] = np.bincount(text[later], chars[later], c.n) / np.maximum(np.bincount(text, chars, c.n), 1)
    return out


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept from the figures."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    bad = (m["dup_line_share"] > DUP_LINES) | (m["dup_line_char_share"] > DUP_LINE_CHARS)
    for k, most in COVERAGE.items():
        bad |= m[f"cover_{k}"] > most
    return failed, ~failed & ~bad


def annotate(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, only_kept: bool = False) -> DataFrame:
    """Add the figures and verdicts to the columns keep (all by default); only_kept filters in the same pass."""
    added = [f"{k} long" for k in FIGURES] + [f"cover_{k} double" for k in COVERAGE] + ["dup_line_share double", "dup_line_char_share double", "base_failed boolean", "kept boolean"]
    names = [x.split()[0] for x in added]
    through = docs.columns if keep is None else keep
    own = [c for c in through if only_kept or c not in names]
    # By place, as names may clash with the helpers' or hold dots.
    numbers = [f"c{i}" for i in range(len(own))]
    source = docs.select(*[named(c).alias(k) for c, k in zip(own, numbers, strict=True)], named(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measure(batch.column(batch.num_columns - 1))
            failed, kept = verdicts(m)
            columns = [batch.column(i) for i in range(len(own))]
            if only_kept:
                yield pa.RecordBatch.from_arrays(columns, numbers).filter(pa.array(kept))
                continue
            arrays = columns + [pa.array(m[k]) for k in names[:-2]] + [pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(arrays, numbers + names)

    schema = ", ".join(x for x in (fields(source.drop("t").schema), "" if only_kept else ", ".join(added)) if x)
    return source.mapInArrow(K.tidy(run), schema).toDF(*own, *([] if only_kept else names))
