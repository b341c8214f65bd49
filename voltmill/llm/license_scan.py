"""License scans (2): exact set-similarity join of text blocks with license templates.

A block is a window of two strides, a new one every STRIDE words, so any span of STRIDE + 1 words lies in one.
For templates and phrases of more words the stride is doubled until they fit, whatever their length.  A template is a set of words, a phrase a template that must be contained in full.  Words are ordered
by their count over all documents, rare ones first; a block that contains at least the share `threshold` of
a template has one of the template's first s - o + 1 words (prefix filter), at least o words (length filter),
and enough words of the template from its first common one on (positional filter).  Blocks that pass are
counted exactly.  Phrase blocks then go through an exact check for the words standing consecutively.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows and equal ids are
scanned one by one; no table size or text length is special; an empty table gives no rows; extra columns are not
read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

STRIDE, THRESHOLD = 32, 0.9
#: Phrases and the labels of their places.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices and whole texts as their licenses word them, and labels of this scan.
TEMPLATES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-terms": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-terms": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "mit-notice": "released under the mit license",
    "mit-terms": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "rights-reserved": "all rights reserved no part may be reproduced without permission",
    "apache-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
        THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
        BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it
        will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details. You should have received a copy of the GNU General Public License along with this program.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD
        TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
        OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
        sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE.""",
}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    """The words of a template, as documents have them."""
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def stride_of(n: int) -> int:
    """Words between the blocks that hold any span of n words."""
    stride = STRIDE
    while n > stride + 1:
        stride *= 2
    return stride


class Plan:
    """Templates over a vocabulary that is ordered by corpus counts."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str], threshold: float, counts: dict[str, int] | None = None):
        rows = [(label, words_of(t), threshold, False) for label, t in templates.items()] + [(label, words_of(p), 1.0, True) for p, label in phrases.items()]
        words = sorted({w for _, ws, _, _ in rows for w in ws}, key=lambda w: ((counts or {}).get(w, 0), w))
        self.words, self.rank = words, {w: i for i, w in enumerate(words)}
        data = "\n".join(words).encode()
        b = np.frombuffer(data, np.uint8)
        end = np.append(np.flatnonzero(b == 10), len(b))
        hashes = K.hash_spans(b, np.concatenate(([0], end[:-1] + 1)), end)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.rows = []
        #: Of each stride: the templates that have a word in their prefix, and whether a word is in any.
        self.by_prefix: dict[int, dict[int, list[int]]] = {}
        for k, (label, ws, share, whole) in enumerate(rows):
            tokens = sorted({self.rank[w] for w in ws})
            need = max(1, int(np.ceil(share * len(tokens) - 1e-9)))
            self.rows.append((label, tokens, need, [self.rank[w] for w in ws] if whole else None))
            of_stride = self.by_prefix.setdefault(stride_of(len(ws)), {})
            for r in tokens[: len(tokens) - need + 1]:
                of_stride.setdefault(r, []).append(k)
        self.is_prefix = {stride: np.zeros(len(words) + 1, bool) for stride in self.by_prefix}
        for stride, on in self.is_prefix.items():
            on[list(self.by_prefix[stride])] = True

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """The rank of each word hash, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.order[at], -1)

    def matches(self, ranks: np.ndarray, first_word: np.ndarray) -> Iterator[tuple[int, int, int, int, float, list[int]]]:
        """(text, template, block start, block end, containment, places of a phrase) in words of the text."""
        for stride, by_prefix in self.by_prefix.items():
            hit = np.flatnonzero(self.is_prefix[stride][ranks])
            text = np.searchsorted(first_word, hit, side="right") - 1
            block = (hit - first_word[text]) // stride
            pairs = np.unique(np.stack((np.concatenate((text, text)), np.concatenate((block, block - 1)))), axis=1)
            for d, k in pairs[:, pairs[1] >= 0].T.tolist():
                a = first_word[d] + k * stride
                b = min(a + 2 * stride, first_word[d + 1])
                here = ranks[a:b]
                tokens = np.unique(here[here >= 0]).tolist()
                own = set(tokens)
                for t in sorted({t for r in tokens for t in by_prefix.get(r, ())}):
                    label, wanted, need, phrase = self.rows[t]
                    if len(tokens) < need:
                        continue
                    first = next(i for i, r in enumerate(wanted) if r in own)
                    if len(wanted) - first < need or sum(r >= wanted[first] for r in tokens) < need:
                        continue
                    overlap = sum(r in own for r in wanted)
                    if overlap >= need:
                        places = [] if phrase is None else [i for i in range(len(here) - len(phrase) + 1) if here[i : i + len(phrase)].tolist() == phrase]
                        if phrase is None or places:
                            yield d, t, k * stride, b - first_word[d], overlap / len(wanted), [k * stride + i for i in places]


def _chunks(texts, plan: Plan) -> Iterator[tuple[K.Chunk, np.ndarray, np.ndarray]]:
    for c in K.chunks(texts, fold=True):
        start, end, text = c.spans(K.ALNUM)
        yield c, plan.ranks(K.hash_spans(c.b, start, end)), np.searchsorted(text, np.arange(c.n + 1))


def corpus_plan(docs: DataFrame, templates: dict[str, str], phrases: dict[str, str], threshold: float) -> Plan:
    """The plan with the order that the counts over all documents give."""
    bare = Plan(templates, phrases, threshold)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(bare.words), np.int64)
        for batch in batches:
            for _, ranks, _ in _chunks(batch.column(0), bare):
                total += np.bincount(ranks[ranks >= 0], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["r", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "r long, n long").groupBy("r").agg(F.sum("n").alias("n")).collect()
    return Plan(templates, phrases, threshold, {bare.words[r["r"]]: r["n"] for r in rows})


def find_blocks(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each block that meets a template: doc_id, label, first_word, end_word, containment, phrase_starts."""
    plan = corpus_plan(docs, TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[c.i0 + d], plan.rows[t][0], int(a), int(b), share, places) for c, ranks, first in _chunks(batch.column(1), plan) for d, t, a, b, share, places in plan.matches(ranks, first)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "label", "first_word", "end_word", "containment", "phrase_starts"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, label string, first_word long, end_word long, containment double, phrase_starts array<long>")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (best containment)."""
    plan = corpus_plan(docs, TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            places: dict[int, set[tuple[int, int]]] = {}
            labels: dict[int, set[str]] = {}
            score, n_words = np.zeros(n), np.zeros(n, np.int64)
            for c, ranks, first in _chunks(batch.column(1), plan):
                n_words[c.i0 : c.i1] = np.diff(first)
                for d, t, _, _, share, at in plan.matches(ranks, first):
                    i = c.i0 + d
                    labels.setdefault(i, set()).add(plan.rows[t][0])
                    places.setdefault(i, set()).update((p, t) for p in at)
                    score[i] = max(score[i], share)
            base = [sorted(places.get(i, ())) for i in range(n)]
            columns = [
                batch.column(0),
                pa.array(n_words),
                pa.array([len(x) for x in base], pa.int64()),
                pa.array([int(x[0][0]) if x else None for x in base], pa.int64()),
                pa.array([int(x[-1][0]) if x else None for x in base], pa.int64()),
                pa.array([",".join(sorted({plan.rows[t][0] for _, t in x})) for x in base], pa.string()),
                pa.array([",".join(sorted(labels.get(i, ()))) for i in range(n)], pa.string()),
                pa.array(score),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
