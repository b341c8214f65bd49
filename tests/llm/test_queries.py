"""Every opN query and the pipeline on whole tables."""

import pytest
from oracle import assert_equal, connect

from voltmill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_oracle(spark, sf, name):
    assert_equal(queries.QUERIES[name](spark, sf), connect(sf), queries.SQL[name])


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline_against_brute_force(spark, sf):
    import numpy as np
    import pyarrow.parquet as pq

    import corpus_pipeline
    from voltmill.llm import quality_rules

    t = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    kept = quality_rules.verdicts(quality_rules.measure(__import__("pyarrow").array([r["text"] for r in t])))[1]
    t = [r for r, k in zip(t, kept, strict=True) if k]
    best = {}
    for r in t:
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    t = [r for r in t if best[r["text"]] == r["doc_id"]]
    words = [r["text"].translate({c: c + 32 for c in range(65, 91)}).split() for r in t]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(t)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(t)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    first = {}
    for i, r in enumerate(t):
        k = find(i)
        first[k] = min(first.get(k, r["doc_id"]), r["doc_id"])
    unique = {first[find(i)] for i in range(len(t))}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert {r.doc_id for r in docs.select("doc_id").collect()} == unique
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert rows and all(r.lossless for r in rows) and {r.doc_id for r in rows} <= unique
    copies = np.unique([r.doc_id for r in rows], return_counts=True)[1]
    assert copies.max() <= 3
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "ngram_jaccard_join", "source_mixing", "piece_codec"]


def test_pipeline_on_edge_rows(spark, docs, empty, tmp_path):
    """An empty table, and one with nulls, ties, repeated rows and other columns."""
    import corpus_pipeline

    for name, df in (("empty", empty), ("edge", docs.select("doc_id", "text", "lang", "source", "n_chars", "`a.b`", "copy", "__id"))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert all(r.lossless for r in rows) and bool(rows) == (name == "edge")
