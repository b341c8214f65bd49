"""Operators that read each text by itself: brute force, round trips, edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voltmill.llm import chat_format, kernels, license_scan, piece_codec, quality_model, quality_rules

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# Kernels


@given(st.lists(st.text(), max_size=6))
@settings(max_examples=60, deadline=None)
def test_spans_are_the_words(texts):
    got = [[] for _ in texts]
    for c in kernels.chunks(pa.array(texts, pa.string()), fold=False):
        for s, e, t in zip(*c.spans(kernels.SPACED), strict=True):
            got[c.i0 + t].append(c.b[s:e].tobytes().decode())
    assert got == [SPACED.findall(t) for t in texts]


def test_hashes_do_not_depend_on_place_or_segment(monkeypatch):
    text = ("abc " * 50 + "x" * 3000 + " abc").encode()
    b = np.frombuffer(text, np.uint8)
    spans = [(m.start(), m.end()) for m in re.finditer(rb"\S+", text)]
    s, e = np.array(spans).T
    whole = kernels.hash_spans(b, s, e)
    assert len(set(whole.tolist())) == 2 and whole[0] == whole[-1]
    long = np.frombuffer(b"q" * (3 * kernels.SEGMENT + 17), np.uint8)
    one = kernels.hash_spans(long, np.array([0]), np.array([len(long)]))
    two = kernels.hash_spans(np.concatenate((b[:7], long)), np.array([7]), np.array([7 + len(long)]))
    assert one[0] == two[0]


# 5: quality rules


def brute_rules(text):
    text = text or ""
    words = SPACED.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


@given(st.lists(st.text(alphabet="ab é#\n \t|", max_size=80), max_size=5))
@settings(max_examples=80, deadline=None)
def test_rules_equal_brute_force(texts):
    m = quality_rules.measure(pa.array(texts, pa.string()))
    failed, kept = quality_rules.verdicts(m)
    for i, t in enumerate(texts):
        assert (*[int(m[k][i]) for k in quality_rules.FIGURES], bool(failed[i])) == brute_rules(t)
        assert not (kept[i] and failed[i])


def test_rules_on_edge_rows(docs, empty):
    rows = quality_rules.annotate(docs, keep=["doc_id"]).collect()
    assert len(rows) == 15
    got = {r.doc_id: r for r in rows}
    assert got[4].n_words == 0 and got[4].base_failed and not got[4].kept
    assert got[1].kept and got[8].base_failed and got[9].n_dup_lines == 29
    assert quality_rules.annotate(empty, keep=["doc_id"]).count() == 0
    own = quality_rules.annotate(docs, only_kept=True)
    assert own.columns == docs.columns and {(r.kept, r["a.b"], r["__text"]) for r in own.collect()} == {("mine", "own", "own")}
    assert quality_rules.annotate(docs).columns[: len(docs.columns) - 2] == [c for c in docs.columns if c not in ("kept", "cover_5")]
    assert quality_rules.annotate(empty, only_kept=True).count() == 0


# 2: license scans


def brute_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    out = []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(out)


def test_license_places(spark, docs, empty):
    rng = np.random.default_rng(4)
    parts = ["mit license", "Apache  License", "general public\nlicense", "license", "mit", "the", "word", "général", "public"]
    rows = [(i, " ".join(rng.choice(parts, rng.integers(0, 200)))) for i in range(60)]
    got = by_id(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, text in rows:
        n, places = brute_places(text)
        r = got[i]
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1 or not places)
    edge = license_scan.scan(docs).collect()
    assert len(edge) == 15 and {r.doc_id: r.n_base for r in edge}[11] == 2
    assert license_scan.scan(empty).count() == 0


def test_template_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    t = license_scan.TEMPLATES["mit-terms"].split()
    rows = [(i, " ".join(["foo"] * int(rng.integers(0, 90)) + [w for w in t if rng.random() > 0.08] + ["bar"] * 40)) for i in range(80)]
    found = license_scan.find_blocks(spark.createDataFrame(rows, "doc_id long, text string"), {"mit-terms": " ".join(t)}, {}).collect()
    got = {(r.doc_id, r.first_word) for r in found}
    want = set()
    for i, text in rows:
        w = text.split()
        for a in range(0, len(w), 32):
            if len(set(t) & set(w[a : a + 64])) >= np.ceil(0.9 * len(set(t)) - 1e-9):
                want.add((i, a))
    assert got == want and len(want) > 10


@pytest.mark.parametrize("n", [30, 33, 34, 60, 65, 66, 90, 300])
def test_long_templates_and_phrases_wherever_they_stand(spark, n):
    """Beside a short template, whose blocks stay as they are."""
    t, short = [f"t{i}" for i in range(n)], "this is a short notice"
    rows = [(k, " ".join(["foo"] * k + t + ["bar"] * 20)) for k in range(0, 2 * n, 7 if n < 100 else 41)] + [(-1, " ".join(t[: n // 2])), (-2, "this is " + "foo " * 70 + "a short notice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(license_scan.scan(df, {"long": " ".join(t), "short": short}, {" ".join(t): "phrase"}))
    for k, _ in rows:
        r = got[k]
        assert (r.labels, r.score, r.first_word, r.n_base) == (("long,phrase", 1.0, k, 1) if k >= 0 else ("", 0.0, None, 0))


@pytest.mark.parametrize("label", ["apache-header", "bsd-text", "gpl-header", "isc-text", "mit-text"])
def test_whole_license_texts_at_every_offset(spark, label):
    """As a file has them, with a few words lost, and not where the text is about something else."""
    text = license_scan.TEMPLATES[label]
    rng = np.random.default_rng(3)
    words = text.split()
    damaged = " ".join(w for i, w in enumerate(words) if i % 40 != 7)
    rows = [(k, "word " * k + text) for k in range(0, 300, 13)] + [(1000 + k, "word " * k + damaged + " end" * 99) for k in range(0, 300, 29)]
    rows += [(-1, " ".join(rng.permutation(words)[: len(words) // 2])), (-2, "the software is provided to any person under the license " * 30)]
    got = by_id(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(label in got[k].labels.split(",") and got[k].score > 0.9 for k, _ in rows if k >= 0)
    assert all(label not in got[k].labels.split(",") for k in (-1, -2))


# 4: quality classifier


def test_factorisation_machine_held_out(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_model.train(docs, labels)
    rows = quality_model.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert len(held) > 20 and np.mean([r.predicted == r.quality for r in held]) > 0.9
    again = quality_model.score(docs.repartition(3), quality_model.train(docs.repartition(5), labels)).collect()
    a = {r.doc_id: r.score for r in again}
    assert all(abs(a[r.doc_id] - r.score) < 1e-4 for r in rows)


def test_pairwise_identity():
    rng = np.random.default_rng(1)
    d = quality_model.BUCKETS + quality_model.DENSE
    x = rng.random((40, d)).astype(np.float32)
    fm = quality_model.Machine(x, rng.integers(0, 2, 40).astype(np.float32))
    z = fm.ready(x)[0].astype(float)
    slow = fm.w0 + z @ fm.w + sum(z[i] * z[i + 1 :] @ (fm.v[i + 1 :] @ fm.v[i]) for i in range(d - 1))
    assert abs(1 / (1 + np.exp(-slow)) - fm.score(x)[0]) < 1e-3


def test_classifier_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    fm = quality_model.train(docs, none)
    rows = quality_model.score(docs, fm).collect()
    assert len(rows) == 15 and {r.score for r in rows} == {0.5} and {r.predicted for r in rows} == {1}
    assert quality_model.score(empty, fm).count() == 0


def plain_features(text, stated):
    """The dense statistics of a text by plain means, and its word buckets."""
    b = text.encode()
    size, words, lines = max(1, len(b)), SPACED.findall(text), text.split("\n")
    kinds = [sum(chr(c) in cs for c in b if c < 128) / size for cs in quality_model._CLASSES]
    length = [len(w.encode()) for w in words]
    mean = sum(length) / max(1, len(words))
    grams = list(zip(words, words[1:], words[2:], strict=False))
    full = [x for x in lines if x]
    later = lambda xs: len(xs) - len(set(xs))
    dense = [
        *kinds, np.log1p(len(words)), np.log1p(len(lines)), mean, np.sqrt(max(0, sum(x * x for x in length) / max(1, len(words)) - mean**2)), len(words) / len(lines),
        later(full) / len(lines), later(grams) / max(1, len(words)), np.log1p(stated), not words, sum(x > 20 for x in length) / max(1, len(words)),
    ]
    bag = Counter()
    for w in words:
        x = np.frombuffer("".join(c.lower() if "A" <= c <= "Z" else c for c in w).encode(), np.uint8)
        bag[int(kernels.hash_spans(x, np.array([0]), np.array([len(x)]))[0]) % quality_model.BUCKETS] += 1
    v = np.zeros(quality_model.BUCKETS)
    for k, n in bag.items():
        v[k] = np.sqrt(n)
    return v / max(1e-6, np.sqrt((v**2).sum())), np.array(dense, float)


@given(st.lists(st.text(alphabet="abAB .,!#|()-'@9é\n", max_size=60), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_features_equal_plain_ones(texts):
    stated = np.arange(len(texts)) * 7
    rows = np.concatenate([x for _, x in quality_model.features(pa.array(texts, pa.string()), stated)])
    for i, t in enumerate(texts):
        words, dense = plain_features(t, stated[i])
        assert np.allclose(rows[i, : quality_model.BUCKETS], words, atol=1e-6)
        assert np.allclose(rows[i, quality_model.BUCKETS :], dense, atol=1e-5), (t, rows[i, quality_model.BUCKETS :] - dense)


def test_the_sample_is_one_row_an_id(spark, monkeypatch):
    """Repeated ids, contradicting labels and one kind of label only; the bound holds for rows that reach the driver."""
    seen = []
    monkeypatch.setattr(quality_model, "Machine", lambda x, y: seen.append((len(x), sorted(y.tolist()))))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, f"text {i} {k}") for i in ids for k in range(50)], "doc_id long, text string")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    quality_model.train(docs, labels([(i, i % 2) for i in ids] * 3), rows=5)
    quality_model.train(docs, labels([(ids[0], 0), (ids[0], 1), (ids[1], 1), (ids[1], 1), (None, 0), (ids[2], None)]))
    assert seen[0][0] == 5 and seen[1] == (1, [1.0])
    monkeypatch.undo()
    one_kind = quality_model.train(docs, labels([(i, 1) for i in ids]))
    assert {r.score for r in quality_model.score(docs.limit(9), one_kind).collect()} == {1.0}


def test_scores_of_very_long_texts(spark, sf):
    model = quality_model.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = quality_model.score(spark.createDataFrame([(1, "word " * 600_000), (2, "x" * 3_000_000), (3, None), (4, "")], "doc_id long, text string"), model).collect()
    got = {r.doc_id: r.score for r in rows}
    assert all(0 <= x <= 1 for x in got.values()) and got[3] == got[4]


# 6: piece codec


@pytest.fixture(scope="module")
def pieces():
    return piece_codec.Pieces.load(piece_codec.default_model())


@given(st.lists(st.text(max_size=60) | st.text(alphabet="ab ▁é\n", max_size=30), max_size=5))
@settings(max_examples=60, deadline=None)
def test_round_trip(pieces, texts):
    for p in (0.0, 0.1, 0.5):
        ids, bounds = piece_codec.encode(pieces, texts, list(range(len(texts))), p)
        assert [x.decode("utf-8", "surrogatepass") for x in piece_codec.decode(pieces, ids, bounds)] == texts


@given(st.text(alphabet="the quickbrown é ing  ", max_size=200))
@settings(max_examples=40, deadline=None)
def test_no_dropout_equals_the_library(pieces, text):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    assert piece_codec.encode(pieces, [text], [0], 0.0)[0].tolist() == sp.encode(text)


def test_agenda_equals_brute_force(pieces, monkeypatch):
    """Word by word, with the same keyed hash, one candidate at a time."""
    t = pieces.tables()
    rng = np.random.default_rng(3)
    words = ["▁" + "".join(rng.choice(list("theandiongrs"), rng.integers(1, 25))) for _ in range(200)]
    ids = np.concatenate([[t["chars"][0x20 if c == "▁" else ord(c)] for c in w] for w in words]).astype(np.int32)
    begin = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    key = rng.integers(0, 1 << 63, len(words)).astype(np.uint64)
    final, stay = piece_codec.run_agendas(pieces, ids, begin, key, 0.3)
    monkeypatch.setattr(piece_codec, "LONG_UNIT", 1)
    heap_final, heap_stay = piece_codec.run_agendas(pieces, ids, begin, key, 0.3)
    for u in range(len(words)):
        sym = [(int(x), k, k + 1) for k, x in enumerate(ids[begin[u] : begin[u + 1]])]
        dropped = set()
        while True:
            best = None
            for k in range(len(sym) - 1):
                p = int(pieces.merged(np.array([sym[k][0]]), np.array([sym[k + 1][0]]))[0])
                span = (sym[k][1], sym[k + 1][1], sym[k + 1][2])
                if p >= 0 and span not in dropped and (best is None or t["rank"][p] < best[0]):
                    best = (t["rank"][p], k, p, span)
            if best is None:
                break
            _, k, p, span = best
            if piece_codec.skipped(key[u : u + 1], *[np.array([x]) for x in span], 0.3)[0]:
                dropped.add(span)
                continue
            sym[k : k + 2] = [(p, sym[k][1], sym[k + 1][2])]
        at = slice(begin[u], begin[u + 1])
        assert final[at][stay[at]].tolist() == [x[0] for x in sym]
        assert heap_final[at][heap_stay[at]].tolist() == [x[0] for x in sym]


def test_dropout_is_keyed(pieces):
    text = "international organisation " * 50
    one = piece_codec.encode(pieces, [text], [7], 0.2)[0]
    assert np.array_equal(one, piece_codec.encode(pieces, ["", text], [1, 7], 0.2)[0])
    assert not np.array_equal(one, piece_codec.encode(pieces, [text], [7], 0.2, seed=9)[0])
    assert len(one) > len(piece_codec.encode(pieces, [text], [7], 0.0)[0])


def test_each_occurrence_draws_its_own_skips(pieces):
    """Every unit equals an agenda of its own key; merges are skipped with chance 0.1; frequent words vary."""
    word, n = " international", 4000
    points = np.array([ord(c) for c in word] * n, np.int64)
    fresh = np.zeros(len(points), bool)
    fresh[0] = True
    place = np.arange(len(points)).astype(np.uint64) + np.uint64(99)
    ids, at = shared = piece_codec.encode_chunk(pieces, points, fresh, place, 0.1, 5)
    bounds = np.searchsorted(at, np.arange(n + 1) * len(word))
    assert len({tuple(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)}) > 20
    keys = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(piece_codec, "_skips_any", lambda log, which, k, key, dropout: keys.append(key) or np.ones(len(which), bool))
        alone = piece_codec.encode_chunk(pieces, points, fresh, place, 0.1, 5)
    assert all(np.array_equal(a, b) for a, b in zip(alone, shared, strict=True))
    assert len(np.unique(keys[0])) == n
    drawn = [piece_codec.skipped(keys[0], *[np.full(n, x) for x in (k - 1, k, k + 1)], 0.1).mean() for k in range(1, 13)]
    assert all(0.08 < x < 0.12 for x in drawn) and 0.095 < np.mean(drawn) < 0.105


def test_copies_draw_their_own_skips(spark, pieces):
    text = "international organisation " * 20
    ids, bounds = piece_codec.encode(pieces, [text] * 3, [7] * 3, copies=[1, 2, 2])
    a, b, c = (ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:], strict=True))
    assert a != b and b == c
    rows = spark.createDataFrame([(7, text, 1), (7, text, 2)], "doc_id long, text string, copy int")
    got = piece_codec.encode_documents(rows, copy="copy").collect()
    assert all(r.lossless for r in got) and {tuple(r.ids) for r in got} == {tuple(a), tuple(b)}


def test_long_text_in_segments(pieces, monkeypatch):
    monkeypatch.setattr(piece_codec, "CHUNK_CHARS", 50)
    text = "some words  here and there " * 40 + "x" * 700
    ids, bounds = piece_codec.encode(pieces, [text, None, text], [1, 2, 3], 0.0)
    assert piece_codec.decode(pieces, ids, bounds) == [text.encode(), b"", text.encode()]


def test_codec_on_edge_rows(docs, empty):
    rows = piece_codec.encode_documents(docs, keep=("doc_id", "kept")).collect()
    assert len(rows) == 15 and all(r.lossless and r.n_ids == len(r.ids) for r in rows) and {r.kept for r in rows} == {"mine"}
    assert piece_codec.encode_documents(empty).count() == 0
    every = piece_codec.encode_documents(docs, keep=tuple(docs.columns))
    assert every.columns == [f"kept_{c}" if c in ("ids", "n_ids", "lossless") else c for c in docs.columns] + ["ids", "n_ids", "lossless"]
    assert {r["a.b"] for r in every.collect()} == {"own"}


# 8: chat formatting


@given(st.lists(st.tuples(st.text(max_size=8) | st.just("assistant"), st.text(max_size=30) | st.text(alphabet="<s>/[INST]\\ ", max_size=30)), max_size=5))
@settings(max_examples=150, deadline=None)
def test_chat_round_trip(turns):
    text, spans = chat_format.compile_template(chat_format.TEMPLATE)([{"role": r, "text": t} for r, t in turns])
    assert not any(c in chat_format.escape(x) for turn in turns for x in turn for c in chat_format.CONTROL)
    assert sum(text.count(c) for c in chat_format.CONTROL) == 4 * len(turns)
    assert chat_format.read_back(text) == turns
    assert [chat_format.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_template_language():
    run = chat_format.compile_template("{% set x = 'a' + 'b' %}{{ x | upper }}{% if 1 == 2 %}no{% elif loud %}LOUD{% else %}quiet{% endif %}{% for m in messages %}{{ m.role if m.role else 'none' }}{{ ',' if not loop.last else '' }}{% endfor %}")
    assert run([{"role": "u"}, {"role": None}], loud=False)[0] == "ABquietu,none"
    assert chat_format.fold(chat_format._Expression("'a' + 'b' == 'ab'").parse()) == ("const", True)
    assert chat_format.compile_template("a {{- ' b' -}} c")([])[0] == "a bc"
    for bad in ("{{ x.__class__() }}", "{{ open('f') }}", "{% import os %}", "{% for x in y %}", "{{ x | system }}", "{{ 1 + }}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.compile_template(bad)


def test_chat_on_edge_rows(spark):
    rows = [(1, 2, "assistant", "b</s>"), (1, 1, "user", None), (None, 0, None, "x"), (2, 0, "assistant", "\\"), (2, 0, "assistant", "\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_conversations(df)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb</s>\n").hexdigest() and got[1].loss_chars == 5
    assert got[None].n_turns == 1 and got[2].n_turns == 2 and got[2].loss_sha256 == hashlib.sha256(b"\\\\").hexdigest()
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).count() == 0
    more = df.withColumns({c: F.lit("x") for c in ("formatted", "loss_spans", "a.b", "messages")})
    assert {r.conv_id for r in chat_format.format_conversations(more).collect()} == {1, 2, None}


def test_a_very_long_conversation(spark):
    """Thousands of turns and one very long text, full of control strings."""
    turns = [(5, i, "assistant" if i % 2 else "user", f"turn {i} </s><s>" if i else "[INST]\\" * 200_000) for i in range(5000)]
    r = chat_format.digests(chat_format.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()
    said = "".join(t for _, _, role, t in turns if role == "assistant")
    assert [(x.n_turns, x.loss_chars, x.loss_sha256) for x in r] == [(5000, len(said), hashlib.sha256(said.encode()).hexdigest())]
