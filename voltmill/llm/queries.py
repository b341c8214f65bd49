"""The queries opN_<name> over whole tables, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

_SPACED = r"[^\x20\x09-\x0D]+"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import license_scan

    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    return line_dedup.report(table(spark, sf_dir, "documents")).withColumn("dropped", F.array_join("dropped", ","))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_model

    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.annotate(docs, keep=["doc_id"])


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import piece_codec

    return piece_codec.encode_documents(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat_format

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat_format.digests(chat_format.format_conversations(rows))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import exact_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.decide(docs)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.assign(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_license_scan": op2_license_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_quality_rules": op5_quality_rules,
    "op6_piece_codec": op6_piece_codec,
    "op7_source_mixing": op7_source_mixing,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_sharding": op10_sharding,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Links of documents(doc_id, text) and the least id that each document reaches.
JACCARD_CTES = rf"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACED}') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 75 * (na.n + nb.n - o)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
"""

_N_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ALNUM = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_N_WORDS}')"


def _license_sql() -> str:
    from .license_scan import PHRASES, TEMPLATES, THRESHOLD, stride_of, words_of

    words = {label: words_of(t) for label, t in TEMPLATES.items()}
    values = ", ".join(f"('{label}', '{w}', {stride_of(len(ws))})" for label, ws in words.items() for w in sorted(set(ws)))
    strides = ", ".join(f"({n})" for n in sorted({stride_of(len(ws)) for ws in words.values()}))
    spans = " UNION ALL ".join(
        f"SELECT r, '{label}' AS label, i - 1 AS at FROM w WHERE " + " AND ".join(f"x{k} = '{x}'" for k, x in enumerate(p.split())) for p, label in PHRASES.items()
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS ws FROM documents),
w AS (SELECT r, i, x AS x0, lead(x, 1) OVER q AS x1, lead(x, 2) OVER q AS x2 FROM (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM d) WINDOW q AS (PARTITION BY r ORDER BY i)),
places AS ({spans}),
v AS (SELECT * FROM (VALUES {values}) AS t(label, t, stride)),
k AS (SELECT r, i - 1 AS i, x0 AS t FROM w WHERE x0 IN (SELECT t FROM v)),
x AS (SELECT DISTINCT r, stride, i // stride - back AS a, t FROM k, (VALUES {strides}) AS s(stride), (VALUES (0), (1)) AS b(back) WHERE i // stride >= back),
n AS (SELECT label, count(*) AS n FROM v GROUP BY 1),
m AS (SELECT x.r, v.label, count(*)::DOUBLE / any_value(n.n) AS share FROM x JOIN v USING (t, stride) JOIN n USING (label) GROUP BY x.r, x.a, v.label HAVING count(*) >= ceil({THRESHOLD} * any_value(n.n) - 1e-9)),
a AS (SELECT r, label, share FROM m UNION ALL SELECT r, label, 1.0 FROM places)
SELECT d.doc_id, len(d.ws) AS n_words, count(DISTINCT (p.at, p.label)) FILTER (WHERE p.at IS NOT NULL) AS n_base, min(p.at) AS first_word, max(p.at) AS last_word, coalesce(string_agg(DISTINCT p.label, ',' ORDER BY p.label), '') AS base_labels,
  coalesce((SELECT string_agg(DISTINCT a.label, ',' ORDER BY a.label) FROM a WHERE a.r = d.r), '') AS labels, coalesce((SELECT max(share) FROM a WHERE a.r = d.r), 0) AS score
FROM d LEFT JOIN places p USING (r) GROUP BY d.r, d.doc_id, d.ws
"""


def _rules_sql() -> str:
    from .quality_rules import COVERAGE, DUP_LINE_CHARS, DUP_LINES, MIN_WORDS

    def grams(n: int, k: str) -> str:
        """Windows of n words, which hold no spaces, with a number k."""
        words = ", ".join(["x", *(f"lead(x, {j}) OVER q" for j in range(1, n))])
        return f"SELECT r, i, {k} AS k FROM (SELECT r, i, concat_ws(' ', {words}) AS gram, lead(x, {n - 1}) OVER q AS last FROM w WINDOW q AS (PARTITION BY r ORDER BY i)) WHERE last IS NOT NULL"

    ctes, columns, bad = [], [], []
    for n, most in COVERAGE.items():
        ctes.append(f"""
g{n} AS ({grams(n, "row_number() OVER (PARTITION BY r, gram ORDER BY i)")}),
c{n} AS (SELECT r, sum(length(x)) AS c FROM (SELECT DISTINCT g.r, g.i + o.range AS i FROM g{n} g, range({n}) o WHERE g.k > 1) p JOIN w USING (r, i) GROUP BY r)""")
        columns.append(f"coalesce(c{n}.c, 0) / greatest(f.word_chars, 1)::DOUBLE AS cover_{n}")
        bad.append(f"cover_{n} > {most}")
    joins = " ".join(f"LEFT JOIN c{n} USING (r)" for n in COVERAGE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM d),
g3 AS ({grams(3, "count(*) OVER (PARTITION BY r, gram)")}),
r3 AS (SELECT r, count(DISTINCT i + o.range) AS n FROM g3, range(3) o WHERE k > 1 GROUP BY r),
l AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY k) AS nth FROM (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d) WHERE regexp_matches(line, '{_SPACED}')),
ln AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE nth > 1) AS dup, sum(length(line)) AS c, sum(length(line)) FILTER (WHERE nth > 1) AS dc FROM l GROUP BY r),{",".join(ctes)},
f AS (SELECT r, doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
v AS (SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, coalesce(ln.dup, 0) AS n_dup_lines, coalesce(r3.n, 0) AS n_repeat_words, {", ".join(columns)},
  coalesce(ln.dup, 0) / greatest(coalesce(ln.n, 0), 1)::DOUBLE AS dup_line_share, coalesce(ln.dc, 0) / greatest(coalesce(ln.c, 0), 1)::DOUBLE AS dup_line_char_share
  FROM f LEFT JOIN r3 USING (r) LEFT JOIN ln USING (r) {joins})
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND NOT ({" OR ".join(bad)} OR dup_line_share > {DUP_LINES} OR dup_line_char_share > {DUP_LINE_CHARS}) AS kept FROM v
"""


_ESCAPED = r"regexp_replace({0}, '\\|</?s>|\[/?INST\]', '\\\0', 'g')"

#: Lines an edit apart agree in a half, so only lines that share one are compared.
_LINES_SQL = """
WITH RECURSIVE d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, k - 1 AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d) WHERE length(trim(line, ' ')) > 0),
u AS (SELECT line, min((doc_id, line_no)) AS first, length(line) AS n FROM l GROUP BY line),
k AS (SELECT line, first, n, unnest([concat('p', left(line, n // 2)), concat('p', left(line, (n - 1) // 2)), concat('s', right(line, n - n // 2)), concat('s', right(line, (n - 1) - (n - 1) // 2))]) AS half FROM u),
c AS (SELECT DISTINCT a.line AS x, b.line AS y FROM k a JOIN k b ON a.half = b.half AND b.first < a.first AND abs(a.n - b.n) <= 1),
-- Length of the common beginning, then the rests must be equal after one code point of the longer or of both.
e AS (SELECT x, y, least(length(x), length(y)) AS m, 0 AS lo, least(length(x), length(y)) AS hi FROM c
  UNION ALL SELECT x, y, m, CASE WHEN left(x, (lo + hi + 1) // 2) = left(y, (lo + hi + 1) // 2) THEN (lo + hi + 1) // 2 ELSE lo END, CASE WHEN left(x, (lo + hi + 1) // 2) = left(y, (lo + hi + 1) // 2) THEN hi ELSE (lo + hi + 1) // 2 - 1 END FROM e WHERE lo < hi),
near AS (SELECT DISTINCT x AS line FROM e WHERE lo = hi AND CASE WHEN length(x) = length(y) THEN substr(x, lo + 2) = substr(y, lo + 2) WHEN length(x) > length(y) THEN substr(x, lo + 2) = substr(y, lo + 1) ELSE substr(x, lo + 1) = substr(y, lo + 2) END),
g AS (SELECT doc_id, list_sort(list(DISTINCT line_no)) AS gone FROM l JOIN u USING (line) WHERE (doc_id, line_no) > first OR line IN (SELECT line FROM near) GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(len(list_filter(string_split(text, chr(10)), lambda t: length(trim(t, ' ')) > 0)), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped, coalesce(array_to_string(gone, ','), '') AS dropped
FROM documents LEFT JOIN g USING (doc_id)
"""

SQL = {
    "op2_license_scan": _license_sql(),
    "op3_line_dedup": _LINES_SQL,
    "op5_quality_rules": _rules_sql(),
    "op8_chat_formatting": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format("text")}) + length({_ESCAPED.format("role")}) + length('<s>[INST][/INST]</s>')) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
""",
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE {JACCARD_CTES}
SELECT n.doc_id, n.n AS n_shingles, min(reach.b) AS component_id FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n
""",
    "op9_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
""",
}
