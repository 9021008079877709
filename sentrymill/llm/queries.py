"""The registered queries of this subpackage, with oracle SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill.llm import (
    audit, backoff, benchmark, lattice, licenses, lines, manifest, mixing, packing, preference, quality, recompress,
    simhash,
)

QUERIES = {}
ORACLES = {}
_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"
_LOWER = f"'{licenses.UPPER}', '{licenses.LOWER}'"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return keep


@query("op1_simhash")
def _(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents"))


@query("op2_quality")
def _(spark, d):
    return quality.score(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op3_substrings", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
win AS (SELECT r, i AS pos, array_to_string(w[i:i + {recompress.WINDOW - 1}], ' ') AS s FROM (
  SELECT r, w, unnest(range(1, len(w) - {recompress.WINDOW - 2})) AS i FROM d WHERE len(w) >= {recompress.WINDOW})),
rep AS (SELECT r, pos FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT p.r, p.word, p.pos, max(CASE WHEN rep.pos IS NOT NULL THEN 1 ELSE 0 END) OVER (
  PARTITION BY p.r ORDER BY p.pos ROWS BETWEEN {recompress.WINDOW - 1} PRECEDING AND CURRENT ROW) AS g
  FROM p LEFT JOIN rep ON rep.r = p.r AND rep.pos = p.pos),
kept AS (SELECT r, sum(g) AS n, string_agg(word, ' ' ORDER BY pos) FILTER (g = 0) AS t FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""")
def _(spark, d):
    return recompress.remove_repeats(table(spark, d, "documents"), texts=False)


@query("op4_mixing")
def _(spark, d):
    return mixing.mix(table(spark, d, "documents")).drop("sub")


def _licence_oracle() -> str:
    known = ", ".join(f"('{i}', '{s}')" for i, s in licenses.SENTENCES.items())
    rules = ", ".join(f"('{name}', '(^|.*,){',(.*,)?'.join(ids)}(,.*|$)')" for name, ids in licenses.RULES)
    plain = "trim(regexp_replace(translate(p, {}), '[^a-z0-9]+', ' ', 'g'))".format(_LOWER)
    # letters that some known sentence or notice begins with: spares most comparisons
    begins = "m[1] IN (" + ", ".join(sorted({f"'{s[0]}'" for s in licenses.SENTENCES.values()} | {f"'{c}'" for c in "tlrdpma"})) + ")"
    joined = "sequence"
    for two, one in licenses.TOGETHER.items():
        joined = f"replace({joined}, '{','.join(two)}', '{one}')"
    return rf"""
WITH known(id, s) AS (VALUES {known}), rules(licence, pattern) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(list_transform(string_split(
  regexp_replace(text, '{licenses.BREAK}', '\1' || chr(10), 'g'), chr(10)), lambda p: {plain}), lambda p: p <> '') AS w FROM documents),
o AS (SELECT r, doc_id, i, array_to_string(w[i:i + {licenses._MOST_WORDS - 1}], chr(10)) || chr(10) AS m
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
b AS (SELECT r, doc_id, i, m, replace(m, chr(10), ' ') AS flat FROM o WHERE {begins}),
k AS (SELECT r, doc_id, i - 1 AS pos, id FROM b JOIN known ON starts_with(flat, s || ' ') AND substr(m, length(s) + 1, 1) = chr(10)),
f AS (FROM k UNION ALL SELECT r, doc_id, i - 1, 'notice ' || regexp_extract(flat, '{licenses.NOTICE}', {licenses.NAME_GROUP})
  FROM b WHERE regexp_matches(flat, '{licenses.NOTICE}') AND NOT EXISTS (FROM k WHERE k.r = b.r AND k.pos = b.i - 1)),
q AS (SELECT r, doc_id, count(*) AS n_sentences, min(pos)::BIGINT AS first_pos, string_agg(id, ',' ORDER BY pos, id) AS sequence
  FROM f GROUP BY r, doc_id)
SELECT DISTINCT r AS _r, doc_id, licence, n_sentences, first_pos, sequence FROM q JOIN rules ON regexp_matches({joined}, pattern)"""


@query("op5_licenses", f"SELECT doc_id, licence, n_sentences, first_pos, sequence FROM ({_licence_oracle()})")
def _(spark, d):
    return licenses.recognise(table(spark, d, "documents"))


@query("op6_lines", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LOWER}) AS key FROM e),
hot AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {lines.LEAST_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {lines.LEAST_DOCS}),
m AS (SELECT r, k.doc_id, line, pos, coalesce(top <> k.doc_id, false) AS gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id""")
def _(spark, d):
    done = lines.dedup_lines(table(spark, d, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op7_decontamination")
def _(spark, d):
    return benchmark.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op8_embeddings", f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e,
  len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
l AS (SELECT a.r AS a, b.r AS b, a.vec_id AS va, b.vec_id AS vb FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND a.ok AND b.ok
  AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {lattice.LEAST_COSINE}),
g AS (SELECT r, vec_id AS c FROM v UNION SELECT l.b, g.c FROM g JOIN l ON l.a = g.r WHERE g.c < l.vb)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = v.r)::BIGINT AS n_links, min(c) AS component_id, vec_id = min(c) AS kept
FROM v JOIN g USING (r) GROUP BY r, vec_id""")
def _(spark, d):
    return lattice.near_duplicates(table(spark, d, "embeddings"))


def _spans(c):
    return F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), "|")


_TURN = "'<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)"


def _side_sql(name: str) -> str:
    """Completion and learnt spans of one side."""
    return f"""
{name}s AS (SELECT conv_id, i, t, sum(length({_TURN})) OVER (PARTITION BY conv_id ORDER BY i) AS stop
  FROM (SELECT conv_id, unnest({name}[n + 1:]) AS t, generate_subscripts({name}[n + 1:], 1) AS i FROM n)),
{name}x AS (SELECT conv_id, string_agg({_TURN}, '' ORDER BY i) AS full_text,
  string_agg((stop - length(t.text) - 8)::VARCHAR || '-' || stop::VARCHAR, '|' ORDER BY i)
    FILTER (t.role = 'assistant') AS spans FROM {name}s GROUP BY conv_id)"""


@query("op9_preference", f"""
WITH q AS (SELECT conv_id, turn, role, text,
  role = 'assistant' AND row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn DESC, text DESC) = 1 AS last_one,
  row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn, text) = 1 AS first_one,
  lag(text) OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn, text) AS earlier FROM conversations),
c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS c FROM q GROUP BY conv_id),
s AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS r FROM (
  SELECT conv_id, turn, role, CASE WHEN last_one THEN earlier ELSE text END AS text FROM q WHERE NOT (last_one AND first_one)) GROUP BY conv_id),
b AS (SELECT conv_id, c, coalesce(r, []) AS r FROM c LEFT JOIN s USING (conv_id)),
n AS (SELECT conv_id, c, r, coalesce(list_min(list_filter(range(1, greatest(len(c), len(r)) + 1),
  lambda i: i > len(c) OR i > len(r) OR c[i] <> r[i])) - 1, len(c)) AS n FROM b),
{_side_sql("c")}, {_side_sql("r")}
SELECT conv_id AS pair_id, n::BIGINT AS n_prompt,
  array_to_string(list_transform(c[1:n], lambda t: {_TURN}), '') AS prompt,
  coalesce(cx.full_text, '') AS chosen, coalesce(rx.full_text, '') AS rejected,
  coalesce(cx.spans, '') AS chosen_spans, coalesce(rx.spans, '') AS rejected_spans
FROM n LEFT JOIN cx USING (conv_id) LEFT JOIN rx USING (conv_id)""")
def _(spark, d):
    turns = table(spark, d, "conversations")
    done = preference.format_pairs(turns, preference.stale_replies(turns), "conv_id")
    return done.withColumn("chosen_spans", _spans("chosen_spans")).withColumn("rejected_spans", _spans("rejected_spans"))


@query("op10_backoff", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.replace("text", f"translate(text, {_LOWER})")} AS w FROM documents),
p AS (SELECT r, unnest(w) AS c, generate_subscripts(w, 1) AS pos FROM d),
g AS (SELECT *, lag(c) OVER o AS b, lag(c, 2) OVER o AS a FROM p WINDOW o AS (PARTITION BY r ORDER BY pos)),
x AS (SELECT r, pos, count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY r, c) AS x1,
  CASE WHEN pos < 2 THEN 0 ELSE count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY r, b, c) END AS x2,
  CASE WHEN pos < 3 THEN 0 ELSE count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY r, a, b, c) END AS x3,
  count(*) OVER () AS total, count(*) OVER (PARTITION BY r) AS own FROM g),
y AS (SELECT *, lag(x1) OVER o AS y1, lag(x2) OVER o AS y2, CASE WHEN x3 > 0 THEN 3 WHEN x2 > 0 THEN 2 WHEN x1 > 0 THEN 1 ELSE 0 END AS m
  FROM x WINDOW o AS (PARTITION BY r ORDER BY pos)),
v AS (SELECT r, least(pos, {backoff.ORDER}) - m AS steps, CASE m WHEN 3 THEN x3 / y2 WHEN 2 THEN x2 / y1
  WHEN 1 THEN x1 / (total - own) ELSE 1 / total END AS v FROM y),
s AS (SELECT r, count(*) AS n, count(*) FILTER (steps > 0) AS k, sum(ln(v::DOUBLE) + steps * ln({backoff.ALPHA}::DOUBLE)) AS l FROM v GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_tokens, coalesce(k, 0)::BIGINT AS n_backed_off,
  round(coalesce(l, 0), 4) AS log_score, round(l / n, 6) AS mean_log FROM d LEFT JOIN s USING (r)""")
def _(spark, d):
    return backoff.score(table(spark, d, "documents")).withColumn("log_score", F.round("log_score", 4)).withColumn(
        "mean_log", F.round("mean_log", 6))


_LETTERS = ", ".join(f"({i}, '{letter}')" for i, letter in enumerate(audit.FILTERS))


@query("op11_filter_audit", rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < {audit.LEAST_WORDS})::INT
  + 2 * (100 * len(list_distinct(w)) < {audit.LEAST_DISTINCT} * len(w))::INT
  + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > {audit.MOST_CAPITALS} * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT
  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
v(i, name) AS (VALUES {_LETTERS}),
p AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o, a.name || b.name || c.name || d.name || e.name AS filter_order
  FROM v a, v b, v c, v d, v e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT filter_order, step, o[step] AS which, (1 << o[step])::INT AS bit,
  coalesce(list_sum(list_transform(o[1:step - 1], lambda x: 1 << x)), 0)::INT AS prior
  FROM p, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, which, bit,
  sum(CASE WHEN mask & (prior | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & prior = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & prior <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & prior = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & prior = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, which, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, which))::BIGINT AS shapley FROM r""")
def _(spark, d):
    return audit.audit(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op12_packing")
def _(spark, d):
    from public_tokenizers import path

    return packing.pack(table(spark, d, "documents"), path("byte_bpe_50k.json"), ids=False)


def _leaf_sql(n_chars: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
             for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(parts)})"


_BIT = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
_BYTE = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: %s)" % _BIT
_CRC = ("xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform("
        "string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: %s))" % _BYTE)


@query("op13_manifest", f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
  CASE WHEN {_CRC} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS claim FROM documents),
t AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, n
  FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)),
x AS (SELECT doc_id, leaf, claim, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
  FROM d JOIN t ON d.lang IS NOT DISTINCT FROM t.lang),
up AS (SELECT tree, 0 AS level, idx, leaf AS h, n FROM x
  UNION ALL SELECT tree, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2
  FROM up WHERE n > 1 GROUP BY tree, level, idx // 2, n),
sub AS (SELECT tree, h FROM up WHERE n = 1),
top AS (SELECT 0 AS level, tree AS idx, h, (SELECT count(*) FROM sub) AS n FROM sub
  UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2
  FROM top WHERE n > 1 GROUP BY level, idx // 2, n),
q AS (SELECT tree, idx, 0 AS step, idx AS pos, tree AS over, false AS above, n, ''::VARCHAR AS proof,
    coalesce(claim, leaf) AS fold FROM x
  UNION ALL SELECT q.tree, q.idx, step + 1, CASE WHEN q.n = 1 THEN over ELSE pos // 2 END, over, above OR q.n = 1,
    CASE WHEN q.n = 1 THEN (SELECT count(*) FROM sub) ELSE (q.n + 1) // 2 END,
    CASE WHEN q.n = 1 THEN proof ELSE proof || coalesce(u.h, p.h, '') END,
    CASE WHEN q.n = 1 THEN fold WHEN pos & 1 = 1 THEN sha256(coalesce(u.h, p.h, '') || fold)
         ELSE sha256(fold || coalesce(u.h, p.h, '')) END
  FROM q LEFT JOIN up u ON NOT above AND u.tree = q.tree AND u.n = q.n AND u.idx = xor(pos, 1)
  LEFT JOIN top p ON above AND p.n = q.n AND p.idx = xor(pos, 1)
  WHERE NOT (above AND q.n = 1)),
e AS (SELECT tree, idx, proof, fold FROM q WHERE above AND n = 1)
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = top.h AS verified
FROM x JOIN e USING (tree, idx) JOIN sub USING (tree) JOIN top ON top.n = 1""")
def _(spark, d):
    docs = table(spark, d, "documents")
    seventh = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claim = F.when(seventh, manifest.leaf_hash("doc_id", "source", "lang", F.col("n_chars") + 1, "text"))
    return manifest.proofs(manifest.build(docs, claim=claim)).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
