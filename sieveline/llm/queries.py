"""The registered queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from . import chat, fingerprints, lm, neardup, packing, quality, secrets, sentencepieces, suffixes, topk
from .common import table


def tokenizer(name):
    """Where a vocabulary file of the public tokenizers lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sentencepiece_nbest(spark, sf_dir):
    return sentencepieces.report(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_quality_nbsvm(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat_preferences(spark, sf_dir):
    return chat.format_preferences(chat.conversation_pairs(table(spark, sf_dir, "conversations")), "conv_id")


def op4_suffix_dedup(spark, sf_dir):
    return suffixes.report(table(spark, sf_dir, "documents"))


def op5_cost_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_backoff_lm(spark, sf_dir):
    return lm.scores(table(spark, sf_dir, "documents"))


def op7_minhash_near_dups(spark, sf_dir):
    return neardup.components(table(spark, sf_dir, "documents"))


def op8_weighted_fingerprints(spark, sf_dir):
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


def op10_topk_maxscore(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece_nbest, op2_quality_nbsvm, op3_chat_preferences, op4_suffix_dedup, op5_cost_packing, op6_backoff_lm, op7_minhash_near_dups, op8_weighted_fingerprints, op9_secret_scan, op10_topk_maxscore)}

_RENDER = "list_aggregate(list_transform({0}, lambda x: '<|im_start|>' || coalesce(x.role, 'unknown') || chr(10) || coalesce(x.text, '') || '<|im_end|>' || chr(10)), 'string_agg', '')"
_LEN = "(12 + length(coalesce(x.role, 'unknown')) + 1 + length(coalesce(x.text, '')) + 11)"
_SPANS = """array_to_string(list_transform(list_filter(range(1, len({0}) + 1), lambda i: {0}[i].role = 'assistant'),
  lambda i: (coalesce(list_sum(list_transform({0}[1:i - 1], lambda x: %(len)s)), 0)::BIGINT + 12 + 9 + 1)::VARCHAR || ':' ||
            (coalesce(list_sum(list_transform({0}[1:i], lambda x: %(len)s)), 0)::BIGINT - 1)::VARCHAR), ',')""" % {"len": _LEN}

ORACLE = {
    "op10_topk_maxscore": """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v)::BIGINT AS score
  FROM v q JOIN v r ON q.n <> r.n WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_chat_preferences": f"""
WITH w AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS c FROM conversations GROUP BY conv_id),
p AS (
  SELECT w.conv_id, w.c, CASE WHEN o.conv_id IS NULL THEN w.c[1:len(w.c) - 1] ELSE list_append(w.c[1:len(w.c) - 1], o.c[len(o.c)]) END AS r
  FROM w LEFT JOIN w o ON o.conv_id = xor(w.conv_id, 1::BIGINT)),
n AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i].role IS DISTINCT FROM r[i].role OR c[i].text IS DISTINCT FROM r[i].text)) - 1, least(len(c), len(r)))::BIGINT AS n FROM p),
t AS (SELECT conv_id, n, c[1:n] AS pa, c[n + 1:] AS pc, r[n + 1:] AS pr FROM n)
SELECT conv_id, n AS n_common, coalesce({_RENDER.format("pa")}, '') AS prompt, coalesce({_RENDER.format("pc")}, '') AS chosen,
  coalesce({_RENDER.format("pr")}, '') AS rejected, coalesce({_SPANS.format("pc")}, '') AS chosen_spans, coalesce({_SPANS.format("pr")}, '') AS rejected_spans
FROM t""",
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
_KINDS = f"[{', '.join(repr(k) for k in secrets.KINDS)}]"


def _matches(kind: int, pattern: str, group: int = 0) -> str:
    """Places of a pattern's matches, from what lies between them and the matches."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {kind} AS kind, length(array_to_string(gap[1:i], '')) + length(array_to_string(hit[1:i - 1], '')) AS a, length(hit[i]) AS n, part[i] AS part
  FROM (SELECT doc_id, regexp_split_to_array(t, '{p}') AS gap, regexp_extract_all(t, '{p}', 0) AS hit, regexp_extract_all(t, '{p}', {group}) AS part FROM texts WHERE regexp_matches(t, '{p}')), unnest(range(1, len(hit) + 1)) AS x(i)"""


_ALLOWED = " OR ".join(f"regexp_full_match(part, '{p.replace("}+", "}")}')" for p in secrets.ALLOWED)
_SPELL = f"string_agg({_KINDS}[kind + 1] || ':' || a::VARCHAR || ':' || b::VARCHAR, ',' ORDER BY a, kind)"

ORACLE |= {
    "op4_suffix_dedup": """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, b[i:i + 199] AS w FROM t, unnest(range(1, octet_length(b) - 198)) AS x(i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY sha256(w)) AS n FROM w) WHERE n > 1),
opens AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 1 ELSE 0 END AS o FROM again),
runs AS (SELECT r, i, sum(o) OVER (PARTITION BY r ORDER BY i) AS run FROM opens),
spans AS (SELECT r, min(i) AS a, max(i) + 200 AS e FROM runs GROUP BY r, run),
gaps AS (SELECT r, a, e, lag(e, 1, 1) OVER (PARTITION BY r ORDER BY a) AS before FROM spans),
pieces AS (SELECT t.r, sum(e - a)::BIGINT AS n, count(*) AS k, string_agg(hex(b[before:a - 1]), '' ORDER BY a) || hex(any_value(b[e_last:])) AS h
  FROM gaps JOIN t USING (r) JOIN (SELECT r, max(e) AS e_last FROM spans GROUP BY r) USING (r) GROUP BY t.r)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(k, 0) AS n_spans, sha256(CASE WHEN h IS NULL THEN b ELSE unhex(h) END) AS kept_sha256
FROM t LEFT JOIN pieces USING (r)""",
    "op7_minhash_near_dups": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
classes AS MATERIALIZED (SELECT s, len(s) AS n, min(doc_id) AS id FROM sets WHERE len(s) > 0 GROUP BY s),
each AS MATERIALIZED (SELECT id, n, unnest(s) AS g FROM classes),
links AS MATERIALIZED (
  SELECT a.id AS u, b.id AS v FROM each a JOIN each b ON a.g = b.g AND a.id <> b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT id AS u, id AS v FROM classes UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v),
roots AS (SELECT u, min(v) AS root FROM reach GROUP BY u)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN roots ON roots.u = classes.id""",
    "op9_secret_scan": f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({" UNION ALL ".join((_matches(0, secrets.ASSIGN, 1), _matches(1, secrets.ACCESS), _matches(2, "[0-9a-f]+"), _matches(3, "[A-Za-z0-9+/_=-]{20,}")))}),
judged AS (
  SELECT *, CASE WHEN regexp_full_match(part, '[0-9a-f]+') THEN {secrets.BOUNDS["hex"]} WHEN regexp_full_match(part, '[0-9a-z+/_=-]+') THEN {secrets.BOUNDS["lower"]} ELSE {secrets.BOUNDS["mixed"]} END AS bound,
    CASE WHEN kind = 3 THEN list_max(list_transform(range(1, length(part) - 18), lambda i: list_aggregate(string_split(substr(part, i, 20), ''), 'entropy'))) END AS peak
  FROM hits WHERE CASE kind WHEN 0 THEN length(part) >= 12 WHEN 1 THEN length(part) >= 18 WHEN 2 THEN length(part) >= 16 ELSE regexp_matches(part, '[0-9]') AND NOT ({_ALLOWED}) END),
spans AS (SELECT doc_id, kind, a, a + n AS b FROM judged WHERE kind < 3 OR peak >= bound - 1e-9),
spelled AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, {_SPELL} FILTER (kind < 3) AS base, {_SPELL} AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN spelled USING (doc_id)""",
}
