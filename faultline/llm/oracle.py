"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

from faultline.llm import licenses, quality

ORACLE: dict[str, str] = {}


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


_SUSPECT_LINE = f"""(
    (runs >= {quality.MIN_RUNS} AND runs >= {quality.SYMBOL_SHARE} * k)
    OR (k >= {quality.MIN_WORDS} AND NOT regexp_matches(s, '{_re(quality.SENTENCE_MARK)}'))
    OR (marks >= 2 AND marks * 5 >= k)
    OR {" OR ".join(f"contains(lower(s), '{p}')" for p in quality.BOILERPLATE)})"""

ORACLE["op3_quality_rules"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 0))) AS i FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS k FROM p),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM rep) GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(lines) AS s FROM d),
l1 AS (SELECT doc_id, s, len(list_filter(regexp_split_to_array(s, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS k,
              len(regexp_extract_all(s, '{_re(quality.SYMBOL_RUN)}')) AS runs,
              len(regexp_extract_all(s, '{_re(quality.SEPARATOR)}')) AS marks FROM l0),
l AS (SELECT doc_id, sum(length(s)) AS line_chars, sum(CASE WHEN {_SUSPECT_LINE} THEN length(s) ELSE 0 END) AS lost_chars,
             count(*) FILTER (WHERE k > 0) - count(DISTINCT s) FILTER (WHERE k > 0) AS n_dup_lines FROM l1 GROUP BY doc_id),
q AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         l.n_dup_lines::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         l.line_chars::BIGINT AS line_chars, l.lost_chars::BIGINT AS lost_chars
  FROM d JOIN l USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, line_chars, lost_chars,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_chars <= {quality.MAX_LOST} * line_chars AS kept
FROM q"""

_TEMPLATE_ROWS = ", ".join(
    f"({t}, '{label}', {licenses.template_words(text)}, {licenses.needed(len(licenses.template_words(text)), licenses.THRESHOLD)}, "
    f"{licenses.block_words(text)})" for t, (label, text) in enumerate(licenses.TEMPLATES))
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE["op8_licenses"] = rf"""
WITH t(template, label, tw, need, span) AS (VALUES {_TEMPLATE_ROWS}),
tw AS (SELECT template, label, need, span, len(tw) AS n, unnest(tw) AS word FROM t),
d AS (SELECT doc_id, coalesce(text, '') AS text,
             regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_LICENSE_WORD}') AS w FROM documents),
places AS (
  SELECT doc_id, i - 2 AS pos, CASE w[i - 1] WHEN 'mit' THEN 'mit' WHEN 'apache' THEN 'apache' END AS label
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, 'license'))
  WHERE i > 1 AND w[i] = 'license' AND w[i - 1] IN ('mit', 'apache')
  UNION ALL
  SELECT doc_id, i - 3, 'gpl'
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, 'license'))
  WHERE i > 2 AND w[i] = 'license' AND w[i - 1] = 'public' AND w[i - 2] = 'general'),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS z FROM places GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
blocks AS (SELECT doc_id, label, need, n, count(DISTINCT word) OVER (
             PARTITION BY doc_id, template ORDER BY i RANGE BETWEEN CURRENT ROW AND span - 1 FOLLOWING) AS shared
           FROM words JOIN tw USING (word)),
hits AS (SELECT DISTINCT doc_id, label, shared / n AS score FROM blocks WHERE shared >= need),
best AS (SELECT doc_id, max(score) AS score FROM hits GROUP BY doc_id),
every AS (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM hits),
bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT DISTINCT doc_id, label FROM places) GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM every GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.a::BIGINT AS first_word,
       base.z::BIGINT AS last_word, coalesce(bl.s, '') AS base_labels, coalesce(al.s, '') AS labels,
       coalesce(best.score, 0)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id)"""

ORACLE["op5_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""
