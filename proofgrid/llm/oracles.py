"""SQL for the queries of this subpackage whose result SQL can state."""

from __future__ import annotations

from proofgrid.llm import licenses
from proofgrid.llm.quality_rules import Rules

RULES = Rules()

QUALITY_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM documents),
wins AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id),
j AS (SELECT *, n_words < {RULES.min_words} OR 100 * n_repeat_words > {RULES.max_repeat_percent} * n_words AS base_failed FROM m),
q AS (SELECT source, base_failed OR 100 * n_symbols > {RULES.max_symbol_percent} * word_chars OR {RULES.words_per_dup_line} * n_dup_lines > n_words
   OR word_chars < {RULES.min_word_chars} * n_words OR word_chars > {RULES.max_word_chars} * n_words AS bad FROM j),
h AS (SELECT source, count(*) AS n, count(*) FILTER (bad) AS failed FROM q WHERE source IS NOT NULL GROUP BY source),
p AS (
  SELECT least(greatest(avg(failed / n), 1e-6), 1 - 1e-6) AS mean, greatest(var_pop(failed / n) - avg(failed / n * (1 - failed / n) / (n - 1)), 1e-9) AS spread,
         count(*) AS k
  FROM h WHERE n >= 2),
s AS (SELECT k, mean, least(greatest(mean * (1 - mean) / spread - 1, 1e-3), {RULES.max_strength}) AS strength FROM p),
b AS (SELECT CASE WHEN k = 0 THEN 1.0 ELSE mean * strength END AS alpha, CASE WHEN k = 0 THEN 1.0 ELSE (1 - mean) * strength END AS beta FROM s),
r AS (SELECT source, (failed + alpha) / (n + alpha + beta) AS rate, n + alpha + beta AS weight, alpha / (alpha + beta) AS common FROM h, b),
bad AS (SELECT source FROM r WHERE rate - {RULES.deviations} * sqrt(rate * (1 - rate) / (weight + 1)) > greatest({RULES.max_host_rate}, common))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(source IN (SELECT source FROM bad), false) AS kept
FROM j
"""

LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
f AS (SELECT k, min(doc_id) AS head FROM l WHERE length(k) >= 10 GROUP BY k),
m AS (SELECT l.doc_id, line, pos, f.head IS NOT NULL AND l.doc_id > f.head AS gone FROM l LEFT JOIN f ON f.k = l.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(text: str) -> str:
    """The canonical form of a licence text on DuckDB."""
    out = f"translate(coalesce({text}, ''), '{licenses.UPPER}', '{licenses.LOWER}')"
    for pattern, new in licenses.RULES:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(new.replace('$', chr(92)))}, 'g')"
    return f"trim({out})"


LICENSES_SQL = f"""
WITH t(licence, body) AS (VALUES {", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in licenses.known_texts())}),
known AS (SELECT sha256({canonical_sql("body")}) AS digest, min(licence) AS licence FROM t GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
hits AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS line_licences, count(*) AS n FROM (
    SELECT doc_id, licence FROM (SELECT doc_id, sha256({canonical_sql("line")}) AS digest FROM l WHERE length(line) > 0) x JOIN known USING (digest)) GROUP BY doc_id),
w AS (SELECT doc_id, sha256({canonical_sql("text")}) AS digest FROM documents)
SELECT w.doc_id, w.digest, known.licence AS text_licence, coalesce(line_licences, '') AS line_licences, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_licence_lines
FROM w LEFT JOIN known ON known.digest = w.digest LEFT JOIN hits ON hits.doc_id = w.doc_id
"""

TRIE_SQL = """
WITH RECURSIVE
ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
bits AS (
  SELECT c, 0 AS i, 4294967295::BIGINT AS crc FROM ids
  UNION ALL
  SELECT c, i + 1, list_reduce([xor(crc, ord(substring(CAST(c AS VARCHAR), i + 1, 1))::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))
  FROM bits WHERE i < length(CAST(c AS VARCHAR))),
cut AS (SELECT c, CAST(xor(max_by(crc, i), 4294967295) % 9 AS BIGINT) AS h FROM bits GROUP BY c),
own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
built AS (
  SELECT o.c, list_concat(list_slice(coalesce(b.t, []), 1, h), list_slice(o.t, h + 1, len(o.t))) AS t
  FROM own o JOIN cut USING (c) LEFT JOIN own b ON b.c = o.c - o.c % 5),
m AS (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM built),
p AS (SELECT c, d, list_slice(t, 1, d) AS k, len(t) = d AS ends FROM m),
nodes AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(k[d].x)) END AS bytes
  FROM p GROUP BY d, k),
up AS (SELECT x.d, x.k, y.conv_id AS parent_conv_id FROM nodes x JOIN nodes y ON y.d = x.d - 1 AND y.k = list_slice(x.k, 1, x.d - 1)),
kids AS (SELECT list_slice(k, 1, d - 1) AS k, d - 1 AS d, count(*) AS n_children FROM up GROUP BY 1, 2),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, k)),
below AS (
  SELECT p.d, p.k, sum((x.n_children = 0)::BIGINT) AS n_leaves, sum((x.n - 1) * x.bytes) AS saved_tokens
  FROM p JOIN full_nodes x ON x.conv_id = p.c AND x.d >= p.d GROUP BY p.d, p.k)
SELECT f.conv_id, f.d AS depth, up.parent_conv_id, f.n AS n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below USING (d, k) LEFT JOIN up USING (d, k)
"""
