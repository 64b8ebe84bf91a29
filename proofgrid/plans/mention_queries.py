"""Lexicon and mention queries over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.functions import text as tx
from proofgrid.operators import evidence as ev
from proofgrid.operators import mentions as mn
from proofgrid.plans import lexicon as lx
from proofgrid.plans.base import fold_sql, query, table, texts

TOKENS_SQL = f"""
d AS (SELECT doc_id, text, {fold_sql('text')} AS f FROM documents),
g AS (SELECT doc_id, regexp_extract_all(f, '[a-z0-9+#]+') AS toks, string_split_regex(f, '[a-z0-9+#]+') AS gaps FROM d),
e AS (SELECT doc_id, generate_subscripts(toks, 1) AS i, unnest(toks) AS tok, unnest(gaps[1:len(toks)]) AS gap FROM g WHERE len(toks) > 0),
t AS (SELECT doc_id, i, tok, gap, (sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(tok))::BIGINT AS start FROM e),
n AS (SELECT *, lead(tok) OVER v AS tok2, lead(gap) OVER v AS gap2, lead(start) OVER v AS start2 FROM t WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
plain AS (SELECT doc_id, regexp_extract(tok, '^(that|with|from|license|this|que|der)', 1) AS skill_key, start, start + length(tok) AS "end" FROM t
  WHERE regexp_matches(tok, '^((that|with|from|license)[sx]?|this|que|der)$')),
the_hits AS (SELECT doc_id, start, start + 3 AS "end", tok2, gap2 FROM n WHERE tok = 'the'),
pair AS (SELECT doc_id, start, start2 + 3 AS "end" FROM n WHERE tok = 'of' AND tok2 = 'the' AND regexp_matches(gap2, '^[\\s\\-_/]*$')
  UNION ALL SELECT doc_id, start, start + 5 FROM t WHERE tok = 'ofthe')"""


@query("join_1_mentions", f"""
WITH {TOKENS_SQL} SELECT doc_id, skill_key, start, "end" FROM plain""")
def join_1(spark, sf):
    hits = mn.mentions(texts(spark, sf), lx.corpus_lexicon(spark))
    return hits.select("doc_id", "skill_key", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@query("join_2_context_guard", f"""
WITH {TOKENS_SQL}, a AS (SELECT t.doc_id, start, start + 3 AS "end", substring(f, greatest(start - 160, 0) + 1, start + 3 + 160 - greatest(start - 160, 0)) AS around FROM t JOIN d USING (doc_id) WHERE tok = 'and')
SELECT doc_id, start, "end" FROM a WHERE regexp_matches(around, '(^|[^a-z0-9+#])was($|[^a-z0-9+#])') AND NOT regexp_matches(around, '(^|[^a-z0-9+#])for($|[^a-z0-9+#])')""")
def join_2(spark, sf):
    hits = mn.mentions(texts(spark, sf), lx.guard_lexicon(spark).filter("skill_key = 'and_was'"))
    return hits.select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@query("join_3_exclude_after", f"""
WITH {TOKENS_SQL}, h AS (SELECT doc_id, start, "end", tok2, gap2 FROM the_hits
 UNION ALL SELECT p.doc_id, p.start, p."end", n.tok, n.gap FROM pair p JOIN n ON n.doc_id = p.doc_id AND n.start > p."end" - 1 AND n.start = (SELECT min(start) FROM t WHERE t.doc_id = p.doc_id AND t.start >= p."end")
 UNION ALL SELECT p.doc_id, p.start, p."end", NULL, NULL FROM pair p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = p.doc_id AND t.start >= p."end")),
k AS (SELECT doc_id, start, "end" FROM h WHERE NOT coalesce(tok2 IN ('and', 'of') AND regexp_matches(gap2, '^\\s+$') AND length(gap2) + length(tok2) <= 20, FALSE))
SELECT a.doc_id, a.start, a."end" FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND b."end" >= a."end" AND b."end" - b.start > a."end" - a.start)""")
def join_3(spark, sf):
    hits = mn.mentions(texts(spark, sf), lx.guard_lexicon(spark).filter("skill_key = 'of_the'"))
    return hits.select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@query("join_1_case_sensitive", """
WITH m AS (SELECT doc_id, string_split_regex(text, '[^A-Za-z0-9+#]+') AS w FROM documents)
SELECT doc_id, len(list_filter(w, lambda x: x = 'The')) AS hits FROM m WHERE list_contains(w, 'The')""")
def join_1_cased(spark, sf):
    hits = mn.mentions(texts(spark, sf), lx.guard_lexicon(spark).filter("skill_key = 'Cased'"))
    return hits.groupBy("doc_id").agg(F.count("*").alias("hits"))


@query("join_4_nested_pruning", f"""
WITH {TOKENS_SQL}, the_free AS (SELECT h.doc_id FROM the_hits h WHERE NOT EXISTS (SELECT 1 FROM pair p WHERE p.doc_id = h.doc_id AND p.start <= h.start AND p."end" >= h."end"))
SELECT DISTINCT doc_id, 'the' AS skill_key FROM the_free UNION ALL SELECT DISTINCT doc_id, 'of the' FROM pair UNION ALL SELECT DISTINCT doc_id, skill_key FROM plain""")
def join_4(spark, sf):
    lex = lx.guard_lexicon(spark).filter("skill_key in ('the', 'of_the') or skill_key in ('that', 'with', 'from', 'this', 'que', 'der', 'license')")
    lex = lex.withColumn("aliases", F.when(F.col("skill_key") == "of_the", F.array(F.lit("of the"))).otherwise(F.col("aliases")))
    lex = lex.withColumn("exclude_after", F.array().cast("array<string>"))
    lex = lex.withColumn("skill_key", F.when(F.col("skill_key") == "of_the", "of the").otherwise(F.col("skill_key")))
    return mn.uncovered_skills(mn.mentions(texts(spark, sf), lex), ["doc_id"]).select("doc_id", "skill_key")


@query("join_5_umbrella", f"""
WITH {TOKENS_SQL} SELECT doc_id, count(*) AS hits FROM t WHERE tok IN ('the', 'que', 'der') GROUP BY doc_id""")
def join_5(spark, sf):
    lex = lx.guard_lexicon(spark).filter("skill_key in ('the', 'que', 'der', 'articles')")
    hits = mn.with_umbrella(mn.mentions(texts(spark, sf), lex), lex, ["doc_id"])
    return hits.filter("skill_key = 'articles'").groupBy("doc_id").agg(F.count("*").alias("hits"))


@query("join_27_best_role", f"""
WITH w AS (SELECT role_key, unnest(list_concat(titles, triggers)) AS term, ord FROM {lx.values_sql(lx.ROLES, 'role_key, label, titles, wide_titles, discriminants, triggers, ord')}),
m AS (SELECT p_partkey, role_key, length(term) AS n, ord FROM part JOIN w ON regexp_matches(lower(p_name), '(^|[^a-z0-9+#])' || term || '[sx]?($|[^a-z0-9+#])'))
SELECT p_partkey, role_key FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, ord) AS rn FROM m) WHERE rn = 1""")
def join_27(spark, sf):
    return mn.best_role(table(spark, sf, "part"), lx.role_families(spark), "p_partkey", "p_name")


@query("join_33_described_activity", f"""
WITH l AS (SELECT doc_id, i AS line_no, {fold_sql('lines[i]')} AS f FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) x, unnest(range(1, len(lines) + 1)) AS u(i)),
w AS (SELECT doc_id, line_no, list_distinct(regexp_extract_all(f, '[a-z0-9+#]+')) AS w FROM l)
SELECT doc_id, line_no, len(list_intersect(w, ['the', 'and', 'was', 'for', 'are', 'des', 'und', 'los'])) AS clues FROM w
WHERE len(list_intersect(w, ['the', 'and', 'was', 'for', 'are', 'des', 'und', 'los'])) >= 2 AND NOT list_has_any(w, ['that', 'thats', 'thatx'])""")
def join_33(spark, sf):
    lex = lx.corpus_lexicon(spark).filter("skill_key = 'that'").withColumn("kind", F.lit("activity"))
    lines = texts(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines = lines.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line_no"), tx.fold(F.col("line")).alias("f"))
    named = lines.filter(tx.has_term(F.col("f"), "that")).withColumn("skill_key", F.lit("that"))
    return ev.described_activities(lines, named, lex, ["doc_id", "line_no"], "f").select("doc_id", "line_no", "clues")


@query("win_16_mention_cap", f"""
WITH {TOKENS_SQL} SELECT doc_id, count(*) AS mentions, least(count(*), 300) AS analysed FROM the_hits GROUP BY doc_id""")
def win_16(spark, sf):
    hits = mn.mentions(texts(spark, sf), lx.guard_lexicon(spark).filter("skill_key = 'the'"))
    capped = ev.first_mentions(hits, ["doc_id", "skill_key"])
    return capped.groupBy("doc_id").agg(F.count("*").alias("mentions"), F.sum(F.col("analysed").cast("int")).alias("analysed"))


@query("udf_1_extended_lexicon", f"""
WITH {TOKENS_SQL} SELECT CASE WHEN tok IN ('que', 'der') THEN tok ELSE 'user_term' END AS skill_key, count(*) AS hits, count(DISTINCT doc_id) AS documents
FROM t WHERE tok IN ('que', 'der', 'aux', 'sich', 'les', 'an') GROUP BY 1""")
def udf_1(spark, sf):
    base = lx.corpus_lexicon(spark).filter("skill_key in ('que', 'der')")
    user = base.filter("skill_key = 'que'").withColumn("skill_key", F.lit("user_term")).withColumn("aliases", F.array(*[F.lit(x) for x in ("aux", "sich", "les", "an")]))
    hits = mn.mentions(texts(spark, sf), base.unionByName(user))
    return hits.groupBy("skill_key").agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("documents"))
