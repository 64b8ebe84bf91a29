"""Exports, questions, quality and links between evidence and bullets."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.functions import dates as dt
from proofgrid.functions import text as tx
from proofgrid.operators import evidence as ev
from proofgrid.operators import exports as ex
from proofgrid.operators import intervals as iv
from proofgrid.operators import mentions as mn
from proofgrid.operators import scoring as sc
from proofgrid.operators import structure as st
from proofgrid.operators.scale import by_shuffle, parameter_table
from proofgrid.plans import lexicon as lx
from proofgrid.plans.base import TODAY, query, table, texts
from proofgrid.plans.evidence_queries import N, phrases, pick_sql
from proofgrid.plans.mention_queries import TOKENS_SQL
from proofgrid.plans.scoring_queries import RESULTS_SQL, assessed
from proofgrid.plans.structure_queries import CV_SQL, EXP_SQL, layout, profile_texts

T = [t for t, _ in ex.THEMES]
PHRASE_THEMES = [ex.OTHER_THEME, ex.OTHER_THEME, T[2], T[0], ex.OTHER_THEME, T[0], ex.OTHER_THEME, T[0], ex.OTHER_THEME, T[1], ex.OTHER_THEME, T[0], T[3], T[0]]


@query("fn_31_theme_of_statement", f"SELECT o_orderkey AS doc_id, {pick_sql(PHRASE_THEMES)} AS theme FROM orders")
def fn_31(spark, sf):
    return phrases(spark, sf).select("doc_id", ex.theme(F.col("item")).alias("theme"))


THEME_ORDER = "CASE theme " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(T)) + " ELSE 9 END"


@query("agg_30_theme_parts", f"""
WITH t AS (SELECT o_custkey AS exp_id, o_orderkey AS pos, {pick_sql(PHRASE_THEMES)} AS theme FROM orders),
n AS (SELECT exp_id, theme, count(*) AS n FROM t WHERE theme <> '{ex.OTHER_THEME}' GROUP BY ALL), k AS (SELECT exp_id, theme FROM n QUALIFY row_number() OVER (PARTITION BY exp_id ORDER BY n DESC, {THEME_ORDER}) <= 3)
SELECT t.exp_id, t.pos, CASE WHEN k.theme IS NULL THEN '{ex.OTHER_THEME}' ELSE k.theme END AS part FROM t LEFT JOIN k ON k.exp_id = t.exp_id AND k.theme = t.theme""")
def agg_30(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("exp_id"))
    p = phrases(spark, sf).select("doc_id", "item").join(by_shuffle(o), "doc_id").withColumnRenamed("doc_id", "pos")
    return ex.theme_parts(p, ["exp_id"], "item", "pos").select("exp_id", "pos", "part")


@query("fn_32_period_label", f"""
WITH {EXP_SQL}, m AS (SELECT {dt.MONTH_NAMES!r} AS names)
SELECT doc_id, company, CASE WHEN start IS NULL THEN 'dates non précisées' ELSE CASE WHEN length(start) = 7 THEN names[substring(start, 6, 2)::INT] || ' ' ELSE '' END || substring(start, 1, 4) || ' – '
 || CASE WHEN is_current THEN 'en cours' ELSE CASE WHEN length("end") = 7 THEN names[substring("end", 6, 2)::INT] || ' ' ELSE '' END || substring("end", 1, 4) END END AS period FROM xp, m""")
def fn_32(spark, sf):
    e = st.experiences(profile_texts(spark, sf), TODAY)
    return e.select("doc_id", "company", dt.period_label(F.col("start"), F.col("end"), F.col("is_current"), F.col("months").isNotNull()).alias("period"))


@query("fn_33_environment_sentence", f"WITH {CV_SQL} SELECT k AS doc_id, 'Java, Kafka, Outil' || (k % 9) || '.' AS phrase FROM cv")
def fn_33(spark, sf):
    e = st.env_lines(st.lines_of(layout(spark, sf, "lines")))
    return e.select("doc_id", ex.environment_sentence(F.col("raw")).alias("phrase"))


@query("agg_37_demonstrated_and_deliverables", f"""
WITH {RESULTS_SQL} SELECT doc_id, coalesce(string_agg(label, ', ' ORDER BY pos) FILTER (lo >= 3), '') AS demonstrated, coalesce(string_agg(label, ', ' ORDER BY pos) FILTER (lo >= 3 AND dimension = 'responsabilite'), '') AS responsibilities FROM res GROUP BY doc_id""")
def agg_37(spark, sf):
    names = lambda keep: F.array_join(F.transform(F.filter("results", keep), lambda r: r["label"]), ", ")
    return assessed(spark, sf).select("doc_id", names(lambda r: r["level_ord"] >= 3).alias("demonstrated"), names(lambda r: (r["level_ord"] >= 3) & (r["dimension"] == "responsabilite")).alias("responsibilities"))


@query("agg_37_distinct_deliverables", f"SELECT o_custkey AS candidate_id, CASE WHEN bool_or(o_orderkey % {N} = 13) THEN 'documentation' ELSE '' END AS deliverables FROM orders GROUP BY 1")
def agg_37b(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("candidate_id"))
    a = ev.analyse_mentions(phrases(spark, sf), TODAY).select("doc_id", F.explode_outer("deliverables").alias("deliverable"))
    d = a.join(by_shuffle(o), "doc_id").groupBy("candidate_id").agg(F.array_sort(F.collect_set("deliverable")).alias("d"))
    return d.select("candidate_id", F.array_join("d", ", ").alias("deliverables"))


@query("join_21_evidence_to_bullet", f"""
WITH {TOKENS_SQL}, l AS (SELECT doc_id, generate_subscripts(ls, 1) AS n, unnest(ls) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
lo AS (SELECT doc_id, n, (sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) - length(raw) - 1)::BIGINT AS s, length(raw) AS len FROM l),
sp AS (SELECT doc_id, greatest(start - 40, 0) AS s, "end" + 40 AS e FROM plain WHERE skill_key IN ('license', 'that'))
SELECT lo.doc_id, lo.n AS line_no, count(*) AS linked FROM lo JOIN sp ON sp.doc_id = lo.doc_id AND sp.s < lo.s + lo.len AND sp.e > lo.s GROUP BY ALL""")
def join_21(spark, sf):
    d = texts(spark, sf)
    lines = d.select("doc_id", F.posexplode(tx.pieces(F.col("text"), "\n")).alias("n", "l")).select("doc_id", (F.col("n") + 1).cast("bigint").alias("line_no"), F.col("l.start").alias("ls"), F.col("l.end").alias("le"))
    hits = mn.mentions(d, lx.corpus_lexicon(spark).filter("skill_key in ('license', 'that')"))
    spans = hits.select("doc_id", F.greatest(F.col("start") - 40, F.lit(0)).alias("s"), (F.col("end") + 40).alias("e"))
    return iv.overlap_join(spans, lines, ["doc_id"], "s", "e", "ls", "le").groupBy("doc_id", "line_no").agg(F.count("*").alias("linked"))


GAP_SQL = RESULTS_SQL + """,
gp AS (SELECT doc_id, key, label, row_number() OVER (PARTITION BY doc_id ORDER BY weight * 100 - points + CASE WHEN mandatory THEN 100000 ELSE 0 END + CASE WHEN mandatory AND lo = 1 THEN 50000 ELSE 0 END DESC, key) AS rn FROM res WHERE lo NOT IN (0, 4) QUALIFY rn <= 8)"""


@query("top_4_question_selection", f"WITH {GAP_SQL} SELECT doc_id, key, rn, CASE WHEN rn <= 3 THEN 'prioritaire' ELSE 'complementaire' END AS priority FROM gp")
def top_4(spark, sf):
    return ex.question_gaps(sc.result_rows(assessed(spark, sf), ("doc_id",)), ["doc_id"]).select("doc_id", "key", "rn", "priority")


QUESTIONS = [("that", "Question dédiée sur that ?"), ("with", "Question dédiée sur with ?")]


@query("join_25_question_templates", f"""
WITH {GAP_SQL} SELECT doc_id, key, CASE WHEN key IN ('that', 'with') THEN 'Question dédiée sur ' || key || ' ?' ELSE 'Décris un projet précis où tu as travaillé sur ' || label || ' : contexte, rôle personnel, difficultés et résultats.' END AS question FROM gp""")
def join_25(spark, sf):
    gaps = ex.question_gaps(sc.result_rows(assessed(spark, sf), ("doc_id",)), ["doc_id"])
    return ex.with_questions(gaps, parameter_table(spark, QUESTIONS, "key string, ask string")).select("doc_id", "key", "question")


@query("agg_10_information_quality", f"""
WITH {RESULTS_SQL}, d AS (SELECT doc_id, round_even(sum(CASE WHEN lo IN (0, 3, 4) THEN weight ELSE 0 END) * 100.0 / sum(weight), 0)::BIGINT AS decided FROM res GROUP BY doc_id),
qq AS (SELECT d.doc_id, list_filter([CASE WHEN n_chars >= 250 THEN 100 ELSE 60 END, decided, greatest(0, 100 - 30 * (d.doc_id % 4)), quality * 100], lambda x: x IS NOT NULL) AS c FROM d JOIN documents USING (doc_id) LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id))
SELECT doc_id, round_even(list_sum(c) / len(c), 0)::BIGINT AS quality FROM qq""")
def agg_10(spark, sf):
    a = assessed(spark, sf)
    decided = F.aggregate("results", F.lit(0), lambda s, r: s + F.when(r["level_ord"].isin(0, 3, 4), r["weight"]).otherwise(0))
    total = F.aggregate("results", F.lit(0), lambda s, r: s + r["weight"])
    d = a.select("doc_id", sc._rounded(decided * 100, total).alias("decided")).join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    d = d.join(table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    flags = F.greatest(F.lit(0), 100 - 30 * F.pmod("doc_id", F.lit(4)))
    parts = [F.when(F.col("n_chars") >= 250, 100).otherwise(60), F.col("decided"), flags, F.col("quality") * 100]
    return d.select("doc_id", ex.information_quality([p.cast("bigint") for p in parts]).alias("quality"))


@query("src_7_structured_export", f"""
WITH {EXP_SQL}, j AS (SELECT doc_id, ord, '{{"company":"' || company || '","title":"' || title || '"' || coalesce(',"start":"' || start || '"', '') || coalesce(',"end":"' || "end" || '"', '') || ',"is_current":' || is_current || coalesce(',"months":' || months, '') || '}}' AS e FROM xp)
SELECT doc_id, '{{"experiences":[' || string_agg(e, ',' ORDER BY ord) || ']}}' AS json FROM j GROUP BY doc_id""")
def src_7(spark, sf):
    return ex.profile_json(st.experiences(profile_texts(spark, sf), TODAY))


@query("src_8_text_document", f"""
WITH {EXP_SQL} SELECT doc_id, '# Matière de dossier' || chr(10) || string_agg('### ' || company || ' — ' || CASE WHEN title = '' THEN '(intitulé non précisé)' ELSE title END, chr(10) ORDER BY ord) AS document FROM xp GROUP BY doc_id""")
def src_8(spark, sf):
    e = st.experiences(profile_texts(spark, sf), TODAY)
    title = F.when(F.col("title") == "", "(intitulé non précisé)").otherwise(F.col("title"))
    parts = e.select("doc_id", F.col("idx").alias("pos"), F.concat(F.lit("### "), "company", F.lit(" — "), title).alias("line"))
    d = ex.assembled(parts, ["doc_id"], ["pos"], "line")
    return d.select("doc_id", F.concat(F.lit("# Matière de dossier\n"), "document").alias("document"))
