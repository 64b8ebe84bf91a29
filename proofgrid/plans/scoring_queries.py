"""Documents scored on grids: points, caps, tiers, ranks, differences; grids derived from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.functions import levels as lv
from proofgrid.operators import evidence as ev
from proofgrid.operators import grids as gr
from proofgrid.operators import scoring as sc
from proofgrid.operators.scale import parameter_table
from proofgrid.plans import lexicon as lx
from proofgrid.plans.base import fold_sql, query, table, texts
from proofgrid.plans.text_queries import SENT_MARK, TRIM_EDGE

LEVELS_SQL = f"""
p AS (SELECT doc_id, string_split({SENT_MARK}, chr(1)) AS p FROM documents),
e AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM p),
q AS (SELECT doc_id, i, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(ltrim(piece, chr(10) || {TRIM_EDGE})) AS start, trim(piece, chr(10) || {TRIM_EDGE}) AS t FROM e),
w AS (SELECT doc_id, start::BIGINT AS start, list_distinct(string_split_regex({fold_sql('t')}, '[^a-z0-9+#]+')) AS w FROM q WHERE t <> ''),
a AS (SELECT doc_id, start, key, len(list_intersect(w, ['the', 'and', 'was', 'for', 'are', 'des', 'und', 'los'])) AS n FROM w JOIN (VALUES
  ('that', ['that', 'thats', 'thatx']), ('with', ['with', 'withs', 'withx']), ('from', ['from', 'froms', 'fromx']), ('this', ['this']), ('que', ['que']), ('der', ['der']),
  ('license', ['license', 'licenses', 'licensex'])) AS k(key, forms) ON list_has_any(w, forms)),
items AS (SELECT doc_id, start, key, n, CASE WHEN n >= 3 THEN 4 WHEN n >= 1 THEN 3 ELSE 2 END AS ord FROM a),
lev AS (SELECT doc_id, key, max(ord) AS ord, count(*) AS items FROM items GROUP BY ALL)"""

RESULTS_SQL = LEVELS_SQL + f""",
dm AS (SELECT doc_id, source AS mission_id, 'g' || (CAST(substr(source, 4) AS INT) % 3) AS grid_id FROM documents),
tox AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
c AS (SELECT * FROM {lx.CRITERIA_SQL}),
full_m AS (SELECT dm.doc_id, dm.mission_id, c.*, CASE WHEN c.key = 'that' AND tox.doc_id IS NOT NULL THEN 0 ELSE coalesce(lev.ord, 1) END AS lo
  FROM dm JOIN c ON c.grid_id = dm.grid_id LEFT JOIN lev ON lev.doc_id = dm.doc_id AND lev.key = c.key LEFT JOIN tox ON tox.doc_id = dm.doc_id),
mem AS (SELECT g.doc_id, g.key, count(*) AS n, count(*) FILTER (m.lo = 0) AS c0, count(*) FILTER (m.lo = 2) AS c2, count(*) FILTER (m.lo = 3) AS c3, count(*) FILTER (m.lo = 4) AS c4
  FROM full_m g JOIN full_m m ON m.doc_id = g.doc_id AND list_contains(g.members, m.key) WHERE len(g.members) > 0 GROUP BY ALL),
res AS (SELECT f.doc_id, f.mission_id, f.grid_id, f.key, f.label, f.category, f.dimension, f.weight, f.mandatory, f.ord AS pos,
  CASE WHEN mem.key IS NULL THEN f.lo WHEN n - c0 < at_least THEN 0 WHEN c4 >= at_least THEN 4 WHEN c4 + c3 >= 1 THEN 3 WHEN c2 >= 1 THEN 2 ELSE 1 END AS lo,
  CASE WHEN mem.key IS NULL THEN f.weight * ([0, 0, 15, 50, 100])[f.lo + 1]
    ELSE CAST(round_even(f.weight * least(1000 * c4 + 500 * c3 + 150 * c2, 1000 * at_least) / (10.0 * at_least), 0) AS BIGINT) END AS points
  FROM full_m f LEFT JOIN mem ON mem.doc_id = f.doc_id AND mem.key = f.key WHERE f.scored),
asm0 AS (SELECT doc_id, mission_id, grid_id, sum(points) AS documented, sum(CASE WHEN lo >= 2 THEN weight ELSE 0 END) * 100 AS pot0,
  min(CASE WHEN lo = 0 AND category = 'eliminatoire_confirme' THEN 35 WHEN lo = 0 AND mandatory THEN 60 END) AS cap,
  count(*) FILTER (mandatory AND lo = 0) AS n_contra, count(*) FILTER (mandatory AND lo BETWEEN 1 AND 3) AS n_open, sum(weight) AS total,
  sum(CASE WHEN lo BETWEEN 1 AND 3 THEN weight ELSE 0 END) AS unsure FROM res GROUP BY ALL),
asm1 AS (SELECT *, least(documented, coalesce(cap * 100, documented)) AS score, least(pot0, coalesce(cap * 100, pot0)) AS potential FROM asm0),
asm AS (SELECT *, CASE WHEN n_contra > 0 THEN 'ecart_majeur' WHEN n_open > 0 THEN CASE WHEN potential < 5000 THEN 'adequation_faible' ELSE 'a_qualifier' END
  WHEN score >= 9600 THEN 'tres_interessant' WHEN score >= 8000 THEN 'interessant' WHEN score >= 5000 THEN 'a_qualifier' ELSE 'adequation_faible' END AS tier FROM asm1)"""


def doc_missions(spark: SparkSession, sf: str) -> DataFrame:
    """Each source is a mission; its grid is chosen by its number."""
    d = table(spark, sf, "documents")
    n = F.substring("source", 4, 9).cast("int")
    return d.select("doc_id", F.col("source").alias("mission_id"), F.concat(F.lit("g"), F.pmod(n, F.lit(lx.N_GRIDS)).cast("string")).alias("grid_id"))


def corpus_levels(spark: SparkSession, sf: str) -> DataFrame:
    return ev.best_levels(ev.sentence_mentions(texts(spark, sf), lx.corpus_lexicon(spark)))


def corpus_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Levels of the texts; a document flagged by a reviewer contradicts the criterion ``that``."""
    flagged = table(spark, sf, "labels").filter("toxic = 1").select("doc_id", F.lit("that").alias("key"), F.lit(0).alias("override")).distinct()
    merged = corpus_levels(spark, sf).select("doc_id", "key", "level_ord").join(flagged, ["doc_id", "key"], "full")
    return merged.select("doc_id", "key", F.coalesce("override", "level_ord").alias("level_ord"))


def assessed(spark: SparkSession, sf: str, parameters: DataFrame | None = None, reviewed: bool = True) -> DataFrame:
    grids = sc.grid_rows(lx.criteria(spark), parameters)
    evidence = corpus_evidence(spark, sf) if reviewed else corpus_levels(spark, sf).select("doc_id", "key", "level_ord")
    return sc.assess(sc.criterion_results(doc_missions(spark, sf), evidence, grids))


def points(c: str):
    return (F.col(c) / 100).cast("double").alias(c)


@query("win_4_rank", f"""
WITH {RESULTS_SQL} SELECT doc_id, grid_id, tier, (score / 100.0)::DOUBLE AS score, (potential / 100.0)::DOUBLE AS potential,
 rank() OVER (PARTITION BY grid_id ORDER BY n_contra, n_open, score DESC, potential DESC) AS rank FROM asm""")
def win_4(spark, sf):
    return sc.ranked(assessed(spark, sf)).select("doc_id", "grid_id", "tier", points("score"), points("potential"), "rank")


@query("agg_1_documented_score", f"WITH {RESULTS_SQL} SELECT doc_id, (documented / 100.0)::DOUBLE AS documented FROM asm")
def agg_1(spark, sf):
    return assessed(spark, sf).select("doc_id", points("documented"))


@query("agg_2_potential", f"WITH {RESULTS_SQL} SELECT doc_id, (potential / 100.0)::DOUBLE AS potential FROM asm")
def agg_2(spark, sf):
    return assessed(spark, sf).select("doc_id", points("potential"))


@query("agg_3_caps", f"""
WITH {RESULTS_SQL}, r AS (SELECT doc_id, string_agg(label || ' → ' || CASE WHEN category = 'eliminatoire_confirme' THEN 35 ELSE 60 END, '; ' ORDER BY pos) AS reasons FROM res WHERE lo = 0 AND mandatory GROUP BY doc_id)
SELECT asm.doc_id, cap, (score / 100.0)::DOUBLE AS score, coalesce(reasons, '') AS reasons FROM asm LEFT JOIN r USING (doc_id)""")
def agg_3(spark, sf):
    reasons = F.array_join(F.transform("caps", lambda c: F.concat(c["criterion"], F.lit(" → "), c["cap"].cast("string"))), "; ")
    return assessed(spark, sf).select("doc_id", "cap", points("score"), reasons.alias("reasons"))


@query("agg_4_tier", f"WITH {RESULTS_SQL} SELECT doc_id, tier, round_even(score / 100.0, 0)::BIGINT AS displayed FROM asm")
def agg_4(spark, sf):
    return assessed(spark, sf).select("doc_id", "tier", "displayed")


@query("agg_5_alerts", f"""
WITH {RESULTS_SQL} SELECT doc_id, CASE lo WHEN 0 THEN 'bloquant' WHEN 1 THEN 'majeur' ELSE 'à vérifier' END AS severity, label AS criterion FROM res WHERE mandatory AND lo < 4
UNION ALL SELECT doc_id, 'plafond', label FROM res WHERE mandatory AND lo = 0""")
def agg_5(spark, sf):
    return sc.alerts(assessed(spark, sf))


@query("agg_6_uncertainty", f"""
WITH {RESULTS_SQL} SELECT doc_id, round_even(unsure * 100.0 / total, 0)::BIGINT AS unsure_pct,
 CASE WHEN round_even(unsure * 100.0 / total, 0) < 25 THEN 'faible' WHEN round_even(unsure * 100.0 / total, 0) < 50 THEN 'moyenne' ELSE 'élevée' END AS uncertainty FROM asm""")
def agg_6(spark, sf):
    return assessed(spark, sf).select("doc_id", F.col("unsure_pct").cast("bigint").alias("unsure_pct"), "uncertainty")


@query("agg_7_label_lists", f"""
WITH {RESULTS_SQL} SELECT doc_id, coalesce(string_agg(label, ', ' ORDER BY pos) FILTER (lo = 4), '') AS covered, coalesce(string_agg(label, ', ' ORDER BY pos) FILTER (lo = 3), '') AS partial,
 coalesce(string_agg(label, ', ' ORDER BY pos) FILTER (lo IN (1, 2)), '') AS not_demonstrated, coalesce(string_agg(label, ', ' ORDER BY pos) FILTER (lo = 0), '') AS contradicted FROM res GROUP BY doc_id""")
def agg_7(spark, sf):
    return assessed(spark, sf).select("doc_id", *[F.array_join(c, ", ").alias(c) for c in ("covered", "partial", "not_demonstrated", "contradicted")])


@query("agg_8_k_of_n", f"""
WITH {RESULTS_SQL} SELECT doc_id, (['contredit', 'non_documente', 'declare_sans_preuve', 'partiellement_demontre', 'confirme_demontre'])[lo + 1] AS level, (points / 100.0)::DOUBLE AS points FROM res WHERE key = 'duo'""")
def agg_8(spark, sf):
    r = sc.result_rows(assessed(spark, sf)).filter("key = 'duo'")
    return r.select("doc_id", lv.level_name(F.col("level_ord")).alias("level"), points("points"))


@query("agg_11_best_level", f"""
WITH {LEVELS_SQL} SELECT doc_id, key, max(ord)::BIGINT AS level_ord, arg_max(start, (ord, -start)) AS best_start, count(*) AS items FROM items GROUP BY doc_id, key""")
def agg_11(spark, sf):
    return corpus_levels(spark, sf).select("doc_id", "key", F.col("level_ord").cast("bigint").alias("level_ord"), F.col("best.start").cast("bigint").alias("best_start"), "items")


@query("agg_14_distinct_clues", f"WITH {LEVELS_SQL} SELECT doc_id, start, key, n AS clues FROM items")
def agg_14(spark, sf):
    m = ev.sentence_mentions(texts(spark, sf), lx.corpus_lexicon(spark))
    return m.select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("skill_key").alias("key"), F.size("clues").cast("bigint").alias("clues"))


@query("join_10_complete_matrix", f"""
WITH {RESULTS_SQL} SELECT doc_id, grid_id, key, (['contredit', 'non_documente', 'declare_sans_preuve', 'partiellement_demontre', 'confirme_demontre'])[lo + 1] AS level FROM res""")
def join_10(spark, sf):
    return sc.result_rows(assessed(spark, sf)).select("doc_id", "grid_id", "key", lv.level_name(F.col("level_ord")).alias("level"))


@query("fn_29_factors_and_points", f"""
WITH {RESULTS_SQL} SELECT grid_id, key, category, lo AS level_ord, min(points)::BIGINT AS points, count(*) AS documents FROM res WHERE key <> 'duo' GROUP BY ALL""")
def fn_29(spark, sf):
    r = sc.result_rows(assessed(spark, sf)).filter("key <> 'duo'")
    return r.groupBy("grid_id", "key", "category", "level_ord").agg(F.min("points").cast("bigint").alias("points"), F.count("*").alias("documents"))


@query("flt_13_work_view", f"WITH {RESULTS_SQL} SELECT doc_id, grid_id, score >= 9500 AS work_view FROM asm")
def flt_13(spark, sf):
    return assessed(spark, sf).select("doc_id", "grid_id", "work_view")


@query("top_1_candidate_list", f"""
WITH {RESULTS_SQL}, l AS (SELECT asm.*, d.n_chars < 250 AS pending FROM asm JOIN documents d USING (doc_id))
SELECT doc_id, mission_id, pending, rank() OVER (PARTITION BY mission_id ORDER BY pending, CASE WHEN pending THEN 0 ELSE n_contra END, CASE WHEN pending THEN 0 ELSE n_open END,
 CASE WHEN pending THEN 0 ELSE score END DESC, CASE WHEN pending THEN 0 ELSE potential END DESC) AS position FROM l""")
def top_1(spark, sf):
    from proofgrid.operators.scale import rank_by_counts

    a = assessed(spark, sf).join(table(spark, sf, "documents").select("doc_id", (F.col("n_chars") < 250).alias("pending")), "doc_id")
    hide = lambda c: F.when(F.col("pending"), F.lit(0)).otherwise(c)
    a = a.select("doc_id", "mission_id", "pending", hide(F.size("contradicted_mandatory")).alias("k1"), hide(F.size("open_mandatory")).alias("k2"), hide(F.col("score")).alias("k3"), hide(F.col("potential")).alias("k4"))
    listed = rank_by_counts(a, ["mission_id"], [("pending", False), ("k1", False), ("k2", False), ("k3", True), ("k4", True)], "position")
    return listed.select("doc_id", "mission_id", "pending", "position")


@query("top_2_best_items", f"""
WITH {LEVELS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY ord DESC, start) AS rn FROM items) SELECT doc_id, key, start, rn FROM r WHERE rn <= 6""")
def top_2(spark, sf):
    from pyspark.sql import Window

    m = ev.sentence_mentions(texts(spark, sf), lx.corpus_lexicon(spark)).select("doc_id", F.col("skill_key").alias("key"), F.col("start").cast("bigint").alias("start"), ev.depth_level(F.size("clues")).alias("o"))
    w = Window.partitionBy("doc_id", "key").orderBy(F.col("o").desc(), "start")
    return m.withColumn("rn", F.row_number().over(w).cast("bigint")).filter("rn <= 6").select("doc_id", "key", "start", "rn")


@query("top_3_leader_differences", f"""
WITH {RESULTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY n_contra, n_open, score DESC, potential DESC, doc_id) AS rn FROM asm),
d AS (SELECT a.grid_id, a.doc_id AS leader, b.doc_id AS second, x.key, x.points::BIGINT AS leader_points, y.points::BIGINT AS second_points, abs(x.points - y.points) AS df, x.pos
 FROM r a JOIN r b ON a.grid_id = b.grid_id AND a.rn = 1 AND b.rn = 2 JOIN res x ON x.doc_id = a.doc_id JOIN res y ON y.doc_id = b.doc_id AND y.key = x.key)
SELECT grid_id, leader, second, key, leader_points, second_points FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY df DESC, pos) AS n FROM d) WHERE n <= 3 AND df > 0""")
def top_3(spark, sf):
    return sc.leader_differences(assessed(spark, sf))


@query("agg_29_comparison_matrix", f"""
WITH {RESULTS_SQL} SELECT grid_id, key, count(*) FILTER (lo = 0) AS contredit, count(*) FILTER (lo = 1) AS non_documente, count(*) FILTER (lo = 2) AS declare_sans_preuve,
 count(*) FILTER (lo = 3) AS partiellement_demontre, count(*) FILTER (lo = 4) AS confirme_demontre, (max(points) - min(points))::BIGINT AS spread FROM res GROUP BY grid_id, key""")
def agg_29(spark, sf):
    return sc.comparison(sc.result_rows(assessed(spark, sf))).withColumn("spread", F.col("spread").cast("bigint"))


WANTED_SQL = """
want AS (SELECT doc_id, doc_id % 60 AS comparison_id FROM documents UNION ALL SELECT doc_id, 1000 + doc_id // 2 FROM documents),
cr AS (SELECT w.comparison_id, r.* FROM want w JOIN res r ON r.doc_id = w.doc_id),
gr AS (SELECT comparison_id, count(DISTINCT grid_id) AS grids FROM cr GROUP BY 1)"""


def wanted(spark, sf):
    """Candidates sixty apart, and neighbours, who mostly stand on different grids."""
    d = table(spark, sf, "documents").select("doc_id")
    return d.select("doc_id", F.pmod("doc_id", F.lit(60)).alias("comparison_id")).unionByName(d.select("doc_id", (1000 + F.floor(F.col("doc_id") / 2)).alias("comparison_id")))


@query("agg_29_compared_candidates", f"""
WITH {RESULTS_SQL}, {WANTED_SQL} SELECT comparison_id, key, doc_id, (['contredit', 'non_documente', 'declare_sans_preuve', 'partiellement_demontre', 'confirme_demontre'])[lo + 1] AS level, points::BIGINT AS points,
 (max(points) OVER (PARTITION BY comparison_id, key) - min(points) OVER (PARTITION BY comparison_id, key))::BIGINT AS spread FROM cr JOIN gr USING (comparison_id) WHERE grids = 1""")
def agg_29_cells(spark, sf):
    cells, _ = sc.compared(sc.result_rows(assessed(spark, sf)), wanted(spark, sf))
    return cells.withColumns({c: F.col(c).cast("bigint") for c in ("points", "spread")})


@query("agg_29_refused_comparisons", f"WITH {RESULTS_SQL}, {WANTED_SQL} SELECT comparison_id, grids FROM gr WHERE grids > 1")
def agg_29_refused(spark, sf):
    return sc.compared(sc.result_rows(assessed(spark, sf)), wanted(spark, sf))[1]


@query("join_15_assessment_diff", f"""
WITH {RESULTS_SQL} SELECT r.doc_id, r.key, 'changed' AS change, (['contredit', 'non_documente', 'declare_sans_preuve', 'partiellement_demontre', 'confirme_demontre'])[coalesce(l.ord, 1) + 1] AS from_level,
 'contredit' AS to_level, (-r.weight * ([0, 0, 15, 50, 100])[coalesce(l.ord, 1) + 1])::BIGINT AS points_delta
FROM res r JOIN tox USING (doc_id) LEFT JOIN lev l ON l.doc_id = r.doc_id AND l.key = r.key WHERE r.key = 'that'""")
def join_15(spark, sf):
    before = sc.result_rows(assessed(spark, sf, reviewed=False))
    after = sc.result_rows(assessed(spark, sf))
    return sc.assessment_diff(before, after).withColumn("points_delta", F.col("points_delta").cast("bigint"))


@query("join_15_reasons", """
WITH c AS (SELECT conv_id AS doc_id, role AS key, turn, text, turn < 2 AS own FROM conversations),
n AS (SELECT doc_id, key, count(*) AS n, count(*) FILTER (own) AS o, max(length(text)) AS longest FROM c GROUP BY ALL),
b AS (SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id, key ORDER BY turn) AS i, text FROM c WHERE NOT own),
w AS (SELECT doc_id, key, string_agg(substring(text, 1, 200), ' | ' ORDER BY i) AS why, bool_or(length(text) > 200) AS cut FROM b WHERE i <= 3 GROUP BY ALL)
SELECT n.doc_id, n.key, CASE WHEN o = 0 THEN 'new' ELSE 'changed' END AS change, (1000 * (least(n, 4) - least(o, 4)))::BIGINT AS points_delta,
 CASE WHEN o = 0 THEN '' ELSE coalesce(why, '') END AS because, o > 0 AND coalesce(cut, false) AS truncated FROM n LEFT JOIN w USING (doc_id, key) WHERE o = 0 OR n <> o""")
def join_15_reasons(spark, sf):
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("role").alias("key"), F.col("turn").alias("ord"), F.col("text").alias("excerpt"), F.when(F.col("turn") < 2, "cv").otherwise("appel").alias("source")
    )
    rows = lambda e: e.groupBy("doc_id", "key").agg(F.least(F.count("*"), F.lit(4)).cast("int").alias("level_ord")).withColumn("points", F.col("level_ord") * 1000)
    before = c.filter("source = 'cv'")
    d = sc.with_reasons(rows(c), rows(before), c, before)
    return d.select("doc_id", "key", "change", F.col("points_delta").cast("bigint").alias("points_delta"), F.array_join("because", " | ").alias("because"), "truncated")


OTHER_PARAMETERS = [("g0", [0, 0, 200, 600, 1000], 50, 30, 20, 90, 70, 40), ("g1", [0, 0, 100, 400, 900], 55, 25, None, 95, 75, 45)]


@query("udf_3_grid_parameters", f"""
WITH {RESULTS_SQL}, pr AS (SELECT * FROM (VALUES ('g0', [0, 0, 20, 60, 100], 50, 20), ('g1', [0, 0, 10, 40, 90], 25, NULL), ('g2', [0, 0, 15, 50, 100], 60, NULL)) AS v(grid_id, f, cap0, cap1)),
r2 AS (SELECT res.doc_id, pr.grid_id, CASE WHEN res.key = 'duo' THEN round_even(res.weight * least(900 * c4 + 400 * c3 + 100 * c2, 2000) / 20.0, 0) ELSE res.weight * f[lo + 1] END AS pts,
  CASE WHEN lo = 0 AND mandatory THEN cap0 WHEN lo = 1 AND mandatory THEN cap1 END AS cap
  FROM res JOIN pr USING (grid_id) LEFT JOIN mem ON mem.doc_id = res.doc_id AND mem.key = res.key)
SELECT doc_id, (least(sum(pts), coalesce(min(cap) * 100, sum(pts))) / 100.0)::DOUBLE AS score FROM r2 GROUP BY doc_id""")
def udf_3(spark, sf):
    schema = "grid_id string, factors array<int>, cap_imperative int, cap_eliminatory int, cap_undocumented int, very_interesting int, interesting int, low_fit int"
    return assessed(spark, sf, parameter_table(spark, OTHER_PARAMETERS, schema)).select("doc_id", points("score"))


# Grids derived from order lines: an order is a mission, its lines are requirements.
LINES_SQL = """
reqs AS (SELECT l_orderkey AS mission_id, l_linenumber AS n, 'k' || l_partkey || '_' || l_linenumber AS key,
 (['eliminatoire_confirme', 'imperatif', 'fortement_differenciant', 'souhaitable', 'contextuel', 'a_clarifier'])[(l_partkey % 6) + 1] AS category,
 CASE WHEN l_suppkey % 9 = 0 THEN 'contrainte' ELSE 'technique' END AS dimension, CASE WHEN l_quantity > 45 THEN 'group:a' END AS group_key,
 CASE WHEN l_returnflag = 'R' THEN 'advanced' ELSE 'practice' END AS depth FROM lineitem),
crit AS (SELECT *, category IN ('eliminatoire_confirme', 'imperatif', 'fortement_differenciant', 'souhaitable') AND dimension <> 'contrainte' AND group_key IS NULL AS scored,
 category IN ('eliminatoire_confirme', 'imperatif') AS mandatory FROM reqs)"""
WEIGHTS_SQL = LINES_SQL + """,
b0 AS (SELECT *, CASE category WHEN 'eliminatoire_confirme' THEN 6 WHEN 'imperatif' THEN 5 WHEN 'fortement_differenciant' THEN 3 ELSE 1 END AS raw FROM crit WHERE scored),
b1 AS (SELECT *, sum(raw) OVER (PARTITION BY mission_id) AS s FROM b0),
b2 AS (SELECT *, greatest(raw * 100 // s, 1) AS base, (raw * 100) % s AS frac FROM b1),
b3 AS (SELECT *, 100 - sum(base) OVER (PARTITION BY mission_id) AS diff, row_number() OVER (PARTITION BY mission_id ORDER BY frac DESC, key) AS up FROM b2),
wt AS (SELECT mission_id, n, key, category, depth, mandatory, (base + CASE WHEN up <= diff THEN 1 ELSE 0 END)::BIGINT AS weight FROM b3)"""


def line_requirements(spark, sf):
    l = table(spark, sf, "lineitem")
    names = [lv.ELIMINATORY, lv.IMPERATIVE, lv.DIFFERENTIATING, lv.DESIRED, lv.CONTEXTUAL, lv.TO_CLARIFY]
    return l.select(
        F.col("l_orderkey").alias("mission_id"), F.col("l_linenumber").alias("n"),
        F.concat(F.lit("k"), "l_partkey", F.lit("_"), "l_linenumber").alias("key"),
        lv.lookup(dict(enumerate(names)), F.pmod("l_partkey", F.lit(6))).alias("category"),
        F.when(F.pmod("l_suppkey", F.lit(9)) == 0, "contrainte").otherwise("technique").alias("dimension"),
        F.when(F.col("l_quantity") > 45, "group:a").alias("group_key"),
        F.when(F.col("l_returnflag") == "R", "advanced").otherwise("practice").alias("depth"),
    )


def line_weights(spark, sf, requirements=None):
    crit = gr.criteria_of(line_requirements(spark, sf) if requirements is None else requirements).filter("scored")
    return gr.largest_remainder(crit.withColumn("raw", lv.lookup(lv.BASE_WEIGHTS, F.col("category"))), ["mission_id"], "raw", "key")


@query("prj_9_criteria_from_requirements", f"WITH {LINES_SQL} SELECT mission_id, key, category, scored, mandatory FROM crit")
def prj_9(spark, sf):
    return gr.criteria_of(line_requirements(spark, sf)).select("mission_id", "key", "category", "scored", "mandatory")


@query("win_12_largest_remainder", f"WITH {WEIGHTS_SQL} SELECT mission_id, key, weight FROM wt")
def win_12(spark, sf):
    return line_weights(spark, sf).select("mission_id", "key", "weight")


@query("win_12_surplus", """
WITH r AS (SELECT c_custkey // 40 AS g, c_custkey AS k, 1 + (c_custkey % 97) * (c_custkey % 97) AS raw FROM customer),
a AS (SELECT *, sum(raw) OVER (PARTITION BY g) AS s FROM r), b AS (SELECT *, greatest(raw * 100 // s, 1) AS base, (raw * 100) % s AS frac FROM a),
c AS (SELECT *, 100 - sum(base) OVER (PARTITION BY g) AS diff, row_number() OVER (PARTITION BY g ORDER BY frac DESC, k) AS up FROM b),
ev AS (SELECT g, k, diff, row_number() OVER (PARTITION BY g ORDER BY rd, up DESC) AS e FROM c, unnest(range(1, base::BIGINT)) AS u(rd) WHERE diff < 0),
tk AS (SELECT g, k, count(*) AS t FROM ev WHERE e <= -diff GROUP BY ALL)
SELECT c.g, c.k, (base + CASE WHEN diff > 0 AND up <= diff THEN 1 ELSE 0 END - coalesce(t, 0))::BIGINT AS weight FROM c LEFT JOIN tk ON tk.g = c.g AND tk.k = c.k""")
def win_12b(spark, sf):
    # forty consecutive customers form a grid: one hundred points cannot be split over more than a hundred criteria
    c = table(spark, sf, "customer").select(
        F.floor(F.col("c_custkey") / 40).alias("g"), F.col("c_custkey").alias("k"), (1 + F.pmod("c_custkey", F.lit(97)) * F.pmod("c_custkey", F.lit(97))).alias("raw")
    )
    return gr.largest_remainder(c, ["g"], "raw", "k").select("g", "k", "weight")


@query("flt_14_grid_errors", f"""
WITH {WEIGHTS_SQL}, f AS (SELECT c.mission_id, c.scored, c.mandatory, c.dimension, coalesce(wt.weight, 0) - CASE WHEN c.n = 1 AND c.mission_id % 5 = 0 THEN 1 ELSE 0 END AS weight FROM crit c LEFT JOIN wt ON wt.mission_id = c.mission_id AND wt.key = c.key),
g AS (SELECT mission_id, coalesce(sum(weight) FILTER (scored), 0) AS total, count(*) FILTER (scored AND weight <= 0) AS zero, count(*) FILTER (scored) AS n,
 coalesce(sum(weight) FILTER (scored AND mandatory), 0) AS mand, count(*) FILTER (scored AND weight > 40) AS big, count(*) FILTER (mandatory AND NOT scored AND dimension <> 'contrainte') AS uns FROM f GROUP BY mission_id)
SELECT mission_id, concat_ws(',', CASE WHEN total <> 100 THEN 'weights' END, CASE WHEN zero > 0 THEN 'zero_weight' END, CASE WHEN n = 0 THEN 'no_scored_criterion' END, CASE WHEN uns > 0 THEN 'mandatory_not_scored' END) AS errors,
 concat_ws(',', CASE WHEN total = 100 AND mand > 0 AND mand < 50 THEN 'mandatory_below_half' END, CASE WHEN big > 0 THEN 'above_forty' END) AS warnings FROM g""")
def flt_14(spark, sf):
    crit = gr.criteria_of(line_requirements(spark, sf))
    w = line_weights(spark, sf).select("mission_id", "key", "weight")
    full = crit.join(w, ["mission_id", "key"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)) - F.when((F.col("n") == 1) & (F.pmod("mission_id", F.lit(5)) == 0), 1).otherwise(0))
    e = gr.grid_errors(full, ["mission_id"])
    return e.select("mission_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


@query("flt_14_parameter_errors", """
WITH g AS (SELECT o_orderkey, 70 + o_orderkey % 37 AS v, 40 + o_orderkey % 50 AS i, o_custkey % 60 AS l, [0, o_orderkey % 11 // 10, 150, 100 + o_orderkey % 500, 1000 + o_custkey % 2] AS f, [35 + o_orderkey % 80, NULL] AS c FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN v > 100 THEN 'threshold_bounds' END, CASE WHEN v <= 100 AND NOT (l <= i AND i <= v) THEN 'threshold_order' END, CASE WHEN c[1] > 100 THEN 'cap_bounds' END,
 CASE WHEN f[4] < 150 OR f[5] > 1000 THEN 'factor_order' END, CASE WHEN f[2] <> 0 THEN 'factor_zero' END) AS errors FROM g""")
def flt_14b(spark, sf):
    o = table(spark, sf, "orders")
    m = lambda c, n: F.pmod(c, F.lit(n)).cast("int")
    factors = F.array(F.lit(0), F.floor(m("o_orderkey", 11) / 10).cast("int"), F.lit(150), m("o_orderkey", 500) + 100, m("o_custkey", 2) + 1000)
    caps = F.array(m("o_orderkey", 80) + 35, F.lit(None).cast("int"))
    errors = gr.parameter_errors(m("o_orderkey", 37) + 70, m("o_orderkey", 50) + 40, m("o_custkey", 60), factors, caps)
    return o.select("o_orderkey", F.array_join(errors, ",").alias("errors"))


@query("flt_14_group_members", """
WITH k AS (SELECT l_orderkey AS g, l_linenumber AS n FROM lineitem), x AS (SELECT DISTINCT g FROM k)
SELECT x.g, 'm' || v.n AS member FROM x, (VALUES (1), (2), (3)) AS v(n) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.g = x.g AND k.n = v.n)
UNION ALL SELECT g, NULL FROM x WHERE g % 4 = 0""")
def flt_14c(spark, sf):
    l = table(spark, sf, "lineitem")
    rows = l.select(F.col("l_orderkey").alias("g"), F.concat(F.lit("m"), "l_linenumber").alias("key"), F.array().cast("array<string>").alias("members"), F.lit(0).alias("at_least"))
    groups = l.select(F.col("l_orderkey").alias("g")).distinct().select("g", F.lit("group:x").alias("key"), F.array(*[F.lit(f"m{i}") for i in (1, 2, 3)]).alias("members"), F.when(F.pmod("g", F.lit(4)) == 0, 4).otherwise(2).alias("at_least"))
    return gr.missing_members(rows.unionByName(groups), ["g"]).select("g", "member")


@query("fn_26_grid_hash", f"""
WITH {WEIGHTS_SQL} SELECT mission_id, sha256('[' || string_agg('{{"key":"' || key || '","category":"' || category || '","weight":' || weight || '}}', ',' ORDER BY key) || ']') AS content_hash FROM wt GROUP BY mission_id""")
def fn_26_grid(spark, sf):
    return gr.grid_hash(line_weights(spark, sf), ["mission_id"], ["key", "category", "weight"])


@query("fn_27_tamper_check", f"WITH {WEIGHTS_SQL} SELECT mission_id, mission_id % 7 = 0 AS changed FROM wt GROUP BY mission_id")
def fn_27(spark, sf):
    frozen = line_weights(spark, sf)
    fields = ["key", "category", "weight"]
    stored = gr.grid_hash(frozen, ["mission_id"], fields)
    later = frozen.withColumn("weight", F.col("weight") + F.when(F.pmod("mission_id", F.lit(7)) == 0, 1).otherwise(0))
    now = gr.grid_hash(later, ["mission_id"], fields).withColumnRenamed("content_hash", "now")
    return stored.join(now, "mission_id").select("mission_id", (F.col("now") != F.col("content_hash")).alias("changed"))


def new_requirements(spark, sf):
    """A later version of the needs: the first line is gone, returned lines change category."""
    r = line_requirements(spark, sf).filter("n > 1 or mission_id % 3 = 0")
    return r.withColumn("category", F.when((F.col("depth") == "advanced") & (F.pmod("mission_id", F.lit(2)) == 0), lv.DESIRED).otherwise(F.col("category")))


NEW_SQL = WEIGHTS_SQL + """,
r2 AS (SELECT mission_id, n, key, depth, dimension, group_key, CASE WHEN depth = 'advanced' AND mission_id % 2 = 0 THEN 'souhaitable' ELSE category END AS category FROM reqs WHERE n > 1 OR mission_id % 3 = 0),
c2 AS (SELECT *, CASE category WHEN 'eliminatoire_confirme' THEN 6 WHEN 'imperatif' THEN 5 WHEN 'fortement_differenciant' THEN 3 ELSE 1 END AS raw FROM r2
  WHERE category IN ('eliminatoire_confirme', 'imperatif', 'fortement_differenciant', 'souhaitable') AND dimension <> 'contrainte' AND group_key IS NULL),
d1 AS (SELECT *, sum(raw) OVER (PARTITION BY mission_id) AS s FROM c2),
d2 AS (SELECT *, greatest(raw * 100 // s, 1) AS base, (raw * 100) % s AS frac FROM d1),
d3 AS (SELECT *, 100 - sum(base) OVER (PARTITION BY mission_id) AS diff, row_number() OVER (PARTITION BY mission_id ORDER BY frac DESC, key) AS up FROM d2),
wt2 AS (SELECT mission_id, n, key, category, depth, (base + CASE WHEN up <= diff THEN 1 ELSE 0 END)::BIGINT AS weight FROM d3)"""


@query("join_14_grid_diff", f"""
WITH {NEW_SQL} SELECT coalesce(a.mission_id, b.mission_id) AS mission_id, coalesce(a.key, b.key) AS key,
 CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change, a.weight AS from_weight, b.weight AS to_weight, a.category AS from_category, b.category AS to_category
FROM wt a FULL JOIN wt2 b ON a.mission_id = b.mission_id AND a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.weight <> b.weight OR a.category <> b.category OR a.depth <> b.depth""")
def join_14(spark, sf):
    d = gr.grid_diff(line_weights(spark, sf), line_weights(spark, sf, new_requirements(spark, sf)), ["mission_id"])
    return d.select("mission_id", "key", "change", "from_weight", "to_weight", "from_category", "to_category")


@query("join_32_keep_old_weights", f"""
WITH {NEW_SQL}, j AS (SELECT b.mission_id, b.key, b.weight AS fresh, a.weight AS old FROM wt2 b LEFT JOIN wt a ON a.mission_id = b.mission_id AND a.key = b.key),
k AS (SELECT mission_id, bool_and(old IS NOT NULL) AND sum(old) = 100 AS kept FROM j GROUP BY mission_id)
SELECT j.mission_id, j.key, kept, CASE WHEN kept THEN old ELSE fresh END AS weight FROM j JOIN k USING (mission_id)""")
def join_32(spark, sf):
    k = gr.keep_old_weights(line_weights(spark, sf, new_requirements(spark, sf)), line_weights(spark, sf), ["mission_id"])
    return k.select("mission_id", "key", "kept", "weight")
