"""Keyword filters over the corpus; filters, requirements and feedback derived from orders, lines and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.functions import levels as lv
from proofgrid.functions import text as tx
from proofgrid.operators import filters as fl
from proofgrid.operators.scale import row_number_by_bucket
from proofgrid.plans import lexicon as lx
from proofgrid.plans.base import fold_sql, query, table, term_sql, texts

GROUPS = {"that or with": ["that", "with"], "the": ["the"], "and or for": ["and", "for"]}
NEGATIVES = ["license", "open source"]
F_SQL = fold_sql("text")
G_SQL = {"that or with": "(that|with)[sx]?", "the": "the", "and or for": "and|for"}


@query("flt_2_boolean_filter", f"""
SELECT doc_id, {' AND '.join(term_sql('f', rx) for rx in G_SQL.values())} AND NOT {term_sql('f', 'license[sx]?|open[\\s\\-_/]*source[sx]?')} AS selected FROM (SELECT doc_id, {F_SQL} AS f FROM documents)""")
def flt_2(spark, sf):
    d = texts(spark, sf).select("doc_id", tx.fold(F.col("text")).alias("f"))
    return d.select("doc_id", fl.filter_predicate(F.col("f"), GROUPS, NEGATIVES).alias("selected"))


@query("flt_3_failing_groups", "SELECT doc_id, concat_ws(', ', " + ", ".join(f"CASE WHEN NOT {term_sql('f', rx)} THEN '{name}' END" for name, rx in G_SQL.items())
       + f") AS failing FROM (SELECT doc_id, {F_SQL} AS f FROM documents)")
def flt_3(spark, sf):
    d = texts(spark, sf).select("doc_id", tx.fold(F.col("text")).alias("f"))
    return d.select("doc_id", F.array_join(fl.failing_groups(F.col("f"), GROUPS), ", ").alias("failing"))


@query("flt_4_all_words", f"SELECT doc_id, contains({F_SQL}, 'that') AND contains({F_SQL}, 'deres') AND contains({F_SQL}, 'was') AS hit FROM documents")
def flt_4(spark, sf):
    return texts(spark, sf).select("doc_id", tx.all_words_in(F.col("text"), "That  dérès WAS").alias("hit"))


def benchmark_searches(spark, sf):
    """One filter per benchmark passage: its first word, one of its next three, and not its last word."""
    b = table(spark, sf, "benchmark").select("item_id", F.array_distinct(F.regexp_extract_all(tx.fold(F.col("text")), F.lit("[a-z]+"), F.lit(0))).alias("w")).filter(F.size("w") >= 6)
    groups = F.array(
        F.struct(F.lit("g1").alias("group_id"), F.slice("w", 1, 1).alias("terms"), F.lit(False).alias("negative")),
        F.struct(F.lit("g2").alias("group_id"), F.slice("w", 2, 3).alias("terms"), F.lit(False).alias("negative")),
        F.struct(F.lit("n").alias("group_id"), F.array(F.element_at("w", -1)).alias("terms"), F.lit(True).alias("negative")),
    )
    return b.select(F.col("item_id").alias("search_id"), F.explode(groups).alias("g")).select("search_id", "g.*")


FORMS = "CASE WHEN length({0}) > 3 AND right({0}, 1) NOT IN ('s', 'x') THEN [{0}, {0} || 's', {0} || 'x'] ELSE [{0}] END"


@query("agg_12_many_filters", f"""
WITH b AS (SELECT item_id, regexp_extract_all({F_SQL}, '[a-z]+') AS l FROM benchmark),
b2 AS (SELECT item_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS w FROM b),
g AS (SELECT item_id, unnest([{{'g': 'g1', 't': w[1]}}, {{'g': 'g2', 't': w[2]}}, {{'g': 'g2', 't': w[3]}}, {{'g': 'g2', 't': w[4]}}, {{'g': 'n', 't': w[-1]}}]) AS s FROM b2 WHERE len(w) >= 6),
f AS (SELECT item_id, s.g AS grp, unnest({FORMS.format('s.t')}) AS tok FROM g),
d AS (SELECT DISTINCT doc_id, unnest(string_split_regex({F_SQL}, '[^a-z0-9+#]+')) AS tok FROM documents),
m AS (SELECT item_id, doc_id, count(DISTINCT grp) FILTER (grp <> 'n') AS n, bool_or(grp = 'n') AS ex FROM f JOIN d USING (tok) GROUP BY ALL)
SELECT item_id AS search_id, doc_id FROM m WHERE n = 2 AND NOT ex""")
def agg_12(spark, sf):
    return fl.run_filters(texts(spark, sf), benchmark_searches(spark, sf))


@query("agg_13_k_of_n_match", f"""
WITH d AS (SELECT doc_id, list_distinct(string_split_regex({F_SQL}, '[^a-z0-9+#]+')) AS w FROM documents),
k AS (SELECT doc_id, list_has_any(w, ['that', 'thats', 'thatx'])::INT + list_has_any(w, ['with', 'withs', 'withx'])::INT + list_has_any(w, ['from', 'froms', 'fromx'])::INT + list_contains(w, 'this')::INT + list_contains(w, 'que')::INT AS members FROM d)
SELECT doc_id, members FROM k WHERE members >= 3""")
def agg_13(spark, sf):
    hits = fl.term_hits(texts(spark, sf), lx.corpus_lexicon(spark).select(F.col("skill_key").alias("term")))
    return fl.at_least_k(hits, ["that", "with", "from", "this", "que"], 3)


# Filters derived from orders: an order is a filter, its lines are groups, the customer is the mission.
CATS = [lv.ELIMINATORY, lv.IMPERATIVE, lv.DIFFERENTIATING, lv.DESIRED]
GROUPS_SQL = """
sg AS (SELECT l_orderkey AS search_id, 'k' || l_partkey || '_' || l_linenumber AS group_id,
 CASE WHEN l_linenumber = 1 THEN 'role' WHEN l_returnflag = 'R' THEN 'narrower' ELSE 'skill' END AS kind,
 CASE WHEN p_size % 3 = 0 THEN [lower(p_type) || ' ' || p_name] WHEN p_size % 3 = 1 THEN [p_name, p_name || ' ' || lower(p_type)]
   ELSE [p_name, string_split(p_name, ' ')[2], upper(p_name), lower(p_brand)] END AS terms,
 l_linenumber AS priority, l_quantity > 40 AS protected, l_linenumber = 7 AS negative,
 (['eliminatoire_confirme', 'imperatif', 'fortement_differenciant', 'souhaitable'])[(l_partkey % 4) + 1] AS category, 1 + p_size % 5 AS rarity, p_name, p_type
 FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def order_groups(spark, sf):
    l = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    kind = F.when(F.col("l_linenumber") == 1, "role").when(F.col("l_returnflag") == "R", "narrower").otherwise("skill")
    size = F.pmod("p_size", F.lit(3))
    typed = F.lower("p_type")
    terms = (
        F.when(size == 0, F.array(F.concat_ws(" ", typed, "p_name")))
        .when(size == 1, F.array(F.col("p_name"), F.concat_ws(" ", "p_name", typed)))
        .otherwise(F.array(F.col("p_name"), F.get(F.split("p_name", " "), F.lit(1)), F.upper("p_name"), F.lower("p_brand")))
    )
    return l.select(
        F.col("l_orderkey").alias("search_id"), F.concat(F.lit("k"), "l_partkey", F.lit("_"), "l_linenumber").alias("group_id"), kind.alias("kind"), terms.alias("terms"),
        F.col("l_linenumber").alias("priority"), (F.col("l_quantity") > 40).alias("protected"), (F.col("l_linenumber") == 7).alias("negative"),
        lv.lookup(dict(enumerate(CATS)), F.pmod("l_partkey", F.lit(4))).alias("category"), (1 + F.pmod("p_size", F.lit(5))).alias("rarity"), "p_name", "p_type",
    )


CANON_SQL = GROUPS_SQL + """,
gk AS (SELECT DISTINCT search_id, CASE WHEN negative THEN 'NOT(OR(' ELSE 'OR(' END || list_aggregate(list_sort(list_distinct(list_transform(terms, lambda t: trim(lower(t))))), 'string_agg', '|') || CASE WHEN negative THEN '))' ELSE ')' END AS g FROM sg),
canon AS (SELECT search_id, 'AND(' || string_agg(g, '|' ORDER BY g) || ')' AS canonical FROM gk GROUP BY search_id)"""


@query("set_5_canonical_filters", f"WITH {CANON_SQL} SELECT * FROM canon")
def set_5(spark, sf):
    return fl.canonical_filters(order_groups(spark, sf))


@query("set_2_ordered_distinct", f"""
WITH {GROUPS_SQL}, t AS (SELECT search_id, priority, group_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM sg),
f AS (SELECT search_id, lower(term) AS k, min(row(priority, group_id, pos, term)) AS m FROM t GROUP BY ALL)
SELECT search_id, string_agg(m[4], ' | ' ORDER BY m) AS alternatives FROM f GROUP BY search_id""")
def set_2(spark, sf):
    t = order_groups(spark, sf).select("search_id", "priority", "group_id", F.posexplode("terms").alias("pos", "term"))
    d = fl.ordered_distinct(t, ["search_id"], "term", ["priority", "group_id", "pos"])
    return d.select("search_id", F.array_join("terms", " | ").alias("alternatives"))


@query("set_4_required_and_excluded", f"""
WITH {GROUPS_SQL}, t AS (SELECT search_id, negative, lower(unnest(terms)) AS term FROM sg)
SELECT search_id, term FROM t WHERE NOT negative INTERSECT SELECT search_id, term FROM t WHERE negative""")
def set_4(spark, sf):
    t = order_groups(spark, sf).select("search_id", "negative", F.explode("terms").alias("t")).select("search_id", "negative", tx.fold(F.col("t")).alias("term"))
    return t.filter(~F.col("negative")).drop("negative").intersect(t.filter("negative").drop("negative"))


VERSIONS_SQL = """
v AS (SELECT o_orderkey AS search_id, o_custkey AS mission_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version,
 CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) % 15000 END AS result_count,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'bonne' WHEN '2-HIGH' THEN 'partielle' WHEN '3-MEDIUM' THEN 'mauvaise' END AS relevance,
 CASE o_orderstatus WHEN 'P' THEN ['trop_juniors'] WHEN 'F' THEN ['mauvaise_expertise', 'trop_juniors'] ELSE [] END AS tags, o_orderpriority AS modification FROM orders)"""


def order_versions(spark, sf):
    """Every order as a version of its customer's filter, numbered by date."""
    o = table(spark, sf, "orders")
    k = F.pmod("o_orderkey", F.lit(10))
    o = o.select(
        F.col("o_orderkey").alias("search_id"), F.col("o_custkey").alias("mission_id"), "o_orderdate",
        F.when(k == 0, None).when(k == 1, 0).otherwise(F.pmod(F.floor("o_totalprice").cast("bigint"), F.lit(15000))).alias("result_count"),
        lv.lookup({"1-URGENT": "bonne", "2-HIGH": "partielle", "3-MEDIUM": "mauvaise"}, F.col("o_orderpriority")).alias("relevance"),
        F.when(F.col("o_orderstatus") == "P", F.array(F.lit("trop_juniors"))).when(F.col("o_orderstatus") == "F", F.array(F.lit("mauvaise_expertise"), F.lit("trop_juniors")))
        .otherwise(F.array().cast("array<string>")).alias("tags"),
        F.col("o_orderpriority").alias("modification"),
    )
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return row_number_by_bucket(o, ["mission_id"], month, [F.col("o_orderdate"), F.col("search_id")], "version")


@query("agg_26_similarity", f"""
WITH {GROUPS_SQL}, {VERSIONS_SQL}, t AS (SELECT search_id, list_distinct(flatten(list(list_transform(terms, lambda x: lower(x))))) AS ts FROM sg GROUP BY search_id),
p AS (SELECT v.mission_id, v.version, a.ts AS x, b.ts AS y FROM v JOIN t a USING (search_id) JOIN v w ON w.mission_id = v.mission_id AND w.version = v.version - 1 JOIN t b ON b.search_id = w.search_id)
SELECT mission_id, version, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS similarity FROM p""")
def agg_26(spark, sf):
    t = order_groups(spark, sf).select("search_id", F.explode("terms").alias("t")).groupBy("search_id").agg(F.collect_set(F.trim(tx.fold(F.col("t")))).alias("ts"))
    v = order_versions(spark, sf).select("search_id", "mission_id", "version").join(t, "search_id")
    before = v.select("mission_id", (F.col("version") + 1).alias("version"), F.col("ts").alias("old"))
    return v.join(before, ["mission_id", "version"]).select("mission_id", "version", fl.term_similarity(F.col("ts"), F.col("old")).alias("similarity"))


@query("join_23_never_replay", f"""
WITH {CANON_SQL}, v AS (SELECT o_orderkey AS search_id, o_custkey % 40 AS mission_id, o_orderstatus AS st FROM orders), c AS (SELECT v.*, canonical FROM v JOIN canon USING (search_id))
SELECT search_id FROM c a WHERE st = 'P' AND NOT EXISTS (SELECT 1 FROM c b WHERE b.st <> 'P' AND b.mission_id = a.mission_id AND b.canonical = a.canonical)""")
def join_23(spark, sf):
    v = table(spark, sf, "orders").select(F.col("o_orderkey").alias("search_id"), F.pmod("o_custkey", F.lit(40)).alias("mission_id"), "o_orderstatus")
    c = v.join(fl.canonical_filters(order_groups(spark, sf)), "search_id")
    return fl.not_replayed(c.filter("o_orderstatus = 'P'"), c.filter("o_orderstatus <> 'P'")).select("search_id")


@query("join_24_exclusion_guard", f"""
WITH {GROUPS_SQL}, w AS (SELECT DISTINCT search_id, string_split(p_name, ' ')[1] AS term FROM sg WHERE priority % 2 = 0), p AS (SELECT search_id, lower(unnest(terms)) AS t FROM sg WHERE priority % 2 = 1)
SELECT w.search_id, w.term, NOT coalesce(bool_or(contains(p.t, w.term) OR contains(w.term, p.t)), FALSE) AS allowed FROM w LEFT JOIN p USING (search_id) GROUP BY ALL""")
def join_24(spark, sf):
    g = order_groups(spark, sf)
    wanted = g.filter("priority % 2 = 0").select("search_id", F.get(F.split("p_name", " "), F.lit(0)).alias("term")).distinct()
    positives = g.filter("priority % 2 = 1").select("search_id", F.explode("terms").alias("term"))
    return fl.exclusion_guard(wanted, positives)


@query("join_29_implied_parents", f"""
WITH {GROUPS_SQL}, g AS (SELECT search_id, group_id, kind, list_transform(terms, lambda t: ' ' || list_aggregate(regexp_extract_all(lower(t), '[a-z0-9+#]+'), 'string_agg', ' ') || ' ') AS ts,
 CASE category WHEN 'eliminatoire_confirme' THEN 4 WHEN 'imperatif' THEN 3 WHEN 'fortement_differenciant' THEN 2 ELSE 1 END AS s FROM sg),
pr AS (SELECT a.search_id, a.group_id AS a, b.group_id AS b, len(list_filter(b.ts, lambda tb: len(list_filter(a.ts, lambda ta: contains(tb, ta))) > 0)) = len(b.ts) AS ba,
  len(list_filter(a.ts, lambda ta: len(list_filter(b.ts, lambda tb: contains(ta, tb))) > 0)) = len(a.ts) AS ab, a.s AS sa, b.s AS sb
  FROM g a JOIN g b ON a.search_id = b.search_id AND a.group_id <> b.group_id AND a.kind = 'skill' AND b.kind = 'skill')
SELECT search_id, group_id FROM g WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.search_id = g.search_id AND pr.a = g.group_id AND g.kind = 'skill' AND ba AND sb >= sa AND NOT (ab AND sa >= sb AND b < a))""")
def join_29(spark, sf):
    return fl.drop_implied(order_groups(spark, sf))


@query("join_30_filters_with_feedback", """
SELECT o_orderkey AS search_id, o_orderpriority AS strategy, l_suppkey AS author, l_quantity AS result_count, CASE WHEN l_orderkey IS NOT NULL THEN row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) END AS feedback_no
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def join_30(spark, sf):
    l = table(spark, sf, "lineitem")
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    numbered = row_number_by_bucket(l, ["l_orderkey"], month, [F.col("l_shipdate"), F.col("l_linenumber"), F.col("l_partkey")], "feedback_no")
    o = table(spark, sf, "orders")
    j = o.join(numbered, o.o_orderkey == numbered.l_orderkey, "left")
    return j.select(F.col("o_orderkey").alias("search_id"), F.col("o_orderpriority").alias("strategy"), F.col("l_suppkey").alias("author"), F.col("l_quantity").alias("result_count"), "feedback_no")


# Requirements derived from lines and parts, with aliases of every kind the term selection knows.
REQS_SQL = """
rq0 AS (SELECT l_orderkey AS mission_id, l_partkey || '_' || l_linenumber AS req_id, p_name AS label, [p_name, p_name || ' ' || p_size, string_split(p_name, ' ')[2], lower(p_type), 'x' || (p_size % 3), 'q'] AS terms,
 CASE WHEN p_size % 4 = 0 THEN [lower(p_type)] ELSE [] END AS cs, p_size % 6 <> 0 AS lit, p_size % 11 = 0 AND 1 + p_size % 5 >= 4 AS amb,
 CASE WHEN p_size % 10 = 0 THEN 'years' ELSE 'skill' END AS kind, CASE WHEN p_size % 7 = 0 THEN 'methodologie' ELSE 'technique' END AS dimension, p_size % 13 = 0 AS generic,
 (['eliminatoire_confirme', 'imperatif', 'fortement_differenciant', 'souhaitable', 'contextuel', 'a_clarifier'])[(l_partkey % 6) + 1] AS category, 1 + p_size % 5 AS rarity
 FROM lineitem JOIN part ON p_partkey = l_partkey),
rq1 AS (SELECT *, list_filter(terms, lambda t: NOT (list_contains(cs, t) OR (length(replace(t, ' ', '')) <= 2 AND NOT regexp_matches(t, '\\d')) OR (t <> label AND starts_with(t, label || ' '))
  OR (amb AND NOT contains(t, ' ')) OR (NOT lit AND t = label))) AS k FROM rq0),
rq AS (SELECT * EXCLUDE (k), list_filter(k, lambda t: len(list_filter(k, lambda o: o <> t AND contains(' ' || t || ' ', ' ' || o || ' '))) = 0) AS allowed FROM rq1),
ru AS (SELECT *, CASE WHEN kind = 'years' THEN 'native_filter' WHEN dimension = 'methodologie' OR generic THEN 'too_generic' WHEN category IN ('contextuel', 'a_clarifier') THEN 'not_imposed' WHEN len(allowed) = 0 THEN 'ambiguous_aliases' END AS reason FROM rq),
rr AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY CASE category WHEN 'eliminatoire_confirme' THEN 4 WHEN 'imperatif' THEN 3 WHEN 'fortement_differenciant' THEN 2 ELSE 1 END DESC, rarity DESC, label, req_id) AS pos,
  category <> 'souhaitable' AS strong FROM ru WHERE reason IS NULL),
rh AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY pos) AS n FROM rr WHERE strong QUALIFY n <= 3),
rs AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY pos) AS n FROM rr WHERE category IN ('eliminatoire_confirme', 'imperatif') QUALIFY n <= 5)"""


def order_requirements(spark, sf):
    names = [*CATS, lv.CONTEXTUAL, lv.TO_CLARIFY]
    m = lambda n: F.pmod("p_size", F.lit(n))
    # the terms depend on the part only: they are chosen once per part, before the lines are joined
    p = table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("label"),
        F.array(F.col("p_name"), F.concat_ws(" ", "p_name", "p_size"), F.get(F.split("p_name", " "), F.lit(1)), F.lower("p_type"), F.concat(F.lit("x"), m(3)), F.lit("q")).alias("all_terms"),
        F.when(m(4) == 0, F.array(F.lower("p_type"))).otherwise(F.array().cast("array<string>")).alias("cs"), (m(6) != 0).alias("lit"),
        ((m(11) == 0) & (1 + m(5) >= 4)).alias("amb"), F.when(m(10) == 0, "years").otherwise("skill").alias("kind"),
        F.when(m(7) == 0, "methodologie").otherwise("technique").alias("dimension"), (m(13) == 0).alias("generic"), (1 + m(5)).alias("rarity"),
    )
    p = p.withColumn("terms", fl.allowed_terms(F.col("label"), F.col("all_terms"), F.col("cs"), F.col("lit"), F.col("amb"))).drop("all_terms", "cs", "lit", "amb")
    l = table(spark, sf, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey"))
    r = l.select(
        F.col("l_orderkey").alias("mission_id"), F.concat("l_partkey", F.lit("_"), "l_linenumber").alias("req_id"), "label", "terms", "kind", "dimension", "generic", "rarity",
        lv.lookup(dict(enumerate(names)), F.pmod("l_partkey", F.lit(6))).alias("category"),
    )
    return r.withColumn("reason", fl.usable(F.col("kind"), F.col("dimension"), F.col("generic"), F.col("category"), F.col("terms")))


@query("flt_18_allowed_terms", f"WITH {REQS_SQL} SELECT mission_id, req_id, array_to_string(allowed, ' | ') AS allowed FROM rq")
def flt_18(spark, sf):
    return order_requirements(spark, sf).select("mission_id", "req_id", F.array_join("terms", " | ").alias("allowed"))


@query("flt_19_usable_in_filter", f"WITH {REQS_SQL} SELECT mission_id, req_id, reason IS NULL AS usable, reason FROM ru")
def flt_19(spark, sf):
    return order_requirements(spark, sf).select("mission_id", "req_id", F.col("reason").isNull().alias("usable"), "reason")


@query("top_5_three_strategies", f"""
WITH {REQS_SQL} SELECT mission_id, 'exploratory' AS strategy, string_agg(allowed[1], ' OR ' ORDER BY pos) AS query FROM rh GROUP BY mission_id
UNION ALL SELECT mission_id, 'balanced', string_agg(array_to_string(allowed[1:CASE WHEN n = 1 THEN 3 ELSE 2 END], ' OR '), ' AND ' ORDER BY pos) FROM rh GROUP BY mission_id
UNION ALL SELECT mission_id, 'strict', string_agg(array_to_string(allowed[1:2], ' OR '), ' AND ' ORDER BY pos) FROM rs GROUP BY mission_id""")
def top_5(spark, sf):
    return fl.three_strategies(fl.ranked_requirements(order_requirements(spark, sf)))


@query("top_5_search_sets", f"""
WITH {REQS_SQL}, ti AS (SELECT o_orderkey AS mission_id, [o_orderpriority, 'role ' || (o_custkey % 7)] AS core, ['role ' || (o_custkey % 7), 'a', 'b', 'c', 'd'] AS wide FROM orders WHERE o_orderkey % 5 > 0),
mb AS (SELECT mission_id, 'c' || mission_id AS combo_id, req_id FROM rq WHERE mission_id % 3 = 0 AND split_part(req_id, '_', 2)::INT <= 3),
bc AS (SELECT mb.mission_id, combo_id, list(allowed[1:2] ORDER BY pos) AS members FROM mb JOIN rr ON rr.mission_id = mb.mission_id AND rr.req_id = mb.req_id GROUP BY ALL),
fr AS (SELECT rr.*, (bc.mission_id IS NOT NULL)::INT AS nu FROM rr LEFT JOIN bc ON bc.mission_id = rr.mission_id WHERE NOT EXISTS (SELECT 1 FROM mb WHERE mb.mission_id = rr.mission_id AND mb.req_id = rr.req_id)),
tp AS (SELECT mission_id, allowed[1] AS t, pos FROM fr WHERE strong UNION ALL SELECT mission_id, allowed[1], pos FROM rr WHERE mission_id NOT IN (SELECT mission_id FROM fr WHERE strong)),
tq AS (SELECT mission_id, list(t ORDER BY pos) AS own FROM (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY pos) AS n FROM tp) WHERE n <= 3 GROUP BY 1),
un AS (SELECT coalesce(tq.mission_id, bc.mission_id) AS mission_id, list_concat(coalesce(own, []), coalesce(flatten(members)[1:3], [])) AS l FROM tq FULL JOIN bc ON bc.mission_id = tq.mission_id),
ch AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY pos) AS rk, row_number() OVER (PARTITION BY mission_id, strong ORDER BY pos) AS sr, count(*) FILTER (strong) OVER (PARTITION BY mission_id) AS ns, count(*) OVER (PARTITION BY mission_id) AS nf FROM fr),
cc AS (SELECT *, least(CASE WHEN ns > 0 THEN ns ELSE nf END, 3 - nu) AS c FROM ch),
md AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY pos) AS i FROM cc WHERE CASE WHEN c + nu < 2 THEN rk <= greatest(2 - nu, c) WHEN ns > 0 THEN strong AND sr <= c ELSE rk <= c END),
h0 AS (SELECT mission_id, req_id, category, pos, 0 AS part, 'skill' AS kind, allowed[1:2] AS t, rarity AS r FROM fr WHERE category IN ('eliminatoire_confirme', 'imperatif')
 UNION ALL SELECT mission_id, req_id, category, pos, 1, 'narrower', [label || ' pro', label || ' plus'], 5 FROM fr WHERE category IN ('eliminatoire_confirme', 'imperatif') AND rarity >= 4),
h1 AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY category, r DESC, pos, part) AS n FROM h0),
h2 AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY pos, part) AS i FROM h1 WHERE n <= 5),
g AS (SELECT mission_id, 'exploratory' AS strategy, 1 AS priority, 'union' AS group_id, 'union' AS kind, list_filter(l, lambda x, i: list_position(l, x) = i) AS terms, 1 AS at_least, 0 AS members FROM un
 UNION ALL SELECT mission_id, 'balanced', i + 1, req_id, 'skill', allowed[1:CASE WHEN i = 1 THEN 3 ELSE 2 END], 1, 0 FROM md
 UNION ALL SELECT mission_id, 'balanced', 1, 'union:' || combo_id, 'union', flatten(members)[1:4], 1, 0 FROM bc
 UNION ALL SELECT mission_id, 'strict', i, CASE WHEN part = 1 THEN 'narrow:' ELSE '' END || req_id, kind, t, 1, 0 FROM h2
 UNION ALL SELECT mission_id, 'strict', 1, combo_id, 'combo', [], 2, len(members) FROM bc WHERE len(members) >= 2
 UNION ALL SELECT mission_id, s, 0, 'title', 'title', CASE s WHEN 'exploratory' THEN [core[1], core[2], 'a', 'b', 'c', 'd'] ELSE core END, 1, 0 FROM ti, (VALUES ('exploratory'), ('balanced'), ('strict')) v(s))
SELECT mission_id, strategy, priority::BIGINT AS priority, group_id, kind, array_to_string(terms, ' OR ') AS terms, at_least::BIGINT AS at_least, members::BIGINT AS n_members FROM g""")
def top_5_sets(spark, sf):
    reqs = order_requirements(spark, sf)
    ranked = fl.ranked_requirements(reqs.withColumn("advanced", F.col("rarity") >= 4).withColumn("narrowers", F.array(F.concat("label", F.lit(" pro")), F.concat("label", F.lit(" plus")))))
    o = table(spark, sf, "orders").filter("o_orderkey % 5 > 0")
    role = F.concat(F.lit("role "), (F.col("o_custkey") % 7).cast("string"))
    titles = o.select(F.col("o_orderkey").alias("mission_id"), F.array("o_orderpriority", role).alias("core"), F.array(role, *[F.lit(x) for x in "abcd"]).alias("wide"))
    some = reqs.filter((F.col("mission_id") % 3 == 0) & (F.element_at(F.split("req_id", "_"), -1).cast("int") <= 3))
    combos = some.groupBy("mission_id").agg(F.collect_list("req_id").alias("members")).withColumn("combo_id", F.concat(F.lit("c"), "mission_id")).withColumn("at_least", F.lit(2))
    g = fl.search_sets(ranked, titles, combos)
    return g.select(
        "mission_id", "strategy", F.col("priority").cast("bigint").alias("priority"), "group_id", "kind", F.array_join("terms", " OR ").alias("terms"),
        F.col("at_least").cast("bigint").alias("at_least"), F.size("members").cast("bigint").alias("n_members"),
    )


@query("top_9_strict_groups", f"""
WITH {REQS_SQL} SELECT mission_id, req_id, row_number() OVER (PARTITION BY mission_id ORDER BY pos) <= 5 AS searched FROM rr WHERE category IN ('eliminatoire_confirme', 'imperatif')""")
def top_9(spark, sf):
    return fl.strict_groups(fl.ranked_requirements(order_requirements(spark, sf))).select("mission_id", "req_id", "searched")


@query("join_35_left_out", f"""
WITH {REQS_SQL} SELECT mission_id, req_id, CASE WHEN reason IS NOT NULL THEN reason WHEN category = 'souhaitable' THEN 'desired_not_imposed' WHEN category = 'fortement_differenciant' THEN 'differentiating_not_imposed'
 WHEN category = 'imperatif' THEN 'imperative_left_to_scoring' ELSE 'not_imposed_here' END AS why FROM ru WHERE kind <> 'years' AND NOT EXISTS (SELECT 1 FROM rh WHERE rh.mission_id = ru.mission_id AND rh.req_id = ru.req_id)""")
def join_35(spark, sf):
    from proofgrid.operators.scale import top_rows

    reqs = order_requirements(spark, sf)
    used = top_rows(fl.ranked_requirements(reqs).filter("_strong"), ["mission_id"], [F.col("pos")], 3)
    return fl.left_out(reqs, used, ["mission_id", "req_id"])


@query("win_15_length_packing", f"""
WITH {GROUPS_SQL}, t AS (SELECT search_id, priority, group_id, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos FROM sg),
u AS (SELECT *, sum(length(term) + 4) OVER (PARTITION BY search_id ORDER BY priority, group_id, pos ROWS UNBOUNDED PRECEDING) AS used FROM t)
SELECT search_id, group_id, pos, term, used::BIGINT AS used FROM u WHERE used <= 120""")
def win_15(spark, sf):
    t = order_groups(spark, sf).select("search_id", "priority", "group_id", F.posexplode("terms").alias("pos", "term"))
    return fl.pack(t, "search_id", [F.col("priority"), F.col("group_id"), F.col("pos")], "term", budget=120).select("search_id", "group_id", "pos", "term", "used")


@query("win_14_unlocking_steps", f"""
WITH {VERSIONS_SQL}, z AS (SELECT mission_id, min(version) FILTER (result_count = 0) AS zero_version FROM v GROUP BY mission_id),
u AS (SELECT v.mission_id, zero_version, min(version) AS usable_version FROM v JOIN z USING (mission_id) WHERE version > zero_version AND result_count BETWEEN 30 AND 10000 GROUP BY ALL)
SELECT v.mission_id, zero_version, usable_version, version AS step_version, modification FROM v JOIN u USING (mission_id) WHERE version > zero_version AND version <= usable_version + 1""")
def win_14(spark, sf):
    return fl.unlocking_steps(order_versions(spark, sf), "mission_id")


@query("agg_31_volume_risk", f"""
WITH {GROUPS_SQL}, n AS (SELECT search_id, count(*) FILTER (kind <> 'role') AS n, count(*) FILTER (kind <> 'role' AND rarity >= 5) AS r FROM sg GROUP BY search_id)
SELECT search_id, CASE WHEN n >= 4 OR (n >= 3 AND r > 0) OR (n >= 2 AND r >= 2) THEN 'élevé' WHEN n = 3 OR r > 0 THEN 'modéré' ELSE 'faible' END AS low_risk,
 CASE WHEN search_id % 3 = 0 OR n <= 1 THEN 'élevé' WHEN n = 2 THEN 'modéré' ELSE 'faible' END AS high_risk FROM n""")
def agg_31(spark, sf):
    imposed = F.col("kind") != "role"
    n = order_groups(spark, sf).groupBy("search_id").agg(F.count_if(imposed).alias("n"), F.count_if(imposed & (F.col("rarity") >= 5)).alias("r"))
    low, high = fl.volume_risk(F.col("n"), F.col("r"), F.pmod("search_id", F.lit(3)) == 0)
    return n.select("search_id", low.alias("low_risk"), high.alias("high_risk"))


def diagnosis_sql(lo: int, hi: int, broad: int) -> str:
    return f"""CASE WHEN result_count IS NULL THEN 'unknown' WHEN result_count = 0 THEN 'zero' WHEN result_count > {broad} THEN 'too_broad' WHEN result_count < {lo} THEN 'too_narrow'
 WHEN result_count > {hi} AND (relevance IS NULL OR relevance = 'bonne') THEN 'acceptable' WHEN relevance IN ('partielle', 'mauvaise') OR len(tags) > 0 THEN 'low_relevance' ELSE 'acceptable' END"""


@query("fn_34_diagnosis", f"""
WITH {GROUPS_SQL}, {VERSIONS_SQL}, n AS (SELECT search_id, count(*) FILTER (kind <> 'role' AND NOT negative) AS n_and, bool_or(len(list_filter(terms, lambda t: len(string_split(t, ' ')) >= 3)) > 0) AS long_phrase,
 coalesce(max(len(terms)) FILTER (kind = 'role'), 0) AS n_titles, bool_or(negative) AS neg FROM sg GROUP BY search_id),
d AS (SELECT v.*, n.*, {diagnosis_sql(30, 100, 10000)} AS problem FROM v JOIN n USING (search_id)),
c AS (SELECT search_id, problem, concat_ws(',', CASE WHEN problem = 'zero' AND n_and >= 4 THEN 'many_groups' END, CASE WHEN problem = 'zero' AND long_phrase THEN 'long_phrase' END,
 CASE WHEN problem = 'zero' AND n_titles BETWEEN 1 AND 2 THEN 'few_titles' END, CASE WHEN problem = 'zero' AND neg THEN 'exclusions' END, CASE WHEN problem = 'too_broad' THEN 'beyond_limit' END,
 CASE WHEN problem = 'too_broad' AND n_and <= 1 THEN 'single_skill' END, CASE WHEN problem = 'too_broad' AND n_titles >= 5 THEN 'wide_titles' END, CASE WHEN problem = 'too_narrow' THEN 'below_target' END,
 CASE WHEN problem = 'too_narrow' AND n_and >= 3 THEN 'secondary_blocks' END, CASE WHEN problem = 'low_relevance' THEN 'false_positives' END, CASE WHEN list_contains(tags, 'trop_juniors') THEN 'juniors' END,
 CASE WHEN list_contains(tags, 'mauvaise_expertise') THEN 'wrong_expertise' END) AS causes FROM d)
SELECT search_id, problem, CASE WHEN problem = 'zero' AND causes = '' THEN 'rare_need' ELSE causes END AS causes FROM c""")
def fn_34(spark, sf):
    v = order_versions(spark, sf)
    g = order_groups(spark, sf)
    longest = F.exists("terms", lambda t: F.size(F.split(t, " ")) >= 3)
    n = g.groupBy("search_id").agg(
        F.count_if((F.col("kind") != "role") & ~F.col("negative")).alias("n_and"), F.bool_or(longest).alias("long_phrase"),
        F.coalesce(F.max(F.when(F.col("kind") == "role", F.size("terms"))), F.lit(0)).alias("n_titles"), F.bool_or("negative").alias("neg"),
    )
    d = v.join(n, "search_id").withColumn("problem", fl.diagnosis(F.col("result_count"), F.col("relevance"), F.col("tags")))
    why = fl.causes(F.col("problem"), F.col("n_and"), F.col("long_phrase"), F.col("n_titles"), F.col("neg"), F.col("tags"))
    return d.select("search_id", "problem", F.array_join(why, ",").alias("causes"))


@query("udf_2_platform_profile", f"WITH {VERSIONS_SQL} SELECT {diagnosis_sql(200, 900, 5000)} AS problem, count(*) AS searches FROM v GROUP BY 1")
def udf_2(spark, sf):
    profile = fl.Profile(max_length=400, target_min=200, target_max=900, too_broad=5000)
    v = order_versions(spark, sf)
    return v.groupBy(fl.diagnosis(F.col("result_count"), F.col("relevance"), F.col("tags"), profile).alias("problem")).agg(F.count("*").alias("searches"))


@query("fn_35_split_long_phrase", f"""
WITH {GROUPS_SQL}, l AS (SELECT search_id, group_id, string_split(terms[1], ' ') AS w FROM sg WHERE len(terms) = 1)
SELECT search_id, group_id, 'head' AS part, w[1] || ' ' || w[2] AS term FROM l WHERE len(w) >= 3 UNION ALL SELECT search_id, group_id, 'tail', array_to_string(w[3:], ' ') FROM l WHERE len(w) >= 3""")
def fn_35a(spark, sf):
    return fl.split_long_phrase(order_groups(spark, sf))


@query("fn_35_drop_secondary", f"""
WITH {GROUPS_SQL}, o AS (SELECT * FROM sg WHERE kind <> 'role'), m AS (SELECT search_id, max(priority) AS p FROM o WHERE NOT protected GROUP BY search_id),
b AS (SELECT o.search_id, o.group_id FROM o JOIN m ON m.search_id = o.search_id AND m.p = o.priority WHERE NOT protected)
SELECT search_id, group_id FROM b WHERE EXISTS (SELECT 1 FROM o WHERE o.search_id = b.search_id AND NOT EXISTS (SELECT 1 FROM b c WHERE c.search_id = o.search_id AND c.group_id = o.group_id))""")
def fn_35b(spark, sf):
    return fl.drop_secondary(order_groups(spark, sf))


@query("fn_35_widen_titles", f"""
WITH {GROUPS_SQL}, p AS (SELECT DISTINCT search_id, lower(p_type) || ' ' || p_name AS title FROM sg WHERE kind <> 'role'), h AS (SELECT search_id, lower(unnest(terms)) AS k FROM sg WHERE kind = 'role')
SELECT p.search_id, title FROM p WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.search_id = p.search_id AND h.k = title)""")
def fn_35c(spark, sf):
    g = order_groups(spark, sf)
    pool = g.filter("kind <> 'role'").select("search_id", F.concat_ws(" ", F.lower("p_type"), "p_name").alias("title")).distinct()
    return fl.widen_titles(g, pool)


@query("fn_35_add_synonyms", f"""
WITH {GROUPS_SQL}, s AS (SELECT search_id, group_id, unnest([p_name, string_split(p_name, ' ')[1], string_split(p_name, ' ')[2], lower(p_type)]) AS term, unnest([0, 1, 2, 3]) AS pos FROM sg WHERE kind = 'skill'),
f AS (SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM sg WHERE sg.search_id = s.search_id AND sg.group_id = s.group_id AND list_contains(list_transform(terms, lambda t: lower(t)), s.term)))
SELECT search_id, group_id, pos, term FROM f QUALIFY row_number() OVER (PARTITION BY search_id, group_id ORDER BY pos) <= 2""")
def fn_35d(spark, sf):
    g = order_groups(spark, sf)
    words = F.split("p_name", " ")
    alt = F.array(F.col("p_name"), F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.lower("p_type"))
    s = g.filter("kind = 'skill'").select("search_id", "group_id", F.posexplode(alt).alias("pos", "term"))
    return fl.add_synonyms(g, s).select("search_id", "group_id", "pos", "term")


@query("fn_35_next_discriminant", f"""
WITH {REQS_SQL} SELECT mission_id AS search_id, arg_min(req_id, pos) AS req_key FROM rr WHERE NOT EXISTS (SELECT 1 FROM rr b WHERE b.mission_id = rr.mission_id AND b.req_id = rr.req_id AND b.pos % 2 = 1) GROUP BY mission_id""")
def fn_35e(spark, sf):
    r = fl.ranked_requirements(order_requirements(spark, sf)).select(F.col("mission_id").alias("search_id"), F.col("req_id").alias("req_key"), "pos")
    imposed = r.filter("pos % 2 = 1").select("search_id", F.col("req_key").alias("group_id"))
    return fl.next_discriminant(imposed, r)


@query("fn_35_drop_widest_title", f"WITH {GROUPS_SQL} SELECT search_id, group_id, terms[-1] AS term FROM sg WHERE kind = 'role' AND len(terms) >= 4")
def fn_35f(spark, sf):
    return fl.drop_widest_title(order_groups(spark, sf))


@query("fn_35_add_narrower", f"""
WITH {GROUPS_SQL}, n AS (SELECT search_id, p_name AS group_id, kind, priority FROM sg), nr AS (SELECT DISTINCT p_name AS group_id, [p_name || ' advanced', p_name || ' tuning', p_name || ' scale'] AS w FROM part WHERE p_name LIKE '%ring%' OR p_name LIKE '%plate%'),
f AS (SELECT n.search_id, n.group_id, n.priority, w FROM n JOIN nr USING (group_id) WHERE kind = 'skill' AND NOT EXISTS (SELECT 1 FROM n d WHERE d.kind = 'narrower' AND d.search_id = n.search_id AND d.group_id = n.group_id))
SELECT search_id, arg_min(group_id, (priority, group_id)) AS group_id, array_to_string(arg_min(w, (priority, group_id)), ', ') AS terms FROM f GROUP BY search_id""")
def fn_35g(spark, sf):
    g = order_groups(spark, sf).select("search_id", "kind", "priority", F.when(F.col("kind") == "narrower", F.concat(F.lit("narrow:"), "p_name")).otherwise(F.col("p_name")).alias("group_id"))
    p = table(spark, sf, "part").filter(F.col("p_name").contains("ring") | F.col("p_name").contains("plate")).select(F.col("p_name").alias("group_id")).distinct()
    p = p.withColumn("narrowers", F.array(*[F.concat("group_id", F.lit(f" {w}")) for w in ("advanced", "tuning", "scale")]))
    return fl.add_narrower(g, p).select("search_id", "group_id", F.array_join("terms", ", ").alias("terms"))


@query("fn_35_add_missing_skill", f"""
WITH {REQS_SQL}, m AS (SELECT o_orderkey AS mission_id, (['ring', 'plate', 'widget', 'small rod kit'])[(o_custkey % 4) + 1] AS skill FROM orders)
SELECT mission_id AS search_id, arg_min(req_id, pos) AS req_id FROM rr JOIN m USING (mission_id) WHERE contains(skill, label) OR contains(label, skill) GROUP BY mission_id""")
def fn_35h(spark, sf):
    r = fl.ranked_requirements(order_requirements(spark, sf)).withColumnRenamed("mission_id", "search_id")
    skill = F.element_at(F.array(*[F.lit(x) for x in ("ring", "plate", "widget", "small rod kit")]), (F.pmod("o_custkey", F.lit(4)) + 1).cast("int"))
    return fl.add_missing_skill(r, table(spark, sf, "orders").select(F.col("o_orderkey").alias("search_id"), skill.alias("skill")))


@query("join_34_title_pool", f"""
WITH r AS (SELECT * FROM {lx.values_sql(lx.ROLES, 'role_key, label, titles, wide_titles, discriminants, triggers, ord')}),
w AS (SELECT role_key, unnest(list_concat(titles, triggers)) AS term, ord FROM r),
m AS (SELECT p_partkey, role_key, length(term) AS n, ord, p_size % 4 AS lead FROM part JOIN w ON regexp_matches(p_name, '(^|[^a-z0-9+#])' || term || '[sx]?($|[^a-z0-9+#])')),
b AS (SELECT p_partkey, role_key, lead FROM m QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, ord) = 1),
t AS (SELECT b.p_partkey, 0 AS rk, o.ord, unnest(o.titles[1:2]) AS title, generate_subscripts(o.titles[1:2], 1) AS pos FROM b JOIN r o ON o.role_key <> b.role_key AND o.discriminants[1] = (['that', 'from', 'this', 'zzz'])[b.lead + 1]
   UNION ALL SELECT b.p_partkey, 1, 0, unnest(titles), generate_subscripts(titles, 1) FROM b JOIN r USING (role_key)
   UNION ALL SELECT b.p_partkey, 2, 0, unnest(wide_titles), generate_subscripts(wide_titles, 1) FROM b JOIN r USING (role_key)
   UNION ALL SELECT b.p_partkey, 3, o.ord, unnest(o.wide_titles[1:2]), generate_subscripts(o.wide_titles[1:2], 1) FROM b JOIN r o ON o.role_key <> b.role_key AND o.discriminants[1] = (['that', 'from', 'this', 'zzz'])[b.lead + 1])
SELECT p_partkey, string_agg(title, ', ' ORDER BY rk, ord, pos) AS titles FROM t GROUP BY p_partkey""")
def join_34(spark, sf):
    from proofgrid.operators.needs import title_pool

    p = table(spark, sf, "part")
    lead = F.element_at(F.array(*[F.lit(x) for x in ("that", "from", "this", "zzz")]), (F.pmod("p_size", F.lit(4)) + 1).cast("int"))
    imposed = p.select("p_partkey", lead.alias("skill_key"))
    return title_pool(p, lx.role_families(spark), imposed, "p_partkey", "p_name").select("p_partkey", F.array_join("terms", ", ").alias("titles"))
