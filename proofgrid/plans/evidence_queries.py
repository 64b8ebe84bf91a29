"""Evidence rules: phrases derived from orders with known signals, items derived from order lines, scope rules over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.functions import scope as sp
from proofgrid.functions import text as tx
from proofgrid.functions.levels import level_name
from proofgrid.operators import evidence as ev
from proofgrid.operators import intervals as iv
from proofgrid.operators import mentions as mn
from proofgrid.operators.scale import parameter_table
from proofgrid.plans import lexicon as lx
from proofgrid.plans.base import TODAY, fold_sql, query, spread, table, texts, turns
from proofgrid.plans.scoring_queries import LEVELS_SQL  # noqa: F401
from proofgrid.plans.text_queries import SENT_MARK, TRIM_EDGE
from proofgrid.session import durable

LEVEL_SQL = "(['contredit', 'non_documente', 'declare_sans_preuve', 'partiellement_demontre', 'confirme_demontre'])"
# One phrase shape per line; {n} is a number taken from the order.
PHRASES = [
    "- Mise en place d'un cluster Kafka avec {n} topics, {n} partitions et {n} brokers.",
    "- Je n'ai jamais configuré de cluster Kafka.",
    "- Migration vers Kafka planifiée pour la suite : topics et partitions à venir.",
    "- Participation à la conception de la plateforme Kafka : {n} topics, {n} brokers.",
    "- Utilisation de Kafka.",
    "- Formation Kafka : développement de producers et consumers en TP.",
    "- Collaboration avec l'équipe plateforme qui administre le cluster Kafka.",
    "- Développement d'un service Kafka.",
    "- Connaissance de Kafka.",
    "- Exploitation de Kafka avec {n} topics et {n} partitions.",
    "- Administration et configuration : Kafka, Redis, Nginx, Linux",
    "- Développement Java ; jamais de problème en production avec Kafka sur {n} brokers.",
    "- Animation de formations Kafka pour {n} équipes.",
    "- Responsable de Kafka : conception et déploiement de {n} topics, documentation livrée.",
]
SKILL_LEVELS = [4, 1, 2, 3, 2, 2, 2, 3, 2, 3, 2, 2, 3, 4]
ACTIVITY_LEVELS = [4, 1, 2, 3, 2, 2, 2, 2, 2, 4, 2, 2, 2, 3]
DOMAIN_LEVELS = [4, 1, 2, 3, 2, 2, 2, 2, 2, 2, 2, 2, 2, 4]
POINTS = [4, 0, 2, 3, 0, 2, 0, 0, 0, 3, 1, 2, 1, 5]
ACTIONS = ["strong", "none", "strong", "strong", "weak", "strong", "strong", "strong", "none", "weak", "strong", "none", "strong", "strong"]
ROLES = ["neutral"] * 3 + ["participant"] + ["neutral"] * 9 + ["owner"]
DEPTHS = [3, 0, 2, 2, 0, 2, 0, 0, 0, 2, 0, 1, 0, 1]
CODES = ["", "", "future", "", "", "training", "third_party", "", "", "", "", "", "trainer", ""]
KAFKA = lx._skill("kafka", ["Kafka"], rarity=4, depth=["topics", "partitions", "producers", "consumers", "brokers"])
N = len(PHRASES)


def phrases(spark, sf, kind="skill"):
    o = spread(table(spark, sf, "orders"), "o_orderkey")
    pick = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.pmod("o_orderkey", F.lit(N)) + 1).cast("int"))
    item = F.replace(pick, F.lit("{n}"), (2 + F.pmod("o_custkey", F.lit(9))).cast("string"))
    lex = parameter_table(spark, [KAFKA], mn.LEXICON_SCHEMA)
    rows = o.select(F.col("o_orderkey").alias("doc_id"), item.alias("item"), F.lit(kind).alias("kind"), F.lit("kafka").alias("skill_key"))
    rows = rows.withColumn("at", F.instr(F.lower("item"), "kafka") - 1)
    return rows.join(F.broadcast(ev.depth_patterns(lex)), "skill_key")


def pick_sql(values, key="o_orderkey"):
    return f"({values!r})[{key} % {N} + 1]"


@query("fn_8_window_signals", f"""SELECT o_orderkey AS doc_id, {pick_sql(ACTIONS)} AS action, {pick_sql(ROLES)} AS role, {pick_sql(DEPTHS)}::BIGINT AS depth, o_orderkey % {N} = 1 AS negated FROM orders""")
def fn_8(spark, sf):
    a = ev.analyse_mentions(phrases(spark, sf), TODAY)
    return a.select("doc_id", "action", "role", F.size("depth").cast("bigint").alias("depth"), "negated")


@query("fn_9_skill_levels", f"SELECT o_orderkey AS doc_id, {LEVEL_SQL}[{pick_sql(SKILL_LEVELS)} + 1] AS level FROM orders")
def fn_9(spark, sf):
    return ev.analyse_mentions(phrases(spark, sf), TODAY).select("doc_id", level_name(F.col("level_ord")).alias("level"))


@query("fn_9_activity_levels", f"SELECT o_orderkey AS doc_id, {pick_sql(ACTIVITY_LEVELS)}::BIGINT AS level_ord FROM orders")
def fn_9b(spark, sf):
    return ev.analyse_mentions(phrases(spark, sf, "activity"), TODAY).select("doc_id", F.col("level_ord").cast("bigint").alias("level_ord"))


@query("fn_9_domain_levels", f"SELECT o_orderkey AS doc_id, {pick_sql(DOMAIN_LEVELS)}::BIGINT AS level_ord FROM orders")
def fn_9c(spark, sf):
    return ev.analyse_mentions(phrases(spark, sf, "domain"), TODAY).select("doc_id", F.col("level_ord").cast("bigint").alias("level_ord"))


@query("agg_15_signal_points", f"SELECT o_orderkey AS doc_id, {pick_sql(POINTS)}::BIGINT AS points FROM orders")
def agg_15(spark, sf):
    return ev.analyse_mentions(phrases(spark, sf), TODAY).select("doc_id", F.col("points").cast("bigint").alias("points"))


@query("fn_5_scope_caps", f"SELECT o_orderkey AS doc_id, {pick_sql(CODES)} AS caps FROM orders")
def fn_5(spark, sf):
    return ev.analyse_mentions(phrases(spark, sf), TODAY).select("doc_id", F.array_join("caps", ",").alias("caps"))


@query("fn_7_stack_list", f"SELECT o_orderkey AS doc_id, o_orderkey % {N} = 10 AS listed FROM orders")
def fn_7(spark, sf):
    return phrases(spark, sf).select("doc_id", sp.stack_list(tx.fold(F.col("item"))).alias("listed"))


@query("fn_3_clauses", f"""
WITH f AS (SELECT conv_id, turn, replace({fold_sql('text')}, chr(10), ' ') AS f FROM conversations),
m AS (SELECT conv_id, turn, string_split(regexp_replace(regexp_replace(regexp_replace(f, '([.!?])\\s+([a-z0-9"''(])', '\\1' || chr(1) || '\\2', 'g'), '\\b(?:mais|but|however|toutefois|cependant|alors\\s+que|whereas|en\\s+revanche)\\b', chr(1), 'g'), ';', chr(1), 'g'), chr(1)) AS c FROM f)
SELECT conv_id, turn, clause FROM (SELECT conv_id, turn, unnest(c) AS clause FROM m) WHERE clause <> ''""")
def fn_3(spark, sf):
    c = turns(spark, sf).select("conv_id", "turn", F.explode(sp.clauses(F.translate(tx.fold(F.col("text")), "\n", " "))).alias("c"))
    return c.select("conv_id", "turn", F.col("c.text").alias("clause"))


NEG_RX = "(?:\\bjamais\\b|\\bpas\\s+(?:de\\s|du\\s|des\\s)|\\bnever\\b|\\b(?:did|do|does|have|has|had|was|were|am|is)\\s*not\\b)"
NEG_SQL = f"""
p AS (SELECT doc_id, string_split({SENT_MARK}, chr(1)) AS p FROM documents), e AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM p),
s AS (SELECT doc_id, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(ltrim(piece, chr(10) || {TRIM_EDGE})) AS start, {fold_sql(f"trim(piece, chr(10) || {TRIM_EDGE})")} AS f FROM e),
n AS (SELECT doc_id, start::BIGINT AS start, f, regexp_extract_all(f, '{NEG_RX}(?:[^,:;()!?.]|\\.(?:[^\\s]|$))*') AS regions FROM s WHERE f <> '')"""


def negated_sentences(spark, sf):
    s = ev.sentence_rows(texts(spark, sf)).withColumn("f", tx.fold(F.col("sentence")))
    return s.withColumn("regions", sp.negated_regions(F.col("f"), sp.clauses(F.col("f"))))


@query("fn_4_negated_regions", f"WITH {NEG_SQL} SELECT doc_id, start, array_to_string(regions, ' | ') AS regions FROM n WHERE len(regions) > 0")
def fn_4(spark, sf):
    r = negated_sentences(spark, sf).filter(F.size("regions") > 0).select("doc_id", "start", "f", F.explode("regions").alias("r"))
    m = iv.merge_intervals(r.select("doc_id", "start", "f", F.col("r.start").alias("s"), F.col("r.end").alias("e")), ["doc_id", "start", "f"], "s", "e")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("s", F.substring("f", F.col("s") + 1, F.col("e") - F.col("s")).alias("t")))), lambda x: x["t"])
    return m.groupBy("doc_id", "start").agg(F.array_join(parts, " | ").alias("regions")).withColumn("start", F.col("start").cast("bigint"))


@query("fn_6_mask", f"""
WITH {NEG_SQL} SELECT doc_id, start, regexp_replace(regexp_replace(f, '{NEG_RX}(?:[^,:;()!?.]|\\.(?:[^\\s]|$))*', ' ', 'g'), '\\s+', ' ', 'g') AS kept, length(f) AS chars FROM n WHERE len(regions) > 0""")
def fn_6(spark, sf):
    r = negated_sentences(spark, sf).filter(F.size("regions") > 0).withColumn("m", tx.mask(F.col("f"), F.col("regions")))
    return r.select("doc_id", F.col("start").cast("bigint").alias("start"), F.regexp_replace("m", "\\s+", " ").alias("kept"), F.length("m").cast("bigint").alias("chars"))


@query("join_9_mentions_in_regions", f"""
WITH {NEG_SQL}, t AS (SELECT doc_id, start, regions, list_filter(string_split_regex(array_to_string(regions, ' | '), '[^a-z0-9+#]+'), lambda x: x IN ('pas', 'de', 'not', 'was', 'is', 'the')) AS w FROM n WHERE len(regions) > 0)
SELECT doc_id, start, len(w) AS inside FROM t WHERE len(w) > 0""")
def join_9(spark, sf):
    # mentions and regions both read these sentences: they are cut once
    s = durable(negated_sentences(spark, sf).filter(F.size("regions") > 0).select("doc_id", "start", "sentence", "regions"))
    keys = ["doc_id", "start"]
    hits = mn.raw_mentions(s.select("doc_id", F.col("start").alias("sent"), "sentence"), parameter_table(spark, [lx._skill(w, [w]) for w in ("pas", "de", "not", "was", "is", "the")], mn.LEXICON_SCHEMA), ("doc_id", "sent"), "sentence")
    r = s.select("doc_id", F.col("start").alias("sent"), F.explode("regions").alias("r")).select("doc_id", "sent", F.col("r.start").alias("rs"), F.col("r.end").alias("re"))
    pairs = iv.overlap_join(hits, r, ["doc_id", "sent"], "start", "end", "rs", "re")
    inside = pairs.groupBy("doc_id", "sent", F.col("start").alias("at"), "skill_key").agg(F.count("*").alias("n"))
    return inside.groupBy("doc_id", F.col("sent").cast("bigint").alias("start")).agg(F.count("*").alias("inside")).select(*keys, "inside")


# Items of a criterion derived from order lines.
T_ORD = 2026 * 12 + 9
ITEMS_SQL = f"""
it AS (SELECT l_orderkey AS doc_id, l_linenumber % 4 AS exp_idx, l_partkey || '_' || l_linenumber AS item_id, l_suppkey % 4 = 0 AS negated, CASE WHEN l_returnflag = 'R' THEN 'env_list' ELSE 'experience' END AS location,
 CASE WHEN l_returnflag = 'R' THEN 2 ELSE 2 + l_partkey % 3 END AS lo, CASE WHEN l_suppkey % 11 = 0 THEN 'participant' ELSE 'neutral' END AS role, CASE WHEN l_linestatus = 'O' THEN 'strong' ELSE 'weak' END AS action,
 l_partkey % 5 = 0 AS scoped, CAST(l_quantity AS INT) AS months, l_discount > 0.05 AS workish, year(l_shipdate) * 12 + month(l_shipdate) + l_partkey % 300 AS end_ord,
 ['a' || (l_partkey % 3), 'a' || (l_suppkey % 2)] AS clues, l_partkey % 20 AS version, 1 + l_orderkey % 5 AS rarity, l_orderkey % 3 = 0 AS advanced, 10 + l_orderkey % 5 AS need_version, l_orderkey % 2 = 0 AS vol FROM lineitem),
ex AS (SELECT doc_id, exp_idx, bool_or(NOT negated) AS seen, max(lo) FILTER (NOT negated AND location = 'experience') AS pl, max(lo) FILTER (NOT negated) AS al, coalesce(bool_or(location = 'env_list') FILTER (NOT negated), FALSE) AS env,
 max(months) AS months, bool_or(workish) AS workish, max(end_ord) AS end_ord FROM it GROUP BY ALL),
bb AS (SELECT doc_id, exp_idx, lo, location, action, role, scoped, months FROM it WHERE NOT negated QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lo DESC, end_ord DESC, item_id DESC) = 1),
bx AS (SELECT bb.*, e.env FROM bb JOIN ex e ON e.doc_id = bb.doc_id AND e.exp_idx = bb.exp_idx),
dd AS (SELECT it.doc_id, max(rarity) AS rarity, bool_or(advanced) AS advanced, max(need_version) AS nv, bool_or(vol) AS vol, count(*) AS items, count(*) FILTER (NOT negated) AS seen, coalesce(bool_or(role = 'participant') FILTER (NOT negated), FALSE) AS part,
 len(list_distinct(flatten(coalesce(list(clues) FILTER (NOT negated AND location = 'experience'), [])))) AS nc, max(version) AS version FROM it GROUP BY it.doc_id),
de AS (SELECT doc_id, count(*) FILTER (pl >= 3) AS pr, count(*) FILTER (seen AND months > 0 AND workish) AS su, max(end_ord) FILTER (al >= 3 OR pl >= 3) AS lp, max(end_ord) FILTER (al >= 2 OR pl >= 3) AS la, max(end_ord) FILTER (seen AND months > 0 AND workish) AS ls FROM ex GROUP BY doc_id),
l0 AS (SELECT dd.*, de.* EXCLUDE (doc_id), coalesce(bx.lo, 1) AS b, bx.location, bx.action, bx.role, bx.scoped, bx.months AS bm, bx.env FROM dd JOIN de USING (doc_id) LEFT JOIN bx USING (doc_id)),
l1 AS (SELECT *, rarity <= 3 AND pr >= 2 AND b = 3 AND NOT part AS repeated, CASE WHEN rarity <= 3 AND pr >= 2 AND b = 3 AND NOT part THEN 4 ELSE b END AS v1 FROM l0),
l2 AS (SELECT *, CASE WHEN rarity <= 2 AND NOT part AND seen > 0 AND su >= 2 AND v1 < 4 THEN 4 WHEN rarity <= 2 AND NOT part AND seen > 0 AND su = 1 AND v1 = 2 THEN 3 END AS commodity FROM l1),
l3 AS (SELECT *, coalesce(commodity, v1) AS v2 FROM l2),
l4 AS (SELECT *, coalesce(rarity <= 3 AND location = 'experience' AND v2 = 3 AND action = 'strong' AND role <> 'participant' AND NOT scoped AND bm >= 24 AND env AND NOT advanced, FALSE) AS corroborated FROM l3),
l5 AS (SELECT *, CASE WHEN corroborated THEN 4 ELSE v2 END AS v3 FROM l4),
l6 AS (SELECT *, advanced AND nc < 2 AND v3 > 3 AS depth_capped, CASE WHEN advanced AND nc < 2 AND v3 > 3 THEN 3 ELSE v3 END AS v4 FROM l5),
l7 AS (SELECT *, version < nv AND v4 > 3 AS version_capped, CASE WHEN version < nv AND v4 > 3 THEN 3 ELSE v4 END AS v5 FROM l6),
l8 AS (SELECT *, greatest(CASE WHEN v5 >= 3 THEN lp ELSE la END, CASE WHEN commodity IS NOT NULL THEN ls END) AS last_used FROM l7),
fin AS (SELECT *, coalesce(vol AND {T_ORD} - last_used > 84 AND v5 >= 3, FALSE) AS downgraded, v5 - coalesce(vol AND {T_ORD} - last_used > 84 AND v5 >= 3, FALSE)::INT AS level_ord FROM l8)"""


def line_items(spark, sf):
    l = table(spark, sf, "lineitem")
    m = lambda c, n: F.pmod(c, F.lit(n))
    env = F.col("l_returnflag") == "R"
    return l.select(
        F.col("l_orderkey").alias("doc_id"), m("l_linenumber", 4).alias("exp_idx"), F.concat("l_partkey", F.lit("_"), "l_linenumber").alias("item_id"), (m("l_suppkey", 4) == 0).alias("negated"),
        F.when(env, "env_list").otherwise("experience").alias("location"), F.when(env, 2).otherwise(2 + m("l_partkey", 3)).alias("level_ord"),
        F.when(m("l_suppkey", 11) == 0, "participant").otherwise("neutral").alias("role"), F.when(F.col("l_linestatus") == "O", "strong").otherwise("weak").alias("action"),
        (m("l_partkey", 5) == 0).alias("scoped"), F.col("l_quantity").cast("int").alias("months"), (F.col("l_discount") > 0.05).alias("workish"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate") + m("l_partkey", 300)).alias("end_ord"),
        F.array(F.concat(F.lit("a"), m("l_partkey", 3)), F.concat(F.lit("a"), m("l_suppkey", 2))).alias("clues"), F.array(m("l_partkey", 20)).alias("versions"),
        (1 + m("l_orderkey", 5)).alias("rarity"), (m("l_orderkey", 3) == 0).alias("advanced"), (10 + m("l_orderkey", 5)).alias("need_version"), (m("l_orderkey", 2) == 0).alias("volatile"),
    )


def decided(spark, sf):
    return ev.document_levels(line_items(spark, sf), ["doc_id"], T_ORD)


def register_rule(name: str, column: str, sql_column: str | None = None):
    @query(name, f"WITH {ITEMS_SQL} SELECT doc_id, b::BIGINT AS best_level, {sql_column or column} AS {column} FROM fin")
    def rule(spark, sf):
        d = decided(spark, sf)
        value = F.col(column).cast("bigint") if column in ("commodity", "last_used") else F.col(column)
        return d.select("doc_id", F.col("best_level").cast("bigint").alias("best_level"), value.alias(column))

    return rule


register_rule("agg_16_repeated_practice", "repeated")
register_rule("agg_17_commodity_upgrade", "commodity")
register_rule("agg_18_corroboration", "corroborated")
register_rule("agg_19_advanced_depth_cap", "depth_capped")
register_rule("agg_20_version_cap", "version_capped")


@query("agg_36_declared_absence", f"WITH {ITEMS_SQL} SELECT doc_id, seen = 0 AS declared_absence, level_ord::BIGINT AS level_ord FROM fin")
def agg_36(spark, sf):
    return decided(spark, sf).select("doc_id", "declared_absence", F.col("level_ord").cast("bigint").alias("level_ord"))


@query("fn_10_recency", f"WITH {ITEMS_SQL} SELECT doc_id, last_used::BIGINT AS last_used, downgraded, level_ord::BIGINT AS level_ord FROM fin")
def fn_10(spark, sf):
    return decided(spark, sf).select("doc_id", F.col("last_used").cast("bigint").alias("last_used"), "downgraded", F.col("level_ord").cast("bigint").alias("level_ord"))


@query("agg_20_versions_cited", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size % 17 + 1 || ',' || (p_size % 9 + 2) WHEN 1 THEN '' ELSE (p_size % 17 + 1)::VARCHAR END AS versions FROM part""")
def agg_20b(spark, sf):
    p = table(spark, sf, "part")
    a, b = (F.pmod("p_size", F.lit(17)) + 1).cast("string"), (F.pmod("p_size", F.lit(9)) + 2).cast("string")
    k = F.pmod("p_partkey", F.lit(3))
    line = F.when(k == 0, F.concat(F.lit("java "), a, F.lit(" → "), b)).when(k == 1, F.concat(F.lit("java "), a, F.lit(" ans de pratique"))).otherwise(F.concat(F.lit("java v"), a, F.lit(".2 en production")))
    return p.select("p_partkey", F.array_join(F.transform(ev.versions_after(line, F.lit(4)), lambda v: v.cast("string")), ",").alias("versions"))


VOLUMES = [("{a} 000 messages par seconde", 1000.0 * 86400), ("{a},500 events per minute", None), ("{a} k requetes par heure", 1000.0 * 24), ("{a} millions de transactions par an", 1e6 / 365), ("{a}0000 messages", None), ("{a} tps", 86400.0)]
VOL_SQL = """CASE l_partkey % 6 WHEN 0 THEN a * 1000.0::DOUBLE * 86400 WHEN 1 THEN (a * 1000 + 500)::DOUBLE * 1440 WHEN 2 THEN a::DOUBLE * 1000 * 24 WHEN 3 THEN a::DOUBLE * 1000000 * (1.0::DOUBLE / 365) WHEN 5 THEN a::DOUBLE * 86400 END"""


def volume_lines(spark, sf):
    l = spread(table(spark, sf, "lineitem"), "l_orderkey").withColumn("a", F.col("l_quantity").cast("int"))
    pick = F.element_at(F.array(*[F.lit(v[0]) for v in VOLUMES]), (F.pmod("l_partkey", F.lit(6)) + 1).cast("int"))
    return l.withColumn("figure", F.replace(pick, F.lit("{a}"), F.col("a").cast("string"))).withColumn("row_id", F.concat_ws("_", "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey"))


@query("fn_25_volume_per_day", f"""
SELECT l_orderkey || '_' || l_partkey || '_' || l_linenumber || '_' || l_suppkey AS row_id, CAST(floor({VOL_SQL} + 0.001) AS BIGINT) AS per_day FROM (SELECT *, CAST(l_quantity AS INT) AS a FROM lineitem)""")
def fn_25(spark, sf):
    v = sp.volume_per_day(F.concat(F.lit("Mise en place : "), "figure", F.lit(".")))
    return volume_lines(spark, sf).select("row_id", F.floor(v + 0.001).cast("bigint").alias("per_day"))


@query("fn_24_numbers", """SELECT p_partkey, (p_partkey * 1000 + p_size)::DOUBLE AS grouped, p_size + 0.25::DOUBLE AS decimal_comma FROM part""")
def fn_24(spark, sf):
    p = table(spark, sf, "part")
    n = (F.col("p_partkey") * 1000 + F.col("p_size")).cast("string")
    spaced = F.regexp_replace(n, "(?<=\\d)(?=(?:\\d{3})+$)", " ")
    return p.select("p_partkey", sp.parse_number(spaced).alias("grouped"), sp.parse_number(F.concat(F.col("p_size").cast("string"), F.lit(",25"))).alias("decimal_comma"))


@query("agg_21_max_volume", f"""
WITH v AS (SELECT l_orderkey, {VOL_SQL} AS v FROM (SELECT *, CAST(l_quantity AS INT) AS a FROM lineitem))
SELECT l_orderkey AS doc_id, CASE WHEN max(v) >= 100000 THEN 4 WHEN max(v) >= 10000 THEN 3 WHEN max(v) IS NOT NULL THEN 2 ELSE 1 END::BIGINT AS level_ord FROM v GROUP BY 1""")
def agg_21(spark, sf):
    v = volume_lines(spark, sf).withColumn("v", sp.volume_per_day(F.col("figure")))
    return v.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.coalesce(sp.volume_level(F.max("v")), F.lit(1)).cast("bigint").alias("level_ord"))


@query("join_22_volume_scope", f"""
WITH v AS (SELECT l_orderkey || '_' || l_partkey || '_' || l_linenumber || '_' || l_suppkey AS row_id, l_suppkey % 2 = 0 AS ins, max({VOL_SQL}) AS v FROM (SELECT *, CAST(l_quantity AS INT) AS a FROM lineitem) GROUP BY ALL)
SELECT row_id, CASE WHEN NOT ins THEN 1 WHEN v >= 100000 THEN 4 WHEN v >= 10000 THEN 3 ELSE 2 END::BIGINT AS level_ord, NOT ins AS elsewhere FROM v WHERE v IS NOT NULL""")
def join_22(spark, sf):
    l = volume_lines(spark, sf)
    item = F.when(F.pmod("l_suppkey", F.lit(2)) == 0, F.concat(F.lit("Flux Kafka de "), "figure", F.lit(" dans un SI bancaire"))).otherwise(F.concat(F.lit("Flux Kafka vers un SI qui traite "), "figure"))
    v = ev.volume_levels(l.withColumn("item", item), ["row_id"], "item", ["Kafka"])
    return v.select("row_id", F.col("level_ord").cast("bigint").alias("level_ord"), F.col("elsewhere").isNotNull().alias("elsewhere"))
