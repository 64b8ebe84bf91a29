"""Need texts derived from parts (one per part), and external needs derived from orders and customers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from proofgrid.functions import levels as lv
from proofgrid.operators import needs as nd
from proofgrid.operators.mentions import LEXICON_SCHEMA, best_role
from proofgrid.operators.scale import by_shuffle, parameter_table
from proofgrid.plans import lexicon as lx
from proofgrid.plans.base import query, spread, table
from proofgrid.sources import needs_source as ns
from proofgrid.sources import warehouse as wh

SKILLS = ["Java", "Kafka", "Python", "Docker", "Terraform"]
NEED_SQL = f"""
nt AS (SELECT p_partkey AS n, p_name, p_brand, ({SKILLS!r})[p_partkey % 5 + 1] AS s1, ({SKILLS!r})[(p_partkey + 1) % 5 + 1] AS s2, ({SKILLS!r})[(p_partkey + 2) % 5 + 1] AS s3 FROM part)"""


def need_lexicon(spark):
    rows = [lx._skill(s.lower(), [s], advanced=["tuning", "scale"]) for s in SKILLS] + [lx._skill("supervision", ["supervision"], kind="activity", advanced=["tuning"])]
    return parameter_table(spark, rows, LEXICON_SCHEMA)


def need_texts(spark, sf):
    p = spread(table(spark, sf, "part"), "p_partkey")
    k = lambda n: F.pmod("p_partkey", F.lit(n)).cast("int")
    skill = lambda i: F.get(F.array(*[F.lit(s) for s in SKILLS]), F.pmod(F.col("p_partkey") + i, F.lit(5)).cast("int"))
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    text = F.concat_ws(
        "\n", F.lit("Contexte :"), cat("Projet de refonte ", F.col("p_name"), " dans le cadre du programme ", F.col("p_brand"), "."), F.lit("Vos missions :"),
        F.when(k(2) == 0, "- Conduite de la supervision des services de production du groupe.").otherwise("- Suivi quotidien de la production avec les équipes du groupe."),
        F.lit("Compétences requises :"), cat("- La pratique avancée de ", skill(0), " en production est demandée ici."),
        cat("- La connaissance de ", skill(1), " dans un contexte industriel de grande taille."),
        F.when(k(4) == 0, "- Au moins deux de ces technologies sont attendues par le client."), F.lit("Souhaité :"), cat("- Une première expérience de ", skill(2), " serait un plus pour cette équipe."),
        F.when(k(5) == 0, cat("- Pas de nécessité de maîtriser ", skill(0), " au démarrage de la mission.")), F.lit("Modalités :"),
        cat(1 + k(3), " jours sur site à Lyon, ", 1 + k(2), " jours de télétravail."), cat("TJM max ", 400 + k(400), " €. Durée : ", 3 + k(9), " mois. Démarrage : ASAP."),
        F.when(k(3) == 0, "Anglais courant demandé pour les réunions du projet."), cat(2 + k(9), " ans d'expérience minimum sur ce type de poste."),
    )
    return p.select(F.col("p_partkey").alias("mission_id"), F.col("p_name").alias("title"), text.alias("text"))


def need_mentions(spark, sf):
    return nd.requirement_mentions(nd.blocks(need_texts(spark, sf)), need_lexicon(spark))


@query("fn_15_need_sections", """
SELECT p_partkey AS mission_id, v.section, (CASE v.section WHEN 'mandatory' THEN 2 + (p_partkey % 4 = 0)::INT WHEN 'desired' THEN 1 + (p_partkey % 5 = 0)::INT WHEN 'modalities' THEN 5 + (p_partkey % 3 = 0)::INT ELSE 1 END)::BIGINT AS sentences
FROM part, (VALUES ('context'), ('tasks'), ('mandatory'), ('desired'), ('modalities')) AS v(section)""")
def fn_15_need(spark, sf):
    return nd.blocks(need_texts(spark, sf)).groupBy("mission_id", "section").agg(F.count("*").alias("sentences"))


@query("fn_17_requirement_category", f"""
WITH {NEED_SQL} SELECT n AS mission_id, lower(s1) AS skill_key, CASE WHEN n % 4 = 0 THEN 'fortement_differenciant' ELSE 'imperatif' END AS category FROM nt
UNION ALL SELECT n, lower(s2), CASE WHEN n % 4 = 0 THEN 'fortement_differenciant' ELSE 'imperatif' END FROM nt UNION ALL SELECT n, lower(s3), 'souhaitable' FROM nt
UNION ALL SELECT n, lower(s1), 'contextuel' FROM nt WHERE n % 5 = 0 UNION ALL SELECT n, 'supervision', 'fortement_differenciant' FROM nt WHERE n % 2 = 0""")
def fn_17(spark, sf):
    return need_mentions(spark, sf).select("mission_id", "skill_key", "category")


@query("agg_22_strongest_requirement", f"""
WITH {NEED_SQL} SELECT n AS mission_id, lower(s1) AS skill_key, CASE WHEN n % 5 = 0 THEN 'a_clarifier' WHEN n % 4 = 0 THEN 'fortement_differenciant' ELSE 'imperatif' END AS category, 'advanced' AS depth FROM nt
UNION ALL SELECT n, lower(s2), CASE WHEN n % 4 = 0 THEN 'fortement_differenciant' ELSE 'imperatif' END, 'practice' FROM nt UNION ALL SELECT n, lower(s3), 'souhaitable', 'practice' FROM nt
UNION ALL SELECT n, 'supervision', 'fortement_differenciant', 'practice' FROM nt WHERE n % 2 = 0""")
def agg_22(spark, sf):
    return nd.strongest_requirements(need_mentions(spark, sf)).select("mission_id", "skill_key", "category", "depth")


@query("agg_23_activity_counts", "SELECT p_partkey AS mission_id, 'supervision' AS skill_key, 1 AS mentions, TRUE AS in_tasks FROM part WHERE p_partkey % 2 = 0")
def agg_23(spark, sf):
    return nd.activities(need_mentions(spark, sf))


@query("agg_24_internal_contradiction", f"WITH {NEED_SQL} SELECT n AS mission_id, lower(s1) AS skill_key FROM nt WHERE n % 5 = 0")
def agg_24(spark, sf):
    return nd.strongest_requirements(need_mentions(spark, sf)).filter("ambiguous").select("mission_id", "skill_key")


@query("fn_18_modalities", """
SELECT p_partkey AS mission_id, 1 + p_partkey % 3 AS onsite, 1 + p_partkey % 2 AS remote, 'Lyon' AS city, (3 + p_partkey % 9) || ' mois' AS duration, 'ASAP' AS start, 400 + p_partkey % 400 AS tjm,
 CASE WHEN p_partkey % 3 = 0 THEN 'courant' END AS english FROM part""")
def fn_18(spark, sf):
    m = need_texts(spark, sf).select("mission_id", nd.modalities(F.col("text")).alias("m"))
    return m.select(
        "mission_id", F.col("m.onsite_days_per_week").alias("onsite"), F.col("m.remote_days_per_week").alias("remote"), "m.city", "m.duration", "m.start", F.col("m.tjm_max").alias("tjm"), "m.english"
    )


@query("agg_32_missing_information", "SELECT p_partkey AS mission_id, CASE WHEN p_partkey % 3 = 0 THEN 'astreinte' ELSE 'astreinte,english' END AS missing FROM part")
def agg_32(spark, sf):
    m = need_texts(spark, sf).select("mission_id", nd.modalities(F.col("text")).alias("m"))
    return m.select("mission_id", F.array_join(nd.missing_fields(F.col("m")), ",").alias("missing"))


@query("fn_19_seniority", "SELECT p_partkey AS mission_id, 2 + p_partkey % 9 AS years, 'a_clarifier' AS category FROM part")
def fn_19(spark, sf):
    return nd.seniority(nd.blocks(need_texts(spark, sf)))


@query("fn_20_k_among_n", f"WITH {NEED_SQL} SELECT n AS mission_id, 2 AS at_least, 'imperatif' AS category, array_to_string(list_sort([lower(s1), lower(s2)]), ',') AS members FROM nt WHERE n % 4 = 0")
def fn_20(spark, sf):
    b = nd.blocks(need_texts(spark, sf))
    members = nd.requirement_mentions(b, need_lexicon(spark)).filter("member").groupBy("mission_id").agg(F.array_join(F.array_sort(F.collect_set("skill_key")), ",").alias("members"))
    g = nd.group_lines(b).select("mission_id", "at_least", F.col("group_category").alias("category"))
    return g.join(by_shuffle(members), "mission_id")


@query("join_26_title_mismatch", f"""
WITH w AS (SELECT role_key, unnest(list_concat(titles, triggers)) AS term, ord FROM {lx.values_sql(lx.ROLES, 'role_key, label, titles, wide_titles, discriminants, triggers, ord')}),
m AS (SELECT p_partkey, role_key, length(term) AS n, ord FROM part JOIN w ON regexp_matches(p_name, '(^|[^a-z0-9+#])' || term || '[sx]?($|[^a-z0-9+#])'))
SELECT p_partkey AS mission_id, role_key, 'supervision' AS skill_key FROM m WHERE p_partkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, ord) = 1""")
def join_26(spark, sf):
    roles = lx.role_families(spark)
    families = best_role(need_texts(spark, sf), roles, "mission_id", "title")
    return nd.title_mismatch(nd.activities(need_mentions(spark, sf)), families, roles)


@query("top_11_leading_lines", """
SELECT p_partkey AS mission_id, 'context' AS part, 1 AS rn, 'Projet de refonte ' || p_name || ' dans le cadre du programme ' || p_brand || '.' AS sent FROM part
UNION ALL SELECT p_partkey, 'objective', 1, CASE WHEN p_partkey % 2 = 0 THEN 'Conduite de la supervision des services de production du groupe.' ELSE 'Suivi quotidien de la production avec les équipes du groupe.' END FROM part
UNION ALL SELECT p_partkey, 'objective', 2, 'Pas de nécessité de maîtriser ' || (['Java', 'Kafka', 'Python', 'Docker', 'Terraform'])[p_partkey % 5 + 1] || ' au démarrage de la mission.' FROM part WHERE p_partkey % 5 = 0""")
def top_11(spark, sf):
    return nd.leading_lines(nd.blocks(need_texts(spark, sf)))


@query("fn_36_candidate_description", """
SELECT p_partkey AS mission_id, p_name || chr(10) || '- localisation : Lyon' || chr(10) || '- presence : ' || (1 + p_partkey % 3) || ' jour(s) par semaine sur site' || chr(10) || '- teletravail : ' || (1 + p_partkey % 2) || ' jour(s) par semaine' || chr(10)
 || '- duree : ' || (3 + p_partkey % 9) || ' mois' || chr(10) || '- demarrage : ASAP' || chr(10) || '- astreintes : Non communiqué' || chr(10) || '- tjm : ' || (400 + p_partkey % 400) || ' € (maximum communiqué)' || chr(10)
 || '- langues : ' || CASE WHEN p_partkey % 3 = 0 THEN 'courant' ELSE 'Non communiqué' END AS body FROM part""")
def fn_36(spark, sf):
    m = need_texts(spark, sf).select("mission_id", "title", nd.modalities(F.col("text")).alias("m"))
    return m.select("mission_id", nd.description(F.col("m"), F.col("title")).alias("body"))


@query("fn_42_fill_only_merge", """
SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, CASE WHEN p_size % 3 = 0 THEN p_type END) AS city, CASE WHEN p_size % 5 = 0 THEN p_name END AS duration FROM part""")
def fn_42(spark, sf):
    some = lambda cond, k, v: F.struct(F.when(cond, F.lit(k)).alias("k"), F.col(v).alias("v"))
    made = lambda *pairs: F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["k"].isNotNull()))
    p = table(spark, sf, "part")
    old = made(some(F.pmod("p_size", F.lit(2)) == 0, "city", "p_brand"))
    new = made(some(F.pmod("p_size", F.lit(3)) == 0, "city", "p_type"), some(F.pmod("p_size", F.lit(5)) == 0, "duration", "p_name"))
    m = p.select("p_partkey", nd.fill_only(old, new).alias("m"))
    return m.select("p_partkey", F.try_element_at("m", F.lit("city")).alias("city"), F.try_element_at("m", F.lit("duration")).alias("duration"))


RESOLVE_SQL = """
rq AS (SELECT l_orderkey AS mission_id, 'k' || (l_partkey % 3) AS key, l_linenumber || '_' || l_partkey AS req_id, 1 + l_suppkey % 5 AS rank, CAST(l_shipdate AS DATE) AS d, (['eliminatoire_confirme', 'imperatif', 'souhaitable'])[l_partkey % 2 + l_suppkey % 2 + 1] AS category,
 (l_linenumber - 1) AS sup, l_tax > 0.05 AS has_sup, l_linenumber AS n FROM lineitem),
ov AS (SELECT DISTINCT mission_id, sup FROM rq WHERE rank <= 2 AND has_sup),
rs AS (SELECT rq.* FROM rq WHERE NOT EXISTS (SELECT 1 FROM ov WHERE ov.mission_id = rq.mission_id AND ov.sup = rq.n)),
kp AS (SELECT * FROM rs QUALIFY row_number() OVER (PARTITION BY mission_id, key ORDER BY rank, d DESC, n::VARCHAR, req_id) = 1)"""


def line_sources(spark, sf):
    l = table(spark, sf, "lineitem")
    n = F.col("l_linenumber").cast("string")
    cats = F.array(F.lit(lv.ELIMINATORY), F.lit(lv.IMPERATIVE), F.lit(lv.DESIRED))
    return l.select(
        F.col("l_orderkey").alias("mission_id"), F.concat(F.lit("k"), F.pmod("l_partkey", F.lit(3))).alias("key"), n.alias("req_id"),
        (1 + F.pmod("l_suppkey", F.lit(5))).alias("rank"), F.col("l_shipdate").cast("date").alias("source_date"), F.get(cats, (F.pmod("l_partkey", F.lit(2)) + F.pmod("l_suppkey", F.lit(2))).cast("int")).alias("category"),
        F.when(F.col("l_tax") > 0.05, (F.col("l_linenumber") - 1).cast("string")).alias("supersedes"), F.lit("active").alias("status"), F.concat_ws("_", "l_linenumber", "l_partkey").alias("line"),
    )


@query("join_13_explicit_supersession", f"WITH {RESOLVE_SQL} SELECT mission_id, key, count(*) AS live FROM rs GROUP BY ALL")
def join_13(spark, sf):
    return nd.not_superseded(line_sources(spark, sf)).groupBy("mission_id", "key").agg(F.count("*").alias("live"))


@query("agg_25_conflict_report", f"""
WITH {RESOLVE_SQL}, o AS (SELECT kp.mission_id, kp.key, min(kp.rank) AS rank, bool_or(rs.d > kp.d) FILTER (rs.category <> kp.category) AS review, count(*) FILTER (rs.category <> kp.category) AS div FROM kp JOIN rs ON rs.mission_id = kp.mission_id AND rs.key = kp.key GROUP BY kp.mission_id, kp.key)
SELECT mission_id, key, review AS needs_review FROM o WHERE div > 0""")
def agg_25(spark, sf):
    _, conflicts = nd.resolve(line_sources(spark, sf), ties=["line"])
    return conflicts.select("mission_id", "key", "needs_review")


@query("prj_5_compose_brief", """
SELECT p_partkey, concat_ws(chr(10) || chr(10), p_name, nullif(concat_ws(chr(10), CASE WHEN p_size % 3 > 0 THEN 'Lieu : ' || p_type END, CASE WHEN p_size % 4 = 0 THEN 'Démarrage : ' || p_size || '/2026' END), ''),
 CASE WHEN p_size % 5 > 0 THEN 'Description du besoin' || chr(10) || p_brand || ' pour ' || p_name END, CASE WHEN p_size % 2 = 0 THEN 'Profil recherché' || chr(10) || p_type END) AS brief FROM part""")
def prj_5(spark, sf):
    p = table(spark, sf, "part")
    m = lambda n: F.pmod("p_size", F.lit(n))
    opt = lambda cond, c: F.when(cond, c).otherwise(F.lit(""))
    brief = ns.compose_brief(
        F.col("p_name"), opt(m(3) > 0, F.col("p_type")), opt(m(4) == 0, F.concat(F.col("p_size").cast("string"), F.lit("/2026"))), F.lit(""),
        opt(m(5) > 0, F.concat_ws(" pour ", "p_brand", "p_name")), opt(m(2) == 0, F.col("p_type")),
    )
    return p.select("p_partkey", brief.alias("brief"))


@query("flt_12_usable_text", """SELECT page_id, length(trim(substring(url, 1, 30) || ' ' || substring(url, 31, 9))) >= 40 AS usable FROM pages""")
def flt_12(spark, sf):
    return table(spark, sf, "pages").select("page_id", ns.usable_text(F.substring("url", 1, 30), F.substring("url", 31, 9)).alias("usable"))


@query("src_5_json_snapshot", """
SELECT c_custkey, CASE WHEN c_custkey % 50 = 7 THEN 'unreadable' WHEN c_custkey % 50 = 1 THEN 'unknown_field' WHEN c_custkey % 50 = 2 THEN 'missing_id' WHEN c_custkey % 50 IN (3, 4) THEN 'repeated_id' END AS problem FROM customer""")
def src_5(spark, sf):
    c = table(spark, sf, "customer")
    k = F.pmod("c_custkey", F.lit(50))
    ident = F.when(k == 2, F.lit("")).when(k == 4, (F.col("c_custkey") - 1).cast("string")).otherwise(F.col("c_custkey").cast("string"))
    good = F.to_json(F.struct(ident.alias("external_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("company")))
    json = F.when(k == 7, F.lit("{broken")).when(k == 1, F.to_json(F.struct(ident.alias("external_id"), F.col("c_name").alias("phone")))).otherwise(good)
    return ns.validate_json(c.select("c_custkey", json.alias("json"))).select("c_custkey", "problem")


NEEDS = wh.AllowList({"external_id": "o_orderkey", "reference": "o_orderpriority", "state": "o_orderstatus", "since": "o_orderdate"}, ("state", "since"))
OPEN_NEEDS = wh.AllowList(
    {"external_id": "o_orderkey", "reference": "o_orderpriority", "state": "o_orderstatus", "budget": "o_totalprice", "owner": "o_custkey"}, ("state", "budget"), (("owner", "<=", 900),)
)


@query("src_6_warehouse_read", """
SELECT o_orderkey AS external_id, o_orderpriority AS reference, o_orderstatus AS state FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus = 'P'""")
def src_6(spark, sf):
    where = [("since", ">=", datetime(1998, 1, 1)), ("state", "=", "P")]
    return wh.read(table(spark, sf, "orders"), NEEDS, ["external_id", "reference", "state"], where)


@query("src_6_allowed_needs", """
SELECT o_orderkey AS external_id, o_orderpriority AS reference, o_totalprice AS budget FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey <= 900 AND o_totalprice > 150000""")
def src_6b(spark, sf):
    where = [("state", "in", ["F", "O"]), ("budget", ">", 150_000)]
    return wh.read(table(spark, sf, "orders"), OPEN_NEEDS, ["external_id", "reference", "budget"], where)


@query("src_5_schema_tag", """
SELECT n_nationkey AS snapshot, CASE WHEN n_nationkey % 5 = 0 THEN 'wrong_schema' WHEN n_nationkey % 5 = 1 THEN 'unreadable' END AS problem,
 CASE WHEN n_nationkey % 5 > 1 THEN count(c_custkey) ELSE 0 END AS needs FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def src_5b(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.struct(F.col("c_custkey").cast("string").alias("external_id"), F.col("c_name").alias("title")).alias("need"))
    per = table(spark, sf, "nation").select("n_nationkey").join(c, "n_nationkey", "left").groupBy("n_nationkey").agg(F.collect_list("need").alias("needs"))
    k = F.pmod("n_nationkey", F.lit(5))
    tag = F.when(k == 0, "other/1").otherwise(ns.SNAPSHOT_SCHEMA)
    whole = F.when(k == 1, F.lit('{"schema": ')).otherwise(F.to_json(F.struct(tag.alias("schema"), "needs")))
    checked = ns.tagged_snapshots(per.select("n_nationkey", whole.alias("json")), "json")
    return checked.select(F.col("n_nationkey").cast("int").alias("snapshot"), "problem", F.size("needs").cast("bigint").alias("needs"))


@query("join_17_needs_with_labels", """
SELECT o_orderkey AS need_id, coalesce(c_name, '') AS company, coalesce(n_name, '') AS state FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 7 > 0 LEFT JOIN nation ON n_nationkey = o_orderkey % 30""")
def join_17(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("need_id"), F.col("o_custkey").alias("company_id"), F.pmod("o_orderkey", F.lit(30)).alias("state_id"))
    c = table(spark, sf, "customer").filter("c_custkey % 7 > 0").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("state_id"), F.col("n_name").alias("state"))
    return ns.listing(o, n, c).select("need_id", "company", "state")


@query("join_18_imported_marker", """SELECT o_orderkey AS external_id, CASE WHEN o_orderkey % 3 = 0 THEN 'M' || o_orderkey END AS mission_id FROM orders""")
def join_18(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("external_id"))
    imported = o.filter("external_id % 3 = 0").withColumn("mission_id", F.concat(F.lit("M"), "external_id"))
    return ns.mark_imported(o, imported, ["owner", "external_id"]).select("external_id", "mission_id")


@query("join_19_idempotent_import", """
SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'created' WHEN o_orderkey % 4 = 0 THEN 'updated' ELSE 'unchanged' END AS status, count(*) AS needs, min(sha256(o_orderkey || o_orderpriority)) AS first_hash FROM orders GROUP BY 1""")
def join_19(spark, sf):
    o = table(spark, sf, "orders").select(F.lit("file").alias("source"), F.col("o_orderkey").alias("external_id"), F.sha2(F.concat("o_orderkey", "o_orderpriority"), 256).alias("content_hash"))
    stored = o.filter("external_id % 5 <> 0").withColumn("content_hash", F.when(F.pmod("external_id", F.lit(4)) == 0, F.lit("old")).otherwise(F.col("content_hash")))
    s = ns.import_status(o, stored, ["source", "external_id"])
    return s.groupBy("status").agg(F.count("*").alias("needs"), F.min("content_hash").alias("first_hash"))


@query("top_6_newest_page", """
SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority || ' ' || o_orderstatus), 'high') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 20""")
def top_6(spark, sf):
    return ns.page(table(spark, sf, "orders"), "High", 80, 20, fields=["o_orderpriority", "o_orderstatus"], newest="o_orderdate", key="o_orderkey").select("o_orderkey")


@query("udf_5_other_source", """
SELECT c_mktsegment AS company, count(*) AS needs, count(*) FILTER (length(trim(c_name || ' ' || c_mktsegment)) >= 28) AS usable FROM customer GROUP BY 1""")
def udf_5(spark, sf):
    # any frame with the columns of a need is a source
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("company"), F.col("c_name").alias("description"), F.concat(F.lit("critère 1234"), "c_mktsegment").alias("criteria"))
    return c.groupBy("company").agg(F.count("*").alias("needs"), F.count_if(ns.usable_text(F.col("description"), F.col("criteria"))).alias("usable"))
