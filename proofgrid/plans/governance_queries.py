"""Governance over events, labels, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.functions import levels as lv
from proofgrid.functions import text as tx
from proofgrid.functions.hashing import text_key
from proofgrid.operators import governance as gv
from proofgrid.operators import scoring as sc
from proofgrid.operators.scale import previous_by_bucket
from proofgrid.plans.base import TODAY, fold_sql, query, table, texts, turns
from proofgrid.plans.filter_queries import VERSIONS_SQL, order_versions
from proofgrid.plans.scoring_queries import RESULTS_SQL, assessed, points
from proofgrid.plans.text_queries import SCRUB_SQL

KEY = "00112233445566778899aabbccddeeff" * 2
SEGMENT = 64


@query("win_1_latest_per_key", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def win_1(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return gv.latest_per_key(e, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("win_2_reference_numbers", "SELECT doc_id, source, 'C-' || lpad(CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR), 4, '0') AS ref FROM documents")
def win_2(spark, sf):
    return gv.reference_numbers(table(spark, sf, "documents").select("doc_id", "source"), ["source"], "doc_id").select("doc_id", "source", "ref")


@query("win_3_first_seen_duplicate", f"""
WITH k AS (SELECT doc_id, lang, n_chars >= 100 AS ok, sha256(trim(regexp_replace({fold_sql('text')}, '\\s+', ' ', 'g'))) AS h FROM documents), f AS (SELECT lang, h, min(doc_id) AS f FROM k WHERE ok GROUP BY ALL)
SELECT doc_id, CASE WHEN f < doc_id THEN f END AS duplicate_of FROM k LEFT JOIN f ON f.lang = k.lang AND f.h = k.h""")
def win_3(spark, sf):
    d = texts(spark, sf).select("doc_id", "lang", "n_chars", text_key(F.col("text")).alias("text_key"))
    return gv.first_seen(d, ["lang"], "text_key", "doc_id", F.col("n_chars") >= 100).select("doc_id", "duplicate_of")


def audit_log(spark, sf):
    """Events as a keyed log in chains of 64 rows; one payload in a thousand is altered after the fact."""
    return log_of(table(spark, sf, "events"))


def log_of(events):
    e = events.withColumn("seg", F.floor(F.col("event_id") / SEGMENT))
    row = F.struct("event_id", F.to_json(F.struct("user_id", "event_type", "props")).alias("payload"))
    chains = e.groupBy("seg").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit("").alias("p"), F.array().cast("array<struct<seq:bigint,payload:string,prev_hash:string,hash:string>>").alias("out"))

    def link(acc, r):
        h = gv.digest(KEY, acc["p"], r["payload"])
        return F.struct(h.alias("p"), F.concat(acc["out"], F.array(F.struct(r["event_id"].alias("seq"), r["payload"].alias("payload"), acc["p"].alias("prev_hash"), h.alias("hash")))).alias("out"))

    log = chains.select("seg", F.explode(F.aggregate("rows", start, link, lambda a: a["out"])).alias("r")).select("seg", "r.*")
    return log.withColumn("payload", F.when(F.pmod("seq", F.lit(1000)) == 500, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))


CHAIN_SQL = f"c AS (SELECT event_id // {SEGMENT} AS seg, count(*) AS rows, max(event_id) AS head_seq, min(event_id) FILTER (event_id % 1000 = 500) AS broken_at FROM events GROUP BY 1)"


@query("win_13_hash_chain", f"WITH {CHAIN_SQL} SELECT seg, rows, broken_at FROM c")
def win_13(spark, sf):
    return gv.verify_chain(audit_log(spark, sf), ["seg"], KEY)


@query("src_9_audit_head", f"WITH {CHAIN_SQL} SELECT seg, head_seq, broken_at IS NULL AS ok, 64 AS hash_chars FROM c")
def src_9(spark, sf):
    h = gv.chain_head(audit_log(spark, sf), ["seg"], KEY)
    return h.select("seg", "head_seq", "ok", F.length("head_hash").cast("bigint").alias("hash_chars"))


@query("win_17_score_delta", f"""
WITH {VERSIONS_SQL}, s AS (SELECT v.mission_id, v.version, CAST(o_totalprice AS DECIMAL(14, 2)) AS score FROM v JOIN orders ON o_orderkey = v.search_id)
SELECT mission_id, version, CAST(score - lag(score) OVER (PARTITION BY mission_id ORDER BY version) AS DOUBLE) AS delta FROM s""")
def win_17(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("search_id"), F.col("o_totalprice").cast("decimal(14,2)").alias("score"))
    v = order_versions(spark, sf).select("search_id", "mission_id", "version").join(o, "search_id")
    p = previous_by_bucket(v, ["mission_id"], F.floor(F.col("version") / 256), [F.col("version")], "score", F.col("version"), "before")
    return p.select("mission_id", "version", (F.col("score") - F.col("before")).cast("double").alias("delta"))


@query("win_18_request_rate", """
WITH w AS (SELECT event_id, user_id, epoch_us(ts) AS t, count(*) OVER x AS requests, min(epoch_us(ts)) OVER x AS oldest FROM events WINDOW x AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, requests, requests > 3 AS limited, CASE WHEN requests > 3 THEN greatest(1, (86400000000 - (t - oldest)) // 1000000 + 1) END AS retry_after FROM w""")
def win_18(spark, sf):
    return gv.request_counts(table(spark, sf, "events"), "user_id", "ts", 86_400, 3, "event_id")


@query("prj_11_audit_detail", """
SELECT doc_id, '[' || length(text) || ' caractères non journalisés]' AS text, CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '…' ELSE text END AS note, lang FROM documents""")
def prj_11(spark, sf):
    d = table(spark, sf, "documents")
    m = gv.scrub_detail(F.create_map(F.lit("text"), F.col("text"), F.lit("note"), F.col("text"), F.lit("lang"), F.col("lang")))
    return d.select("doc_id", m.alias("m")).select("doc_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("text", "note", "lang")])


SHARES_SQL = """
ms AS (SELECT c_custkey AS mission_id, c_nationkey AS owner, c_name AS title, c_mktsegment AS client, c_acctbal AS updated_at FROM customer),
sh AS (SELECT c_custkey AS mission_id, (c_nationkey + 1 + c_custkey % 3) % 25 AS user_id, (['strategie', 'lecture', 'edition'])[c_custkey % 3 + 1] AS scope FROM customer),
vs AS (SELECT ms.*, 'owner' AS scope FROM ms WHERE owner = 3 UNION ALL SELECT ms.*, sh.scope FROM ms JOIN sh USING (mission_id) WHERE user_id = 3 AND owner <> 3)"""


def missions(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("mission_id"), F.col("c_nationkey").alias("owner"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("client"), F.col("c_acctbal").alias("updated_at"))


def shares(spark, sf):
    c = table(spark, sf, "customer")
    k = F.pmod("c_custkey", F.lit(3))
    scope = F.get(F.array(*[F.lit(s) for s in ("strategie", "lecture", "edition")]), k.cast("int"))
    return c.select(F.col("c_custkey").alias("mission_id"), F.pmod(F.col("c_nationkey") + 1 + k, F.lit(25)).alias("user_id"), scope.alias("scope"))


@query("flt_16_visible_missions", f"WITH {SHARES_SQL} SELECT mission_id, scope FROM vs")
def flt_16(spark, sf):
    return gv.visible(missions(spark, sf), shares(spark, sf), F.lit(3)).select("mission_id", "scope")


@query("prj_10_columns_by_access", f"WITH {SHARES_SQL} SELECT mission_id, title, CASE WHEN scope <> 'strategie' THEN client END AS client, CASE WHEN scope IN ('edition', 'owner') THEN updated_at END AS updated_at FROM vs")
def prj_10(spark, sf):
    v = gv.visible(missions(spark, sf), shares(spark, sf), F.lit(3))
    return gv.by_access(v, F.col("scope"), {"client": "lecture", "updated_at": "edition"}).select("mission_id", "title", "client", "updated_at")


@query("top_7_bounded_history", f"""
WITH {SHARES_SQL}, f AS (SELECT o_custkey AS mission_id, o_orderkey AS ord, o_orderpriority || ' ' || o_orderstatus AS text FROM orders WHERE contains(lower(o_orderpriority || ' ' || o_orderstatus), 'high')),
h AS (SELECT f.* FROM f JOIN vs USING (mission_id)), n AS (SELECT mission_id, count(*) AS hit_count FROM h GROUP BY 1),
p AS (SELECT mission_id, hit_count, row_number() OVER (ORDER BY updated_at DESC, mission_id) AS position, count(*) OVER () > 25 AS truncated FROM n JOIN vs USING (mission_id)),
q AS (SELECT h.mission_id, ord, row_number() OVER (PARTITION BY h.mission_id ORDER BY ord) AS rn FROM h)
SELECT p.mission_id, hit_count, position, truncated, ord, rn FROM p JOIN q ON q.mission_id = p.mission_id WHERE position <= 25 AND rn <= 8""")
def top_7(spark, sf):
    v = gv.visible(missions(spark, sf), shares(spark, sf), F.lit(3))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("mission_id"), F.col("o_orderkey").alias("ord"), F.lit("recherche").alias("kind"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"))
    page, hits = gv.history_search(v, o, "HIGH")
    return page.select("mission_id", "hit_count", "position", "truncated").join(hits.select("mission_id", "ord", "rn"), "mission_id")


@query("top_8_far_and_kept_profiles", f"""
WITH {RESULTS_SQL} SELECT doc_id, 'far' AS list, (score / 100.0)::DOUBLE AS score FROM asm WHERE tier IN ('ecart_majeur', 'adequation_faible')
UNION ALL SELECT doc_id, 'kept', (score / 100.0)::DOUBLE FROM asm WHERE tier IN ('tres_interessant', 'interessant') OR (tier = 'a_qualifier' AND potential >= 8000)""")
def top_8(spark, sf):
    a = assessed(spark, sf)
    far = F.col("tier").isin("ecart_majeur", "adequation_faible")
    kept = F.col("tier").isin("tres_interessant", "interessant") | ((F.col("tier") == "a_qualifier") & (F.col("potential") >= 8000))
    listed = a.withColumn("list", F.when(far, "far").when(kept, "kept")).filter("list is not null")
    return listed.select("doc_id", "list", points("score"))


@query("top_10_last_audit_events", "SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 500")
def top_10(spark, sf):
    from proofgrid.operators.scale import top_rows

    return top_rows(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], [F.col("event_id").desc()], 500)


@query("set_3_not_yet_known", """
SELECT l_partkey AS key, l_suppkey AS source FROM lineitem WHERE l_returnflag <> 'A' EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'A'""")
def set_3(spark, sf):
    l = table(spark, sf, "lineitem").filter("l_returnflag <> 'A'")
    cols = [F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("source")]
    return l.select(*cols).exceptAll(l.filter("l_linestatus = 'F'").select(*cols))


@query("agg_27_mission_summary", f"""
WITH {RESULTS_SQL} SELECT grid_id, tier, count(*) AS candidates FROM asm GROUP BY CUBE (grid_id, tier)""")
def agg_27(spark, sf):
    return assessed(spark, sf).cube("grid_id", "tier").agg(F.count("*").alias("candidates"))


RETENTION_SQL = "x AS (SELECT doc_id, doc_id // 2 AS candidate_id, source, DATE '2026-01-01' + CAST(doc_id % 400 AS INT) AS expires_at, text FROM documents), dm AS (SELECT DISTINCT candidate_id FROM x WHERE expires_at < DATE '2026-10-08')"


def retained(spark, sf):
    return retention_rows(table(spark, sf, "documents"))


def retention_rows(d):
    return d.select("doc_id", F.floor(F.col("doc_id") / 2).alias("candidate_id"), "source", F.date_add(F.lit("2026-01-01").cast("date"), F.pmod("doc_id", F.lit(400)).cast("int")).alias("expires_at"), F.col("text").alias("excerpt"))


@query("agg_28_purge_preview", f"WITH {RETENTION_SQL} SELECT count(*) AS documents, count(DISTINCT candidate_id) AS candidates FROM x WHERE expires_at < DATE '2026-10-08'")
def agg_28(spark, sf):
    return gv.purge_preview(retained(spark, sf), TODAY)


@query("fn_40_retention", f"WITH {RETENTION_SQL} SELECT doc_id FROM x WHERE candidate_id NOT IN (SELECT candidate_id FROM dm)")
def fn_40(spark, sf):
    d = retained(spark, sf)
    return gv.purge(d, gv.expired(d, TODAY)).select("doc_id")


@query("join_28_redaction_cascade", f"WITH {RETENTION_SQL} SELECT doc_id, source, candidate_id IN (SELECT candidate_id FROM dm) AS redacted, md5(CASE WHEN candidate_id IN (SELECT candidate_id FROM dm) THEN '[effacé : candidat supprimé]' ELSE text END) AS excerpt_md5 FROM x")
def join_28(spark, sf):
    d = retained(spark, sf)
    return gv.redact(d, gv.expired(d, TODAY), ["excerpt"]).select("doc_id", "source", "redacted", F.md5("excerpt").alias("excerpt_md5"))


@query("agg_35_correction_statistics", """
SELECT lang, quality, toxic, count(*) AS corrections FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang, quality, toxic), (lang), (quality, toxic), ())""")
def agg_35(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    sets = [[F.col("lang"), F.col("quality"), F.col("toxic")], [F.col("lang")], [F.col("quality"), F.col("toxic")], []]
    return j.groupingSets(sets, "lang", "quality", "toxic").agg(F.count("*").alias("corrections"))


@query("fn_37_regression_case", f"""
WITH c AS (SELECT doc_id, substring(text, 1, 200) AS text, quality * 2 + doc_id % 3 AS o, (toxic + doc_id % 4) AS n FROM labels JOIN documents USING (doc_id))
SELECT doc_id, CASE WHEN n = 0 THEN 'contredit' WHEN n < o THEN 'plafonne' ELSE 'supporte' END AS kind, (['contredit', 'non_documente', 'declare_sans_preuve', 'partiellement_demontre', 'confirme_demontre'])[n + 1] AS expected, {SCRUB_SQL} AS excerpt FROM c""")
def fn_37(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    old = (F.col("quality") * 2 + F.pmod("doc_id", F.lit(3))).cast("int")
    new = (F.col("toxic") + F.pmod("doc_id", F.lit(4))).cast("int")
    return j.select("doc_id", gv.regression_case(old, new, F.col("text")).alias("c")).select("doc_id", "c.kind", "c.expected", "c.excerpt")


FEEDBACK = ["La maîtrise de {x} est insuffisante", "Bon profil sur {x}", "Il manque de la pratique sur {x}", "{x} ne correspond pas au besoin"]


@query("fn_38_feedback_lessons", f"""
WITH f AS (SELECT conv_id, turn, conv_id % 4 AS k, text, (['that', 'que'])[turn % 2 + 1] AS x FROM conversations)
SELECT conv_id, turn, x AS skill_key FROM f WHERE k <> 1 AND NOT (x = 'que' AND conv_id % 5 = 0)
UNION SELECT conv_id, turn, s FROM f, (VALUES ('that'), ('que')) AS v(s) WHERE (k <> 1 OR regexp_matches({fold_sql('text')}, 'insuffisant|pas assez|manque|trop faible|refuse|ne correspond pas|un peu juste|pas suffisamment')) AND regexp_matches({fold_sql('text')}, '(^|[^a-z0-9+#])' || CASE s WHEN 'that' THEN 'that[sx]?' ELSE s END || '($|[^a-z0-9+#])')
 AND NOT (s = 'que' AND conv_id % 5 = 0)
UNION SELECT conv_id, turn, x FROM f WHERE k = 1 AND regexp_matches({fold_sql('text')}, 'insuffisant|pas assez|manque|trop faible|refuse|ne correspond pas|un peu juste|pas suffisamment') AND NOT (x = 'que' AND conv_id % 5 = 0)""")
def fn_38(spark, sf):
    from proofgrid.operators.mentions import mentions
    from proofgrid.plans import lexicon as lx

    skill = F.get(F.array(F.lit("that"), F.lit("que")), F.pmod("turn", F.lit(2)).cast("int"))
    said = F.replace(F.get(F.array(*[F.lit(x) for x in FEEDBACK]), F.pmod("conv_id", F.lit(4)).cast("int")), F.lit("{x}"), skill)
    c = turns(spark, sf).select("conv_id", "turn", F.concat_ws(". ", "text", said).alias("text")).filter(gv.negative_feedback(F.col("text")))
    named = mentions(c, lx.corpus_lexicon(spark).filter("skill_key in ('that', 'que')"), ("conv_id", "turn"), "text").select("conv_id", "turn", "skill_key").distinct()
    known = turns(spark, sf).filter("conv_id % 5 = 0").select("conv_id", F.lit("que").alias("skill_key")).distinct()
    return named.join(known, ["conv_id", "skill_key"], "left_anti").select("conv_id", "turn", "skill_key")


@query("flt_15_traced_quotes", f"""
WITH r AS (SELECT item_id AS mission_id, text AS quote FROM benchmark), s AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS mission_id, text FROM documents),
n AS (SELECT mission_id, trim(regexp_replace({fold_sql('quote')}, '[\\s\\x{{a0}}]+', ' ', 'g')) AS q FROM r)
SELECT mission_id FROM n WHERE length(q) >= 12 AND EXISTS (SELECT 1 FROM s WHERE s.mission_id = n.mission_id AND contains(trim(regexp_replace({fold_sql('text')}, '[\\s\\x{{a0}}]+', ' ', 'g')), q))
UNION ALL SELECT doc_id + 1000000 FROM documents WHERE length(trim(regexp_replace(substring(text, 1, 40), '[\\s\\x{{a0}}]+', ' ', 'g'))) >= 12""")
def flt_15(spark, sf):
    d = texts(spark, sf)
    reqs = table(spark, sf, "benchmark").select(F.col("item_id").alias("mission_id"), F.col("text").alias("quote"))
    own = d.select((F.col("doc_id") + 1_000_000).alias("mission_id"), F.substring("text", 1, 40).alias("quote"))
    sources = d.select("doc_id", F.pmod("doc_id", F.lit(table(spark, sf, "benchmark").count())).alias("mission_id"), "text").unionByName(d.select("doc_id", (F.col("doc_id") + 1_000_000).alias("mission_id"), "text"))
    return gv.traced_quotes(reqs.unionByName(own), sources, source="doc_id").select("mission_id")


@query("flt_17_library_listing", """
SELECT p_partkey AS entry_id, p_name AS title FROM part WHERE (p_size % 3 = 0 OR p_partkey % 50 = 7) AND p_type = 'PROMO' AND contains(lower(p_name || ' ' || p_brand), 'ring')""")
def flt_17(spark, sf):
    p = table(spark, sf, "part")
    e = p.select(
        F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("body"), F.col("p_type").alias("role_family"), F.pmod("p_partkey", F.lit(50)).alias("author_id"),
        F.when(F.pmod("p_size", F.lit(3)) == 0, "published").otherwise("proposed").alias("status"), F.col("p_retailprice").alias("updated_at"),
    )
    return gv.library(e, F.lit(7), family="PROMO", query="Ring").select("entry_id", "title")


@query("join_16_knowledge_suggestions", """
WITH en AS (SELECT p_partkey AS entry_id, p_type AS fam, [string_split(p_name, ' ')[1], string_split(p_name, ' ')[2], p_brand] AS tags, p_partkey * 3 AS origin FROM part),
mi AS (SELECT c_custkey AS mission_id, (['ECONOMY', 'STANDARD', 'SMALL', 'MEDIUM', 'PROMO', 'NONE'])[c_custkey % 6 + 1] AS fam FROM customer),
sk AS (SELECT c_custkey AS mission_id, unnest(['Brand#' || (c_custkey % 25), (['ring', 'bolt', 'rod', 'plate'])[c_custkey % 4 + 1]]) AS skill FROM customer),
t AS (SELECT entry_id, fam, origin, unnest(tags) AS skill FROM en), n AS (SELECT mission_id, entry_id, count(*) AS shared FROM sk JOIN t USING (skill) GROUP BY ALL),
a AS (SELECT mi.mission_id, en.entry_id, CASE WHEN mi.fam = en.fam THEN 2 ELSE 0 END + coalesce(shared, 0) AS relevance FROM mi JOIN en ON en.origin <> mi.mission_id LEFT JOIN n ON n.mission_id = mi.mission_id AND n.entry_id = en.entry_id)
SELECT mission_id, entry_id, relevance, row_number() OVER (PARTITION BY mission_id ORDER BY relevance DESC, entry_id) AS rn FROM a WHERE relevance > 0 QUALIFY rn <= 8""")
def join_16(spark, sf):
    w = F.split("p_name", " ")
    e = table(spark, sf, "part").select(F.col("p_partkey").alias("entry_id"), F.col("p_type").alias("family"), F.array(F.get(w, F.lit(0)), F.get(w, F.lit(1)), F.col("p_brand")).alias("tags"), (F.col("p_partkey") * 3).alias("origin"))
    c = table(spark, sf, "customer")
    pick = lambda xs, n: F.get(F.array(*[F.lit(x) for x in xs]), F.pmod("c_custkey", F.lit(n)).cast("int"))
    m = c.select(F.col("c_custkey").alias("mission_id"), pick(["ECONOMY", "STANDARD", "SMALL", "MEDIUM", "PROMO", "NONE"], 6).alias("family"))
    skill = F.array(F.concat(F.lit("Brand#"), F.pmod("c_custkey", F.lit(25)).cast("string")), pick(["ring", "bolt", "rod", "plate"], 4))
    return gv.suggestions(m, c.select(F.col("c_custkey").alias("mission_id"), F.explode(skill).alias("skill")), e)


@query("join_31_candidate_card", """
SELECT c_custkey AS candidate_id, o.o_orderkey AS assessment_id, o.o_orderpriority AS tier, e.event_id AS document_id FROM customer
LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) o ON o.o_custkey = c_custkey
LEFT JOIN (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) e ON e.user_id = c_custkey""")
def join_31(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderkey").alias("assessment_id"), F.col("o_orderpriority").alias("tier"), "o_orderdate")
    e = table(spark, sf, "events").select(F.col("user_id").alias("candidate_id"), F.col("event_id").alias("document_id"), "ts")
    last_o = gv.latest_per_key(o, ["candidate_id"], ["o_orderdate", "assessment_id"]).drop("o_orderdate")
    last_e = gv.latest_per_key(e, ["candidate_id"], ["ts", "document_id"]).drop("ts")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("candidate_id"))
    return c.join(last_o, "candidate_id", "left").join(last_e, "candidate_id", "left")


@query("src_10_append_versions", f"""
WITH v AS (SELECT o_orderkey AS id, o_custkey AS lineage, o_orderdate, o_orderstatus = 'F' AS stored FROM orders),
s AS (SELECT lineage, max(version) AS top FROM (SELECT lineage, row_number() OVER (PARTITION BY lineage ORDER BY o_orderdate, id) AS version FROM v WHERE stored) GROUP BY 1)
SELECT v.id, v.lineage, row_number() OVER (PARTITION BY v.lineage ORDER BY o_orderdate, id) + coalesce(top, 0) AS version FROM v LEFT JOIN s ON s.lineage = v.lineage WHERE NOT stored""")
def src_10(spark, sf):
    from proofgrid.operators.scale import row_number_by_bucket

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("lineage"), "o_orderdate", "o_orderstatus")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    order = [F.col("o_orderdate"), F.col("id")]
    stored = row_number_by_bucket(o.filter("o_orderstatus = 'F'"), ["lineage"], month, order, "version")
    return gv.next_versions(o.filter("o_orderstatus <> 'F'"), stored, "lineage", order, month).select("id", "lineage", "version")
