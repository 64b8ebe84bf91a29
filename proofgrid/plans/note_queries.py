"""Conversation notes derived from orders, evidence folds over order lines, quotes of the benchmark in the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.functions import levels as lv
from proofgrid.operators import claims as cl
from proofgrid.operators import notes as nt
from proofgrid.operators.mentions import LEXICON_SCHEMA
from proofgrid.operators.scale import by_shuffle, parameter_table
from proofgrid.plans import lexicon as lx
from proofgrid.plans.base import TODAY, fold_sql, query, spread, table, texts, turns
from proofgrid.plans.evidence_queries import KAFKA, SKILL_LEVELS, phrases, pick_sql

SAID = [
    "J'ai développé des services Kafka avec 3 topics.",
    "Je n'ai jamais utilisé Kafka.",
    "J'ai seulement contribué à un projet Kafka.",
    "Je pense avoir mis en place Kafka sur 3 topics et 4 partitions avec 2 brokers.",
    "Mon TJM est de 550 euros et je suis disponible immédiatement.",
    "Le client veut absolument Kafka.",
    "Je souhaite travailler sur Kafka.",
    "Je refuse les astreintes et maximum 2 jours sur site.",
]
N = len(SAID)


def notes(spark, sf):
    """One transcript per order: a candidate statement chosen by its key, a question, a client requirement and a form line."""
    o = spread(table(spark, sf, "orders"), "o_orderkey")
    said = F.element_at(F.array(*[F.lit(s) for s in SAID]), (F.pmod("o_orderkey", F.lit(N)) + 1).cast("int"))
    text = F.concat_ws(
        "\n", F.concat(F.lit("Candidat : "), said), F.concat(F.lit("merci ref"), F.col("o_orderkey").cast("string")), F.lit("Recruteur : Quel est votre préavis ?"),
        F.lit("[00:12] Client : Il nous faut absolument Kafka sur ce projet."), F.lit("TJM : 650 €"),
    )
    return o.select(F.col("o_orderkey").alias("note_id"), F.col("o_custkey").alias("candidate_id"), text.alias("text"))


def note_facts(spark, sf):
    return nt.facts(notes(spark, sf), parameter_table(spark, [KAFKA], LEXICON_SCHEMA), TODAY)


SAID_SQL = "(" + "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in SAID) + f"])[o_orderkey % {N} + 1]"


@query("win_7_utterances", f"""
SELECT o_orderkey AS note_id, 'Candidat' AS speaker, 'candidate' AS role, {SAID_SQL} || ' merci ref' || o_orderkey AS said FROM orders UNION ALL SELECT o_orderkey, 'Recruteur', 'recruiter', 'Quel est votre préavis ?' FROM orders
UNION ALL SELECT o_orderkey, 'Client', 'client', 'Il nous faut absolument Kafka sur ce projet. TJM : 650 €' FROM orders""")
def win_7(spark, sf):
    return nt.utterances(notes(spark, sf)).select("note_id", "speaker", "role", F.col("text").alias("said"))


@query("win_7_conversation_turns", """
SELECT conv_id, turn, role AS label, trim(regexp_replace(regexp_replace(text, '[ \\t]*\\n+[ \\t]*', ' ', 'g'), '^ +| +$', '', 'g')) AS said FROM conversations""")
def win_7b(spark, sf):
    c = turns(spark, sf).withColumn("note_id", F.struct("conv_id", "turn")).withColumn("full", F.concat(F.initcap("role"), F.lit(" : "), F.ltrim("text", F.lit(" \n"))))
    u = nt.utterances(c, "note_id", "full")
    return u.select("note_id.conv_id", "note_id.turn", F.lower("speaker").alias("label"), F.trim("text").alias("said"))


@query("fn_21_speaker_roles", """
SELECT p_partkey, ([NULL, 'candidate', 'sales', 'unknown', 'recruiter', 'client'])[p_partkey % 6 + 1] AS role FROM part""")
def fn_21(spark, sf):
    labels = ["Compétence {n}", "Consultant", "Ingénieur d'affaires", "Camille", "Recruteuse", "Directrice"]
    p = table(spark, sf, "part")
    label = F.replace(F.element_at(F.array(*[F.lit(x) for x in labels]), (F.pmod("p_partkey", F.lit(6)) + 1).cast("int")), F.lit("{n}"), F.col("p_size").cast("string"))
    return p.select("p_partkey", F.when(nt.plausible_speaker(label), nt.speaker_role(label)).alias("role"))


FACT_SQL = f"""
fx AS (SELECT o_orderkey AS note_id, v.* FROM orders JOIN (VALUES (0, 'candidate_experience', 'kafka', 'supporte', 'partiellement_demontre', 'certain', NULL, NULL, NULL, NULL), (1, 'candidate_experience', 'kafka', 'contredit', 'contredit', 'certain', NULL, NULL, NULL, NULL),
 (2, 'candidate_experience', 'kafka', 'limite', 'partiellement_demontre', 'certain', NULL, NULL, NULL, NULL), (3, 'candidate_experience', 'kafka', 'supporte', 'partiellement_demontre', 'hedged', NULL, NULL, NULL, NULL),
 (4, 'candidate_constraint', NULL, NULL, NULL, 'certain', 'availability', 'immediate', NULL, NULL), (4, 'candidate_constraint', NULL, NULL, NULL, 'certain', 'tjm', '550', NULL, NULL),
 (5, 'client_requirement', 'kafka', NULL, NULL, 'certain', NULL, NULL, 'imperatif', TRUE), (7, 'candidate_constraint', NULL, NULL, NULL, 'certain', 'onsite_max_days', '2', NULL, NULL),
 (7, 'candidate_constraint', NULL, NULL, NULL, 'certain', 'refuses', 'astreinte', NULL, NULL), (7, 'candidate_constraint', NULL, NULL, NULL, 'certain', 'refuses', 'onsite', NULL, NULL)
 ) AS v(k, kind, topic, evidence_kind, level, certainty, field, value, category_hint, relayed) ON v.k = o_orderkey % {N}
 UNION ALL SELECT o_orderkey, -1, 'client_requirement', 'kafka', NULL, NULL, 'certain', NULL, NULL, 'imperatif', FALSE FROM orders)"""


@query("fn_22_typed_facts", f"WITH {FACT_SQL} SELECT note_id, kind, topic, evidence_kind, level, certainty, category_hint, relayed FROM fx WHERE kind <> 'candidate_constraint'")
def fn_22(spark, sf):
    f = note_facts(spark, sf).filter("kind <> 'candidate_constraint'")
    return f.select("note_id", "kind", "topic", "evidence_kind", "level", "certainty", "category_hint", "relayed")


@query("fn_23_constraint_values", f"WITH {FACT_SQL} SELECT note_id, field, value FROM fx WHERE kind = 'candidate_constraint'")
def fn_23(spark, sf):
    s = nt.note_sentences(nt.utterances(notes(spark, sf))).filter("kind = 'candidate_constraint'")
    return s.select("note_id", F.explode("constraints").alias("c")).select("note_id", "c.field", "c.value")


@query("fn_28_note_mappings", f"""
SELECT p_partkey, (['explique_en_appel', 'explique_en_appel', 'confirme_en_entretien', 'document_complementaire'])[p_size % 4 + 1] AS reliability, (['note_appel_candidat', 'transcription', 'compte_rendu_entretien', 'document_complementaire'])[p_size % 4 + 1] AS source,
 (['technique', 'technique', 'responsabilite', 'contexte_metier', 'methodologie', 'contrainte'])[p_size % 6 + 1] AS dimension, (['skill', 'skill', 'activity', 'domain', 'skill', 'language'])[p_size % 6 + 1] AS kind FROM part""")
def fn_28(spark, sf):
    p = table(spark, sf, "part")
    note = F.get(F.array(*[F.lit(k) for k in nt.NOTE_RELIABILITY]), F.pmod("p_size", F.lit(4)))
    kind = F.get(F.array(*[F.lit(k) for k in nt.DIMENSIONS]), F.pmod("p_size", F.lit(6)))
    return p.select(
        "p_partkey", lv.lookup(nt.NOTE_RELIABILITY, note).alias("reliability"), lv.lookup(nt.NOTE_SOURCE, note).alias("source"),
        lv.lookup({k: v[0] for k, v in nt.DIMENSIONS.items()}, kind).alias("dimension"), lv.lookup({k: v[1] for k, v in nt.DIMENSIONS.items()}, kind).alias("kind"),
    )


@query("fn_41_fact_routing", f"""
WITH {FACT_SQL} SELECT CASE WHEN kind = 'client_requirement' THEN 'proposal' ELSE 'evidence' END AS route, coalesce(CASE WHEN kind = 'candidate_constraint' THEN 'constraint:' || field END, CASE WHEN kind = 'candidate_experience' THEN 'skill:' || topic END, topic) AS subject, count(*) AS n FROM fx GROUP BY ALL""")
def fn_41(spark, sf):
    f = note_facts(spark, sf)
    e = nt.to_evidence(f, "transcript").select(F.lit("evidence").alias("route"), F.col("subject_key").alias("subject"))
    p = nt.to_proposals(f).select(F.lit("proposal").alias("route"), F.col("topic").alias("subject"))
    return e.unionByName(p).groupBy("route", "subject").agg(F.count("*").alias("n"))


CAND_SQL = FACT_SQL + """,
cf AS (SELECT o_custkey AS candidate_id, fx.note_id, field, value FROM fx JOIN orders ON o_orderkey = fx.note_id WHERE kind = 'candidate_constraint'),
cm AS (SELECT candidate_id, arg_max(value, note_id) FILTER (field = 'availability') AS availability, arg_max(value, note_id) FILTER (field = 'tjm') AS tjm, arg_max(value, note_id) FILTER (field = 'onsite_max_days') AS onsite_max_days,
 coalesce(array_to_string(list_sort(list_distinct(list(value) FILTER (field = 'refuses'))), ','), '') AS refuses FROM cf GROUP BY candidate_id)"""


def candidate_facts(spark, sf):
    f = note_facts(spark, sf).filter("kind = 'candidate_constraint'").join(by_shuffle(notes(spark, sf).select("note_id", "candidate_id")), "note_id")
    return nt.merged_constraints(f, ["candidate_id"], F.struct("note_id", "turn", "sent_no", "pos"))


@query("agg_33_last_fact_wins", f"WITH {CAND_SQL} SELECT * FROM cm")
def agg_33(spark, sf):
    return candidate_facts(spark, sf).select("candidate_id", "availability", "tjm", "onsite_max_days", F.array_join("refuses", ",").alias("refuses"))


@query("join_12_constraints", f"""
WITH {CAND_SQL}, n AS (SELECT o_orderkey AS need_id, cm.*, o_orderkey % 4 AS days, 400 + o_orderkey % 300 AS mx FROM orders LEFT JOIN cm ON cm.candidate_id = o_custkey)
SELECT need_id, v.key, CASE v.key WHEN 'constraint:presence' THEN CASE WHEN contains(coalesce(refuses, ''), 'onsite') THEN 'incompatible' WHEN onsite_max_days IS NULL THEN 'inconnu' WHEN onsite_max_days::INT >= days THEN 'compatible' ELSE 'incompatible' END
 WHEN 'constraint:astreinte' THEN CASE WHEN contains(coalesce(refuses, ''), 'astreinte') THEN 'incompatible' ELSE 'inconnu' END WHEN 'constraint:tjm' THEN CASE WHEN tjm IS NULL THEN 'inconnu' WHEN tjm::INT <= mx THEN 'compatible' ELSE 'a_valider' END
 WHEN 'constraint:timezone' THEN 'inconnu' WHEN 'language:english' THEN CASE need_id % 4 WHEN 0 THEN 'compatible' WHEN 1 THEN 'a_valider' WHEN 2 THEN 'inconnu' ELSE 'compatible' END ELSE CASE WHEN availability IS NULL THEN 'inconnu' ELSE 'compatible' END END AS status
FROM n, (VALUES ('constraint:presence'), ('constraint:astreinte'), ('constraint:tjm'), ('constraint:timezone'), ('language:english'), ('constraint:availability')) AS v(key)""")
def join_12(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("need_id"), F.col("o_custkey").alias("candidate_id"))
    k = F.pmod("need_id", F.lit(4)).cast("int")
    keys = ["constraint:presence", "constraint:astreinte", "constraint:tjm", "constraint:timezone", "language:english", "constraint:availability"]
    row = lambda key: F.struct(
        F.lit(key).alias("key"), k.alias("onsite_days"), F.lit(None).cast("string").alias("city"), (400 + F.pmod("need_id", F.lit(300))).cast("int").alias("tjm_max"), F.lit("professionnel").alias("level")
    )
    j = o.join(by_shuffle(candidate_facts(spark, sf)), "candidate_id", "left").select("*", F.explode(F.array(*[row(x) for x in keys])).alias("c"))
    facts = {
        "refuses": F.col("refuses"), "onsite_max_days": F.col("onsite_max_days").cast("int"), "tjm": F.col("tjm").cast("int"), "city": F.lit(None).cast("string"), "accepts_astreinte": F.col("accepts_astreinte").cast("boolean"),
        "timezone_ok": F.lit(None).cast("boolean"), "availability": F.col("availability"), "english_level": F.get(F.array(F.lit("courant"), F.lit("notions"), F.lit(None).cast("string"), F.lit("professionnel")), k),
    }
    return j.select("need_id", "c.key", nt.constraint_status(F.col("c"), facts).alias("status"))


@query("fn_30_language_comparison", """
WITH l AS (SELECT p_partkey, ['notions', 'scolaire', 'intermédiaire', 'professionnel', 'courant', 'bilingue', 'niveau non précisé'] AS a, p_size % 7 + 1 AS h, p_partkey % 6 + 1 AS n FROM part)
SELECT p_partkey, CASE WHEN h < 7 THEN h >= n END AS enough FROM l""")
def fn_30(spark, sf):
    have = F.element_at(F.array(*[F.lit(x) for x in (*lv.LANGUAGE_ORDER, "niveau non précisé")]), (F.pmod("p_size", F.lit(7)) + 1).cast("int"))
    need = F.element_at(F.array(*[F.lit(x) for x in lv.LANGUAGE_ORDER]), (F.pmod("p_partkey", F.lit(6)) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", lv.language_at_least(have, F.concat(need, F.lit(" exigé"))).alias("enough"))


EV_SQL = """
rv AS (SELECT event_id % 4000 AS evidence_id, event_id AS review_id, ts AS tm, CASE event_type WHEN 'purchase' THEN 'validated' WHEN 'error' THEN 'rejected' END AS decision FROM events WHERE event_type IN ('purchase', 'error')),
lr AS (SELECT evidence_id, arg_max(decision, (tm, review_id)) AS decision FROM rv GROUP BY evidence_id),
ev AS (SELECT l_orderkey % 97 AS subject, l_shipdate AS created_at, l_orderkey || '_' || l_linenumber || '_' || l_partkey AS id, (['supporte', 'supporte', 'limite', 'plafonne', 'contredit'])[l_partkey % 5 + 1] AS kind, CASE WHEN l_suppkey % 7 > 0 THEN 2 + l_suppkey % 3 END AS level_ord,
 CASE WHEN l_linenumber = 6 THEN 'hypothese' WHEN l_linenumber = 5 THEN 'declaration_non_etayee' ELSE 'explique_en_appel' END AS reliability, CASE WHEN l_partkey % 50 = 4 THEN 'saisie_recruteur' ELSE 'transcription' END AS source, l_returnflag = 'R' AS auto, lr.decision
 FROM lineitem LEFT JOIN lr ON lr.evidence_id = l_partkey),
e2 AS (SELECT *, coalesce(decision = 'validated', FALSE) OR source = 'saisie_recruteur' AS validated, coalesce(decision = 'rejected', FALSE) AS superseded FROM ev)"""


def line_evidence(spark, sf, lines=None):
    l = table(spark, sf, "lineitem") if lines is None else lines
    m = lambda c, n: F.pmod(c, F.lit(n)).cast("int")
    e = l.select(
        m("l_orderkey", 97).alias("subject"), F.col("l_shipdate").alias("created_at"), F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_partkey").alias("evidence_id"),
        F.get(F.array(*[F.lit(x) for x in (nt.SUPPORTS, nt.SUPPORTS, nt.LIMITS, nt.CAPS, nt.CONTRADICTS)]), m("l_partkey", 5)).alias("kind"),
        F.when(m("l_suppkey", 7) > 0, 2 + m("l_suppkey", 3)).alias("level_ord"),
        F.when(F.col("l_linenumber") == 6, nt.HYPOTHESIS).when(F.col("l_linenumber") == 5, nt.UNSUPPORTED).otherwise("explique_en_appel").alias("reliability"),
        F.when(m("l_partkey", 50) == 4, "saisie_recruteur").otherwise("transcription").alias("source"), (F.col("l_returnflag") == "R").alias("auto_generated"),
    )
    ev = table(spark, sf, "events").filter("event_type in ('purchase', 'error')")
    reviews = ev.select(F.pmod("event_id", F.lit(4000)).alias("evidence_id"), F.col("event_id").alias("review_id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "purchase", "validated").otherwise("rejected").alias("decision"))
    return nt.with_latest_review(e, reviews)


@query("join_11_latest_review", f"WITH {EV_SQL} SELECT validated, superseded, kind, count(*) AS n FROM e2 GROUP BY ALL")
def join_11(spark, sf):
    return line_evidence(spark, sf).groupBy("validated", "superseded", "kind").agg(F.count("*").alias("n"))


FOLD_SQL = EV_SQL + """,
fxn AS (SELECT subject, created_at, id, list_transform([0, 1, 2, 3, 4], lambda x: CASE WHEN superseded OR reliability = 'hypothese' THEN x
 WHEN kind = 'supporte' THEN CASE WHEN x = 0 THEN 0 ELSE greatest(x, least(coalesce(level_ord, 3), CASE WHEN reliability = 'declaration_non_etayee' THEN 2 ELSE 4 END, CASE WHEN auto AND NOT validated THEN 3 ELSE 4 END)) END
 WHEN kind = 'limite' THEN least(x, 3) WHEN kind = 'plafonne' THEN least(x, coalesce(level_ord, 2)) WHEN validated OR source = 'saisie_recruteur' THEN 0 ELSE least(x, 2) END) AS fx FROM e2),
fold AS (SELECT subject, list_reduce(list_prepend([0, 1, 2, 3, 4], list(fx ORDER BY created_at, id)), lambda a, b: list_transform(a, lambda x: b[x + 1])) AS fx FROM fxn GROUP BY subject)"""


@query("fn_39_ordered_evidence_fold", f"""
WITH {FOLD_SQL} SELECT o_orderkey AS doc_id, o_orderkey % 97 AS subject, (1 + o_orderkey % 4)::BIGINT AS level_ord, fold.fx[1 + o_orderkey % 4 + 1]::BIGINT AS merged_ord FROM orders JOIN fold ON fold.subject = o_orderkey % 97""")
def fn_39(spark, sf):
    e = line_evidence(spark, sf)
    effects = nt.evidence_effects(e, ["subject"], ["created_at", "id"])
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.pmod("o_orderkey", F.lit(97)).cast("int").alias("subject"), (1 + F.pmod("o_orderkey", F.lit(4))).cast("int").alias("level_ord"))
    m = nt.merged_levels(o, effects, ["subject"])
    return m.select("doc_id", "subject", F.col("level_ord").cast("bigint").alias("level_ord"), F.col("merged_ord").cast("bigint").alias("merged_ord"))


CLUES = ["schéma", "connecteur", "réplication"]
DEEP_SQL = EV_SQL + """,
dp AS (SELECT e2.*, (evidence_id % 3 > 0)::INT AS a, 1 + evidence_id % 3 AS d, 1 + evidence_id % 4 AS x FROM (SELECT *, CAST(split_part(id, '_', 3) AS BIGINT) AS evidence_id FROM e2) e2),
dq AS (SELECT *, a = 0 OR x <= 3 AND x <> d AS deep FROM dp),
dx AS (SELECT subject, created_at, id, list_transform([0, 1, 2, 3, 4], lambda x: CASE WHEN superseded OR reliability = 'hypothese' THEN x
 WHEN kind = 'supporte' THEN CASE WHEN x = 0 THEN 0 ELSE greatest(x, least(coalesce(level_ord, 3), CASE WHEN reliability = 'declaration_non_etayee' THEN 2 ELSE 4 END, CASE WHEN deep THEN 4 ELSE 3 END, CASE WHEN auto AND NOT validated THEN 3 ELSE 4 END)) END
 WHEN kind = 'limite' THEN least(x, 3) WHEN kind = 'plafonne' THEN least(x, coalesce(level_ord, 2)) WHEN validated OR source = 'saisie_recruteur' THEN 0 ELSE least(x, 2) END) AS fx FROM dq),
dfold AS (SELECT subject, list_reduce(list_prepend([0, 1, 2, 3, 4], list(fx ORDER BY created_at, id)), lambda a, b: list_transform(a, lambda x: b[x + 1])) AS fx FROM dx GROUP BY subject)"""


@query("fn_39_advanced_depth", f"WITH {DEEP_SQL} SELECT subject, array_to_string(fx, ',') AS effect FROM dfold")
def fn_39b(spark, sf):
    e = line_evidence(spark, sf)
    clue = lambda n: F.filter(F.array(F.get(F.array(*[F.lit(c) for c in CLUES]), F.pmod("evidence_id", F.lit(n)).cast("int"))), lambda c: c.isNotNull())
    deep = nt.enough_depth(F.pmod("evidence_id", F.lit(3)) > 0, clue(3), clue(4))
    return nt.evidence_effects(e, ["subject"], ["created_at", "id"], deep=deep).select("subject", F.array_join("effect", ",").alias("effect"))


@query("set_1_evidence_union", """
SELECT 'document' AS origin, 'documente_cv' AS reliability, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'exchange', CASE WHEN role = 'user' THEN 'explique_en_appel' ELSE 'hypothese' END, count(*) FROM conversations GROUP BY ALL""")
def set_1(spark, sf):
    d = table(spark, sf, "lineitem").select(F.lit("document").alias("origin"), F.lit("documente_cv").alias("reliability"), F.col("l_quantity").alias("weight"))
    c = table(spark, sf, "conversations").select(F.lit("exchange").alias("origin"), F.when(F.col("role") == "user", "explique_en_appel").otherwise(nt.HYPOTHESIS).alias("reliability"), F.col("text").alias("excerpt"))
    return d.unionByName(c, allowMissingColumns=True).groupBy("origin", "reliability").agg(F.count("*").alias("n"))


@query("join_20_verified_claims", f"""
WITH c AS (SELECT d.doc_id, d.text, CASE WHEN doc_id % 2 = 0 THEN replace(substring(d.text, 1 + length(d.text) // 3, 60), ' ', '  ') ELSE b.text END AS quote FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
f AS (SELECT doc_id, quote, regexp_replace({fold_sql('text')}, '[\\s\\x{{a0}}]+', ' ', 'g') AS t, trim(regexp_replace({fold_sql('quote')}, '[\\s\\x{{a0}}]+', ' ', 'g')) AS q, {fold_sql('quote')} AS qf FROM c)
SELECT doc_id, CASE WHEN length(q) >= 12 AND contains(t, q) AND regexp_matches(qf, '(^|[^a-z0-9+#])(the|der|los)($|[^a-z0-9+#])') THEN 'verified' ELSE 'downgraded' END AS status,
 CASE WHEN length(q) >= 12 AND contains(t, q) THEN instr(t, q) END AS at FROM f""")
def join_20(spark, sf):
    d = texts(spark, sf).select("doc_id", "text")
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage"))
    own = F.replace(F.substring("text", F.floor(F.length("text") / 3).cast("int") + 1, F.lit(60)), F.lit(" "), F.lit("  "))
    c = d.withColumn("item_id", F.pmod("doc_id", F.lit(b.count()))).join(b, "item_id").select("doc_id", F.when(F.pmod("doc_id", F.lit(2)) == 0, own).otherwise(F.col("passage")).alias("quote"))
    from proofgrid.functions.text import any_term_regex

    return cl.traced(c, d, any_term_regex(["the", "der", "los"])).select("doc_id", "status", "at")


@query("join_20_recomputed_level", f"""
WITH c AS (SELECT o_orderkey AS claim_id, o_orderkey % 3 > 0 AS true_quote, (1 + o_orderkey % 4)::BIGINT AS asserted, {pick_sql(SKILL_LEVELS)}::BIGINT AS found FROM orders)
SELECT claim_id, CASE WHEN true_quote THEN 'verified' ELSE 'downgraded' END AS status, CASE WHEN true_quote THEN least(asserted, found) END AS level_ord FROM c""")
def join_20_levels(spark, sf):
    p = phrases(spark, sf).select("doc_id", "item")
    docs = p.select("doc_id", F.concat(F.lit("Plateforme de données\n"), "item", F.lit("\nEnvironnement : Linux, Redis")).alias("text"))
    said = F.when(F.pmod("doc_id", F.lit(3)) > 0, F.upper(F.replace("item", F.lit(" "), F.lit("  ")))).otherwise(F.concat("item", F.lit(" ailleurs")))
    c = p.select("doc_id", F.col("doc_id").alias("claim_id"), F.lit("kafka").alias("skill_key"), said.alias("quote"), (1 + F.pmod("doc_id", F.lit(4))).cast("int").alias("asserted_ord"))
    v = cl.verify(c, docs, parameter_table(spark, [KAFKA], LEXICON_SCHEMA), TODAY)
    return v.select("claim_id", "status", F.col("level_ord").cast("bigint").alias("level_ord"))


@query("udf_4_claims_from_any_producer", f"""
WITH q AS (SELECT item_id, trim(regexp_replace({fold_sql('text')}, '[\\s\\x{{a0}}]+', ' ', 'g')) AS q FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace({fold_sql('text')}, '[\\s\\x{{a0}}]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, item_id FROM q JOIN d ON contains(t, q) WHERE length(q) >= 12""")
def udf_4(spark, sf):
    return cl.quotes_in_corpus(table(spark, sf, "benchmark"), texts(spark, sf), "item_id", "text")
