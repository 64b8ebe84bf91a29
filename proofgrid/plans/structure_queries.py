"""Profile texts derived from orders (one text per order), parsed back and compared with the order columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.functions import dates as dt
from proofgrid.functions import text as tx
from proofgrid.operators import intervals as iv
from proofgrid.operators import mentions as mn
from proofgrid.operators import structure as st
from proofgrid.operators.mentions import LEXICON_SCHEMA
from proofgrid.operators.scale import by_shuffle, parameter_table
from proofgrid.plans.base import TODAY, fold_sql, query, spread, table
from proofgrid.plans.lexicon import _skill

MONTHS_FR = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]
LONG = "Participation à des travaux variés de reprise de données et de support pour plusieurs entités du groupe, avec relecture des livrables et suivi des anomalies ouvertes"
T_ORD = dt.today_ordinal(TODAY)

CV_SQL = f"""
o AS (SELECT o_orderkey AS k, o_custkey AS c, year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderkey % 60 AS d, o_orderkey % 5 AS fmt FROM orders),
r AS (SELECT *, (y * 12 + m - 1) AS so, (y * 12 + m - 1 + d) AS eo, (y * 12 + m - 1 + d) // 12 AS ey, (y * 12 + m - 1 + d) % 12 + 1 AS em FROM o),
g AS (SELECT *, CASE fmt WHEN 0 THEN lpad(m::VARCHAR, 2, '0') || '/' || y || ' – ' || lpad(em::VARCHAR, 2, '0') || '/' || ey
  WHEN 1 THEN ({MONTHS_FR!r})[m] || ' ' || y || ' – ' || ({MONTHS_FR!r})[em] || ' ' || ey WHEN 2 THEN y || '/' || lpad(m::VARCHAR, 2, '0') || ' – ' || ey || '/' || lpad(em::VARCHAR, 2, '0')
  WHEN 3 THEN lpad(m::VARCHAR, 2, '0') || '.' || y || ' – en cours' ELSE 'depuis ' || ({MONTHS_FR!r})[m] || ' ' || y END AS rng FROM r),
h AS (SELECT *, 'Société ' || c || ' — Ingénieur ' || (k % 7) || CASE WHEN fmt = 4 THEN ', ' || rng ELSE ' (' || rng || ')' END AS h1, 'Agence ' || (c % 50) || ' — Analyste (' || (y - 4) || ' – ' || (y - 1) || ')' AS h2 FROM g),
cv AS (SELECT *, concat_ws(chr(10), 'Consultant ' || c, 'Fort de ' || (k % 20) || ' ans d''expérience', '', 'Compétences', 'Java, Kafka, outil ' || (k % 9), '', 'EXPÉRIENCES PROFESSIONNELLES :',
  CASE WHEN k % 6 = 0 THEN '{LONG}' END, CASE WHEN k % 4 = 0 THEN 'Groupe Exemple ' || (c % 50) END, h1,
  '- Développement de ' || (2 + k % 5) || ' services Kafka pour la facturation,', '  reprise des flux existants.', CASE WHEN k % 3 = 0 AND fmt >= 3 THEN '- Migration (' || (y + 1) || ' - ' || (y + 1) || ') vers le cloud' END,
  'Environnement technique : Java, Kafka, Outil' || (k % 9), h2, '- Exploitation de la plateforme Java. Supervision quotidienne.', '', 'Formations', 'Master informatique (' || (y - 8) || ' - ' || (y - 6) || ')', 'Langues',
  'Anglais : ' || (['courant', 'notions', 'B2'])[k % 3 + 1], CASE WHEN k % 2 = 0 THEN 'Allemand' END) AS text FROM h)"""


def profile_texts(spark, sf):
    """One profile text per order; every value in it comes from the order row."""
    o = spread(table(spark, sf, "orders"), "o_orderkey").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.pmod("o_orderkey", F.lit(60)).cast("int").alias("d")
    )
    k = lambda n: F.pmod("k", F.lit(n)).cast("int")
    o = o.withColumn("so", F.col("y") * 12 + F.col("m") - 1).withColumn("eo", F.col("so") + F.col("d")).withColumn("fmt", k(5))
    o = o.withColumn("ey", F.floor(F.col("eo") / 12).cast("int")).withColumn("em", F.pmod("eo", F.lit(12)) + 1)
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    name = lambda c: F.get(F.array(*[F.lit(x) for x in MONTHS_FR]), F.col(c) - 1)
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    y, ey = F.col("y"), F.col("ey")
    rng = (
        F.when(F.col("fmt") == 0, cat(two("m"), "/", y, " – ", two("em"), "/", ey))
        .when(F.col("fmt") == 1, cat(name("m"), " ", y, " – ", name("em"), " ", ey))
        .when(F.col("fmt") == 2, cat(y, "/", two("m"), " – ", ey, "/", two("em")))
        .when(F.col("fmt") == 3, cat(two("m"), ".", y, " – en cours"))
        .otherwise(cat("depuis ", name("m"), " ", y))
    )
    o = o.withColumn("rng", rng)
    c = F.col("c")
    c50 = F.pmod("c", F.lit(50))
    h1 = cat("Société ", c, " — Ingénieur ", k(7), F.when(F.col("fmt") == 4, cat(", ", F.col("rng"))).otherwise(cat(" (", F.col("rng"), ")")))
    level = F.get(F.array(F.lit("courant"), F.lit("notions"), F.lit("B2")), k(3))
    body = F.concat_ws(
        "\n", cat("Consultant ", c), cat("Fort de ", k(20), " ans d'expérience"), F.lit(""), F.lit("Compétences"), cat("Java, Kafka, outil ", k(9)), F.lit(""), F.lit("EXPÉRIENCES PROFESSIONNELLES :"),
        F.when(k(6) == 0, F.lit(LONG)), F.when(k(4) == 0, cat("Groupe Exemple ", c50)), h1, cat("- Développement de ", 2 + k(5), " services Kafka pour la facturation,"),
        F.lit("  reprise des flux existants."), F.when((k(3) == 0) & (F.col("fmt") >= 3), cat("- Migration (", y + 1, " - ", y + 1, ") vers le cloud")),
        cat("Environnement technique : Java, Kafka, Outil", k(9)), cat("Agence ", c50, " — Analyste (", y - 4, " – ", y - 1, ")"),
        F.lit("- Exploitation de la plateforme Java. Supervision quotidienne."), F.lit(""), F.lit("Formations"), cat("Master informatique (", y - 8, " - ", y - 6, ")"), F.lit("Langues"),
        cat("Anglais : ", level), F.when(k(2) == 0, F.lit("Allemand")),
    )
    return o.select(F.col("k").alias("doc_id"), "rng", body.alias("text"))


def layout(spark, sf, *keep):
    return st.layout(profile_texts(spark, sf), TODAY, keep=keep)


def lexicon(spark):
    return parameter_table(spark, [_skill("java", ["Java"], rarity=2, depth=["services", "plateforme"]), _skill("kafka", ["Kafka"], rarity=4, depth=["services", "flux"])], LEXICON_SCHEMA)


@query("fn_15_headings", f"""
WITH {CV_SQL}, l AS (SELECT k, string_split(text, chr(10)) AS ls FROM cv), e AS (SELECT k, generate_subscripts(ls, 1) AS n, unnest(ls) AS raw FROM l)
SELECT k AS doc_id, n::BIGINT AS line_no, CASE raw WHEN 'Compétences' THEN 'skills' WHEN 'EXPÉRIENCES PROFESSIONNELLES :' THEN 'experience' WHEN 'Formations' THEN 'education' ELSE 'languages' END AS heading
FROM e WHERE raw IN ('Compétences', 'EXPÉRIENCES PROFESSIONNELLES :', 'Formations', 'Langues')""")
def fn_15(spark, sf):
    l = st.lines_of(layout(spark, sf, "lines")).filter("heading is not null")
    return l.select("doc_id", (F.col("line_no") + 1).cast("bigint").alias("line_no"), "heading")


@query("win_6_sections", f"""
WITH {CV_SQL}, l AS (SELECT k, k % 6 = 0 AS a, k % 4 = 0 AS b, k % 3 = 0 AND fmt >= 3 AS mg, k % 2 = 0 AS al FROM cv)
SELECT k AS doc_id, v.section, (CASE v.section WHEN 'summary' THEN 3 WHEN 'skills' THEN 3 WHEN 'experience' THEN 8 + a::INT + b::INT + mg::INT WHEN 'education' THEN 2 ELSE 2 + al::INT END - (v.section = 'experience')::INT)::BIGINT AS lines
FROM l, (VALUES ('summary'), ('skills'), ('experience'), ('education'), ('languages')) AS v(section)""")
def win_6(spark, sf):
    return st.lines_of(layout(spark, sf, "lines")).groupBy("doc_id", "section").agg(F.count_if((F.trim("raw") != "") | (F.col("section") != "experience")).alias("lines"))


@query("fn_11_partial_dates", f"WITH {CV_SQL} SELECT k AS doc_id, y::BIGINT AS y, m::BIGINT AS m FROM cv")
def fn_11(spark, sf):
    p = profile_texts(spark, sf)
    token = F.regexp_extract(tx.fold(F.col("rng")), f"({dt.DATE})", 1)
    ym = dt.year_month(token)
    return p.select("doc_id", ym["y"].cast("bigint").alias("y"), ym["m"].cast("bigint").alias("m"))


@query("fn_12_date_ranges", f"""
WITH {CV_SQL} SELECT k AS doc_id, y || '-' || lpad(m::VARCHAR, 2, '0') AS "from", CASE WHEN fmt < 3 THEN ey || '-' || lpad(em::VARCHAR, 2, '0') END AS "to", fmt >= 3 AS is_current FROM cv
UNION ALL SELECT k, (y - 4)::VARCHAR, (y - 1)::VARCHAR, FALSE FROM cv UNION ALL SELECT k, (y + 1)::VARCHAR, (y + 1)::VARCHAR, FALSE FROM cv WHERE k % 3 = 0 AND fmt >= 3""")
def fn_12(spark, sf):
    c = st.dated_lines(layout(spark, sf, "dated"))
    return c.select("doc_id", dt.iso(F.col("from")).alias("from"), F.when(~F.col("is_current"), dt.iso(F.col("to"))).alias("to"), "is_current")


@query("flt_10_plausible_ranges", """
SELECT p_partkey, v.kind, CASE v.kind WHEN 'period' THEN 1950 + p_size * 2 BETWEEN 1960 AND 2027 WHEN 'quantity' THEN FALSE ELSE FALSE END AS plausible FROM part, (VALUES ('period'), ('quantity'), ('future')) AS v(kind)""")
def flt_10(spark, sf):
    p = table(spark, sf, "part")
    year = (1950 + F.col("p_size") * 2).cast("string")
    texts = F.array(
        F.struct(F.lit("period").alias("kind"), F.concat(F.lit("mission "), year, F.lit(" - "), year, F.lit(" projet")).alias("line")),
        F.struct(F.lit("quantity").alias("kind"), F.concat(F.lit("débit de 2000 - 2020 messages "), F.col("p_size").cast("string")).alias("line")),
        F.struct(F.lit("future").alias("kind"), F.concat(F.lit("de 2030 - "), (F.lit(2031) + F.col("p_size")).cast("string")).alias("line")),
    )
    e = p.select("p_partkey", F.explode(texts).alias("t"))
    return e.select("p_partkey", "t.kind", dt.first_range(tx.fold(F.col("t.line")), TODAY).isNotNull().alias("plausible"))


@query("flt_11_project_periods", f"WITH {CV_SQL} SELECT k AS doc_id, (k % 3 = 0 AND fmt >= 3)::BIGINT AS project_periods, 2 AS kept FROM cv")
def flt_11(spark, sf):
    c = st.dated_lines(layout(spark, sf, "dated"))
    return c.groupBy("doc_id").agg(F.sum(F.col("project_period").cast("bigint")).alias("project_periods"), F.count_if(~F.col("project_period")).alias("kept"))


EXP_SQL = CV_SQL + f""",
xp AS (SELECT k AS doc_id, CASE WHEN k % 4 = 0 THEN 'Groupe Exemple ' || (c % 50) ELSE 'Société ' || c END AS company,
  CASE WHEN k % 4 = 0 THEN 'Société ' || c ELSE 'Ingénieur ' || (k % 7) || CASE WHEN fmt = 4 THEN ', ' || rng ELSE '' END END AS title,
  y || '-' || lpad(m::VARCHAR, 2, '0') AS start, CASE WHEN fmt < 3 THEN ey || '-' || lpad(em::VARCHAR, 2, '0') END AS "end", fmt >= 3 AS is_current,
  greatest(1, CASE WHEN fmt < 3 THEN d + 1 ELSE {T_ORD} - so + 1 END) AS months, 'month' AS precision, so, CASE WHEN fmt < 3 THEN eo ELSE {T_ORD} END AS eo, 1 AS ord,
  instr(text, CASE WHEN k % 4 = 0 THEN 'Groupe Exemple' ELSE h1 END) - 1 AS s, instr(text, h1) - 1 + length(h1) AS body_s, instr(text, h2) - 1 AS e FROM cv
 UNION ALL SELECT k, 'Agence ' || (c % 50), 'Analyste', (y - 4)::VARCHAR, (y - 1)::VARCHAR, FALSE, 36, 'year', (y - 4) * 12 + 6, (y - 1) * 12 + 6, 2, instr(text, h2) - 1, instr(text, h2) - 1 + length(h2), instr(text, 'Formations') - 1 FROM cv
 UNION ALL SELECT k, '{LONG}', '', NULL, NULL, FALSE, NULL, 'unknown', NULL, NULL, 0, instr(text, 'EXPÉRIENCES PRO') - 1, instr(text, 'EXPÉRIENCES PRO') - 1, instr(text, CASE WHEN k % 4 = 0 THEN 'Groupe Exemple' ELSE h1 END) - 1 FROM cv WHERE k % 6 = 0)"""


@query("fn_13_durations", f"WITH {EXP_SQL} SELECT doc_id, start, \"end\", is_current, months::BIGINT AS months, precision FROM xp WHERE ord > 0")
def fn_13(spark, sf):
    e = st.experiences(profile_texts(spark, sf), TODAY).filter("precision <> 'unknown'")
    return e.select("doc_id", "start", "end", "is_current", F.col("months").cast("bigint").alias("months"), "precision")


@query("fn_14_header_split", f"WITH {EXP_SQL} SELECT doc_id, company, title FROM xp")
def fn_14(spark, sf):
    return st.experiences(profile_texts(spark, sf), TODAY).select("doc_id", "company", "title")


@query("win_10_header_look_back", f"WITH {EXP_SQL} SELECT doc_id, s::BIGINT AS s, body_s::BIGINT AS body_s, e::BIGINT AS e FROM xp WHERE ord > 0")
def win_10(spark, sf):
    e = st.experiences(profile_texts(spark, sf), TODAY).filter("precision <> 'unknown'")
    return e.select("doc_id", *[F.col(x).cast("bigint").alias(x) for x in ("s", "body_s", "e")])


@query("win_11_undated_blocks", f"WITH {EXP_SQL} SELECT doc_id, s::BIGINT AS s, e::BIGINT AS e, company AS header FROM xp WHERE ord = 0")
def win_11(spark, sf):
    e = st.experiences(profile_texts(spark, sf), TODAY).filter("precision = 'unknown'")
    return e.select("doc_id", F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"), "header")


@query("fn_16_languages", f"""
WITH {CV_SQL} SELECT k AS doc_id, (['courant', 'notions', 'professionnel'])[k % 3 + 1] AS anglais, CASE WHEN k % 2 = 0 THEN (['courant', 'notions', 'professionnel'])[k % 3 + 1] END AS allemand, NULL::VARCHAR AS espagnol FROM cv""")
def fn_16(spark, sf):
    p = profile_texts(spark, sf).select("doc_id", st.languages(F.col("text")).alias("l"))
    return p.select("doc_id", *[F.try_element_at("l", F.lit(x)).alias(x) for x in ("anglais", "allemand", "espagnol")])


def hits(spark, sf):
    return mn.mentions(profile_texts(spark, sf), lexicon(spark))


HITS_SQL = EXP_SQL + f""",
tk AS (SELECT k AS doc_id, text, {fold_sql('text')} AS f FROM cv),
ln AS (SELECT doc_id, generate_subscripts(ls, 1) AS n, unnest(ls) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM tk)),
lo AS (SELECT doc_id, n, raw, (sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) - length(raw) - 1)::BIGINT AS start FROM ln),
hit AS (SELECT doc_id, n, start AS line_start, lower(w) AS skill_key, start + instr(raw, w) - 1 AS start, raw FROM lo, (VALUES ('Java'), ('Kafka')) AS v(w) WHERE instr(raw, w) > 0),
hx AS (SELECT hit.*, xp.ord, xp.body_s FROM hit LEFT JOIN xp ON xp.doc_id = hit.doc_id AND hit.start >= xp.s AND hit.start < xp.e)"""


@query("join_6_mention_to_experience", f"WITH {HITS_SQL} SELECT doc_id, skill_key, start, (ord - (doc_id % 6 <> 0)::INT)::BIGINT AS exp_idx FROM hx")
def join_6(spark, sf):
    h = st.located(hits(spark, sf), layout(spark, sf, "spans"))
    return h.select("doc_id", "skill_key", F.col("start").cast("bigint").alias("start"), F.col("exp_idx").cast("bigint").alias("exp_idx"))


@query("join_7_mention_location", f"""
WITH {HITS_SQL} SELECT doc_id, skill_key, start, CASE WHEN ord IS NULL THEN 'skills_list' WHEN starts_with(raw, 'Environnement') THEN 'env_list' WHEN start < body_s THEN 'header' ELSE 'experience' END AS location FROM hx""")
def join_7(spark, sf):
    h = st.located(hits(spark, sf), layout(spark, sf, "spans"))
    return h.select("doc_id", "skill_key", F.col("start").cast("bigint").alias("start"), "location")


ITEMS_SQL = HITS_SQL + """,
it AS (SELECT doc_id, start, CASE WHEN starts_with(raw, '- Développement') THEN raw || chr(10) || '  reprise des flux existants.' ELSE raw END AS item, raw FROM lo WHERE starts_with(raw, '- ') OR starts_with(raw, 'Environnement')
  OR starts_with(raw, 'Participation') OR starts_with(raw, 'EXPÉRIENCES PRO') AND doc_id % 6 = 0)"""


@query("win_8_items", f"WITH {ITEMS_SQL} SELECT doc_id, start, (start + length(item))::BIGINT AS \"end\", item FROM it")
def win_8(spark, sf):
    i = st.items_of(layout(spark, sf, "items"))
    return i.select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "item")


@query("join_8_mention_to_item", f"WITH {ITEMS_SQL} SELECT h.doc_id, h.skill_key, h.start, it.start AS item_start FROM hit h JOIN it ON it.doc_id = h.doc_id AND h.start >= it.start AND h.start < it.start + length(it.item)")
def join_8(spark, sf):
    h = st.located(hits(spark, sf), layout(spark, sf, "spans")).filter("it is not null")
    return h.select("doc_id", "skill_key", F.col("start").cast("bigint").alias("start"), F.col("it.start").cast("bigint").alias("item_start"))


@query("win_9_sentence_window", """
WITH t AS (SELECT conv_id, turn, replace(text, chr(10), ' ') AS t FROM conversations),
p AS (SELECT conv_id, turn, string_split(regexp_replace(t, '([.!?])(\\s+)([A-ZÀ-ÖØ-Þ0-9"''(])', '\\1' || chr(1) || '\\2\\3', 'g'), chr(1)) AS p FROM t),
e AS (SELECT conv_id, turn, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM p),
s AS (SELECT conv_id, turn, i, sum(length(piece)) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING) - length(ltrim(piece)) AS s, rtrim(ltrim(piece)) AS x FROM e)
SELECT conv_id, turn, s::BIGINT AS start, (min(s) OVER w)::BIGINT AS window_start, (max(s + length(x)) OVER w)::BIGINT AS window_end FROM s WHERE x <> '' WINDOW w AS (PARTITION BY conv_id, turn ORDER BY s ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def win_9(spark, sf):
    from proofgrid.operators.evidence import sentence_windows
    from proofgrid.plans.base import turns

    c = turns(spark, sf).select("conv_id", "turn", F.translate("text", "\n", " ").alias("flat"))
    return sentence_windows(c, ["conv_id", "turn"], "flat").select("conv_id", "turn", *[F.col(x).cast("bigint").alias(x) for x in ("start", "window_start", "window_end")])


PERIODS_SQL = """
pr AS (SELECT o_custkey AS c, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS s, year(o_orderdate) * 12 + month(o_orderdate) - 1 + o_orderkey % 9 AS e FROM orders),
q1 AS (SELECT *, max(e) OVER (PARTITION BY c ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pr),
q2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM q1),
isl AS (SELECT c, island, min(s) AS s, max(e) AS e FROM q2 GROUP BY c, island)"""


def order_periods(spark, sf):
    o = table(spark, sf, "orders")
    s = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("bigint")
    return o.select(F.col("o_custkey").alias("c"), s.alias("start_ord"), (s + F.pmod("o_orderkey", F.lit(9))).alias("end_ord"))


@query("win_5_interval_merge", f"WITH {PERIODS_SQL} SELECT c, s::BIGINT AS start_ord, e::BIGINT AS end_ord FROM isl")
def win_5(spark, sf):
    return iv.merge_intervals(order_periods(spark, sf), ["c"], "start_ord", "end_ord").select("c", "start_ord", "end_ord")


@query("agg_9_years_of_practice", f"""
WITH {PERIODS_SQL}, y AS (SELECT c, round_even(sum(e - s) * 10 / 12.0, 0)::BIGINT AS tenths FROM isl GROUP BY c)
SELECT c_custkey AS c, tenths, CASE WHEN tenths IS NULL THEN 'non_documente' WHEN tenths >= (1 + c_nationkey % 5) * 10 THEN 'confirme_demontre' WHEN tenths * 10 >= (1 + c_nationkey % 5) * 60 THEN 'partiellement_demontre' ELSE 'declare_sans_preuve' END AS level
FROM customer LEFT JOIN y ON y.c = c_custkey""")
def agg_9(spark, sf):
    from proofgrid.functions.levels import level_name

    y = st.years_of_practice(order_periods(spark, sf), ["c"])
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("c"), ((1 + F.pmod("c_nationkey", F.lit(5))) * 10).alias("need"))
    return c.join(y, "c", "left").select("c", "tenths", level_name(st.years_level(F.col("tenths"), F.col("need"))).alias("level"))


@query("agg_34_declared_gap", f"""
WITH {EXP_SQL}, q1 AS (SELECT doc_id, so, eo, max(eo) OVER (PARTITION BY doc_id ORDER BY so, eo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM xp WHERE so IS NOT NULL),
q2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR so > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY so, eo ROWS UNBOUNDED PRECEDING) AS island FROM q1),
y AS (SELECT doc_id, round_even(sum(e - s) * 10 / 12.0, 0)::BIGINT AS tenths FROM (SELECT doc_id, island, min(so) AS s, max(eo) AS e FROM q2 GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, doc_id % 20 AS declared, tenths, doc_id % 20 > 0 AND abs(doc_id % 20 * 10 - tenths) > 20 AS gap FROM y""")
def agg_34(spark, sf):
    p = profile_texts(spark, sf)
    y = st.years_of_practice(st.experiences(p, TODAY), ["doc_id"])
    d = p.select("doc_id", st.declared_years(F.col("text")).cast("bigint").alias("declared"))
    gap = (F.col("declared") > 0) & (F.abs(F.col("declared") * 10 - F.col("tenths")) > 20)
    return d.join(by_shuffle(y), "doc_id").select("doc_id", "declared", "tenths", gap.alias("gap"))
