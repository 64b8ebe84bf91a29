"""Need texts to requirements, titles and modalities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.functions import levels as lv
from proofgrid.functions import text as tx
from proofgrid.operators.filters import ordered_distinct
from proofgrid.operators.mentions import best_role, mentions, uncovered_skills
from proofgrid.operators.scale import broadcast_if_small, by_shuffle, top_rows


def title_pool(needs: DataFrame, roles: DataFrame, imposed: DataFrame, key: str, title: str) -> DataFrame:
    """Titles to search for: those of a neighbouring family whose lead activity is imposed, then the family's, then wider ones.

    imposed(key, skill_key) lists the imposed activities of a need.
    """
    family = best_role(needs, roles, key, title)
    lead = roles.select(F.col("role_key").alias("other"), "titles", "wide_titles", F.get("discriminants", F.lit(0)).alias("skill_key"), F.col("ord").alias("fam"))
    near = imposed.join(broadcast_if_small(lead), "skill_key").join(by_shuffle(family), key).filter(F.col("other") != F.col("role_key"))
    own = family.join(broadcast_if_small(roles.select("role_key", "titles", "wide_titles")), "role_key").withColumn("fam", F.lit(0))

    def rows(df: DataFrame, column: Column, rank: int) -> DataFrame:
        return df.select(key, F.lit(rank).alias("rk"), "fam", F.posexplode(column).alias("pos", "term"))

    pool = (
        rows(near, F.slice("titles", 1, 2), 0).unionByName(rows(own, F.col("titles"), 1))
        .unionByName(rows(own, F.col("wide_titles"), 2)).unionByName(rows(near, F.slice("wide_titles", 1, 2), 3))
    )
    return ordered_distinct(pool, [key], "term", ["rk", "fam", "pos"])


# Sections of a need (name, pattern on a folded line) and their order.
SECTIONS = [
    ("mandatory", "imperatifs?|obligatoires?|indispensables?|requis(?:e|es)?\\b|prerequis|must[- ]have|incontournables?|competences requises|exigences"),
    ("desired", "souhait|apprecie|nice[- ]to[- ]have|atouts?\\b|bonus|\\bplus\\b"),
    ("modalities", "modalites|conditions|localisation|lieu|duree|demarrage|teletravail|tjm|budget|presence|astreintes?"),
    ("tasks", "missions?\\b|responsabilit|activites|\\brole\\b|livrables?|objectifs?|perimetre|vos missions"),
    ("context", "contexte|presentation|environnement|\\bstack\\b|enjeux|\\bprojet\\b"),
    ("profile", "profil|competences|experience|technologies"),
]
# Markers of the category of a requirement, of depth and of groups.
ELIMINATORY_RX = "eliminatoire|redhibitoire|no[- ]go|non negociable|sans cela pas|sans quoi pas"
IMPERATIVE_RX = "imperatif|indispensable|obligatoire|incontournable|\\bexige|\\brequis|doit (?:imperativement )?(?:avoir|maitriser|justifier)|must[- ]have|mandatory|necessaire|absolument|imperativement"
DIFFERENTIATING_RX = "fortement (?:apprecie|souhaite|differenciant|recommande)|tres important|differenciant|forte valeur ajoutee|atout majeur|prioritaire|\\bcle\\b|determinant"
DESIRED_RX = "souhait|apprecie|serait un plus|\\bun plus\\b|ideal|nice[- ]to[- ]have|\\batout\\b|bonus|de preference|\\bplus\\b"
NOT_NEEDED_RX = "(?:pas|aucune?|non)\\s+(?:de\\s+|d')?(?:necessite|obligation|exigence)|pas\\s+(?:absolument\\s+)?(?:necessaire|obligatoire|indispensable|requis)|n'est pas\\s+(?:une\\s+)?(?:exigence|obligatoire|necessaire|requis)"
ADVANCED_RX = "avance|approfondi|expert|expertise|solide|forte? |confirme|poussee|significative|reelle experience|conception"
GROUP_RX = "(plusieurs|au moins (\\d|deux|trois|quatre|cinq)|l'une|une partie)\\s+de\\s+(?:ces|cette|ses)\\s+(?:technologies|outils|solutions|produits|competences|plateformes)"
NUMBER_WORDS = {"un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6, "sept": 7, "huit": 8, "neuf": 9, "dix": 10}
YEARS_RX = "(\\d{1,2})\\s*(?:a\\s*\\d{1,2}\\s*)?\\+?\\s*(?:ans|annees|years)"
EXPECTED_FIELDS = ["onsite_days_per_week", "city", "duration", "start", "tjm_max", "astreinte", "english"]
STATED_NOWHERE = "Non communiqué"


def need_section(line: Column) -> Column:
    """Section opened by a short heading line, or null."""
    t = F.trim(line)
    f = F.trim(tx.fold(line), F.lit(" :#*-—\t"))
    upper = (F.upper(t) == t) & t.rlike("\\p{L}")
    shaped = t.endswith(":") | upper | t.startswith("#") | (F.size(F.split(f, "\\s+")) <= 5)
    named = None
    for name, rx in SECTIONS:
        named = F.when(f.rlike(rx), name) if named is None else named.when(f.rlike(rx), name)
    head = (f != "") & (F.length(f) <= 70) & ~f.endswith(".") & shaped
    return F.when(head & (t.endswith(":") | upper | (F.length(t) < 45)), named)


def blocks(needs: DataFrame, key: str = "mission_id", text: str = "text") -> DataFrame:
    """Sentences and bullets of a need with their section; text after the colon of a heading is kept."""
    l = needs.select(key, F.posexplode(F.split(tx.normalize_text(F.col(text)), "\n")).alias("line_no", "line")).filter(F.trim("line") != "")
    l = l.withColumn("head", need_section(F.col("line")))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(w), F.lit("none")))
    rest = F.trim(F.regexp_replace("line", "^[^:]*:?", ""))
    l = l.withColumn("body", F.when(F.col("head").isNull(), F.col("line")).when(F.contains("line", F.lit(":")) & (F.length(rest) > 2), rest)).filter("body is not null")
    s = l.select(key, "line_no", "section", F.posexplode(F.split("body", "(?<=[.!?;])\\s+")).alias("part", "sent"))
    s = s.withColumn("sent", F.trim("sent", F.lit(" -–—•*·▪►→\t"))).filter(F.col("sent") != "")
    return s.withColumn("sent_no", F.col("line_no").cast("bigint") * 4294967296 + F.col("part")).select(key, "sent_no", "section", "sent", tx.fold_compact(F.col("sent")).alias("f"))


def category(section: Column, f: Column) -> Column:
    """Category of a requirement: explicit markers first, then the section."""
    return (
        F.when(f.rlike(NOT_NEEDED_RX), lv.CONTEXTUAL).when(f.rlike(ELIMINATORY_RX), lv.ELIMINATORY).when(f.rlike(IMPERATIVE_RX), lv.IMPERATIVE)
        .when(f.rlike(DIFFERENTIATING_RX), lv.DIFFERENTIATING).when(f.rlike(DESIRED_RX), lv.DESIRED).when(section == "mandatory", lv.IMPERATIVE)
        .when(section == "desired", lv.DESIRED).when(section == "context", lv.CONTEXTUAL).when(section == "tasks", lv.DIFFERENTIATING).otherwise(lv.TO_CLARIFY)
    )


def number_word(value: Column) -> Column:
    return F.coalesce(value.try_cast("int"), lv.lookup(NUMBER_WORDS, value).cast("int"))


def group_lines(b: DataFrame, key: str = "mission_id") -> DataFrame:
    """"k among n" lines: how many of the technologies named before in the section are required."""
    word, count = F.regexp_extract("f", GROUP_RX, 1), F.regexp_extract("f", GROUP_RX, 2)
    cat = F.when(F.col("f").rlike(ELIMINATORY_RX), lv.ELIMINATORY).when(F.col("f").rlike(IMPERATIVE_RX) | (F.col("section") == "mandatory"), lv.IMPERATIVE).otherwise(lv.DIFFERENTIATING)
    at_least = F.when(word == "plusieurs", 2).otherwise(F.coalesce(number_word(count), F.lit(1)))
    return b.filter(F.col("f").rlike(GROUP_RX)).select(key, "section", F.col("sent_no").alias("group_sent"), at_least.alias("at_least"), cat.alias("group_category"))


def requirement_mentions(b: DataFrame, lexicon: DataFrame, key: str = "mission_id") -> DataFrame:
    """(need, skill) mentions with category, depth and negation; members named before a group line are demoted."""
    hits = mentions(b.filter(~F.col("f").rlike(GROUP_RX)), lexicon, (key, "sent_no"), "sent")
    found = uncovered_skills(hits, [key, "sent_no"]).select(key, "sent_no", "skill_key")
    info = broadcast_if_small(lexicon.select("skill_key", "kind", F.size("advanced_terms").alias("n_advanced")))
    r = found.join(by_shuffle(b), [key, "sent_no"]).join(info, "skill_key")
    r = r.withColumn("category", category(F.col("section"), F.col("f"))).withColumn("negated", F.col("f").rlike(NOT_NEEDED_RX))
    r = r.withColumn("depth", F.when(F.col("f").rlike(ADVANCED_RX) & (F.col("n_advanced") > 0), "advanced").otherwise("practice"))
    r = r.withColumn("imposed", F.col("category").isin(lv.IMPERATIVE, lv.ELIMINATORY))
    g = group_lines(b, key).groupBy(key, "section").agg(F.max("group_sent").alias("group_sent"))
    r = r.join(by_shuffle(g), [key, "section"], "left")
    member = (F.col("sent_no") < F.col("group_sent")) & F.col("kind").isin("tech", "product")
    r = r.withColumn("member", F.coalesce(member, F.lit(False)))
    return r.withColumn("category", F.when(F.col("member") & F.col("imposed"), lv.DIFFERENTIATING).otherwise(F.col("category")))


def strongest_requirements(r: DataFrame, key: str = "mission_id") -> DataFrame:
    """One row per (need, skill): the strongest category, the earliest mention on a tie; advanced depth is kept; imposed and denied becomes to clarify."""
    order = F.struct(lv.strength(F.col("category")), -F.col("sent_no"))
    out = r.groupBy(key, "skill_key").agg(
        F.max_by("category", order).alias("strongest"), F.max(F.when(F.col("depth") == "advanced", 1).otherwise(0)).alias("_adv"),
        F.bool_or("negated").alias("_neg"), F.bool_or(F.col("imposed") & ~F.col("negated")).alias("_pos"), F.bool_or("member").alias("member"),
    )
    ambiguous = F.col("_neg") & F.col("_pos")
    return out.select(
        key, "skill_key", F.when(ambiguous, lv.TO_CLARIFY).otherwise(F.col("strongest")).alias("category"), F.when(F.col("_adv") == 1, "advanced").otherwise("practice").alias("depth"),
        ambiguous.alias("ambiguous"), "member",
    )


def activities(r: DataFrame, key: str = "mission_id") -> DataFrame:
    """How often an activity is named, and whether among the tasks."""
    return r.filter(F.col("kind") == "activity").groupBy(key, "skill_key").agg(F.count("*").alias("mentions"), F.bool_or(F.col("section") == "tasks").alias("in_tasks"))


def title_mismatch(acts: DataFrame, families: DataFrame, roles: DataFrame, key: str = "mission_id") -> DataFrame:
    """Described activities that are no discriminant of the family of the title."""
    known = roles.select("role_key", F.explode("discriminants").alias("skill_key"))
    typed = acts.filter("in_tasks").join(by_shuffle(families), key)
    return typed.join(broadcast_if_small(known), ["role_key", "skill_key"], "left_anti").select(key, "role_key", "skill_key")


def seniority(b: DataFrame, key: str = "mission_id") -> DataFrame:
    """Required years and their category."""
    years = F.regexp_extract("f", YEARS_RX, 1)
    hit = b.filter((years != "") & F.col("f").rlike("experience|exp\\b|minimum|au moins|seniorite|years") & ~F.col("f").rlike("duree|mission de|renouvel"))
    cat = category(F.col("section"), F.col("f"))
    cat = F.when((cat == lv.CONTEXTUAL) & ~F.col("f").rlike(NOT_NEEDED_RX), lv.TO_CLARIFY).otherwise(cat)
    first = hit.select(key, "sent_no", years.cast("int").alias("years"), cat.alias("category"))
    return first.groupBy(key).agg(F.min_by("years", "sent_no").alias("years"), F.min_by("category", "sent_no").alias("category"))


# Patterns of working conditions, on folded text unless named "cased"; group 1 is the value.
CONDITIONS = {
    "no_on_call": "(?:pas d'|sans |aucune )astreintes?",
    "on_call": "astreintes?",
    "duration": "(?:duree|mission de|renouvelable|initiale(?:ment)? de|pour)\\s*[:=]?\\s*(\\d{1,2}\\s*(?:mois|ans|semaines))",
    "start_now": "demarrage\\s*[:=]?\\s*(?:asap|des que possible)|asap",
    "start": "(?:demarrage|debut|start)\\s*(?:de la mission)?\\s*[:=]?\\s*((?:le\\s*)?\\d{1,2}[/.]\\d{1,2}[/.]\\d{2,4}|[a-zéûô]+\\s+\\d{4})",
    "city_on_site_cased": "(?:sur site|sur place|en pr[ée]sentiel)\\s*(?:[aàâ]|en|:)\\s*([A-ZÀ-Ý][\\wÀ-ÿ'’\\- ]{2,30})",
    "city_cased": "(?:localisation|lieu(?: de mission)?|ville)\\s*[:=]\\s*([A-ZÀ-Ý][\\wÀ-ÿ'’\\- ]{2,30})",
    "city_end": "[,.;\\n(]| et | - ",
    "english": "anglais",
    "english_level": "anglais\\s*(courant|professionnel|bilingue|fluent|operationnel|b2|c1|c2)",
    "english_word": "\\benglish\\b",
    "onsite": "(\\d)\\s*jours?\\s*(?:par semaine\\s*|/\\s*semaine\\s*)?(?:sur site|sur place|en presentiel|de presence)",
    "remote": "(\\d)\\s*jours?\\s*(?:de\\s*)?teletravail",
    "full_remote": "full remote|100\\s*%\\s*remote|100\\s*%\\s*teletravail|teletravail complet",
    "rate": "(?:tjm|budget|taux journalier)\\s*(?:max(?:imum)?|cible|client|propose)?\\s*[:=]?\\s*(?:jusqu'a|<=|max)?\\s*(\\d{3,4})",
    "team": (
        "(?:encadrement|encadrer|manag\\w+|animation)\\s*(?:technique\\s*)?(?:de|d')\\s*(\\d+|un|une|deux|trois|quatre|cinq|six|sept|huit)\\s*"
        "(?:developpeurs?|personnes|collaborateurs|ingenieurs|devs?)"
    ),
    "time_zone": "fuseau horaire|timezone|time zone|decalage horaire",
    "time_zone_cased": "\\b(?:GMT|UTC|CEST|CET|EST|PST|IST)\\b",
}
ENGLISH_UNSTATED = "demandé (niveau non précisé)"


def modalities(text: Column) -> Column:
    """struct of the working conditions stated in a need; null where nothing is stated."""

    def read(f: Column) -> Column:
        named = lambda name: (text if name.endswith("_cased") else f).rlike(CONDITIONS[name])

        def value(name: str) -> Column:
            v = F.regexp_extract(text if name.endswith("_cased") else f, CONDITIONS[name], 1)
            return F.when(v != "", v)

        number = lambda name: value(name).cast("int")
        english = F.when(named("english"), F.coalesce(value("english_level"), F.lit(ENGLISH_UNSTATED))).when(named("english_word"), ENGLISH_UNSTATED)
        city = F.coalesce(value("city_on_site_cased"), value("city_cased"))
        return F.struct(
            number("onsite").alias("onsite_days_per_week"), number("remote").alias("remote_days_per_week"), named("full_remote").alias("full_remote"),
            F.trim(F.get(F.split(city, CONDITIONS["city_end"]), F.lit(0))).alias("city"),
            F.when(named("no_on_call"), False).when(named("on_call"), True).alias("astreinte"),
            F.regexp_replace(value("duration"), "^(\\d+)\\s*", "$1 ").alias("duration"),
            F.when(named("start_now"), "ASAP").otherwise(F.trim(value("start"))).alias("start"),
            number("rate").alias("tjm_max"), english.alias("english"), number_word(value("team")).alias("team_size_managed"),
            (named("time_zone") | named("time_zone_cased")).alias("timezone_constraint"),
        )

    return tx.let(tx.fold_compact(text), read)


def missing_fields(m: Column) -> Column:
    """Expected fields that were not found; the presence question is moot for a remote need."""
    gone = F.filter(F.array(*[F.when(m[name].isNull(), F.lit(name)) for name in EXPECTED_FIELDS]), lambda x: x.isNotNull())
    return F.when(m["full_remote"], F.array_remove(gone, "onsite_days_per_week")).otherwise(gone)


def not_superseded(reqs: DataFrame, mission: str = "mission_id") -> DataFrame:
    """Active requirements that no source of rank one or two replaces explicitly."""
    live = reqs.filter(F.col("status") == "active")
    over = live.filter((F.col("rank") <= 2) & F.col("supersedes").isNotNull()).select(mission, F.col("supersedes").alias("req_id")).distinct()
    return live.join(over, [mission, "req_id"], "left_anti")


def resolve(reqs: DataFrame, mission: str = "mission_id", ties: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Effective requirement per key (authority, then date) and the conflicts between sources.

    A row replaced explicitly by a source of rank one or two is left out first. ``ties`` are columns that decide between
    rows of one rank, date and id, where ids are not unique.
    """
    rest = not_superseded(reqs, mission)
    order = F.struct(F.col("rank"), F.date_diff(F.lit("9999-12-31").cast("date"), F.col("source_date")), F.col("req_id"), *[F.col(c) for c in ties])
    per_cat = rest.groupBy(mission, "key", "category").agg(F.min(order).alias("o"), F.max("source_date").alias("newest"), F.min_by("source_date", order).alias("date"), F.count("*").alias("n"))
    per_key = per_cat.groupBy(mission, "key").agg(
        F.min_by(F.struct("category", "date", F.col("o.req_id").alias("req_id")), "o").alias("kept"), F.sum("n").alias("rows"),
        F.collect_list(F.struct("category", "newest")).alias("cats"),
    )
    others = F.filter("cats", lambda c: c["category"] != F.col("kept.category"))
    review = F.exists(others, lambda c: c["newest"] > F.col("kept.date"))
    effective = per_key.select(mission, "key", "kept.req_id", "kept.category")
    conflicts = per_key.filter(F.size(others) > 0).select(mission, "key", "kept.req_id", review.alias("needs_review"))
    return effective, conflicts


def leading_lines(b: DataFrame, key: str = "mission_id", context: int = 6, objectives: int = 8) -> DataFrame:
    """First context and objective lines of a need."""
    is_context = F.col("section") == "context"
    is_goal = (F.col("section") == "tasks") | F.col("f").rlike("objectif|afin de|livrable|mission")
    c = top_rows(b.filter(is_context), [key], [F.col("sent_no")], context).withColumn("part", F.lit("context"))
    o = top_rows(b.filter(is_goal), [key], [F.col("sent_no")], objectives).withColumn("part", F.lit("objective"))
    return c.unionByName(o).select(key, "part", "rn", "sent")


def description(m: Column, title: Column) -> Column:
    """Text for a candidate: stated conditions, and an explicit default where nothing was communicated."""
    nc = F.lit(STATED_NOWHERE)
    say = lambda label, value: F.concat(F.lit(label), F.coalesce(value, nc))
    return F.concat_ws(
        "\n", title,
        say("- localisation : ", m["city"]),
        say("- presence : ", F.concat(m["onsite_days_per_week"].cast("string"), F.lit(" jour(s) par semaine sur site"))),
        say("- teletravail : ", F.coalesce(F.concat(m["remote_days_per_week"].cast("string"), F.lit(" jour(s) par semaine")), F.when(m["full_remote"], "Full remote"))),
        say("- duree : ", m["duration"]), say("- demarrage : ", m["start"]), say("- astreintes : ", F.when(m["astreinte"], "Oui").when(~m["astreinte"], "Non")),
        say("- tjm : ", F.concat(m["tjm_max"].cast("string"), F.lit(" € (maximum communiqué)"))), say("- langues : ", m["english"]),
    )


def fill_only(old: Column, new: Column) -> Column:
    """Attribute map with later values only where the earlier one has none."""
    return F.map_concat(F.map_filter(new, lambda k, v: ~F.map_contains_key(old, k)), old)
