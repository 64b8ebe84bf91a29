"""Conversation notes to utterances, facts, evidence and re-evaluated levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.functions import levels as lv
from proofgrid.functions import scope as sp
from proofgrid.functions import text as tx
from proofgrid.operators.evidence import analyse_mentions, depth_patterns
from proofgrid.operators.intervals import contained_in_longer
from proofgrid.operators.mentions import mentions
from proofgrid.operators.scale import broadcast_if_small, by_shuffle, composed_in_order, computed_once, in_order
from proofgrid.session import durable

# Speaker labels and roles, labels of form fields, cues of facts.
SPEAKER = "^\\s*(?:\\[?\\d{1,2}:\\d{2}(?::\\d{2})?\\]?\\s*)?(?:\\*\\*)?([A-ZÀ-Ý][\\wÀ-ÿ'’.()\\- ]{0,38}?)(?:\\*\\*)?\\s*[:：]\\s+(\\S.*)$"
ROLE_HINTS = {
    "candidate": ["candidat", "freelance", "consultant", "prestataire", "independant"],
    "recruiter": ["recruteur", "recruteuse", "talent", "recrutement", "tm", "rh"],
    "client": ["client", "dsi", "manager", "hiring", "responsable", "directeur", "directrice"],
    "sales": ["commercial", "commerciale", "sales", "account", "kam", "ingenieur d'affaires", "bm"],
}
GENERIC_SPEAKER = "^(?:speaker|locuteur|locutrice|intervenant\\w*|interlocuteur|interlocutrice|participant)\\s*\\d*$"
FIELD_LABEL = (
    "\\b(?:tjm|taux|disponibilite|dispo|preavis|localisation|mobilite|teletravail|salaire|remuneration|statut|contexte|resume|note|notes|remarques?|"
    "conclusion|a\\s+verifier|questions?|prochaine?s?\\s+etapes?|competences?|experience|projet|mission|date|lieu|duree|objet|sujet)\\b"
)
REQUIREMENT_CUE = (
    "\\b(?:le\\s+client|ils?|elle|il)\\s+(?:veut|veulent|souhaite|souhaitent|exige|exigent|demande|demandent|cherche|cherchent|attend|attendent|precise|precisent|insiste|aimerait|prefererait)\\b|"
    "\\bc'est\\s+(?:imperatif|obligatoire|indispensable|eliminatoire)\\b|\\bimperatif\\b|\\bindispensable\\b|\\bobligatoire\\b|\\bil\\s+(?:nous\\s+|leur\\s+)?faut\\b|\\bil\\s+(?:nous\\s+|leur\\s+)?faudrait\\b|"
    "\\bexige\\b|\\bvient\\s+de\\s+preciser\\b"
)
STRONG_CUE = "imperatif|indispensable|obligatoire|exige|exigent|absolument|incontournable|non\\s+negociable|eliminatoire|veut|veulent|doit"
DIFFERENTIATING_CUE = "fortement|tres\\s+important|differenciant|prioritaire|determinant|prefere"
SOFT_CUE = "souhait|aimerait|serait\\s+un\\s+plus|ideal|apprecie"
LIMIT_CUE = (
    "\\bne\\s+\\w+(?:\\s+\\w+)?\\s+que\\b|\\bn'(?:a|ai|avait|avais|etait|etais)\\s+(?:\\w+\\s+){0,3}que\\b|seulement|uniquement|\\bjuste\\b|simplement|a\\s+la\\s+marge|en\\s+peripherie|"
    "\\bun\\s+peu\\s+de\\b|\\bquelques\\b|une\\s+seule\\s+fois|\\bcontributeur\\b|n'(?:etait|etais)\\s+pas\\s+(?:l')?(?:architecte|decisionnaire|responsable)|"
    "pas\\s+decisionnaire|n'(?:avait|avais)\\s+pas\\s+la\\s+main|sans\\s+responsabilite|participe\\s+seulement|"
    "\\bonly\\b|\\bjust\\b(?!\\s+in\\s+time)|\\bmerely\\b|\\blimited\\s+to\\b|\\bse\\s+limite\\w*\\b|\\bse\\s+resume\\w*\\b|\\blimite\\w*\\s+a\\b|\\brien\\s+que\\b|\\ba\\s+peine\\b|"
    "\\ba\\s+couple\\s+of\\b|\\ba\\s+few\\b|\\bone\\s+or\\s+two\\b|\\bun\\s+ou\\s+deux\\b|\\bpas\\s+plus\\s+de\\b"
)
DIRECT_ABSENCE = (
    "\\bjamais\\s+(?:utilise|travaille|touche|pratique|manipule|use|worked|touched)|\\b(?:pas|aucune?)\\s+d'?\\s*experience|\\baucune?\\s+(?:experience|pratique|connaissance)|"
    "\\bne\\s+(?:connais|connait|maitrise|pratique)\\s+pas\\b|\\bno\\s+(?:prior\\s+|hands-on\\s+)?experience\\b|\\bnever\\s+(?:used|worked|touched)\\b|\\bsans\\s+experience\\b|\\bjamais\\s+pratique"
)
SPECIFIC_ACTIVITY = (
    "\\b(?:administr\\w*|configur\\w*|deploy\\w*|deploi\\w*|migr\\w*|exploit\\w*|optimis\\w*|supervis\\w*|install\\w*|parametr\\w*|automatis\\w*|"
    "monitor\\w*|tun(?:e|ing)\\b|conc\\w*|develop\\w*|implement\\w*|mis\\s+en\\s+place|manag\\w*|operat\\w*|built|designed|set\\s+up)\\b"
)
CLIENT_SUBJECT = (
    "\\b(?:le\\s+|la\\s+)?client(?:e)?\\s+(?:\\w+\\s+){0,2}?(?:veut|veulent|exige|exigent|demande|demandent|cherche|cherchent|attend|attendent|souhaite|souhaitent|impose|precise|precisent|insiste)\\b|"
    "\\b(?:the\\s+)?client\\s+(?:wants|requires|requests|needs|expects|insists)\\b"
)
HEDGE = "je\\s+crois|peut-?etre|il\\s+me\\s+semble|\\benviron\\b|a\\s+peu\\s+pres|plus\\s+ou\\s+moins|de\\s+memoire|je\\s+pense|je\\s+ne\\s+sais\\s+plus|sans\\s+doute|probablement|si\\s+je\\s+me\\s+souviens"
WISH = "je\\s+voudrais|je\\s+souhaite|j'aimerais|je\\s+cherche|je\\s+vais\\b|j'envisage|je\\s+compte|je\\s+recherche"
REFUSAL = "refuse|pas question|ne veux pas|n'accepte pas|impossible pour moi|hors de question"
REFUSABLE = {"astreinte": "astreintes?", "onsite": "presentiel|sur site|sur place", "travel": "deplacements?"}
NOTE_RELIABILITY = {"candidate_call_note": "explique_en_appel", "transcript": "explique_en_appel", "interview_report": "confirme_en_entretien", "complementary_doc": "document_complementaire"}
NOTE_SOURCE = {
    "candidate_call_note": "note_appel_candidat", "transcript": "transcription", "client_brief_note": "note_brief_client", "interview_report": "compte_rendu_entretien",
    "client_feedback": "feedback_client", "complementary_doc": "document_complementaire",
}
DIMENSIONS = {
    "tech": ("technique", "skill"), "product": ("technique", "skill"), "activity": ("responsabilite", "activity"), "domain": ("contexte_metier", "domain"), "method": ("methodologie", "skill"), "soft": ("contrainte", "language"),
}
SUPPORTS, LIMITS, CONTRADICTS, CAPS = "supporte", "limite", "contredit", "plafonne"
HYPOTHESIS, UNSUPPORTED = "hypothese", "declaration_non_etayee"


def speaker_role(label: Column) -> Column:
    """Role hinted by a speaker label."""
    f = tx.fold(label)
    out = None
    for role, words in ROLE_HINTS.items():
        hit = f.rlike("\\b(?:" + "|".join(words) + ")\\b")
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out.otherwise("unknown")


def plausible_speaker(label: Column) -> Column:
    """A form field ("TJM : 650") or a label with digits does not take the floor."""
    f = F.trim(tx.fold(label))
    known = (speaker_role(label) != "unknown") | f.rlike(GENERIC_SPEAKER)
    return (F.size(F.split(F.trim(label), "\\s+")) <= 4) & (known | (~f.rlike(FIELD_LABEL) & ~label.rlike("\\d")))


def utterances(notes: DataFrame, key: str = "note_id", text: str = "text") -> DataFrame:
    """Speaker turns; a line without a label continues the turn before it."""
    l = notes.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "raw")).filter(F.trim("raw") != "")
    label = F.regexp_extract("raw", SPEAKER, 1)
    l = l.withColumn("label", F.when((label != "") & plausible_speaker(label), F.trim(label)))
    l = l.withColumn("said", F.when(F.col("label").isNotNull(), F.regexp_extract("raw", SPEAKER, 2)).otherwise(F.trim("raw")))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("turn", F.sum(F.col("label").isNotNull().cast("int")).over(w))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "said"))), lambda x: x["said"]), " ")
    u = l.groupBy(key, "turn").agg(F.coalesce(F.max("label"), F.lit("")).alias("speaker"), said.alias("text"))
    return u.withColumn("role", speaker_role(F.col("speaker")))


# Patterns of constraints in folded sentences; their groups hold the value.
STATED = {
    "now": "immediatement disponible|disponible immediatement|dispo immediatement|\\bdisponibilite\\s*[:\\-]?\\s*immediate",
    "available": "\\bdisponibilite\\s*[:\\-]\\s*(?:a partir (?:du|de)\\s+)?([\\w/]+(?:\\s+[\\w/]+){0,2})",
    "available_from": "(?:disponible|dispo)\\s+(?:a partir (?:du|de)|des|le|en)\\s+([\\w/]+(?:\\s+[\\w/]+){0,2})",
    "next_words": "\\s+(?:mon|ma|mes|et|je|mais)\\b.*$",
    "notice": "preavis\\s+(?:de\\s+)?(\\d+)\\s*(mois|semaines?)",
    "rate": (
        "(?:tjm|taux journalier)\\s*(?:est\\s*)?(?:de|:|a|autour de|vers|cible)?\\s*(\\d{3,4})|"
        "(\\d{3,4})\\s*(?:€|euros?)\\s*(?:/\\s*j|par\\s+jour|jour)"
    ),
    "onsite_most": "(?:maximum|max|pas plus de|jusqu'a)\\s*(\\d)\\s*jours?\\s*(?:de\\s+)?(?:sur site|presentiel|sur place)",
    "onsite": "(\\d)\\s*jours?\\s*(?:par semaine\\s*)?(?:de\\s+)?(?:sur site|presentiel|sur place)",
    "agrees_onsite": "\\b(?:ok|accepte|possible|pas de probleme|d'accord)\\b",
    "on_call": "astreintes?",
    "agrees_on_call": "\\b(?:ok|accepte|pas de probleme|d'accord|sans souci)\\b",
}


def constraint_values(f: Column) -> Column:
    """Constraints stated in a folded sentence: array<struct<field,value>>."""

    def value(name: str, group: int = 1) -> Column:
        v = F.regexp_extract(f, STATED[name], group)
        return F.when(v != "", v)

    says = lambda name: f.rlike(STATED[name])
    item = lambda field, v: F.when(v.isNotNull(), F.struct(F.lit(field).alias("field"), v.alias("value")))
    when = lambda name: F.regexp_replace(F.trim(value(name)), STATED["next_words"], "")
    refuses = f.rlike(REFUSAL)
    found = F.array(
        item("availability", F.coalesce(F.when(says("now"), F.lit("immediate")), when("available"), when("available_from"))),
        item("availability", F.concat(F.lit("préavis "), value("notice"), F.lit(" "), value("notice", 2))),
        item("tjm", F.coalesce(value("rate"), value("rate", 2))),
        item("onsite_max_days", F.coalesce(value("onsite_most"), F.when(says("agrees_onsite"), value("onsite")))),
        *[item("refuses", F.when(refuses & f.rlike(rx), F.lit(name))) for name, rx in REFUSABLE.items()],
        item("accepts_astreinte", F.when(~refuses & says("on_call") & says("agrees_on_call"), F.lit("true"))),
    )
    return F.filter(found, lambda x: x.isNotNull())


def note_sentences(u: DataFrame, key: str = "note_id") -> DataFrame:
    """Statements of the turns with their cues; questions are left out."""
    s = u.select(key, "turn", "speaker", "role", F.posexplode(tx.sentences(F.col("text"))).alias("sent_no", "s"))
    s = s.select(key, "turn", "speaker", "role", "sent_no", F.col("s.text").alias("sent")).filter(~F.rtrim("sent").endswith("?"))
    s = computed_once(s, f=tx.fold_compact(F.col("sent")))
    s = computed_once(s, explicit_client=F.col("f").rlike(CLIENT_SUBJECT), cue=F.col("f").rlike(REQUIREMENT_CUE), hedged=F.col("f").rlike(HEDGE), wish=F.col("f").rlike(WISH))
    candidate = F.col("role").isin("candidate", "candidate_reported")
    requirer = F.col("role").isin("client", "recruiter", "sales", "client_relayed") | F.col("explicit_client") | ((F.col("role") == "unknown") & F.col("cue"))
    wish = F.col("wish") & candidate
    speaks = candidate | (F.col("role") == "unknown")
    s = computed_once(s, constraints=F.when(speaks, constraint_values(F.col("f"))).otherwise(F.array().cast("array<struct<field:string,value:string>>")))
    kind = (
        F.when(requirer & (F.col("cue") | F.col("explicit_client")), "client_requirement").when(wish, "wish")
        .when(F.size("constraints") > 0, "candidate_constraint").when(speaks, "candidate_experience").otherwise("other")
    )
    return computed_once(s, kind=kind).drop("wish")


def facts(notes: DataFrame, lexicon: DataFrame, today: str, key: str = "note_id", text: str = "text") -> DataFrame:
    """Typed facts: client requirements (never a skill of the candidate), candidate constraints, candidate experience with its level."""
    ids = [key, "turn", "sent_no"]
    said = note_sentences(utterances(notes, key, text), key).filter(F.col("kind").isin("client_requirement", "candidate_experience", "candidate_constraint"))
    # mentions and all three kinds of facts read the sentences: they are cut once
    s = durable(said.select(*ids, "role", "kind", "sent", "f", "hedged", "constraints"))
    hits = mentions(s.filter(F.col("kind") != "candidate_constraint"), lexicon, ids, "sent")
    per = hits.withColumn("_inside", contained_in_longer(hits, ids)).groupBy(*ids, "skill_key").agg(
        F.array_sort(F.collect_list("start")).alias("starts"), F.array_sort(F.collect_list("end")).alias("ends"), F.bool_and("_inside").alias("_covered")
    ).filter(~F.col("_covered")).drop("_covered")
    strong = F.col("f").rlike(STRONG_CUE) & ~F.col("f").rlike(SOFT_CUE)
    hint = F.when(strong, lv.IMPERATIVE).when(F.col("f").rlike(DIFFERENTIATING_CUE), lv.DIFFERENTIATING).when(F.col("f").rlike(SOFT_CUE), lv.DESIRED).otherwise(lv.TO_CLARIFY)
    certainty = F.when(F.col("hedged"), "hedged").otherwise("certain").alias("certainty")
    of_kind = lambda kind: s.filter(F.col("kind") == kind).drop("kind")
    # the kind of each part is a constant, so a query for one kind computes no other
    needs = of_kind("client_requirement").join(by_shuffle(per), ids, "left").select(
        *ids, "role", F.lit("client_requirement").alias("kind"), F.col("skill_key").alias("topic"), certainty, hint.alias("category_hint"), (F.col("role") != "client").alias("relayed"), "sent"
    )
    stated = of_kind("candidate_constraint").select("*", F.posexplode("constraints").alias("pos", "c")).select(
        *ids, "role", F.lit("candidate_constraint").alias("kind"), certainty, "pos", F.col("c.field").alias("field"), F.col("c.value").alias("value"), "sent"
    )
    exp = of_kind("candidate_experience").join(by_shuffle(per), ids).withColumnRenamed("role", "speaker_role")
    info = lexicon.select("skill_key", F.col("kind").alias("skill_kind"), F.transform(F.concat("depth_terms", "advanced_terms", "narrowers", "related"), lambda t: tx.fold(t)).alias("parts"))
    exp = exp.join(broadcast_if_small(info), "skill_key").join(broadcast_if_small(depth_patterns(lexicon)), "skill_key")
    exp = computed_once(exp, _ff=tx.fold(F.translate("sent", "\n", " ")))
    exp = computed_once(exp, _cl=sp.clauses(F.col("_ff")))
    exp = computed_once(exp, _neg=sp.negated_regions(F.col("_ff"), F.col("_cl")))
    under = lambda p: F.exists("_neg", lambda r: (r["start"] <= p) & (p < r["end"]))
    lo, hi = F.array_min(F.transform("_neg", lambda r: r["start"])), F.array_max(F.transform("_neg", lambda r: r["end"]))
    exp = computed_once(exp, at=F.coalesce(F.get(F.filter("starts", lambda p: ~under(p)), F.lit(0)), F.lit(-1)), region=F.substring("_ff", lo + 1, hi - lo))
    exp = exp.withColumn("denied", F.col("at") < 0)
    region = F.col("region")
    component = F.exists("ends", lambda e: F.exists("parts", lambda t: F.ltrim(F.substring(F.col("_ff"), e + 1, F.length(F.col("_ff")))).startswith(t)))
    absent = region.rlike(DIRECT_ABSENCE) & ~component & ~(region.rlike(SPECIFIC_ACTIVITY) & ~region.rlike("\\bjamais\\s+(?:utilise|travaille)"))
    exp = computed_once(exp, absent=absent, limited=sp.clause_at(F.col("_cl"), F.col("at"))["text"].rlike(LIMIT_CUE))
    exp = exp.withColumn("crit", F.when(F.col("skill_kind").isin("activity", "domain"), F.col("skill_kind")).otherwise("skill")).drop("_ff", "_cl", "_neg")
    a = analyse_mentions(exp, today, item="sent", at="at", clues="clues", kind="crit")
    level = (
        F.when(F.col("denied"), F.when(F.col("absent"), 0).otherwise(3)).when(F.col("limited"), 3)
        .when(F.col("hedged") & (F.col("level_ord") == 4), 3).otherwise(F.col("level_ord"))
    )
    ek = F.when(F.col("denied"), F.when(F.col("absent"), CONTRADICTS).otherwise(LIMITS)).when(F.col("limited"), LIMITS).otherwise(SUPPORTS)
    done = a.select(*ids, F.col("speaker_role").alias("role"), F.lit("candidate_experience").alias("kind"), F.col("skill_key").alias("topic"), certainty, ek.alias("evidence_kind"), lv.level_name(level).alias("level"), "sent")
    return done.unionByName(needs, allowMissingColumns=True).unionByName(stated, allowMissingColumns=True)


def to_evidence(f: DataFrame, note_kind: str) -> DataFrame:
    """Candidate facts as evidence rows; a hedged declaration is an unsupported claim."""
    unsupported = (F.col("certainty") == "hedged") & (F.col("level") == lv.DECLARED)
    rows = f.filter(F.col("kind").isin("candidate_experience", "candidate_constraint"))
    subject = F.when(F.col("kind") == "candidate_constraint", F.concat(F.lit("constraint:"), "field")).otherwise(F.concat(F.lit("skill:"), "topic"))
    return rows.withColumn("subject_key", subject).withColumn("reliability", F.when(unsupported, UNSUPPORTED).otherwise(NOTE_RELIABILITY.get(note_kind, "explique_en_appel"))).withColumn(
        "source", F.lit(NOTE_SOURCE[note_kind])
    ).withColumn("evidence_kind", F.coalesce("evidence_kind", F.lit(SUPPORTS)))


def to_proposals(f: DataFrame) -> DataFrame:
    """Client requirements as proposals to confirm; they never become evidence."""
    return f.filter((F.col("kind") == "client_requirement") & F.col("topic").isNotNull())


def merged_constraints(f: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Candidate facts per field: the last one wins, refusals accumulate."""
    latest = lambda name: F.max_by(F.when(F.col("field") == name, F.col("value")), F.when(F.col("field") == name, order)).alias(name)
    return f.groupBy(*keys).agg(
        *[latest(n) for n in ("availability", "tjm", "onsite_max_days", "accepts_astreinte")], F.array_sort(F.collect_set(F.when(F.col("field") == "refuses", F.col("value")))).alias("refuses")
    )


def with_latest_review(evidence: DataFrame, reviews: DataFrame, key: str = "evidence_id") -> DataFrame:
    """Evidence with the decision of its latest review; rows typed by a person count as validated."""
    last = reviews.groupBy(key).agg(F.max_by("decision", F.struct("at", "review_id")).alias("decision"))
    e = evidence.join(last, key, "left")
    return e.withColumn("validated", F.coalesce(F.col("decision") == "validated", F.lit(False)) | (F.col("source") == "saisie_recruteur")).withColumn(
        "superseded", F.coalesce(F.col("decision") == "rejected", F.lit(False))
    )


def enough_depth(asked: Column, in_document: Column, in_excerpt: Column, least: int = 2) -> Column:
    """Whether the advanced depth that a criterion asks for shows: different clues of the document and of the exchange together."""
    none = F.array().cast("array<string>")
    return ~F.coalesce(asked, F.lit(False)) | (F.size(F.array_distinct(F.concat(F.coalesce(in_document, none), F.coalesce(in_excerpt, none)))) >= least)


def _effect(x: Column, deep: Column) -> Column:
    """What an evidence row does to the current level x. Without the depth asked for (``deep``), practice is shown in part."""
    level = F.coalesce("level_ord", F.lit(3))
    up = F.least(level, F.when(F.col("reliability") == UNSUPPORTED, 2).otherwise(4), F.when(deep, 4).otherwise(3), F.when(F.col("auto_generated") & ~F.col("validated"), 3).otherwise(4))
    cap = F.coalesce("level_ord", F.lit(2))
    reliable = F.col("validated") | (F.col("source") == "saisie_recruteur")
    return (
        F.when(F.col("superseded") | (F.col("reliability") == HYPOTHESIS), x)
        .when(F.col("kind") == SUPPORTS, F.when(x == 0, 0).otherwise(F.greatest(x, up)))
        .when(F.col("kind") == LIMITS, F.least(x, F.lit(3)))
        .when(F.col("kind") == CAPS, F.least(x, cap))
        .when(F.col("kind") == CONTRADICTS, F.when(reliable, 0).otherwise(F.least(x, F.lit(2))))
        .otherwise(x)
    )


def effects_of_row(deep: Column | None = None) -> Column:
    """The effect of an evidence row on each of the five levels; ``deep`` as from ``enough_depth`` where a criterion asks for it."""
    return F.array(*[_effect(F.lit(i), F.lit(True) if deep is None else deep).cast("int") for i in range(5)])


PIECE = 1024


def bucket_effects(evidence: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, piece: int = PIECE) -> DataFrame:
    """(keys, _b, effect): the ordered effect of the evidence of every (key, bucket) on each of the five levels.

    A row is a function on five levels and functions compose: rows are numbered in order and composed in pieces of a
    fixed size, pieces of pieces again, so no list ever holds more than ``piece`` rows however hot a key is.
    """
    effect = effects_of_row()
    cell = [*keys, "_b"]
    e = evidence.select(*keys, *order, bucket.alias("_b"), effect.alias("effect"))
    part = e.select(*cell, (F.row_number().over(Window.partitionBy(*cell).orderBy(*order)) - 1).cast("bigint").alias("_p"), "effect")
    for _ in range(3):
        part = part.groupBy(*cell, F.floor(F.col("_p") / piece).alias("_q")).agg(_composed("_p").alias("effect")).withColumnRenamed("_q", "_p")
    return part.groupBy(*cell).agg(_composed("_p").alias("effect"))


def _in_turn(rows: Column) -> Column:
    identity = F.array(*[F.lit(i) for i in range(5)])
    return F.aggregate(rows, identity, lambda acc, r: F.transform(acc, lambda x: F.get(r["effect"], x)))


def _composed(order: str) -> Column:
    """Composition of the effects of a group in order."""
    return _in_turn(F.array_sort(F.collect_list(F.struct(order, "effect"))))


def composed_buckets(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, effect) from the effects of the buckets of each key, in bucket order."""
    return parts.groupBy(*keys).agg(_composed("_b").alias("effect"))


def evidence_effects(evidence: DataFrame, keys: Sequence[str], order: Sequence[str], piece: int = PIECE, deep: Column | None = None) -> DataFrame:
    """(keys, effect): the ordered effect of all evidence rows per key, as the level each of the five start levels ends at.

    Rows are functions on five levels and functions compose: a range partition puts them in order, neighbours are composed
    first, so a key that holds most of the rows is as many small groups as it fills.
    """
    e = in_order(evidence.select(*keys, *order, effects_of_row(deep).alias("effect")), keys, order)
    return composed_in_order(e, keys, "ord", "effect", _in_turn, piece)


def merged_levels(levels: DataFrame, effects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Levels after the evidence of later exchanges."""
    j = levels.join(effects, list(keys), "left")
    return j.withColumn("merged_ord", F.coalesce(F.get("effect", F.col("level_ord")), F.col("level_ord")))


def constraint_status(c: Column, facts_: dict[str, Column]) -> Column:
    """struct<status,question> of one constraint (key, onsite_days, city, tjm_max, level) against the known facts; unknown is a question, never a refusal."""
    refused = lambda x: F.coalesce(F.array_contains(facts_["refuses"], x), F.lit(False))
    days, rate = facts_["onsite_max_days"], facts_["tjm"]
    presence = (
        F.when(refused("onsite"), "incompatible")
        .when(days.isNotNull() & c["onsite_days"].isNotNull(), F.when(days >= c["onsite_days"], "compatible").otherwise("incompatible")).otherwise("inconnu")
    )
    elsewhere = c["city"].isNotNull() & facts_["city"].isNotNull() & (F.lower(facts_["city"]) != F.lower(c["city"]))
    presence = F.when((presence != "incompatible") & elsewhere, "a_valider").otherwise(presence)
    on_call = F.when(refused("astreinte") | (facts_["accepts_astreinte"] == F.lit(False)), "incompatible").when(facts_["accepts_astreinte"], "compatible").otherwise("inconnu")
    money = F.when(rate.isNotNull() & c["tjm_max"].isNotNull(), F.when(rate <= c["tjm_max"], "compatible").otherwise("a_valider")).otherwise("inconnu")
    zone = F.when(facts_["timezone_ok"], "compatible").when(~facts_["timezone_ok"], "incompatible").otherwise("inconnu")
    enough = lv.language_at_least(facts_["english_level"], c["level"])
    language = F.when(enough, "compatible").when(~enough, "a_valider").otherwise("inconnu")
    free = F.when(F.coalesce(facts_["availability"], F.lit("")) != "", "compatible").otherwise("inconnu")
    return (
        F.when(c["key"] == "constraint:presence", presence).when(c["key"] == "constraint:astreinte", on_call).when(c["key"] == "constraint:tjm", money)
        .when(c["key"] == "constraint:timezone", zone).when(c["key"].startswith("language:"), language).when(c["key"] == "constraint:availability", free).otherwise("inconnu")
    )
