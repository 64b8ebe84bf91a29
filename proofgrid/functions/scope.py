"""What the clause around a mention says: negation, scope caps, lists, volumes. All on folded, flattened text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofgrid.functions import text as tx
from proofgrid.functions.levels import lookup

# Clause borders, negation cues and their ends, post-positioned negation, denied problems.
CLAUSE_BREAK = ";|(?<=[.!?])\\s+(?=[a-z0-9\"'(])|\\b(?:mais|but|however|toutefois|cependant|alors\\s+que|whereas|en\\s+revanche)\\b"
NEGATION = (
    "\\bn'(?:ai|a|avons|etais|etait|y\\s+ai)\\s+(?:\\w+\\s+){0,2}?(?:jamais|pas|plus|aucun\\w*)\\b"
    "|\\bne\\s+(?:\\w+\\s+){1,2}?(?:jamais|pas|plus)\\b"
    "|\\bjamais\\b|\\bpas\\s+(?:d'|de\\s|du\\s|des\\s|encore\\s|vraiment\\s)"
    "|\\bsans\\s+(?:aucune?\\s+|reelle?\\s+|vraie?\\s+)?(?:experience|pratique|connaissance|expertise|competence|exposition)\\b"
    "|\\baucune?\\s+(?:experience|pratique|connaissance|expertise|competence)\\b"
    "|\\bnon\\s+(?:utilise\\w*|maitrise\\w*|pratique\\w*|applicable|realise\\w*)\\b|\\bn'est\\s+pas\\b|\\bnul(?:le)?\\s+experience\\b"
    "|\\bno\\s+(?:prior\\s+|direct\\s+|hands-on\\s+|professional\\s+|real\\s+)?(?:experience|exposure|knowledge|expertise)\\b"
    "|\\bnever\\b|\\b(?:did|do|does|have|has|had|was|were|am|is)\\s*(?:not|n't)\\b|\\b(?:didn't|haven't|hasn't|hadn't|wasn't|weren't)\\b"
    "|\\bwithout\\s+(?:any\\s+|prior\\s+|real\\s+)?(?:experience|exposure|knowledge)\\b|\\bnot\\s+(?:used|familiar|experienced|involved)\\b"
    "|\\b(?:lack|lacks|lacking)\\b|\\bnon\\s+utilise\\b"
)
NEGATION_END = "[,:;()!?]|\\.\\s|\\s-\\s"
NEITHER_COMMA = ",(?=\\s*\\b(?:ni|nor|or\\s+neither)\\b)"
POST_NEGATION = "\\bnon\\s+(?:utilise|maitrise|pratique|realise)\\w*|\\bnot\\s+(?:directly\\s+)?used\\b|\\bn'(?:est|etait)\\s+pas\\s+(?:utilise|pratique)\\w*"
DENIED_PROBLEM = (
    "^\\s*(?:\\w{1,10}\\s+){0,3}?(?:de\\s+|d')?(?:probleme|difficulte|souci|incident|erreur|panne|bug|perte|blocage|retard|regression|trouble|issue|outage|problem)"
)

# Scope caps, code -> (level order, pattern).
CAPS = {
    "future": (2, (
        "\\b(?:planifi\\w*|prevu\\w*|a\\s+venir|envisag\\w*|souhait(?:e|ons|er|ant)\\b|aspire\\w*|aimerais|aimerai\\w*|desire\\w*|en\\s+cours\\s+d'(?:apprentissage|acquisition)|"
        "autoformation|auto-formation|auto-didacte|autodidacte|veille\\s+technologique|curieu\\w*|interesse\\w*\\s+(?:par|a)|motive\\w*\\s+par|"
        "planned|upcoming|intend\\w*|interested|would\\s+like|looking\\s+to|eager|keen|self-taught|self-study|currently\\s+learning|learning\\s+(?:kafka|about|how)|"
        "plan\\s+to|plans\\s+to|will\\s+(?:be|start|use|develop|implement|migrate)|to\\s+be\\s+(?:developed|implemented|migrated|deployed))\\b")),
    "third_party": (2, (
        "\\b(?:equipes?|services?|poles?|prestataires?|partenaires?|editeurs?|fournisseurs?)\\s+(?:\\w+\\s+){0,3}?qui\\s+(?:\\w+\\s+)?"
        "(?:administr\\w*|ger\\w*|gere\\w*|exploit\\w*|oper\\w*|maintien\\w*|maintain\\w*|deploi\\w*|assur\\w*|fourni\\w*|heberge\\w*|livr\\w*|support\\w*)|"
        "\\b(?:equipes?|services?|poles?|prestataires?|partenaires?|editeurs?|fournisseurs?)\\s+(?:\\w+\\s+){0,3}?(?:en\\s+charge|charge\\s+de)\\b|"
        "\\b(?:assure|assuree|assures|assurees|gere|geree|geres|gerees|realise|realisee|realises|opere|operee|exploite|exploitee|administre|administree|fourni|fournie|"
        "maintenu|maintenue|pilote|pilotee)\\s+par\\s+(?!moi\\b|nous\\b|mon\\b|notre\\b)|\\bcote\\s+(?:plateforme|infra\\w*|client|editeur|fournisseur|equipe|ops)\\b|"
        "\\b(?:par|de)\\s+(?:une|l')\\s*autre\\s+equipe\\b|\\bautre\\s+equipe\\b|"
        "\\b(?:managed|run|operated|handled|owned|provided|maintained|administered)\\s+by\\s+(?!me\\b|my\\b|myself\\b|us\\b|our\\b)|\\b(?:platform|infra\\w*|ops|devops|sre|vendor)\\s+team\\s+(?:that|who|which)\\b|"
        "\\bby\\s+(?:another|a\\s+separate)\\s+team\\b|\\bnot\\s+(?:our|my)\\s+(?:scope|responsibility|perimeter)\\b|\\bhors\\s+(?:de\\s+)?(?:mon\\s+)?perimetre\\b|"
        "\\b(?:collaborat\\w*|travaill\\w*|interag\\w*|echang\\w*|coordination|liaison)\\s+(?:avec|a)\\s+(?:l'|les?\\s+|la\\s+)?(?:equipes?|services?|poles?|prestataires?|partenaires?|editeurs?)\\b|"
        "\\b(?:work\\w*|collaborat\\w*|liais\\w*|interact\\w*)\\s+with\\s+(?:the\\s+|our\\s+)?(?:\\w+\\s+)?(?:team|vendor|provider)s?\\b")),
    "personal": (2, (
        "\\bprojets?\\s+(?:personnels?|perso|annexes?|open[- ]?source|etudiants?|scolaires?|de\\s+fin\\s+d'etudes?)\\b|\\bpersonal\\s+projects?\\b|\\bside[- ]?projects?\\b|\\bpet\\s+projects?\\b|"
        "\\bhobby\\b|\\bhobbies\\b|\\bloisirs?\\b|\\ba\\s+titre\\s+(?:personnel|perso|benevole)\\b|\\busage\\s+personnel\\b|\\bma\\s+famille\\b|\\bfamilial\\w*\\b|"
        "\\b(?:mon|pour\\s+mon)\\s+(?:frere|pere|cousin|oncle|ami\\w*|voisin|beau-frere)\\b|\\bmy\\s+(?:family|brother|father|friend)\\b|\\bfamily\\s+(?:business|site|shop|project)\\b|"
        "\\bbenevol\\w*|\\bassociat(?:ion|if)\\b|\\bhomelab\\b|\\bhome\\s+lab\\b|\\braspberry\\b|\\bcours\\s+du\\s+soir\\b|\\bprojets?\\s+d'ecole\\b|\\bschool\\s+projects?\\b|"
        "\\b(?:en|a\\s+l')\\s*(?:universite|ecole)\\b|\\buniversity\\s+projects?\\b")),
    "training": (2, (
        "\\b(?:formation|formations|stage\\s+de\\s+formation|bootcamp|mooc|coursera|udemy|openclassrooms|pluralsight|tutoriel|tutorial|travaux\\s+pratiques|tp|"
        "atelier\\s+de\\s+formation|workshop\\s+(?:on|training)|training\\s+(?:course|session|program\\w*|on)|trained\\s+(?:on|in)|certification\\s+(?:en\\s+cours|visee|preparee)|webinaire|webinar|hackathon|meetup)\\b")),
    "admin": (2, (
        "\\b(?:contrats?|couts?|budgets?|achats?|devis|tco|appels?\\s+d'offres?|renouvellement\\s+de|procurement|vendor\\s+management|negociation\\s+(?:commerciale|fournisseur)|"
        "licences?\\s+(?:et|ou)\\s+(?:contrats?|maintenance)|facturation\\s+des\\s+(?:licences|produits)|cost\\s+(?:analysis|optimi\\w*)|invoice\\w*)\\b")),
    "user_support": (2, (
        "\\b(?:support\\s+(?:aux?\\s+|des\\s+|a\\s+l'|de\\s+l')?utilisateurs?|support\\s+utilisateurs?|assistance\\s+(?:aux\\s+)?utilisateurs?|help\\s*desk|service\\s+desk|"
        "end[- ]user\\s+support|user\\s+support|hotline|support\\s+bureautique|support\\s+de\\s+niveau\\s+1|support\\s+n1)\\b")),
}
TRAINER = (
    "\\b(?:animation|anime|animer|dispense\\w*|conduite|delivre\\w*|formateur|trainer|taught|delivered|animated|led)\\b"
    "|\\bformations?\\s+(?:de|des|aux?|pour)\\s+(?:\\d+\\s+)?(?:equipes?|utilisateurs?|developpeurs?|collaborateurs?|juniors?|clients?|nouveaux?|\\w+)\\b"
)
LATER_YEAR = "\\b(20[3-9]\\d|20[2-9]\\d)\\b"
CAP_LEVELS = {"future": 2, "third_party": 2, "personal": 2, "training": 2, "trainer": 3, "admin": 2, "user_support": 2}
ITEM_CAPS = ["personal", "training", "trainer", "future", "admin"]
ITEM_PREFIX = 70

# Verbs that make an enumeration an achievement; words that keep a label from being a category.
VERBISH = (
    "\\b(?:conc\\w+|develop\\w+|implement\\w*|mise\\s+en|mis\\s+en|deploi\\w*|deploy\\w*|configur\\w*|parametr\\w*|administr\\w*|migr\\w+|optimis\\w*|"
    "automatis\\w*|constru\\w+|cre(?:e|er|ation)\\b|pilot\\w*|encadr\\w*|exploit\\w*|utilis\\w*|gestion|gerer|realis\\w*|built|designed|developed|implemented|"
    "deployed|configured|managed|led|created|integrated|operated|optimi[sz]ed|automated|used|using|maintained)\\b"
)
LABEL_WORDS = "\\d|\\b(?:le|la|les|l'|un|une|du|des|de|d'|au|aux|a|en|sur|pour|avec|dans|par|the|of|for|with|in|on)\\b"

# Throughput figures, their units per day and multipliers, thresholds per day.
FIGURE = (
    "(?<![\\d.,])(\\d{1,3}(?:[ .,\\u00a0]\\d{3})+|\\d{1,12}(?:[.,]\\d{1,2})?)(?![\\d]) ?(k|m|millions?|milliards?|milliers?|billions?)? ?(?:de |d'|of )?"
    "(?:transactions?|tx|tps|msgs?|messages?|requetes?|requests?|evenements?|events?|fichiers?|files|appels?|calls?|operations?|ops|commandes?|orders?|paiements?|payments?|enregistrements?|records?)\\b"
    "(?: ?(?:/|par |per |a l'|each |by )? ?(seconde|second|sec|minute|min|heure|hour|jour|day|semaine|week|mois|month|an|annee|year|s|h|j|d)\\b)?"
)
SEVERAL_MILLIONS = "plusieurs\\s+millions?\\s+(?:de\\s+)?(?:transactions?|messages?|requetes?|evenements?|operations?)\\s+(?:par|/)\\s+jour"
PER_DAY = {
    "seconde": 86400.0, "second": 86400.0, "sec": 86400.0, "s": 86400.0, "minute": 1440.0, "min": 1440.0, "heure": 24.0, "hour": 24.0, "h": 24.0, "jour": 1.0, "day": 1.0, "j": 1.0, "d": 1.0,
    "semaine": 1 / 7, "week": 1 / 7, "mois": 1 / 30, "month": 1 / 30, "an": 1 / 365, "annee": 1 / 365, "year": 1 / 365,
}
MULTIPLIERS = {"k": 1e3, "m": 1e6, "million": 1e6, "millions": 1e6, "milliard": 1e9, "milliards": 1e9, "billion": 1e9, "billions": 1e9, "millier": 1e3, "milliers": 1e3}
VOLUME_SPLIT = "(?<=[.!?]) |(?<= )(?:qui|dont|which|that|where|ou) "
HIGH_VOLUME, MEDIUM_VOLUME = 100_000, 10_000


def clauses(f: Column) -> Column:
    """Clauses of a folded text as spans."""
    cut = F.filter(tx.pieces(f, CLAUSE_BREAK), lambda c: c["end"] > c["start"])
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(f).alias("end"), f.alias("text")))
    return tx.let(cut, lambda c: F.when(F.size(c) > 0, c).otherwise(whole))


def clause_at(spans: Column, pos: Column) -> Column:
    """The clause that holds a position, else the last one."""
    return F.coalesce(F.get(F.filter(spans, lambda c: (c["start"] <= pos) & (pos < c["end"])), F.lit(0)), F.element_at(spans, -1))


def negated_regions(f: Column, spans: Column) -> Column:
    """Spans under a negation: from its cue to the next break ("ni" extends it); a post-positioned negation takes its clause.

    A denied problem ("never a problem with") is positive.
    """
    linked = F.regexp_replace(f, NEITHER_COMMA, " ")

    def region(g: Column) -> Column:
        def end_of(m: Column) -> Column:
            stop = F.regexp_instr(F.substring(g, m["end"] + 1, F.length(g)), F.lit(NEGATION_END))
            return F.when(stop > 0, m["end"] + stop - 1).otherwise(F.length(g))

        cues = F.filter(tx.matches(f, NEGATION), lambda m: ~F.rlike(F.substring(f, m["end"] + 1, F.lit(45)), F.lit(DENIED_PROBLEM)))
        return F.transform(cues, lambda m: F.struct(m["start"].alias("start"), end_of(m).alias("end")))

    after = F.transform(tx.matches(f, POST_NEGATION), lambda m: clause_at(spans, m["start"]))
    after = F.transform(after, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
    return F.concat(tx.let(linked, region), after)


def cap_codes(clause: Column, today: str) -> Column:
    """Codes of the caps that a folded clause carries."""

    def code(name: str, rx: str) -> Column:
        if name == "training":
            return F.when(clause.rlike(rx), F.when(clause.rlike(TRAINER), "trainer").otherwise("training"))
        return F.when(clause.rlike(rx), name)

    years = F.regexp_extract_all(clause, F.lit(LATER_YEAR), F.lit(1))
    later = F.when(F.exists(years, lambda y: y.cast("int") > int(today[:4])), "future")
    return F.filter(F.array(*[code(n, rx) for n, (_, rx) in CAPS.items()], later), lambda c: c.isNotNull())


def item_cap_codes(item: Column, today: str) -> Column:
    """Markers at the head of an item qualify the whole item."""
    head = F.substring(F.ltrim(item, F.lit(" -•*·▪►→")), F.lit(1), F.lit(ITEM_PREFIX))
    return F.array_intersect(cap_codes(head, today), F.array(*[F.lit(c) for c in ITEM_CAPS]))


def strongest_cap(codes: Column) -> Column:
    return F.array_min(F.transform(codes, lambda c: lookup(CAP_LEVELS, c)))


def stack_list(clause: Column) -> Column:
    """A short label followed by an enumeration of names without a verb: a list, not an achievement."""
    head, tail = F.split_part(clause, F.lit(":"), F.lit(1)), F.regexp_replace(clause, "^[^:]*:", "")
    names = F.filter(F.transform(F.split(tail, ",|/|\\bet\\b|\\band\\b"), lambda t: F.trim(t)), lambda t: t != "")
    words = lambda t: F.size(F.filter(F.split(t, "\\s+"), lambda w: w != ""))
    return (
        F.contains(clause, F.lit(":")) & (words(head) <= 5) & ~head.rlike(LABEL_WORDS) & (F.size(names) >= 3) & ~tail.rlike(VERBISH) & F.forall(names, lambda t: words(t) <= 5)
    )


def parse_number(raw: Column) -> Column:
    """French or English number: groups of three are thousands, else a comma or point is decimal."""
    grouped = raw.rlike("^\\d{1,3}(?:[ .,\\u00a0]\\d{3})+$")
    return F.when(grouped, F.regexp_replace(raw, "[ .,\\u00a0]", "")).otherwise(F.translate(raw, ",", ".")).try_cast("double")


def volume_per_day(text: Column) -> Column:
    """Largest throughput stated with a duration, per day; a total without duration is none."""

    def rate(m: Column) -> Column:
        number = parse_number(F.regexp_extract(m, FIGURE, 1))
        unit, mult = F.regexp_extract(m, FIGURE, 3), F.regexp_extract(m, FIGURE, 2)
        per = F.when(unit != "", lookup(PER_DAY, unit)).when(m.rlike("\\btps\\b"), 86400.0)
        return number * lookup(MULTIPLIERS, mult, 1.0) * per

    def best(f: Column) -> Column:
        stated = F.array_max(F.transform(F.regexp_extract_all(f, F.lit(FIGURE), F.lit(0)), rate))
        return F.greatest(stated, F.when(f.rlike(SEVERAL_MILLIONS), F.lit(2e6)))

    return tx.let(tx.fold_compact(text), best)


def volume_level(per_day: Column) -> Column:
    return F.when(per_day >= HIGH_VOLUME, 4).when(per_day >= MEDIUM_VOLUME, 3).when(per_day.isNotNull(), 2)
