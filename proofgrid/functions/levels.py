"""Evidence levels, requirement categories and their default parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level order, level factors in thousandths, base weights, category strengths, source ranks, caps and thresholds.
CONTRADICTED, NOT_DOCUMENTED, DECLARED, PARTIAL, CONFIRMED = (
    "contredit", "non_documente", "declare_sans_preuve", "partiellement_demontre", "confirme_demontre",
)
LEVELS = [CONTRADICTED, NOT_DOCUMENTED, DECLARED, PARTIAL, CONFIRMED]
FACTORS_MILLI = {CONFIRMED: 1000, PARTIAL: 500, DECLARED: 150, NOT_DOCUMENTED: 0, CONTRADICTED: 0}
ELIMINATORY, IMPERATIVE, DIFFERENTIATING, DESIRED, CONTEXTUAL, TO_CLARIFY = (
    "eliminatoire_confirme", "imperatif", "fortement_differenciant", "souhaitable", "contextuel", "a_clarifier",
)
BASE_WEIGHTS = {ELIMINATORY: 6, IMPERATIVE: 5, DIFFERENTIATING: 3, DESIRED: 1}
BRIEF_STRENGTH = {ELIMINATORY: 6, IMPERATIVE: 5, DIFFERENTIATING: 4, DESIRED: 3, TO_CLARIFY: 2, CONTEXTUAL: 1}
FILTER_STRENGTH = {ELIMINATORY: 4, IMPERATIVE: 3, DIFFERENTIATING: 2, DESIRED: 1}
SOURCE_RANKS = {
    "client_imperatif_confirme": 1, "client_precision_validee": 2, "retour_entretien": 3, "brief_officiel": 4, "description_initiale": 5,
}
LANGUAGE_ORDER = ["notions", "scolaire", "intermédiaire", "professionnel", "courant", "bilingue"]
CAPS = {"contradicted_imperative": 60, "contradicted_eliminatory": 35, "undocumented_imperative": None}
THRESHOLDS = {"very_interesting": 96, "work_view_min": 95, "interesting": 80, "low_fit": 50}
RECENCY_YEARS = 7
MANDATORY = [ELIMINATORY, IMPERATIVE]
SCORED = [ELIMINATORY, IMPERATIVE, DIFFERENTIATING, DESIRED]


def lookup(values: dict, key: Column, default=None) -> Column:
    """Value of a small fixed map; the key is evaluated once."""
    pairs = [F.lit(x) for k, v in values.items() for x in (k, v)]
    typed = key.cast("int") if all(type(k) is int for k in values) else key
    found = F.try_element_at(F.create_map(*pairs), typed)
    return found if default is None else F.coalesce(found, F.lit(default))


def level_ord(level: Column) -> Column:
    return lookup({name: i for i, name in enumerate(LEVELS)}, level).cast("int")


def level_name(order: Column) -> Column:
    return lookup(dict(enumerate(LEVELS)), order)


def strength(category: Column, table: dict = BRIEF_STRENGTH) -> Column:
    return F.coalesce(lookup(table, category).cast("int"), F.lit(0))


def half_even(numerator: Column, denominator: int) -> Column:
    """Integer division rounded to nearest, ties to even; exact on integers."""
    q = F.floor(numerator / F.lit(denominator)).cast("bigint")
    r2 = (numerator - q * denominator) * 2
    return q + F.when((r2 > denominator) | ((r2 == denominator) & (F.pmod(q, F.lit(2)) == 1)), 1).otherwise(0)


def language_rank(level: Column) -> Column:
    return lookup({name: i for i, name in enumerate(LANGUAGE_ORDER)}, level).cast("int")


def language_at_least(have: Column, need: Column) -> Column:
    """True or false when both levels are known, null otherwise. The need may be a longer wording around a level."""
    rank = None
    for i, name in enumerate(LANGUAGE_ORDER):
        hit = F.contains(need, F.lit(name)) | (F.contains(F.lit(name), need) & (need != ""))
        rank = F.when(hit, i) if rank is None else rank.when(hit, i)
    return language_rank(have) >= rank
