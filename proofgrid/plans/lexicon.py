"""A small lexicon of words that occur in the corpus, two role families, and the grids used by the queries.

These are parameters: any other rows with the same schema work the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofgrid.functions.levels import DESIRED, DIFFERENTIATING, ELIMINATORY, IMPERATIVE
from proofgrid.operators.mentions import LEXICON_SCHEMA
from proofgrid.operators.scale import parameter_table

DEPTH = ["the", "and", "was", "for", "are", "des", "und", "los"]


def _skill(key, aliases, kind="tech", rarity=3, volatile=False, depth=DEPTH, advanced=(), needed=(), forbidden=(), after=(), cs=(), narrowers=(), related=(), umbrella=()):
    return (key, key, kind, rarity, volatile, list(aliases), list(depth), list(advanced), list(needed), list(forbidden), list(after), list(cs), list(narrowers), list(related), list(umbrella))


CORPUS = [_skill(w, [w]) for w in ("that", "with", "from", "this", "que", "der", "license")]
GUARDS = [
    _skill("of_the", ["of the", "the"], after=["and", "of"]),
    _skill("the", ["the"]),
    _skill("and_was", ["and"], needed=["was"], forbidden=["for"]),
    _skill("Cased", ["The"], cs=["The"]),
    _skill("articles", ["zzzz"], umbrella=["the", "que", "der"]),
]
ROLES = [
    ("widgets", "Widget maker", ["widget", "red widget"], ["widget hand"], ["that", "with"], ["gizmo"], 0),
    ("rings", "Ring maker", ["ring", "hot ring"], ["ring hand"], ["from"], ["plate"], 1),
    ("small", "Small parts", ["small", "small rod"], ["tiny"], ["this"], ["blue"], 2),
]
ROLE_SCHEMA = "role_key string, label string, titles array<string>, wide_titles array<string>, discriminants array<string>, triggers array<string>, ord int"

# grid_id, key, label, category, dimension, kind, weight, scored, mandatory, members, at_least, ord
GRID_SCHEMA = (
    "grid_id string, key string, label string, category string, dimension string, kind string, weight int, scored boolean, mandatory boolean, "
    "members array<string>, at_least int, ord int"
)
CRITERIA = [
    ("g0", "that", "Critère that", IMPERATIVE, "technique", "skill", 30, True, True, [], 0, 0),
    ("g0", "with", "Critère with", IMPERATIVE, "technique", "skill", 20, True, True, [], 0, 1),
    ("g0", "from", "Critère from", DIFFERENTIATING, "responsabilite", "skill", 20, True, False, [], 0, 2),
    ("g0", "this", "Critère this", DIFFERENTIATING, "technique", "skill", 10, True, False, [], 0, 3),
    ("g0", "que", "Critère que", DESIRED, "technique", "skill", 10, True, False, [], 0, 4),
    ("g0", "der", "Critère der", DESIRED, "technique", "skill", 10, True, False, [], 0, 5),
    ("g1", "that", "Critère that", ELIMINATORY, "technique", "skill", 40, True, True, [], 0, 0),
    ("g1", "license", "Critère license", DESIRED, "technique", "skill", 5, True, False, [], 0, 1),
    ("g1", "duo", "Au moins deux parmi trois", IMPERATIVE, "technique", "custom", 35, True, True, ["with", "from", "this"], 2, 2),
    ("g1", "with", "Critère with", DIFFERENTIATING, "technique", "skill", 0, False, False, [], 0, 3),
    ("g1", "from", "Critère from", DIFFERENTIATING, "responsabilite", "skill", 0, False, False, [], 0, 4),
    ("g1", "this", "Critère this", DIFFERENTIATING, "technique", "skill", 0, False, False, [], 0, 5),
    ("g1", "que", "Critère que", DESIRED, "technique", "skill", 20, True, False, [], 0, 6),
    ("g2", "with", "Critère with", DESIRED, "technique", "skill", 50, True, False, [], 0, 0),
    ("g2", "der", "Critère der", DIFFERENTIATING, "responsabilite", "skill", 50, True, False, [], 0, 1),
]
N_GRIDS = 3


def corpus_lexicon(spark: SparkSession) -> DataFrame:
    return parameter_table(spark, CORPUS, LEXICON_SCHEMA)


def guard_lexicon(spark: SparkSession) -> DataFrame:
    return parameter_table(spark, CORPUS + GUARDS, LEXICON_SCHEMA)


def role_families(spark: SparkSession) -> DataFrame:
    return parameter_table(spark, ROLES, ROLE_SCHEMA)


def criteria(spark: SparkSession) -> DataFrame:
    return parameter_table(spark, CRITERIA, GRID_SCHEMA)


def values_sql(rows: list[tuple], names: str) -> str:
    """The same parameters as a VALUES list."""

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, list):
            return "[" + ", ".join(lit(x) for x in v) + "]::VARCHAR[]"
        return "'" + str(v).replace("'", "''") + "'"

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows) + f") AS v({names}))"


CRITERIA_SQL = values_sql(CRITERIA, "grid_id, key, label, category, dimension, kind, weight, scored, mandatory, members, at_least, ord")
