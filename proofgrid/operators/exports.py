"""Themes, periods, environment phrases, questions, quality and assembled documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.functions import levels as lv
from proofgrid.functions import text as tx
from proofgrid.operators.scale import top_rows

# Activity themes in order of priority (title, pattern on folded text), title of the rest, named themes kept, default wording.
THEMES = [
    ("Conception et développement", "\\b(?:conc(?:u|oi\\w*|eption)|develop\\w*|implement\\w*|realis\\w*|construi\\w*|cre(?:e|er|ation)\\b|programm\\w*|coded?\\b|coding|built|designed|developed|implemented|created|engineered)"),
    ("Exploitation, support et fiabilité", "\\b(?:exploit\\w*|support\\w*|incident\\w*|astreinte\\w*|supervis\\w*|monitor\\w*|maintenance|maintien|post-?mortem|causes?\\s+racines?|resolution|disponibilite|fiabilit\\w*|operated|maintained|troubleshot|on-?call)"),
    ("Migration, déploiement et automatisation", "\\b(?:migr\\w*|deploi\\w*|deploy\\w*|automatis\\w*|industrialis\\w*|mise\\s+en\\s+(?:production|service)|ci/?cd|packag\\w*|bascule|cutover|upgrade\\w*|provision\\w*|installed|migrated|automated)"),
    ("Encadrement et transmission", "\\b(?:encadr\\w*|mentor\\w*|coach\\w*|revues?\\s+de\\s+code|code\\s+reviews?|formation|accompagn\\w*|onboarding|manag\\w*|led\\b|team\\s+lead)"),
    ("Analyse, spécification et documentation", "\\b(?:analys\\w*|specif\\w*|redig\\w*|document\\w*|cahier\\s+des\\s+charges|etude|audit\\w*|cartograph\\w*|recette|expression\\s+de\\s+besoin)"),
    ("Pilotage et coordination", "\\b(?:pilot\\w*|coordin\\w*|planif\\w*|animation|animer|suivi|gouvernance|arbitrage|reporting|comit\\w*)"),
]
OTHER_THEME = "Autres réalisations"
NAMED_THEMES = 3
NOT_STATED = "Non précisé dans le CV"
PRIORITY_QUESTIONS, OTHER_QUESTIONS = 3, 5
GENERIC_QUESTION = "Décris un projet précis où tu as travaillé sur {label} : contexte, rôle personnel, difficultés et résultats."


def theme(statement: Column) -> Column:
    """Theme of a statement: hits in its first 80 characters count twice; the first theme wins a tie."""

    def scored(f: Column) -> Column:
        head = F.substring(f, F.lit(1), F.lit(80))
        rows = F.array(*[F.struct((2 * F.regexp_count(head, F.lit(rx)) + F.regexp_count(f, F.lit(rx))).alias("n"), F.lit(-i).alias("i"), F.lit(title).alias("title")) for i, (title, rx) in enumerate(THEMES)])
        return F.array_max(rows)

    best = tx.let(tx.fold(statement), scored)
    return F.when(best["n"] > 0, best["title"]).otherwise(OTHER_THEME)


def theme_parts(statements: DataFrame, keys: Sequence[str], statement: str, pos: str) -> DataFrame:
    """Statements with the part they go to: the three largest themes keep their title, the rest is "other"."""
    t = statements.withColumn("theme", theme(F.col(statement)))
    n = t.filter(F.col("theme") != OTHER_THEME).groupBy(*keys, "theme").agg(F.count("*").alias("n"))
    order = lv.lookup({title: i for i, (title, _) in enumerate(THEMES)}, F.col("theme"))
    kept = top_rows(n, keys, [F.col("n").desc(), order], NAMED_THEMES).select(*keys, "theme", F.lit(True).alias("_kept"))
    parted = t.join(kept, [*keys, "theme"], "left")
    return parted.select(*keys, pos, F.when(F.col("_kept"), F.col("theme")).otherwise(OTHER_THEME).alias("part"), tx.closed_sentence(F.col(statement)).alias("sentence"))


def environment_items(line: Column) -> Column:
    tail = F.trim(F.regexp_replace(line, "^[^:：]*[:：]", ""))
    return F.filter(F.transform(F.split(F.regexp_replace(tail, "\\.+$", ""), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def environment_sentence(line: Column) -> Column:
    items = environment_items(F.coalesce(line, F.lit("")))
    return F.when(F.size(items) == 0, NOT_STATED).otherwise(F.concat(F.array_join(items, ", "), F.lit(".")))


def question_gaps(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Open criteria ranked by gap: lost points, then mandatory, then undocumented mandatory; three priority and five more."""
    lost = F.col("weight") * 100 - F.col("points")
    gap = lost + F.when(F.col("mandatory"), 100_000).otherwise(0) + F.when(F.col("mandatory") & (F.col("level_ord") == 1), 50_000).otherwise(0)
    open_ = results.filter((F.col("level_ord") != 4) & (F.col("level_ord") != 0)).withColumn("gap", gap)
    ranked = top_rows(open_, keys, [F.col("gap").desc(), F.col("key")], PRIORITY_QUESTIONS + OTHER_QUESTIONS)
    return ranked.withColumn("priority", F.when(F.col("rn") <= PRIORITY_QUESTIONS, "prioritaire").otherwise("complementaire"))


def with_questions(gaps: DataFrame, templates: DataFrame) -> DataFrame:
    """Question text of each open criterion: its template, or the generic one."""
    j = gaps.join(templates, "key", "left")
    return j.withColumn("question", F.coalesce("ask", F.replace(F.lit(GENERIC_QUESTION), F.lit("{label}"), F.col("label")))).drop("ask")


def information_quality(components: list[Column]) -> Column:
    """Mean of the known components (hundredths), rounded to nearest, ties to even."""
    known = F.filter(F.array(*components), lambda c: c.isNotNull())
    total = F.aggregate(known, F.lit(0).cast("bigint"), lambda a, x: a + x)
    n = F.size(known)
    q = F.floor(total / n).cast("bigint")
    r2 = (total - q * n) * 2
    return q + F.when((r2 > n) | ((r2 == n) & (F.pmod(q, F.lit(2)) == 1)), 1).otherwise(0)


def assembled(parts: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, glue: str = "\n") -> DataFrame:
    """One document per key from ordered parts."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text)))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r[text]), glue).alias("document"))


def profile_json(exps: DataFrame, key: str = "doc_id") -> DataFrame:
    """Experiences of a profile as one JSON document."""
    e = F.struct("idx", "company", "title", "start", "end", "is_current", "months")
    rows = F.transform(F.array_sort(F.collect_list(e)), lambda r: F.struct(*[r[c].alias(c) for c in ("company", "title", "start", "end", "is_current", "months")]))
    return exps.groupBy(key).agg(F.to_json(F.struct(rows.alias("experiences"))).alias("json"))
