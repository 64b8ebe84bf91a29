"""Profile texts to lines, sections, dated experiences, items, and the location of a position."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.functions import text as tx
from proofgrid.functions.levels import half_even, lookup
from proofgrid.operators import profile_rows as pr
from proofgrid.operators.scale import by_shuffle, computed_once

# Language names and levels, places of a mention.
LANGUAGE_NAMES = {"anglais": "(?:anglais|english)", "allemand": "(?:allemand|german|deutsch)", "espagnol": "(?:espagnol|spanish)", "francais": "(?:francais|french)"}
LANGUAGE_LEVELS = {
    "courant": "courant", "fluent": "courant", "bilingue": "bilingue", "bilingual": "bilingue", "natif": "bilingue", "native": "bilingue", "professionnel": "professionnel",
    "professional": "professionnel", "operationnel": "professionnel", "intermediaire": "intermédiaire", "intermediate": "intermédiaire", "scolaire": "scolaire", "notions": "notions",
    "basic": "notions", "debutant": "notions", "b1": "intermédiaire", "b2": "professionnel", "c1": "courant", "c2": "bilingue", "a2": "notions", "a1": "notions",
}
LEVEL_UNSTATED = "niveau non précisé"
LOCATIONS = {"skills": "skills_list", "summary": "summary", "education": "training", "certifications": "training", "interests": "other", "languages": "other", "experience": "experience"}


def layout(docs: DataFrame, today: str, text: str = "text", until: str = "items", keep: Sequence[str] | None = None, item_text: bool = False) -> DataFrame:
    """One row per document: its lines, dated lines, experiences and items, as arrays; nothing beyond ``until`` is computed.

    All is computed from the row's own text, in Arrow batches: lines carry their offsets and numbers, so spans become slices and
    nothing is shuffled or sorted. ``lines_of``, ``experiences_of`` and ``items_of`` turn the arrays into rows. ``keep`` names
    the parts that are handed on (by default all up to ``until``); "spans" are the offsets that ``located`` reads.
    """
    parts = list(pr.PARTS)
    out = pr.columns(parts[: parts.index(until) + 1] if keep is None else keep, item_text)
    rows = docs.select("doc_id", F.col(text).cast("string").alias("_t"))
    schema = ", ".join(f"`{name}` {pr.sql_type(fields)}" for name, (_, _, fields) in out.items())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pr.cut_batches(batches, out, today)

    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def lines_of(laid: DataFrame) -> DataFrame:
    """Lines with offsets, heading, section and zone."""
    l = laid.select("doc_id", F.explode("lines").alias("l"))
    return l.select("doc_id", F.col("l.n").alias("line_no"), *[f"l.{c}" for c in ("start", "end", "raw", "f", "heading", "section", "in_zone")])


def dated_lines(laid: DataFrame) -> DataFrame:
    """Lines of the experience zone that open a dated block; ``project_period`` marks the periods inside another one."""
    d = laid.select("doc_id", F.explode("dated").alias("x"))
    return d.select("doc_id", F.col("x.n").alias("line_no"), *[f"x.{c}" for c in ("from", "to", "is_current", "project_period")])


def experiences_of(laid: DataFrame) -> DataFrame:
    e = laid.select("doc_id", F.posexplode("experiences").alias("idx", "x"))
    return e.select("doc_id", "idx", "x.*").drop("body", "until")


def experiences(docs: DataFrame, today: str, text: str = "text") -> DataFrame:
    """Dated blocks with company, title, period, duration and spans; long undated blocks of the zone are kept as undated ones."""
    return experiences_of(layout(docs, today, text, keep=["experiences"]))


def items_of(laid: DataFrame) -> DataFrame:
    return laid.select("doc_id", F.explode("items").alias("i")).select("doc_id", "i.*")


def env_lines(l: DataFrame) -> DataFrame:
    return l.filter(F.col("raw").rlike(pr.ENV_LINE)).select("doc_id", "start", "end", "raw")


SEARCH_BLOCK = 64


def span_at(spans: Column, heads: Column, at: Column) -> Column:
    """The last of the ordered spans that starts at or before ``at``, if it ends after it. ``heads`` are the starts of every 64th span,
    so a long array isn't walked through for every position."""
    before = F.size(F.filter(heads, lambda h: h <= at)) - 1
    near = F.slice(spans, before * SEARCH_BLOCK + 1, F.lit(SEARCH_BLOCK))
    return F.when(before >= 0, tx.let(F.element_at(F.filter(near, lambda x: x["start"] <= at), -1), lambda x: F.when(x["end"] > at, x)))


def heads_of(spans: Column) -> Column:
    return F.transform(F.filter(spans, lambda x, i: i % SEARCH_BLOCK == 0), lambda x: x["start"])


def spans_by_document(laid: DataFrame, item_text: bool = False) -> DataFrame:
    """doc_id and the offsets of lines, experiences and items in order of position; no text but, if asked for, that of the items."""
    if "_lines" in laid.columns:
        return laid
    lines = F.transform("lines", lambda x: F.struct(x["start"].alias("start"), (x["end"] + 1).alias("end"), x["section"].alias("section"), x["raw"].rlike(pr.ENV_LINE).alias("env")))
    exps = F.transform("experiences", lambda x, i: F.struct(x["s"].alias("start"), x["e"].alias("end"), x["body_s"].alias("body_s"), x["months"].alias("months"), i.alias("idx")))
    items = F.transform("items", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["idx"].alias("idx"), *([x["item"].alias("item")] if item_text else [])))
    return laid.select("doc_id", lines.alias("_lines"), exps.alias("_exps"), items.alias("_items"))


def located(hits: DataFrame, laid: DataFrame, item_text: bool = False) -> DataFrame:
    """Mentions with where they stand (``location``), the experience and its months, and the item that holds them (struct, null outside).

    Mentions and offsets meet by document; texts stay where they were cut. The places of a batch of mentions are looked up at once.
    """
    j = hits.join(by_shuffle(spans_by_document(laid, item_text)), "doc_id")
    spans = ("_lines", "_exps", "_items")
    kind = j.schema["_items"].dataType.elementType.simpleString()
    found = F.arrow_udf(pr.places, f"struct<section:string,env:boolean,exp_idx:int,exp_months:int,before_body:boolean,it:{kind}>").asNondeterministic()
    j = j.withColumn("_at", found(F.col("start").cast("bigint"), *spans))
    where = (
        F.when(F.col("_at.exp_idx").isNull(), lookup(LOCATIONS, F.col("_at.section"), "other")).when(F.col("_at.env"), "env_list")
        .when(F.col("_at.before_body"), "header").otherwise("experience")
    )
    return j.select(*hits.columns, where.alias("location"), "_at.exp_idx", "_at.exp_months", "_at.it")


# A language before or after its level; years stated in the head of a profile, whose length is the rule's.
LEVEL_AFTER, LEVEL_BEFORE = "{name}\\s*[:\\-–(]*\\s*(?:niveau\\s*)?({levels})\\b", "\\b({levels})\\b\\s*(?:en\\s+)?{name}"
DECLARED_YEARS = "(\\d{1,2})\\s*(?:\\+\\s*)?(?:ans|annees|years)\\s*d['’ ]?\\s*(?:experience|exp\\b)"
HEAD_CHARS = 2500


def languages(text: Column) -> Column:
    """Map language -> level; a language named without a level is kept as unstated."""
    return tx.let(tx.fold_compact(text), _languages)


def _languages(f: Column) -> Column:
    levels = "|".join(LANGUAGE_LEVELS)
    pairs = []
    for name, rx in LANGUAGE_NAMES.items():
        after, before = (F.regexp_extract(f, p.replace("{name}", rx).replace("{levels}", levels), 1) for p in (LEVEL_AFTER, LEVEL_BEFORE))
        word = F.when(after != "", after).when(before != "", before)
        value = lookup(LANGUAGE_LEVELS, word)
        if name != "francais":
            value = F.coalesce(value, F.when(f.rlike(f"\\b{rx}\\b"), LEVEL_UNSTATED))
        pairs.append(F.struct(F.lit(name).alias("k"), value.alias("v")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))


def declared_years(text: Column, head_chars: int = HEAD_CHARS) -> Column:
    """Years of experience stated in the head of a profile; later statements concern single missions."""
    found = F.regexp_extract(tx.fold(F.substring(text, 1, head_chars)), DECLARED_YEARS, 1)
    return F.when(found != "", found.cast("int"))


def years_of_practice(exps: DataFrame, keys: list[str], start: str = "start_ord", end: str = "end_ord") -> DataFrame:
    """Tenths of years covered by the union of the periods, rounded to nearest, ties to even."""
    from proofgrid.operators.intervals import merge_intervals

    merged = merge_intervals(exps.filter(F.col(start).isNotNull() & F.col(end).isNotNull()), keys, start, end)
    months = merged.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("months"))
    return months.withColumn("tenths", half_even(F.col("months").cast("bigint") * 10, 12))


def years_level(tenths: Column, needed_tenths: Column) -> Column:
    """Level from the ratio of practised to needed years; no period at all is not documented."""
    return F.when(tenths.isNull(), 1).when(tenths >= needed_tenths, 4).when(tenths * 10 >= needed_tenths * 6, 3).otherwise(2)
