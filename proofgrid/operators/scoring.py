"""Evidence levels x frozen grid -> points, caps, tier, rank, differences.

One row per (document, grid) carries the results of all its criteria as an array of
structs: a grid has at most a hundred scored criteria (integer weights that sum to
100), so everything after the evidence is computed inside the row, without a shuffle.
Points are integers in hundredths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.functions import levels as lv
from proofgrid.operators.scale import broadcast_if_small, by_shuffle, rank_by_counts, top_rows

RESULT_FIELDS = ["key", "label", "category", "dimension", "weight", "mandatory", "level_ord", "points"]
# The source name of evidence from the document, longest excerpt given as a reason.
DOCUMENT_SOURCE, REASON_CHARS = "cv", 200


SHARE = "struct<num:bigint,den:bigint>"


def grid_rows(criteria: DataFrame, parameters: DataFrame | None = None) -> DataFrame:
    """One row per grid: its criteria in order, and its factors, caps and thresholds (defaults where none are given)."""
    fields = ["ord", "key", "label", "category", "dimension", "kind", "weight", "scored", "mandatory", "members", "at_least"]
    grids = criteria.groupBy("grid_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("criteria"))
    defaults = {
        "factors": F.array(*[F.lit(lv.FACTORS_MILLI[x]) for x in lv.LEVELS]),
        "cap_imperative": F.lit(lv.CAPS["contradicted_imperative"]),
        "cap_eliminatory": F.lit(lv.CAPS["contradicted_eliminatory"]),
        "cap_undocumented": F.lit(None).cast("int"),
        "very_interesting": F.lit(lv.THRESHOLDS["very_interesting"]),
        "interesting": F.lit(lv.THRESHOLDS["interesting"]),
        "low_fit": F.lit(lv.THRESHOLDS["low_fit"]),
        "work_view_min": F.lit(lv.THRESHOLDS["work_view_min"]),
    }
    if parameters is not None:
        grids = grids.join(F.broadcast(parameters) if parameters.isLocal() else broadcast_if_small(parameters), "grid_id", "left")
    for name, value in defaults.items():
        given = parameters is not None and name in parameters.columns
        grids = grids.withColumn(name, F.coalesce(F.col(name), value) if given and name != "cap_undocumented" else (F.col(name) if given else value))
    return grids


def level_maps(evidence: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Levels of a document as one map criterion -> order, and ``shares``, the factors that take the place of a level's (struct<num,den>)."""
    share = F.col("share") if "share" in evidence.columns else F.lit(None).cast(SHARE)
    measured = F.collect_list(F.when(share.isNotNull(), F.struct("key", share.alias("share"))))
    return evidence.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("key", "level_ord"))).alias("levels"), F.map_from_entries(measured).alias("shares"))


def _level_of(key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col("levels"), key), F.lit(1))


def _group_result(c: Column, member_levels: Column) -> Column:
    """k-of-n: contradicted when too few members are left, else by the number of confirmed and partial members."""

    def count(order: int) -> Column:
        return F.size(F.filter(member_levels, lambda x: x == order))

    k = c["at_least"]
    level = (
        F.when(F.size(member_levels) - count(0) < k, 0)
        .when(count(4) >= k, 4)
        .when(count(4) + count(3) >= 1, 3)
        .when(count(2) >= 1, 2)
        .otherwise(1)
    )
    earned = F.aggregate(member_levels, F.lit(0), lambda a, x: a + F.get(F.col("factors"), x))
    share = F.least(earned, k * 1000)
    return F.struct(level.alias("level_ord"), _rounded(c["weight"] * share, k * 10).alias("points"))


def _rounded(numerator: Column, denominator: Column) -> Column:
    """Integer quotient, nearest, ties to even."""
    q = F.floor(numerator / denominator).cast("int")
    r2 = (numerator - q * denominator) * 2
    return q + F.when((r2 > denominator) | ((r2 == denominator) & (F.pmod(q, F.lit(2)) == 1)), 1).otherwise(0)


def criterion_results(docs: DataFrame, evidence: DataFrame, grids: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Every scored criterion for every document; what was not found is ``not documented``, never dropped.

    evidence(keys, key, level_ord) may have a ``share``: the points of its criterion then follow the measured share, at most
    all of them, instead of the factor of the level; caps, tier and potential follow the level as for any other.
    """
    found = docs.join(by_shuffle(level_maps(evidence, keys)), list(keys), "left").withColumns({"levels": F.coalesce("levels", F.create_map().cast("map<string,int>")), "shares": F.coalesce("shares", F.create_map().cast(f"map<string,{SHARE}>"))})
    rows = found.join(broadcast_if_small(grids), "grid_id")

    def result(c: Column) -> Column:
        group = F.size(c["members"]) > 0
        g = _group_result(c, F.transform(c["members"], _level_of))
        order = F.when(group, g["level_ord"]).otherwise(_level_of(c["key"]))
        share = F.try_element_at("shares", c["key"])
        measured = F.when(~group & share.isNotNull() & (order != 1), _rounded(c["weight"] * 100 * F.least(share["num"], share["den"]), share["den"]))
        by_level = _rounded(c["weight"] * F.get(F.col("factors"), _level_of(c["key"])), F.lit(10))
        points = F.when(group, g["points"]).otherwise(F.coalesce(measured, by_level))
        return F.struct(
            c["key"].alias("key"), c["label"].alias("label"), c["category"].alias("category"), c["dimension"].alias("dimension"),
            c["weight"].alias("weight"), c["mandatory"].alias("mandatory"), order.cast("int").alias("level_ord"), points.cast("int").alias("points"),
        )

    return rows.withColumn("results", F.transform(F.filter("criteria", lambda c: c["scored"]), result)).drop("criteria", "levels", "shares")


def _sum(results: Column, value) -> Column:
    return F.aggregate(results, F.lit(0), lambda a, r: a + value(r))


def _labels(results: Column, keep) -> Column:
    return F.transform(F.filter(results, keep), lambda r: r["label"])


def assess(rows: DataFrame) -> DataFrame:
    """Scores, caps, tier, lists and alerts of criterion results."""
    r = F.col("results")
    cap_of = lambda x: F.when(
        x["level_ord"] == 0, F.when(x["category"] == lv.ELIMINATORY, F.col("cap_eliminatory")).when(x["mandatory"], F.col("cap_imperative"))
    ).when((x["level_ord"] == 1) & x["mandatory"], F.col("cap_undocumented"))
    out = rows.withColumn("documented", _sum(r, lambda x: x["points"]))
    out = out.withColumn("open_potential", _sum(r, lambda x: F.when(x["level_ord"] >= 2, x["weight"]).otherwise(0)) * 100)
    out = out.withColumn("caps", F.filter(F.transform(r, lambda x: F.struct(x["label"].alias("criterion"), cap_of(x).alias("cap"))), lambda c: c["cap"].isNotNull()))
    out = out.withColumn("cap", F.array_min(F.transform("caps", lambda c: c["cap"])))
    out = out.withColumn("score", F.least("documented", F.col("cap") * 100)).withColumn("potential", F.least("open_potential", F.col("cap") * 100))
    out = out.withColumn("contradicted_mandatory", _labels(r, lambda x: x["mandatory"] & (x["level_ord"] == 0)))
    out = out.withColumn("open_mandatory", _labels(r, lambda x: x["mandatory"] & x["level_ord"].between(1, 3)))
    out = out.withColumn("missing_mandatory", _labels(r, lambda x: x["mandatory"] & (x["level_ord"] == 1)))
    out = out.withColumn("covered", _labels(r, lambda x: x["level_ord"] == 4)).withColumn("partial", _labels(r, lambda x: x["level_ord"] == 3))
    out = out.withColumn("not_demonstrated", _labels(r, lambda x: x["level_ord"].isin(1, 2))).withColumn("contradicted", _labels(r, lambda x: x["level_ord"] == 0))
    tier = (
        F.when(F.size("contradicted_mandatory") > 0, "ecart_majeur")
        .when(F.size("open_mandatory") > 0, F.when(F.col("potential") < F.col("low_fit") * 100, "adequation_faible").otherwise("a_qualifier"))
        .when(F.col("score") >= F.col("very_interesting") * 100, "tres_interessant")
        .when(F.col("score") >= F.col("interesting") * 100, "interessant")
        .when(F.col("score") >= F.col("low_fit") * 100, "a_qualifier")
        .otherwise("adequation_faible")
    )
    unsure = _sum(r, lambda x: F.when(x["level_ord"].isin(1, 2, 3), x["weight"]).otherwise(0))
    total = F.greatest(_sum(r, lambda x: x["weight"]), F.lit(1))
    out = out.withColumn("tier", tier).withColumn("unsure_pct", _rounded(unsure * 100, total))
    out = out.withColumn("uncertainty", F.when(F.col("unsure_pct") < 25, "faible").when(F.col("unsure_pct") < 50, "moyenne").otherwise("élevée"))
    return out.withColumn("displayed", lv.half_even(F.col("score").cast("bigint"), 100)).withColumn("work_view", F.col("score") >= F.col("work_view_min") * 100)


def alerts(assessed: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per alert: blocking gaps, missing and unconfirmed mandatory criteria, applied caps."""
    named = lambda labels, severity: F.transform(labels, lambda x: F.struct(F.lit(severity).alias("severity"), x.alias("criterion")))
    unconfirmed = F.array_except("open_mandatory", "missing_mandatory")
    rows = F.concat(
        named(F.col("contradicted_mandatory"), "bloquant"),
        named(F.col("missing_mandatory"), "majeur"),
        named(unconfirmed, "à vérifier"),
        F.transform("caps", lambda c: F.struct(F.lit("plafond").alias("severity"), c["criterion"].alias("criterion"))),
    )
    return assessed.select(*keys, F.explode(rows).alias("a")).select(*keys, "a.severity", "a.criterion")


def result_rows(assessed: DataFrame, keys: Sequence[str] = ("doc_id", "grid_id")) -> DataFrame:
    """The long form: one row per (document, criterion)."""
    return assessed.select(*keys, F.explode("results").alias("r")).select(*keys, *[F.col(f"r.{f}").alias(f) for f in RESULT_FIELDS])


def ranked(assessed: DataFrame, group: Sequence[str] = ("grid_id",)) -> DataFrame:
    """Contradicted mandatory criteria first, then open ones, and only then the score and the potential."""
    keyed = assessed.withColumn("n_contradicted", F.size("contradicted_mandatory")).withColumn("n_open", F.size("open_mandatory"))
    return rank_by_counts(keyed, list(group), [("n_contradicted", False), ("n_open", False), ("score", True), ("potential", True)])


def comparison(results: DataFrame, group: Sequence[str] = ("grid_id",)) -> DataFrame:
    """Criterion by level counts (pivot over the five levels) and spread of the points, per grid."""
    counts = [F.count_if(F.col("level_ord") == i).alias(name) for i, name in enumerate(lv.LEVELS)]
    return results.groupBy(*group, "key").agg(*counts, (F.max("points") - F.min("points")).alias("spread"))


def compared(results: DataFrame, wanted: DataFrame, comparison: str = "comparison_id", key: str = "doc_id", grid: str = "grid_id") -> tuple[DataFrame, DataFrame]:
    """Candidates side by side, and the comparisons that are refused because their candidates were assessed on different grids.

    results in long form, wanted(comparison, key). One row per comparison, criterion and candidate: level, points, and
    the spread of the points over the comparison. Spreads are aggregated apart, so a comparison of any size is a join.
    """
    rows = wanted.join(results, key)
    grids = rows.groupBy(comparison).agg(F.count_distinct(grid).alias("grids"))
    same = rows.join(grids.filter("grids = 1").select(comparison), comparison, "left_semi")
    spread = same.groupBy(comparison, "key").agg((F.max("points") - F.min("points")).alias("spread"))
    cells = same.join(spread, [comparison, "key"]).select(comparison, "key", key, lv.level_name(F.col("level_ord")).alias("level"), "points", "spread")
    return cells, grids.filter("grids > 1")


def leader_differences(assessed: DataFrame, group: Sequence[str] = ("grid_id",), key: str = "doc_id", top: int = 3) -> DataFrame:
    """First against second of every group: the criteria with the largest difference of points."""
    order = [F.size("contradicted_mandatory"), F.size("open_mandatory"), F.col("score").desc(), F.col("potential").desc(), F.col(key)]
    two = top_rows(assessed, group, order, 2)
    wide = two.groupBy(*group).agg(
        F.max(F.when(F.col("rn") == 1, F.struct(key, "results"))).alias("a"), F.max(F.when(F.col("rn") == 2, F.struct(key, "results"))).alias("b")
    )
    zipped = F.arrays_zip(F.col("a.results").alias("x"), F.col("b.results").alias("y"))
    pairs = wide.select(*group, F.col(f"a.{key}").alias("leader"), F.col(f"b.{key}").alias("second"), F.posexplode(zipped).alias("pos", "z"))
    diff = F.abs(F.col("z.x.points") - F.col("z.y.points"))
    best = top_rows(pairs, group, [diff.desc(), F.col("pos")], top, "n").filter(diff > 0)
    return best.select(
        *group, "leader", "second", F.col("z.x.key").alias("key"),
        F.col("z.x.points").cast("bigint").alias("leader_points"), F.col("z.y.points").cast("bigint").alias("second_points"),
    )


def assessment_diff(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("doc_id",), removed: bool = False) -> DataFrame:
    """Changed and new criteria between two result tables in long form; removed ones only on request."""
    o = old.select(*keys, "key", F.col("level_ord").alias("from_ord"), F.col("points").alias("from_points"))
    joined = new.select(*keys, "key", "level_ord", "points").join(o, [*keys, "key"], "full" if removed else "left")
    change = (
        F.when(F.col("from_ord").isNull(), "new")
        .when(F.col("level_ord").isNull(), "removed")
        .when((F.col("from_ord") != F.col("level_ord")) | (F.col("from_points") != F.col("points")), "changed")
    )
    delta = F.coalesce("points", F.lit(0)) - F.coalesce("from_points", F.lit(0))
    return joined.withColumn("change", change).filter(F.col("change").isNotNull()).select(
        *keys, "key", "change", lv.level_name(F.col("from_ord")).alias("from_level"), lv.level_name(F.col("level_ord")).alias("to_level"), delta.alias("points_delta")
    )


def with_reasons(new: DataFrame, old: DataFrame, new_evidence: DataFrame, old_evidence: DataFrame, keys: Sequence[str] = ("doc_id",), limit: int = 3) -> DataFrame:
    """``assessment_diff`` with the reasons: the first excerpts of the new evidence that does not come from the document.

    Evidence rows are (keys, key, ord, source, excerpt). A criterion whose level and points stay the same counts as changed
    when its number of evidence rows does. Excerpts are cut to ``REASON_CHARS`` characters, and ``truncated`` says whether one
    was; of a key with very many rows only ``limit`` travel. Rows without an excerpt count and give no reason; a new criterion
    has none, as nothing changed it.
    """
    by = [*keys, "key"]
    count = lambda e, name: e.groupBy(*by).agg(F.count("*").alias(name))
    o = old.select(*by, F.col("level_ord").alias("from_ord"), F.col("points").alias("from_points"), F.lit(True).alias("_known")).join(count(old_evidence, "_before"), by, "left")
    n = new.select(*by, "level_ord", "points").join(count(new_evidence, "_after"), by, "left").join(o, by, "left")
    counts = F.coalesce("_after", F.lit(0)) != F.coalesce("_before", F.lit(0))
    moved = ~F.col("level_ord").eqNullSafe(F.col("from_ord")) | ~F.col("points").eqNullSafe(F.col("from_points")) | counts
    change = F.when(F.col("_known").isNull(), "new").when(moved, "changed")
    later = new_evidence.filter((F.col("source") != DOCUMENT_SOURCE) & F.col("excerpt").isNotNull())
    cut = later.select(*by, "ord", F.substring("excerpt", 1, REASON_CHARS).alias("_x"), (F.length("excerpt") > REASON_CHARS).alias("_cut"))
    first = top_rows(cut, by, [F.col("ord"), F.col("_x")], limit, "_n")
    why = first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_x"))), lambda r: r["_x"]).alias("_because"), F.bool_or("_cut").alias("_cut"))
    out = n.withColumn("change", change).filter(F.col("change").isNotNull()).join(why, by, "left")
    none = F.array().cast("array<string>")
    return out.select(
        *by, "change", lv.level_name(F.col("from_ord")).alias("from_level"), lv.level_name(F.col("level_ord")).alias("to_level"),
        (F.coalesce("points", F.lit(0)) - F.coalesce("from_points", F.lit(0))).alias("points_delta"),
        F.when(F.col("change") == "changed", F.coalesce("_because", none)).otherwise(none).alias("because"),
        F.coalesce((F.col("change") == "changed") & F.col("_cut"), F.lit(False)).alias("truncated"),
    )
