"""Grids: criteria from requirements, integer weights, validation, hash, versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.functions import levels as lv


def criteria_of(requirements: DataFrame) -> DataFrame:
    """Requirements to criteria: scored when the category bears weight, it is no constraint and no member of a group."""
    scored = F.col("category").isin(*lv.SCORED) & (F.col("dimension") != "contrainte") & F.col("group_key").isNull()
    return requirements.withColumn("scored", scored).withColumn("mandatory", F.col("category").isin(*lv.MANDATORY))


def largest_remainder(rows: DataFrame, keys: Sequence[str], raw: str, idx: str, total: int = 100, floor: int = 1) -> DataFrame:
    """Integer weights that sum to ``total``, at least ``floor`` each.

    Missing points go to the largest fractional parts. Surplus points are taken one
    at a time, smallest fraction first, round after round, from weights above the
    floor; each item lists the points it can give and the first ones are taken.
    """
    whole = Window.partitionBy(*keys)
    r = rows.withColumn("_s", F.sum(raw).over(whole))
    r = r.withColumn("_exact", F.col(raw).cast("bigint") * total)
    r = r.withColumn("_base", F.greatest(F.floor(F.col("_exact") / F.col("_s")).cast("bigint"), F.lit(floor)))
    r = r.withColumn("_frac", F.pmod("_exact", "_s"))
    r = r.withColumn("_diff", total - F.sum("_base").over(whole))
    r = r.withColumn("_up", F.row_number().over(whole.orderBy(F.col("_frac").desc(), F.col(idx))))
    r = r.withColumn("weight", F.col("_base") + F.when(F.col("_up") <= F.col("_diff"), 1).otherwise(0))
    fits = r.filter(F.col("_diff") >= 0).select(*rows.columns, "weight")
    over = r.filter(F.col("_diff") < 0)
    gifts = over.withColumn("_round", F.explode_outer(F.when(F.col("_base") > floor, F.sequence(F.lit(1), F.least(F.col("_base") - floor, -F.col("_diff")).cast("int")))))
    turn = Window.partitionBy(*keys).orderBy(F.col("_round").asc_nulls_last(), F.col("_up").desc())
    taken = gifts.withColumn("_n", F.row_number().over(turn)).withColumn("_take", (F.col("_round").isNotNull() & (F.col("_n") <= -F.col("_diff"))).cast("int"))
    trimmed = taken.groupBy(*rows.columns, "_base").agg(F.sum("_take").alias("_t")).select(*rows.columns, (F.col("_base") - F.col("_t")).alias("weight"))
    return fits.unionByName(trimmed)


def messages(*checks: tuple[Column, str]) -> Column:
    """Codes of the checks that hold, in order."""
    return F.filter(F.array(*[F.when(cond, F.lit(code)) for cond, code in checks]), lambda x: x.isNotNull())


def grid_errors(criteria: DataFrame, keys: Sequence[str] = ("grid_id",)) -> DataFrame:
    """Blocking errors and warnings of a grid from its criteria: weights, empty weights, mandatory rows without a score."""
    scored = F.col("scored")
    per = criteria.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(scored, F.col("weight"))), F.lit(0)).alias("total"),
        F.count_if(scored & (F.col("weight") <= 0)).alias("zero"),
        F.count_if(scored).alias("n"),
        F.coalesce(F.sum(F.when(scored & F.col("mandatory"), F.col("weight"))), F.lit(0)).alias("mandatory"),
        F.count_if(scored & (F.col("weight") > 40)).alias("big"),
        F.count_if(F.col("mandatory") & ~scored & (F.col("dimension") != "contrainte")).alias("unscored"),
    )
    errors = messages((F.col("total") != 100, "weights"), (F.col("zero") > 0, "zero_weight"), (F.col("n") == 0, "no_scored_criterion"), (F.col("unscored") > 0, "mandatory_not_scored"))
    warnings = messages(((F.col("total") == 100) & (F.col("mandatory") > 0) & (F.col("mandatory") < 50), "mandatory_below_half"), (F.col("big") > 0, "above_forty"))
    return per.select(*keys, errors.alias("errors"), warnings.alias("warnings"))


def missing_members(criteria: DataFrame, keys: Sequence[str] = ("grid_id",)) -> DataFrame:
    """Group criteria that name a member absent from their grid, or ask for more members than they list."""
    groups = criteria.filter(F.size("members") > 0)
    named = groups.select(*keys, F.col("key").alias("group_key"), F.explode("members").alias("key"))
    absent = named.join(criteria.select(*keys, "key"), [*keys, "key"], "left_anti").select(*keys, "group_key", F.col("key").alias("member"))
    too_many = groups.filter(F.col("at_least") > F.size("members")).select(*keys, F.col("key").alias("group_key"), F.lit(None).cast("string").alias("member"))
    return absent.unionByName(too_many)


def parameter_errors(very: Column, interesting: Column, low: Column, factors: Column, caps: Column) -> Column:
    """Thresholds, caps and factors out of bounds or out of order. Factors are ordered by level, in thousandths."""
    outside = lambda c: (c < 0) | (c > 100)
    bad = outside(very) | outside(interesting) | outside(low)
    confirmed, partial, declared = F.get(factors, F.lit(4)), F.get(factors, F.lit(3)), F.get(factors, F.lit(2))
    order = ~((confirmed >= partial) & (partial >= declared)) | (F.array_min(factors) < 0) | (F.array_max(factors) > 1000)
    return messages(
        (bad, "threshold_bounds"),
        (~bad & ~((low <= interesting) & (interesting <= very)), "threshold_order"),
        (F.exists(caps, lambda c: c.isNotNull() & outside(c)), "cap_bounds"),
        (order, "factor_order"),
        ((F.get(factors, F.lit(0)) != 0) | (F.get(factors, F.lit(1)) != 0), "factor_zero"),
    )


def grid_hash(criteria: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """SHA-256 of the criteria of a grid as canonical JSON (sorted by key; fields in the given order)."""
    body = F.array_sort(F.collect_list(F.struct(*fields)))
    return criteria.groupBy(*keys).agg(F.sha2(F.to_json(body), 256).alias("content_hash"))


def grid_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], compared: Sequence[str] = ("weight", "category", "depth")) -> DataFrame:
    """Added, removed and changed criteria between two versions."""
    a = old.select(*keys, "key", F.struct(*compared).alias("_a"))
    b = new.select(*keys, "key", F.struct(*compared).alias("_b"))
    both = a.join(b, [*keys, "key"], "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.withColumn("change", change).filter(F.col("change").isNotNull()).select(
        *keys, "key", "change", *[F.col(f"_a.{c}").alias(f"from_{c}") for c in compared], *[F.col(f"_b.{c}").alias(f"to_{c}") for c in compared]
    )


def keep_old_weights(fresh: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A new version keeps the old weights only when every scored key existed and they sum to 100."""
    o = old.select(*keys, "key", F.col("weight").alias("_old"))
    joined = fresh.join(o, [*keys, "key"], "left")
    per = joined.groupBy(*keys).agg(F.bool_and(F.col("_old").isNotNull()).alias("_all"), F.sum("_old").alias("_sum"))
    flagged = joined.join(per.select(*keys, (F.col("_all") & (F.col("_sum") == 100)).alias("kept")), list(keys))
    return flagged.withColumn("weight", F.when(F.col("kept"), F.col("_old")).otherwise(F.col("weight"))).drop("_old")
