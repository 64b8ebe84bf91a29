"""Intervals and positions inside a key, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assign_to_spans(
    points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str = "start", end: str = "end", into: str = "span"
) -> DataFrame:
    """For every point the span of the same key that holds it, or null.

    Spans of one key must not overlap. Points and spans are merged in position order
    and the last span opened is carried forward, so the cost is one sort per key.
    """
    span_fields = [c for c in spans.columns if c not in keys]
    left = points.select(*keys, F.col(at).cast("bigint").alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_p"))
    right = spans.select(*keys, F.col(start).cast("bigint").alias("_at"), F.lit(0).alias("_kind"), F.struct(*span_fields).alias("_s"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    opened = both.withColumn("_open", F.last("_s", ignorenulls=True).over(order)).filter(F.col("_kind") == 1)
    return opened.select("_p.*", F.when(F.col("_at") < F.col(f"_open.{end}"), F.col("_open")).alias(into))


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Union of overlapping or touching intervals per key (gaps and islands).

    Intervals are reduced to one per (key, start) first, so a key with very many
    intervals on a bounded calendar stays small when it is sorted.
    """
    reduced = df.groupBy(*keys, F.col(start).alias("_s")).agg(F.max(end).alias("_e"))
    w = Window.partitionBy(*keys).orderBy("_s")
    reach = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = reduced.withColumn("_new", F.when(reach.isNull() | (F.col("_s") > reach), 1).otherwise(0))
    numbered = opened.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("_s").alias(start), F.max("_e").alias(end))


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], ls: str, le: str, rs: str, re: str, width: int = 512, how: str = "inner"
) -> DataFrame:
    """Pairs of one key whose half-open intervals overlap.

    Both sides are cut into cells of ``width`` positions and joined on (key, cell);
    a pair that shares several cells is kept in its first common cell only.
    """

    def cells(s: str, e: str) -> Column:
        first = F.floor(F.col(s) / width).cast("bigint")
        last = F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / width).cast("bigint")
        return F.explode(F.sequence(first, last))

    a = left.withColumn("_cell", cells(ls, le))
    b = right.withColumn("_cell", cells(rs, re))
    pairs = a.join(b, [*keys, "_cell"])
    first_common = F.floor(F.greatest(F.col(ls), F.col(rs)) / width).cast("bigint")
    return pairs.filter((F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs)) & (F.col("_cell") == first_common)).drop("_cell")


def contained_in_longer(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> Column:
    """True when a strictly longer interval of the same key holds this one."""
    by_start = Window.partitionBy(*keys).orderBy(F.col(start).cast("bigint")).rangeBetween(Window.unboundedPreceding, -1)
    same_start = Window.partitionBy(*keys, start)
    earlier = F.coalesce(F.max(end).over(by_start) >= F.col(end), F.lit(False))
    return earlier | (F.max(end).over(same_start) > F.col(end))
