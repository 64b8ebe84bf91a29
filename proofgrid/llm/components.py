"""Connected components of a link table by alternating large and small stars, all in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of ``links`` (a, b bigint).

    Large star: every node links its larger neighbours to the smallest neighbour it knows. Small star: every node links
    its smaller neighbours, and itself, to the smallest of them. Both keep the components and shorten all paths; about
    log2 of the longest path rounds are needed. Minima are aggregated on the map side, and the join that hands them out
    has one row per node on one side, so a node with very many links is split by Spark like any skewed join key.
    """
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = saved(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = saved(small.select("e.u", "e.v").filter("u <> v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
