"""Building blocks that keep joins, ranks and ordered scans balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofgrid.session import durable

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def parameter_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of parameters written in code: its size is known, so it may be broadcast."""
    df = spark.createDataFrame(list(rows), schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a side for broadcast only after counting its rows and bytes (the count stops at the limit)."""
    probe = df.limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("b"),
    )
    size = probe.first()
    return F.broadcast(df) if size["n"] <= max_rows and size["b"] <= max_bytes else df


def by_shuffle(df: DataFrame) -> DataFrame:
    """Mark a side that grows with the data for a sort-merge join.

    Spark sizes derived rows by the files under them: arrays count as one element and exploded rows as one. A table of
    sentences or offsets built from narrow columns looks smaller than the broadcast limit and would pass through the driver.
    """
    return df.hint("merge")


def rank_by_counts(df: DataFrame, group: Sequence[str], order: Sequence[tuple[str, bool]], name: str = "rank") -> DataFrame:
    """``rank()`` inside a group that may hold most of the table.

    Rows are counted per distinct order key first (partial aggregation on the map
    side), the running count is taken over those keys only, and the rank is joined
    back: no task ever sorts a whole group. ``order`` holds (column, descending).
    """
    keys = [*group, *[c for c, _ in order]]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    by = [F.col(c).desc() if desc else F.col(c).asc() for c, desc in order]
    before = Window.partitionBy(*group).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select(*keys, (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1).cast("bigint").alias(name))
    return df.join(ranks, keys, "left")


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "ord") -> DataFrame:
    """Numbers that grow along (keys, order) over the whole table, with gaps.

    Rows are range-partitioned by keys and order and sorted inside the partitions: a key of any size is spread over as
    many partitions as its rows fill. The number is the partition's and the place in it, so no task counts a whole key.
    ``order`` must leave no ties inside a key whose rows differ.
    """
    by = [*keys, *order]
    return df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id())


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``sum(value)`` from the first row of a key up to this one, for keys of any size.

    Rows are put in order by a range partition, summed inside each (key, partition), and shifted by what the key holds in
    earlier partitions: a row a partition is all that is carried. ``order`` must leave no ties inside a key.
    """
    placed = durable(in_order(df, keys, order, "_ord").withColumn("_part", F.shiftright("_ord", 33)))
    cell = [*keys, "_part"]
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = placed.groupBy(*cell).agg(F.sum(value).alias("_s")).withColumn("_c", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    carry = carry.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(cell)], "_c")
    inside = Window.partitionBy(*cell).orderBy("_ord").rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(cell)])
    out = placed.withColumn("_r", F.sum(value).over(inside)).join(carry, same)
    return out.withColumn(name, F.col("_r") + F.col("_c")).drop("_ord", "_part", "_r", "_c", *[f"_k{i}" for i in range(len(cell))])


def composed_in_order(df: DataFrame, keys: Sequence[str], number: str, value: str, compose: Callable[[Column], Column], piece: int = 1024) -> DataFrame:
    """(keys, value): the values of a key composed in the order of their numbers.

    ``compose`` takes an array of structs (number, value) in order. Values are composed in pieces of neighbouring numbers,
    pieces of pieces again, so a list never holds more than ``piece`` values and a hot key is many small groups; the last
    lists hold one value for each partition that the key spans.
    """
    part = df.select(*keys, F.col(number).alias("_p"), F.col(value).alias(value))
    rows = F.array_sort(F.collect_list(F.struct("_p", value)))
    # a number is a place of up to 33 bits and the partition above it: three levels fold the places
    for _ in range(3):
        part = part.groupBy(*keys, F.floor(F.col("_p") / piece).alias("_q")).agg(compose(rows).alias(value)).withColumnRenamed("_q", "_p")
    return part.groupBy(*keys).agg(compose(rows).alias(value))


def row_number_by_bucket(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "rn"
) -> DataFrame:
    """``row_number()`` inside keys of any size.

    ``bucket`` must not decrease along ``order`` (for example an id divided by a
    constant, or the hour of a timestamp). Numbers are given inside a (key, bucket)
    and shifted by the rows of the earlier buckets, which are counted beforehand.
    """
    b = df.withColumn("_b", bucket)
    sizes = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    out = b.withColumn("_rn", F.row_number().over(inside)).join(shift, [*keys, "_b"])
    return out.withColumn(name, (F.col("_rn") + F.col("_shift")).cast("bigint")).drop("_b", "_rn", "_shift")


def previous_by_bucket(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], value: str, order_key: Column, name: str
) -> DataFrame:
    """``lag(value)`` inside keys of any size: the first row of a bucket takes the last value of the bucket before."""
    b = df.withColumn("_b", bucket)
    last = b.groupBy(*keys, "_b").agg(F.max_by(F.col(value), order_key).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_b")
    carried = last.select(*keys, "_b", F.lag("_last").over(earlier).alias("_carry"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    out = b.withColumn("_lag", F.lag(value).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    out = out.join(carried, [*keys, "_b"], "left")
    return out.withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))).drop(
        "_b", "_lag", "_first", "_carry"
    )


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rn") -> DataFrame:
    """The first ``k`` rows per key.

    Spark cuts every map partition down to ``k`` rows per key before the shuffle
    (window group limit), so a hot key costs ``k`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("bigint")).filter(F.col(name) <= k)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose values later filters and projections only read.

    A filter on a plain projected column is rewritten in terms of its expression and
    pushed below; for an expression of many patterns that would evaluate it again for
    every use. A one-row generator keeps the value.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
