"""Rows that lie unevenly in their file are dealt to all cores."""

from pyspark.sql import functions as F

from proofgrid.plans import base


def test_rows_that_lie_in_one_split_are_dealt_to_all_cores(spark):
    copies = F.when(F.col("id") == 0, 2000).otherwise(1)
    skewed = spark.range(0, 8, 1, 8).select(F.explode(F.sequence(F.lit(1), copies)).alias("n"), "id").select((F.col("n") * 8 + F.col("id")).alias("k"))
    held = base.spread(skewed, "k").groupBy(F.spark_partition_id()).count()
    assert held.agg(F.max("count")).first()[0] < 1000 and base.spread(skewed, "k").count() == 2007


def test_even_splits_of_too_many_rows_are_dealt_to_more_tasks(spark):
    rows = spark.range(0, 8000, 1, 8).withColumnRenamed("id", "k")
    held = base.spread(rows, "k", rows_a_task=100).groupBy(F.spark_partition_id()).count()
    assert held.agg(F.max("count")).first()[0] <= 200 and base.spread(rows, "k", rows_a_task=100).count() == 8000
    assert base.spread(rows, "k", rows_a_task=None).rdd.getNumPartitions() == 8


def test_a_task_of_rows_that_become_texts_stays_short(spark):
    rows = spark.range(0, 480_000, 1, 4).withColumnRenamed("id", "k")
    dealt = base.spread(rows, "k")
    assert dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 40_000
    assert dealt.rdd.getNumPartitions() % spark.sparkContext.defaultParallelism == 0 and dealt.count() == 480_000
