"""Session settings shared by the queries, the tests and the benchmark."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "proofgrid") -> SparkSession:
    """A session with adaptive execution on; cluster managers override every value."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        builder = builder.config("spark.sql.shuffle.partitions", os.environ.get("SPARK_SHUFFLE_PARTITIONS", "8"))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """The folder every executor can reach, as named by the cluster."""
    return spark.conf.get("spark.checkpoint.dir", None)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the cluster's shared folder; in a temporary one only on a local master."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None and spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if folder is not None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
