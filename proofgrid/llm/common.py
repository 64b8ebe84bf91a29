"""What the operators of this subpackage share: saved tables, whole texts in tasks, word splitting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2_000_000


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on a local master (tests, local runs)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: computed once, and whole if executors are lost later."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heaviest(counts: DataFrame, key: str, limit: int) -> DataFrame:
    """The keys with the largest counts ``n``, at most ``limit``, never one that was seen once.

    The keys are counted by the magnitude of their count first (a row per power of two), so that only the magnitudes
    that can matter, four times ``limit`` keys at most, are sorted.
    """
    sizes = {r["m"]: r["k"] for r in counts.filter("n > 1").groupBy(F.floor(F.log2("n")).cast("int").alias("m")).agg(F.count(F.lit(1)).alias("k")).collect()}
    cut, total = 63, 0
    for m in sorted(sizes, reverse=True):
        if total >= limit or total + sizes[m] > 4 * limit:
            break
        cut, total = m, total + sizes[m]
    return counts.filter((F.col("n") > 1) & (F.floor(F.log2("n")) >= cut)).orderBy(F.desc("n"), key).limit(limit)


def one_thread() -> None:
    """Libraries inside tasks use the task's core only."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def chunks(batches: Iterator[pa.RecordBatch], column: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with about ``limit`` bytes of text each (one row at least), and the values of the text column.

    Texts are whole; a slice only bounds how many of them are split into words at a time.
    """
    for batch in batches:
        texts = batch.column(column).to_pylist()
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t) if t else 0
            if size >= limit or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0
