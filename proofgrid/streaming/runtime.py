"""Folders and runs of the streaming jobs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

from proofgrid.session import shared_folder
from proofgrid.streaming.store import Files


def base_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one in local mode."""
    base = shared_folder(spark)
    if base is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return base.rstrip("/")


def work_folder(spark: SparkSession, job: str, folder: str | None = None) -> str:
    """Where a job keeps its checkpoint, state tables and output.

    With a ``folder`` the place is the same at every start, and the job goes on where it stopped. Without one the run is
    a single drain of its input and gets a new folder.
    """
    return f"{folder.rstrip('/')}/{job}" if folder else f"{base_folder(spark)}/{job}-{uuid.uuid4().hex}"


def arrivals(df: DataFrame, delivery: Column, n: int) -> Iterator[str]:
    """The table as ``n`` deliveries of as many files as it has partitions: after each one the folder is handed out, to be
    drained by one run of a job."""
    folder = f"{base_folder(df.sparkSession)}/arrivals-{uuid.uuid4().hex}"
    for i in range(n):
        df.filter(delivery == i).write.mode("append").parquet(folder)
        yield folder


def file_stream(spark: SparkSession, folder: str, like: DataFrame, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(like.schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_batches(stream: DataFrame, folder: str, step: Callable[[DataFrame, int], None], mode: str = "append") -> list:
    """Process everything that is available, batch by batch, then stop; restarts continue from the checkpoint. Returns the last progress reports."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(step).trigger(availableNow=True).start()
    query.awaitTermination()
    return list(query.recentProgress)


def write_batch(df: DataFrame, folder: str, batch: int, *by: str) -> None:
    """Output of one batch; a replayed batch replaces its own output only."""
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/batch={batch}")


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")


def drop_batches(spark: SparkSession, folder: str) -> None:
    """Delete batches that the stream reading them has taken over (its log remembers them)."""
    files = Files(spark, folder)
    for name in files.names(folder):
        if name.startswith("batch="):
            files.delete(f"{folder}/{name}")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Keyed state with timers needs the store that keeps it on disk; the session's own choice is put back afterwards."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
