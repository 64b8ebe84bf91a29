"""Rows kept by hash bucket, changed by copy-on-write, named by one manifest a version.

A version appends files to the buckets of its new rows and writes anew only the buckets that lose rows (or hold many
pieces). Which files count is said by the manifest of the version alone; it is complete when its success marker
exists, which is the last thing that is written. Files that no manifest names any more are deleted afterwards, by the
version itself or, after a crash, by the next call: once a version is swept, nothing of an erased row is stored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "bucket int, version int, batch int"
Change = Callable[[DataFrame], DataFrame]


class Files:
    """Listing, deleting and checking paths on whatever store the folder is in."""

    def __init__(self, spark: SparkSession, folder: str):
        path = spark._jvm.org.apache.hadoop.fs.Path
        self.path = path
        self.fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(folder))] if self.exists(folder) else []

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


class BucketStore:
    """Rows with a fixed schema in ``folder``, dealt to ``buckets`` by the hash of ``keys``.

    ``pieces`` is the number of folders that a bucket may have before a version rewrites it as one.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: Sequence[str], buckets: int = 64, pieces: int = 8):
        self.spark, self.folder, self.schema, self.keys, self.buckets, self.pieces = spark, folder.rstrip("/"), schema, list(keys), buckets, pieces
        self.files = Files(spark, folder)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The newest complete version, -1 before the first."""
        root = f"{self.folder}/manifest"
        done = [int(n.split("=")[1]) for n in self.files.names(root) if n.startswith("version=") and self.files.exists(f"{root}/{n}/_SUCCESS")]
        return max(done, default=-1)

    def _manifest(self) -> list[tuple[int, int, int]]:
        at = self.version()
        if at < 0:
            return [(-1, -1, -1)]
        return [tuple(r) for r in self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/version={at}").collect()]

    def manifest(self) -> list[tuple[int, int]]:
        """(bucket, version) of all pieces that count: at most ``buckets`` x ``pieces`` rows."""
        return sorted((b, v) for b, v, _ in self._manifest() if b >= 0)

    def batch(self) -> int:
        """The last batch of a stream that a complete version holds, -1 before the first."""
        return max(n for _, _, n in self._manifest())

    def _piece(self, bucket: int, version: int) -> str:
        return f"{self.folder}/data/version={version}/_bucket={bucket}"

    def _rows(self, pieces: Sequence[tuple[int, int]]) -> DataFrame:
        if not pieces:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._piece(b, v) for b, v in pieces])

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        """The stored rows, of all buckets or of the given ones."""
        return self._rows([(b, v) for b, v in self.manifest() if buckets is None or b in buckets])

    def touched(self, rows: DataFrame) -> set[int]:
        """The buckets of some rows: at most ``buckets`` numbers."""
        return {r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect()}

    def write(self, new: DataFrame | None = None, gone: DataFrame | None = None, batch: int | None = None, change: Change | None = None, replace: bool = False) -> None:
        """One more version: ``new`` rows are added, and all rows whose keys are in ``gone`` are erased, stored ones and new ones.

        With ``change`` they stay, as it returns them. With ``replace`` the new rows take the place of the stored ones of
        their keys. A ``batch`` that a complete version holds already changes nothing: only what an interrupted run may have
        left is deleted.
        """
        if batch is not None and self.batch() >= batch:
            self.sweep()
            return
        before, last, version = self.manifest(), self.batch(), self.version() + 1
        columns = self.schema.names
        new = self.spark.createDataFrame([], self.schema) if new is None else new.select(*columns)
        crowded = {b for b, n in Counter(b for b, _ in before).items() if n >= self.pieces}
        if replace:
            gone = new
        keys = None if gone is None else gone.select(*self.keys).distinct()
        losing = crowded | (set() if keys is None else self.touched(keys) & {b for b, _ in before})

        def left(rows: DataFrame) -> DataFrame:
            if keys is None:
                return rows
            stay = rows.join(keys, self.keys, "left_anti").select(*columns)
            return stay if change is None else stay.unionByName(change(rows.join(keys, self.keys, "left_semi")).select(*columns))

        rows = left(self._rows([(b, v) for b, v in before if b in losing])).unionByName(new if replace else left(new))
        data = f"{self.folder}/data/version={version}"
        rows.withColumn("_bucket", self.bucket()).write.mode("overwrite").partitionBy("_bucket").parquet(data)
        written = {int(n.split("=")[1]) for n in self.files.names(data) if n.startswith("_bucket=")}
        pieces = [(b, v) for b, v in before if b not in losing] + [(b, version) for b in sorted(written)]
        done = last if batch is None else batch
        table = self.spark.createDataFrame([(-1, -1, done), *((b, v, done) for b, v in pieces)], MANIFEST).coalesce(1)
        table.write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")
        self.sweep()

    def sweep(self) -> None:
        """Delete the manifests before the newest complete one, and all pieces that it does not name."""
        at = self.version()
        if at < 0:
            return
        named = set(self.manifest())
        for name in self.files.names(f"{self.folder}/data"):
            v = int(name.split("=")[1])
            if v > at:
                continue
            held = [n for n in self.files.names(f"{self.folder}/data/{name}") if n.startswith("_bucket=")]
            stale = [n for n in held if (int(n.split("=")[1]), v) not in named]
            if len(stale) == len(held):
                self.files.delete(f"{self.folder}/data/{name}")
            else:
                for n in stale:
                    self.files.delete(f"{self.folder}/data/{name}/{n}")
        for name in self.files.names(f"{self.folder}/manifest"):
            if int(name.split("=")[1]) < at:
                self.files.delete(f"{self.folder}/manifest/{name}")
