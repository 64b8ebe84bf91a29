"""Registration of queries and readers of the input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TODAY = "2026-10-08"          # the reference date of every rule that compares with "today"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_A_TASK = 25_000           # a profile text takes some 2 ms of a core


def spread(df: DataFrame, *keys: str, rows_a_task: int | None = ROWS_A_TASK) -> DataFrame:
    """Hash-partition by the row key when the scan leaves cores idle, or gives one split twice its share or too many rows.

    Splits are cut by bytes, but a row group is read whole by the split that holds its middle: a file of one row group is
    one task whatever its size, and a split of narrow rows holds millions of them, each of which becomes a text. So rows are
    counted by split (no column is read), and rows that lie unevenly or more than twice ``rows_a_task`` to a split are dealt
    to a multiple of the cores, of at most about ``rows_a_task`` rows, so no core waits for the last ones. Rows that hold
    their text already (``rows_a_task`` None) are bounded by the bytes of their split and moved only if they lie unevenly.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    size = held.agg(F.count("split").alias("splits"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    even = size["splits"] >= cores and size["most"] * cores <= 2 * size["rows"]
    small = rows_a_task is None or size["most"] <= 2 * rows_a_task
    return df if even and small else df.repartition(cores * max(1, -(-size["rows"] // (cores * (rows_a_task or ROWS_A_TASK)))), *keys)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id", rows_a_task=None)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "conversations"), "conv_id", "turn", rows_a_task=None)


def fold_sql(expr: str) -> str:
    """The fold on DuckDB, by its own accent stripping."""
    return f"lower(strip_accents(translate({expr}, chr(9) || chr(13) || chr(160) || chr(8239) || '‐‑‒−', '    ----')))"


def squash_sql(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '[\\s\\x{{a0}}]+', ' ', 'g'))"


def term_sql(folded: str, term_rx: str) -> str:
    """Word-bounded term predicate for an engine without look-around."""
    return f"regexp_matches({folded}, '(^|[^a-z0-9+#])(?:{term_rx})($|[^a-z0-9+#])')"
