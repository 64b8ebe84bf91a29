"""Writers: nested JSON, assembled text, append-only versions, the audit head."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(documents: DataFrame, path: str, column: str = "document") -> None:
    documents.select(column).write.mode("overwrite").text(path)


def append_versions(df: DataFrame, path: str, *partitions: str) -> None:
    """New rows only: stored versions are never rewritten."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def publish_head(head: DataFrame, path: str) -> None:
    """One small row per chain, replaced on every run."""
    head.coalesce(1).write.mode("overwrite").json(path)
