"""All queries and their SQL, by name."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from proofgrid.plans import base

MODULES = (
    "text_queries",
    "mention_queries",
    "scoring_queries",
    "filter_queries",
    "structure_queries",
    "evidence_queries",
    "matching_queries",
    "need_queries",
    "note_queries",
    "governance_queries",
    "export_queries",
    "stream_queries",
)

for _m in MODULES:
    importlib.import_module(f"proofgrid.plans.{_m}")


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["win_4_rank"](spark, sf_dir)
