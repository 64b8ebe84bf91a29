"""Sides of joins that grow with the data are shuffled, whatever Spark takes their size to be."""

import pytest

from proofgrid.plans.base import QUERIES
from proofgrid.plans import registry  # noqa: F401

DERIVED = ["agg_22_strongest_requirement", "fn_20_k_among_n", "join_26_title_mismatch", "join_6_mention_to_experience", "agg_34_declared_gap", "fn_22_typed_facts"]


@pytest.mark.parametrize("name", DERIVED)
def test_rows_built_from_a_table_are_not_broadcast(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    grown = ("mission_id#", "doc_id#", "note_id#")
    assert not [line for line in keys if any(k in line.split("], ")[0] for k in grown)]


@pytest.mark.parametrize("name", ["agg_37_distinct_deliverables", "agg_30_theme_parts"])
def test_orders_are_not_broadcast_to_their_phrases(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [doc_id#" in plan
