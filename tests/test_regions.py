"""Sentences with negated regions are cut once for their mentions and their regions."""

from proofgrid.plans import registry


def test_the_texts_are_read_before_the_join_only(spark, sf):
    plan = registry.queries()["join_9_mentions_in_regions"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan
