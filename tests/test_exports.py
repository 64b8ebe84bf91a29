"""Exports read their experiences once."""

from proofgrid.plans import registry


def test_a_document_is_assembled_from_one_pass_over_the_profiles(spark, sf):
    plan = registry.queries()["src_8_text_document"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
