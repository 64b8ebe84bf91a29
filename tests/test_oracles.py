"""Queries against their SQL on the small tables. PROOFGRID_ALL=1 runs every registered query."""

import os

import pytest

import __spark_entry__ as entry
from check import connect, rows_of

SOME = [
    "prj_1_fold", "prj_3_normalize_text", "prj_7_scrub_contact_lines", "fn_1_sentences", "src_4_admission", "flt_7_injection_flags", "join_1_mentions", "join_4_nested_pruning",
    "win_4_rank", "agg_5_alerts", "agg_8_k_of_n", "win_12_surplus", "join_29_implied_parents", "agg_12_many_filters", "win_14_unlocking_steps", "fn_13_durations", "join_7_mention_location",
    "fn_9_skill_levels", "fn_10_recency", "agg_25_conflict_report", "fn_23_constraint_values", "fn_39_ordered_evidence_fold", "win_13_hash_chain", "win_18_request_rate", "str_7_late_evidence",
]
NAMES = list(entry.queries()) if os.environ.get("PROOFGRID_ALL") else SOME


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())


def test_every_query_has_sql():
    assert {q for q in entry.queries() if not (q == "pipeline" or q.startswith("op"))} == {q for q in entry.oracle_sql() if not (q == "pipeline" or q.startswith("op"))}


def test_flagship_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
