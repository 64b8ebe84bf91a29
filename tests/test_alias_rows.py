"""Aliases found in Arrow batches: the plan, repeated and null keys, spellings."""

from proofgrid.operators import mentions as mn
from proofgrid.operators.scale import parameter_table
from proofgrid.plans.lexicon import _skill


def test_texts_are_read_once_and_not_exploded(spark):
    lex = parameter_table(spark, [_skill("big", ["big data"], after=["of"]), _skill("cpp", ["C++"], cs=["C++"]), _skill("java", ["Java"], needed=["big data"])], mn.LEXICON_SCHEMA)
    docs = spark.createDataFrame([(1, "BIG-Data et bigdatas, C++ c++"), (1, "BIG-Data et bigdatas, C++ c++"), (None, "java, Big  data of"), (2, None), (3, "Java")], "doc_id bigint, text string")
    raw = mn.raw_mentions(docs, lex)
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan and "Broadcast" not in plan
    one = [(1, "big", 0, 8, "big data"), (1, "big", 12, 20, "big data"), (1, "cpp", 22, 25, "C++")]
    got = sorted((tuple(r) for r in raw.collect()), key=lambda r: (r[0] is None, str(r[1]), r[2]))
    assert got == sorted(one * 2, key=lambda r: (r[1], r[2])) + [(None, "java", 0, 4, "Java")]
