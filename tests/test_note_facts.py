"""Facts of notes: sentences are cut once, and facts of one kind need no other."""

from pyspark.sql import functions as F

from proofgrid.operators import notes as nt
from proofgrid.operators.mentions import LEXICON_SCHEMA
from proofgrid.operators.scale import parameter_table
from proofgrid.plans.base import TODAY
from proofgrid.plans.evidence_queries import KAFKA

TEXT = "Candidat : J'ai développé des services Kafka avec 3 topics.\nCandidat : Mon TJM est de 550 euros.\nClient : Il nous faut absolument Kafka."


def test_sentences_are_cut_once_and_constraints_look_up_no_mentions(spark):
    notes = spark.range(3).select(F.col("id").alias("note_id"), F.lit(TEXT).alias("text"))
    f = nt.facts(notes, parameter_table(spark, [KAFKA], LEXICON_SCHEMA), TODAY)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan(f)
    assert "Join" not in plan(f.filter("kind = 'candidate_constraint'"))
    got = {(r["kind"], r["topic"], r["field"], r["n"]) for r in f.groupBy("kind", "topic", "field").agg(F.count("*").alias("n")).collect()}
    assert got == {("candidate_experience", "kafka", None, 3), ("candidate_constraint", None, "tjm", 3), ("client_requirement", "kafka", None, 3)}
