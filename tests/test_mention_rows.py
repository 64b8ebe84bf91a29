"""The analysis of mentions in Arrow batches: the plan, odd rows, and single rules beside their column expressions."""

from pyspark.sql import functions as F

from proofgrid.functions import scope as sp
from proofgrid.functions import text as tx
from proofgrid.operators import evidence as ev
from proofgrid.operators import mention_rows as mr

TODAY = "2026-10-08"
SCHEMA = "id int, item string, at int, kind string, clues array<struct<term:string,rx:string>>"
CLUES = [("topics", "(?<![a-z0-9+#])topics(?![a-z0-9+#])"), ("Débits", "(?<![a-z0-9+#])debit(?:s|x)?(?![a-z0-9+#])"), ("throughput", "(?<![a-z0-9+#])throughput(?![a-z0-9+#])")]
ITEMS = [
    "- Mise en place de Kafka : 3 topics, débit de 20 %. Équipe qui administre Redis ; formation en cours de Nginx", "Je n'ai jamais utilisé Kafka, ni Redis. Responsable d'un runbook",
    "Administration : Kafka, Redis, Nginx, Linux", "Jamais de problème avec Kafka en 2031", "Œuvre naïve ² m², animation de formations Kafka", "", "Projet personnel Kafka ; non utilisé",
]


def test_the_analysis_is_one_pass(spark):
    rows = spark.createDataFrame([(1, ITEMS[0], 20, "skill", CLUES)], SCHEMA)
    plan = ev.analyse_mentions(rows, TODAY).filter("not negated and level_ord > 1").select("id", "points")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan and "Generate" not in plan


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None, "skill", CLUES), (2, "Développement Kafka", None, None, CLUES), (3, "", 0, "domain", CLUES), (4, "Kafka", 99, "skill", None), (4, "Kafka", 99, "skill", None)], SCHEMA)
    got = {r["id"]: r for r in ev.analyse_mentions(rows, TODAY).collect()}
    assert got[1]["level_ord"] == 2 and got[1]["negated"] is None and got[1]["points"] is None and got[1]["action"] == "none"
    assert got[2]["action"] == "strong" and got[2]["level_ord"] == 3 and got[3]["window"] == "" and got[4]["depth"] is None
    assert ev.analyse_mentions(rows, TODAY).count() == 5


def test_rules_agree_with_their_columns(spark):
    df = spark.createDataFrame([(t,) for t in ITEMS], "t string").withColumn("f", tx.fold(F.col("t")))
    df = df.select("t", "f", sp.clauses(F.col("f")).alias("c"), sp.cap_codes(F.col("f"), TODAY).alias("caps"), sp.stack_list(F.col("f")).alias("listed"), ev.distinct_clues(F.col("f"), F.array(*[F.struct(F.lit(a).alias("term"), F.lit(b).alias("rx")) for a, b in CLUES])).alias("d"))
    for r in df.withColumn("neg", sp.negated_regions(F.col("f"), F.col("c"))).collect():
        assert [tuple(c) for c in r["c"]] == mr.clauses(r["f"]) and [tuple(n) for n in r["neg"]] == mr.negated_regions(r["f"], mr.clauses(r["f"]))
        assert r["caps"] == mr.cap_codes(r["f"], 2026) and r["listed"] == mr.stack_list(r["f"])
        assert r["d"] == mr.distinct_clues(r["f"], [{"term": a, "rx": b} for a, b in CLUES])
