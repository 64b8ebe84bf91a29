"""Profiles cut in Arrow batches: the plan, the parts handed on, and patterns that mean what they mean to Spark."""

import pytest
from pyspark.sql import functions as F

from proofgrid.functions import date_rows as dr
from proofgrid.functions import rows
from proofgrid.functions import text as tx
from proofgrid.operators import profile_rows as pr
from proofgrid.operators import structure as st

TODAY = "2026-10-08"
TEXT = "Jean\nCompétences : Java\nExpériences\nAcme\nDev (01/2015 – 02/2016)\n- Projet (2015 - 2015)\nEnvironnement : Java\nBeta chez Data (2010 – 2012)\n- Autre\n  suite"


def test_only_the_parts_asked_for_leave_the_batches(spark):
    docs = spark.createDataFrame([(1, TEXT), (None, None), (1, TEXT)], "doc_id bigint, text string")
    dated = st.layout(docs, TODAY, keep=["dated"])
    plan = dated._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "lambda" not in plan and "Exchange" not in plan
    assert dated.columns == ["doc_id", "dated"] and sorted(len(r["dated"]) for r in dated.collect()) == [0, 3, 3]
    whole = {r["doc_id"]: r for r in st.layout(docs, TODAY).collect()}
    assert list(whole[1].asDict()) == ["doc_id", "lines", "dated", "experiences", "items"]
    assert [(e["company"], e["title"], e["start"], e["end"]) for e in whole[1]["experiences"]] == [("Acme", "Dev", "2015-01", "2016-02"), ("Beta", "Data", "2010", "2012")]
    hits = spark.createDataFrame([(1, p) for p in range(len(TEXT))], "doc_id bigint, start int")
    by_spans = st.located(hits, st.layout(docs.limit(1), TODAY, keep=["spans"], item_text=True), item_text=True)
    by_lines = st.located(hits, st.layout(docs.limit(1), TODAY), item_text=True)
    assert sorted(map(repr, by_spans.collect())) == sorted(map(repr, by_lines.collect()))


def test_texts_fill_more_than_one_batch(spark):
    docs = spark.range(5_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Langues\nligne "), F.col("id").cast("string")).alias("text")).coalesce(1)
    got = st.layout(docs, TODAY, keep=["lines"]).collect()
    assert len(got) == 5_000 and all(r["lines"][1]["raw"] == f"ligne {r['doc_id']}" for r in got)


@pytest.mark.parametrize("pattern", ["\\bans\\b", "\\w+\\s\\d", "[.;]$", "a.b", "[\\s\\-_/]+x", "\\bé"])
def test_patterns_mean_what_they_mean_to_spark(spark, pattern):
    texts = ["2²ans x", "anś ans", "a b. ", "fin.\r", "éans", "x x - x", "mot\t7", "٣ans ٣", "-_/x", "étéé é", "a\nb;\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = {r.t: r.m for r in df.select("t", F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("m")).collect()}
    assert {t: [m[0] for m in rows.Pattern(pattern).spans(t)] for t in texts} == want


def test_fold_is_the_fold_of_columns(spark):
    texts = ["Été ‑ Œuvre\tß İ", "ΣΑΣ ΣΑΣ\nΣ", "".join(map(chr, [*range(0x20, 0x530), *range(0x1E00, 0x2070)])), "abc"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.fold(F.col("t")).alias("f")).collect()
    assert all(rows.fold(r.t) == r.f for r in got)


def test_ranges_and_headings():
    assert dr.first_range("mission 2000 - 2020 messages", TODAY) is None and dr.first_range("depuis mars 2011", TODAY) == ("mars 2011", "present")
    assert dr.year_month("13/2010") == (2010, None) and dr.year_month("fevr. 2012") == (2012, 2)
    assert [pr.heading(x) for x in ("## skills ##", "missions realisees :", "autre", "")] == ["skills", "experience", None, None]


def test_places_of_positions(spark):
    spans = [[(0, 7), (10, 17), (20, 27)], [], [(5, 9), (20, 30), (8, 30), (40, 41)], None]
    df = spark.createDataFrame([(i, p, spans[i]) for i in range(4) for p in (-1, 0, 6, 7, 8, 12, 20, 29, 30, 40, 41, None)], "i int, at bigint, s array<struct<start:int,end:int>>")
    look = F.arrow_udf(lambda at, s: pr.last_at(s, at.fill_null(0).to_numpy(zero_copy_only=False), at.is_valid().to_numpy(zero_copy_only=False)), "struct<start:int,end:int>")
    for r in df.coalesce(1).withColumn("found", look("at", "s")).collect():
        last = [x for x in spans[r["i"]] or [] if r["at"] is not None and x[0] <= r["at"]][-1:]
        assert (tuple(r["found"]) if r["found"] else None) == (last[0] if last and last[0][1] > r["at"] else None)
