"""Layout inside the row: long texts, many headings, ties, and positions in arrays longer than a search block."""

import pytest
from pyspark.sql import functions as F

from proofgrid.operators import structure as st

TODAY = "2026-10-08"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_no_text_is_shuffled(spark):
    rows = docs(spark, "Compétences\nJava\nExpériences\nAcme — Dev (01/2015 – 02/2016)\n- Projet Java")
    hits = spark.createDataFrame([(0, "java", 12, 16, "Java")], "doc_id bigint, skill_key string, start int, end int, alias string")
    plan = st.located(hits.join(hits.select("doc_id"), "doc_id", "left_semi"), st.layout(rows, TODAY))._jdf.queryExecution().executedPlan().toString()
    for line in (x for x in plan.splitlines() if "Exchange" in x):
        assert "text" not in line
    assert "Window" not in plan and "text" not in [f.name for f in st.spans_by_document(st.layout(rows, TODAY)).schema.fields]


def test_sections_and_zones(spark):
    text = "Jean\nCompétences\nJava\nExpériences\nAcme — Dev (01/2015 – 02/2016)\n- Projet\nLangues\nAnglais\nExpériences\nBeta — Ops (2010 – 2012)\n- Autre"
    l = {r["line_no"]: r for r in st.lines_of(st.layout(docs(spark, text), TODAY)).collect()}
    assert [l[i]["section"] for i in range(11)] == ["summary", "skills", "skills", "experience", "experience", "experience", "languages", "languages", "experience", "experience", "experience"]
    assert [l[i]["in_zone"] for i in range(11)] == [False] * 3 + [True] * 3 + [False] * 2 + [True] * 3
    assert all(text[r["start"] : r["end"]] == r["raw"] for r in l.values())
    e = sorted(tuple(r[c] for c in ("idx", "company", "title", "start", "end")) for r in st.experiences(docs(spark, text), TODAY).collect())
    assert e == [(0, "Acme", "Dev", "2015-01", "2016-02"), (1, "Beta", "Ops", "2010", "2012")]


@pytest.mark.parametrize("text", [None, "", "\n", "   ", "2010 - 2012", "Expériences", "Expériences\n\n", "x" * 100_000, "Langues\n" * 2_000, "a\n" * 20_000])
def test_odd_texts(spark, text):
    r = st.layout(docs(spark, text), TODAY).first()
    whole = text or ""
    assert [x["raw"] for x in r["lines"]] == whole.split("\n")
    assert all(whole[i["start"] : i["end"]] == i["item"] for i in r["items"])
    assert [x["n"] for x in r["lines"]] == list(range(len(r["lines"])))


def test_items_are_slices_of_the_text(spark):
    body = "\n".join(f"- Tâche {i} sur le système\n  suite de la ligne\n\nParagraphe {i}." for i in range(150))
    text = f"Expériences\nAcme — Dev (01/2015 – 02/2016)\n{body}\nBeta — Ops (2010 – 2012)\n- Fin"
    laid = st.layout(docs(spark, text), TODAY)
    items = sorted((i["start"], i["end"], i["item"], i["idx"]) for i in st.items_of(laid).collect())
    assert len(items) == 301 and all(text[s:e] == t for s, e, t, _ in items)
    assert [x for *_, x in items].count(0) == 300
    # every position is looked up like by walking through all items
    at = [(0, p) for p in range(0, len(text), 37)]
    hits = spark.createDataFrame(at, "doc_id bigint, start int")
    got = {r["start"]: r for r in st.located(hits, laid, item_text=True).collect()}
    exps = sorted((e["s"], e["e"], e["idx"]) for e in st.experiences_of(laid).collect())
    for _, p in at:
        want = [t for s, e, t, _ in items if s <= p < e]
        assert ([got[p]["it"]["item"]] if got[p]["it"] else []) == want
        assert [got[p]["exp_idx"]] == ([i for s, e, i in exps if s <= p < e] or [None])


def test_project_periods_lie_inside_the_block_above(spark):
    text = "Expériences\nAcme — Dev (2015 – 2018)\n- Migration (2016 - 2017) du parc\n- Ancien projet (2009 - 2010) ailleurs\nBeta — Ops (2010 – 2012)\n- Fin (2011 - 2011)"
    d = st.dated_lines(st.layout(docs(spark, text), TODAY, until="dated"))
    assert {r["line_no"]: r["project_period"] for r in d.collect()} == {1: False, 2: True, 3: False, 4: False, 5: True}


def test_search_blocks(spark):
    spans = [(i * 10, i * 10 + 7) for i in range(1000)]
    row = spark.createDataFrame([(spans, list(range(-5, 10_005, 3)))], "spans array<struct<start:int,end:int>>, at array<int>")
    found = row.withColumn("heads", st.heads_of(F.col("spans"))).select(F.transform("at", lambda p: st.span_at(F.col("spans"), F.col("heads"), p)["start"]).alias("s")).first()["s"]
    for p, s in zip(range(-5, 10_005, 3), found):
        assert s == (p // 10 * 10 if 0 <= p < 10_000 and p % 10 < 7 else None)
