"""Allow-listed reads, tagged snapshots, archives."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from proofgrid.plans.need_queries import NEEDS, OPEN_NEEDS
from proofgrid.sources import archives
from proofgrid.sources import needs_source as ns
from proofgrid.sources import warehouse as wh


def orders(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet")


def test_conditions_and_columns_reach_the_scan(spark, sf):
    df = wh.read(orders(spark, sf), NEEDS, ["external_id", "reference"], [("state", "=", "P")], limit=5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,P)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderpriority:string>" in plan
    assert df.columns == ["external_id", "reference"] and df.count() <= 5


@pytest.mark.parametrize("ask", [
    {"columns": ["o_comment"]}, {"columns": ["external_id; DROP TABLE x"]}, {"where": [("reference", "=", "x")]}, {"where": [("state", "like", "x")]}, {"limit": 0}, {"limit": 10**12},
])
def test_what_is_off_the_list_is_refused(spark, sf, ask):
    with pytest.raises(ValueError):
        wh.read(orders(spark, sf), NEEDS, **ask)


def test_values_are_literals_and_fixed_conditions_hold(spark, sf):
    assert wh.read(orders(spark, sf), NEEDS, where=[("state", "=", "P' OR '1'='1")]).count() == 0
    rows = wh.read(orders(spark, sf), OPEN_NEEDS, ["owner"])
    assert rows.agg(F.max("owner")).first()[0] <= 900


def test_one_need(spark, sf):
    first = orders(spark, sf).agg(F.min("o_orderkey")).first()[0]
    assert [r["external_id"] for r in wh.by_identifier(orders(spark, sf), NEEDS, str(first)).collect()] == [first]
    for bad in ("", "1 OR 1=1", "-1", "9" * 13, "١"):
        assert wh.by_identifier(orders(spark, sf), NEEDS, bad).count() == 0


def test_tagged_snapshots(spark, tmp_path):
    good = {"schema": ns.SNAPSHOT_SCHEMA, "needs": [{"external_id": "1", "title": "a"}, {"external_id": "2"}]}
    cases = {
        "good": (good, None), "tag": (good | {"schema": "other"}, "wrong_schema"), "untagged": ({"needs": []}, "wrong_schema"), "list": ({"schema": ns.SNAPSHOT_SCHEMA}, "wrong_schema"),
        "broken": ("{", "unreadable"), "empty": ("", "unreadable"), "array": ("[1]", "unreadable"),
    }
    rows = spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, (v, _) in cases.items()] + [("null", None)], "name string, json string")
    got = {r["name"]: (r["problem"], len(r["needs"])) for r in ns.tagged_snapshots(rows).collect()}
    assert got == {k: (p, 2 if k == "good" else 0) for k, (_, p) in cases.items()} | {"null": ("unreadable", 0)}
    (tmp_path / "good.json").write_text(json.dumps(good))
    assert [r["external_id"] for r in ns.read_tagged_snapshot(spark, str(tmp_path / "good.json")).orderBy("external_id").collect()] == ["1", "2"]
    for name, text in (("tag", good | {"schema": "x"}), ("field", good | {"needs": [{"external_id": "1", "phone": "2"}]}), ("twice", good | {"needs": good["needs"] * 2})):
        (tmp_path / f"{name}.json").write_text(json.dumps(text))
        with pytest.raises(Exception, match="snapshot refused"):
            ns.read_tagged_snapshot(spark, str(tmp_path / f"{name}.json")).collect()


def archive(*entries, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
        z.comment = comment
    return out.getvalue()


def test_archives(spark):
    word = archive(("[Content_Types].xml", "x" * 500), ("word/document.xml", "text " * 400), ("word/styles.xml", "y"))
    many = archive(*[(f"f{i}.txt", "z") for i in range(300)], ("word/document.xml", "t"))
    cases = {
        "word": (word, "docx"), "many": (many, "docx"), "comment": (archive(("word/document.xml", "t"), comment=b"PK\x05\x06 not the end" * 3 + b"x" * 40_000), None),
        "plain comment": (archive(("word/document.xml", "t"), comment=b"made by hand" * 100), "docx"), "sheet": (archive(("xl/workbook.xml", "word/document.xml")), "zip"),
        "empty": (archive(), "zip"), "cut": (word[:-1], "corrupt"), "half": (word[: len(word) // 2], "corrupt"), "appended": (word + b"\0", "corrupt"),
        "shifted": (word[:40] + b"\0" + word[40:], "corrupt"), "no entry": (word.replace(b"PK\x01\x02", b"PK\x01\x03", 1), "corrupt"), "nothing": (b"", "corrupt"), "short": (b"PK", "corrupt"),
        "end only": (b"PK\x05\x06", "corrupt"),
    }
    rows = spark.createDataFrame([(k, bytearray(v)) for k, (v, _) in cases.items()], "name string, content binary")
    got = {r["name"]: r["kind"] for r in rows.select("name", archives.archive_kind(F.col("content")).alias("kind")).collect()}
    for name, (_, kind) in cases.items():
        if kind:
            assert got[name] == kind, name
    assert got["comment"] == "corrupt"       # a comment that looks like an end record is not trusted
    built = rows.limit(1).select(archives.stored_archive("word/document.xml", F.encode(F.lit("été"), "UTF-8")).alias("a")).first()["a"]
    with zipfile.ZipFile(io.BytesIO(bytes(built))) as z:
        assert z.testzip() is None and z.read("word/document.xml").decode() == "été"
