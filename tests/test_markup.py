"""HTML fragments to text."""

from pyspark.sql import functions as F

from proofgrid.functions import markup


def test_long_pages_are_kept_whole(spark):
    raw = "<p>début</p>" + "<p>ligne &amp; suite</p>" * 5_000 + "<p>fin</p>"
    got = spark.createDataFrame([(raw,), (None,)], "html string").select(markup.html_to_text(F.col("html")).alias("t")).collect()
    assert got[0].t == "\n".join(["début", *["ligne & suite"] * 5_000, "fin"]) and got[1].t == ""
