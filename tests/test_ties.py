"""Lines whose ids are not unique: the order of the rule goes on."""

import datetime as dt

import duckdb

from proofgrid.plans import base, registry  # noqa: F401


def test_lines_of_one_number_rank_and_date_are_kept_by_their_part(spark, tmp_path):
    schema = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_tax double, l_shipdate date"
    # one order each: two lines of number 1 and one rank and date, with other categories; a later line of less authority makes the kept category show
    rows = []
    for order, first, second in [(1, 4, 10), (2, 10, 4), (3, 1, 7), (4, 7, 13)]:
        day = dt.date(2020, 1, 1)
        rows += [(order, first, 2, 1, 0.0, day), (order, second, 7, 1, 0.0, day), (order, second, 3, 2, 0.0, dt.date(2021, 1, 1))]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, base.QUERIES["agg_25_conflict_report"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert got == sorted(con.execute(base.ORACLES["agg_25_conflict_report"]).fetchall()) and got
