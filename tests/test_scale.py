"""Operators that split hot keys give the same rows as the plain form, also when one key holds most of them."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofgrid.operators import governance as gv
from proofgrid.operators import grids as gr
from proofgrid.operators import intervals as iv
from proofgrid.operators import notes as nt
from proofgrid.operators.scale import in_order
from proofgrid.operators import scale

RNG = random.Random(7)


def skewed(spark, n=600):
    rows = [(0 if i % 3 else RNG.randrange(5), i, RNG.randrange(40), RNG.randrange(30)) for i in range(n)]
    return spark.createDataFrame(rows, "k int, id bigint, a int, b int")


def same(x, y):
    cols = sorted(x.columns)
    assert sorted(map(tuple, x.select(cols).collect())) == sorted(map(tuple, y.select(cols).collect()))


def test_rank_by_counts(spark):
    d = skewed(spark)
    plain = d.withColumn("rank", F.rank().over(Window.partitionBy("k").orderBy(F.col("a"), F.col("b").desc())).cast("bigint"))
    same(scale.rank_by_counts(d, ["k"], [("a", False), ("b", True)]), plain)


def test_row_number_and_lag_by_bucket(spark):
    d = skewed(spark)
    w = Window.partitionBy("k").orderBy("id")
    same(scale.row_number_by_bucket(d, ["k"], F.floor(F.col("id") / 50), [F.col("id")]), d.withColumn("rn", F.row_number().over(w).cast("bigint")))
    got = scale.previous_by_bucket(d, ["k"], F.floor(F.col("id") / 50), [F.col("id")], "a", F.col("id"), "prev")
    same(got, d.withColumn("prev", F.lag("a").over(w)))


def test_merge_intervals_and_overlap_join(spark):
    rows = [(i % 2, s := RNG.randrange(300), s + RNG.randrange(1, 9)) for i in range(80)]
    d = spark.createDataFrame(rows, "k int, s bigint, e bigint")
    got = {(r.k, r.s, r.e) for r in iv.merge_intervals(d, ["k"], "s", "e").collect()}
    want = set()
    for k in (0, 1):
        cur = None
        for s, e in sorted((s, e) for kk, s, e in rows if kk == k):
            if cur and s <= cur[1]:
                cur[1] = max(cur[1], e)
            else:
                cur and want.add((k, *cur))
                cur = [s, e]
        want.add((k, *cur))
    assert got == want
    r = d.select("k", F.col("s").alias("rs"), F.col("e").alias("re"))
    pairs = sorted((x.k, x.s, x.e, x.rs, x.re) for x in iv.overlap_join(d, r, ["k"], "s", "e", "rs", "re", width=4).collect())
    brute = sorted((k, s, e, s2, e2) for k, s, e in rows for k2, s2, e2 in rows if k == k2 and s < e2 and e > s2)
    assert pairs == brute


def test_assign_to_spans(spark):
    spans = spark.createDataFrame([(1, 0, 10, "a"), (1, 20, 30, "b")], "k int, start bigint, end bigint, n string")
    pts = spark.createDataFrame([(1, p) for p in (0, 9, 10, 19, 20, 29, 30)], "k int, at bigint")
    got = {r["at"]: r["span"]["n"] if r["span"] else None for r in iv.assign_to_spans(pts, spans, ["k"], "at").collect()}
    assert got == {0: "a", 9: "a", 10: None, 19: None, 20: "b", 29: "b", 30: None}


def test_request_counts_across_cells(spark):
    ts = sorted(RNG.randrange(0, 3000) for _ in range(200))
    d = spark.createDataFrame([(i, "hot", t) for i, t in enumerate(ts)], "id int, who string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["requests"] for r in gv.request_counts(d, "who", "ts", 60, 5, "id").collect()}
    assert got == {i: sum(1 for u in ts if t - 60 <= u <= t) for i, t in enumerate(ts)}


def test_evidence_fold_is_the_ordered_fold(spark):
    kinds = [nt.SUPPORTS, nt.LIMITS, nt.CAPS, nt.CONTRADICTS]
    rows = [("hot", i, RNG.choice(kinds), RNG.choice([None, 1, 2, 3, 4]), RNG.choice(["explique_en_appel", nt.UNSUPPORTED, nt.HYPOTHESIS]), "transcription", RNG.random() < 0.5, RNG.random() < 0.2, RNG.random() < 0.1) for i in range(120)]
    d = spark.createDataFrame(rows, "subject string, at int, kind string, level_ord int, reliability string, source string, auto_generated boolean, validated boolean, superseded boolean")
    effect = nt.evidence_effects(d, ["subject"], ["at"], piece=7).first()["effect"]

    def fold(x):
        for _, _, kind, level, rel, _, auto, val, gone in rows:
            if gone or rel == nt.HYPOTHESIS:
                continue
            if kind == nt.SUPPORTS:
                lv = min(level if level is not None else 3, 2 if rel == nt.UNSUPPORTED else 4, 3 if auto and not val else 4)
                x = x if x == 0 else max(x, lv)
            elif kind == nt.LIMITS:
                x = min(x, 3)
            elif kind == nt.CAPS:
                x = min(x, level if level is not None else 2)
            else:
                x = 0 if val else min(x, 2)
        return x

    assert effect == [fold(x) for x in range(5)]


def test_largest_remainder_sums_to_100(spark):
    rows = [(g, i, RNG.randrange(1, 2000)) for g in range(20) for i in range(RNG.randrange(1, 60))]
    d = spark.createDataFrame(rows, "g int, i int, raw bigint")
    w = gr.largest_remainder(d, ["g"], "raw", "i")
    assert all(r["s"] == 100 and r["m"] >= 1 for r in w.groupBy("g").agg(F.sum("weight").alias("s"), F.min("weight").alias("m")).collect())
    assert w.count() == len(rows)


def test_suggestions_equal_full_scoring(spark):
    entries = [(i, "f" + str(i % 3), ["t" + str(RNG.randrange(6)), "t" + str(RNG.randrange(6))], RNG.randrange(15)) for i in range(60)]
    missions = [(m, "f" + str(m % 4)) for m in range(15)]
    skills = [(m, "t" + str(RNG.randrange(6))) for m in range(15) for _ in range(2)]
    got = gv.suggestions(
        spark.createDataFrame(missions, "mission_id int, family string"), spark.createDataFrame(skills, "mission_id int, skill string"),
        spark.createDataFrame(entries, "entry_id int, family string, tags array<string>, origin int"),
    )
    want = set()
    for m, f in missions:
        mine = {s for mm, s in skills if mm == m}
        scored = sorted(((-(2 * (f == ef) + len(mine & set(tags))), e) for e, ef, tags, o in entries if o != m))
        want |= {(m, e, -s) for s, e in scored[:8] if s < 0}
    assert {(r.mission_id, r.entry_id, r.relevance) for r in got.collect()} == want


def test_a_hot_key_is_spread_over_all_tasks(spark):
    """One key with nine tenths of the rows: no task reads twice the median, and the fold is the one of the single list."""
    n = 60_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("subject"), F.xxhash64("id").alias("at"), F.col("id"),
        F.element_at(F.array(*[F.lit(k) for k in (nt.SUPPORTS, nt.CAPS, nt.LIMITS, nt.SUPPORTS)]), (F.col("id") % 4 + 1).cast("int")).alias("kind"),
        (F.col("id") % 5).cast("int").alias("level_ord"), F.lit("x").alias("reliability"), F.lit("x").alias("source"), F.lit(False).alias("auto_generated"),
        (F.col("id") % 3 == 0).alias("validated"), F.lit(False).alias("superseded"),
    )
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = in_order(rows, ["subject"], ["at", "id"]).withColumn("task", F.spark_partition_id())
        sizes = sorted(r["count"] for r in placed.groupBy("task").count().collect())
        assert len(sizes) == 8 and sizes[-1] < 2 * sizes[len(sizes) // 2]
        numbers = [(r["at"], r["id"]) for r in placed.filter("subject = 'hot'").orderBy("ord").select("at", "id").collect()]
        assert numbers == sorted(numbers)
        small = {r["subject"]: r["effect"] for r in nt.evidence_effects(rows, ["subject"], ["at", "id"], piece=64).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    whole = {r["subject"]: r["effect"] for r in nt.composed_buckets(nt.bucket_effects(rows, ["subject"], ["at", "id"], F.floor(F.col("at") / 2**56)), ["subject"]).collect()}
    assert small == whole and len(small) == 51


def test_running_sums_of_a_hot_key_and_of_nulls(spark):
    """The hot key spans all partitions; a null key is a key of its own."""
    rows = [("hot" if i % 10 else None if i % 20 else "cold", i * 7919 % 5000, i % 3) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, at bigint, v bigint").repartition(5)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["k"], r["at"]): r["s"] for r in scale.running_sum(df, ["k"], ["at"], "v", "s").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    want, total = {}, {}
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        total[k] = total.get(k, 0) + v
        want[k, at] = total[k]
    assert got == want
