"""Streams over several deliveries and restarts."""

import pathlib

from pyspark.sql import functions as F

from proofgrid.operators import governance as gv
from proofgrid.operators import notes as nt
from proofgrid.streaming import jobs
from proofgrid.streaming.runtime import file_stream, read_batches
from proofgrid.streaming.store import BucketStore

TODAY = "2026-10-08"
SCHEMA = "doc_id bigint, candidate_id bigint, expires_at date"


def deliver(spark, folder, rows, schema):
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.mode("append").parquet(folder)
    return df


def all_paths(folder):
    return [str(p) for p in pathlib.Path(folder).rglob("*.parquet") if "/rows/" in str(p)]


def all_files(spark, folder):
    files = [str(p) for p in pathlib.Path(folder).rglob("*.parquet")]
    return spark.read.parquet(*files).collect() if files else []


def test_an_expired_row_erases_earlier_and_later_deliveries(spark, tmp_path):
    arrivals, work = str(tmp_path / "in"), str(tmp_path / "work")
    rows = [f"({i}L, {c}L, date '{d}')" for i, c, d in ((1, 7, "2030-01-01"), (2, 7, "2020-01-01"), (3, 7, "2030-01-01"), (4, 8, "2030-01-01"))]
    for r in rows[:3]:
        like = spark.sql(f"SELECT * FROM VALUES {r} AS t(doc_id, candidate_id, expires_at)")
        like.coalesce(1).write.mode("append").parquet(arrivals)
    kept = jobs.retention_pass(file_stream(spark, arrivals, like, files_per_batch=1), TODAY, lambda b: b, folder=work)
    assert kept.count() == 0
    # a restart in the same folder takes only what is new and still knows what it stored
    spark.sql(f"SELECT * FROM VALUES {rows[3]} AS t(doc_id, candidate_id, expires_at)").coalesce(1).write.mode("append").parquet(arrivals)
    kept = jobs.retention_pass(file_stream(spark, arrivals, like, files_per_batch=1), TODAY, lambda b: b, folder=work)
    assert [r["doc_id"] for r in kept.collect()] == [4]
    # every stored file is read, whatever the manifest says: nothing of the erased candidate is on disk
    assert {r["candidate_id"] for r in all_files(spark, f"{work}/retention/rows/data")} == {8}
    before = sorted(p for p in all_paths(work))
    again = jobs.retention_pass(file_stream(spark, arrivals, like, files_per_batch=1), TODAY, lambda b: b, folder=work)
    assert [r["doc_id"] for r in again.collect()] == [4] and sorted(p for p in all_paths(work)) == before
    # time passes: a stored row expires without any delivery
    later = jobs.retention_pass(file_stream(spark, arrivals, like, files_per_batch=1), "2031-01-01", lambda b: b, folder=work)
    assert later.count() == 0 and all_files(spark, f"{work}/retention/rows/data") == []
    # an erased candidate can't come back
    spark.sql("SELECT * FROM VALUES (5L, 7L, date '2040-01-01') AS t(doc_id, candidate_id, expires_at)").coalesce(1).write.mode("append").parquet(arrivals)
    assert jobs.retention_pass(file_stream(spark, arrivals, like), TODAY, lambda b: b, folder=work).count() == 0


def evidence(spark, n):
    kinds = [(nt.SUPPORTS, 4), (nt.CAPS, 2), (nt.LIMITS, None), (nt.SUPPORTS, 3), (nt.CONTRADICTS, None)]
    rows = [(1 if i % 10 else 2, i // 7, i, *kinds[i * i % 5], i % 3 == 0) for i in range(n)]
    df = spark.createDataFrame(rows, "subject int, day int, id int, kind string, level_ord int, validated boolean")
    return df.withColumn("reliability", F.lit("x")).withColumn("source", F.lit("x")).withColumn("auto_generated", F.lit(True)).withColumn("superseded", F.lit(False))


def test_pieces_compose_to_the_same_effect(spark):
    rows = evidence(spark, 400)
    whole = {r["subject"]: r["effect"] for r in nt.evidence_effects(rows, ["subject"], ["day", "id"]).collect()}
    for bucket, piece in ((F.lit(0), 3), (F.floor(F.col("day") / 4), 2), (F.col("day"), 1024)):
        parts = nt.bucket_effects(rows, ["subject"], ["day", "id"], bucket, piece)
        assert {r["subject"]: r["effect"] for r in nt.composed_buckets(parts, ["subject"]).collect()} == whole


def test_late_evidence_changes_the_fold(spark, tmp_path):
    rows = evidence(spark, 90)
    whole = {r["subject"]: r["effect"] for r in nt.evidence_effects(rows, ["subject"], ["day", "id"]).collect()}
    arrivals = str(tmp_path / "in")
    for i in (1, 2, 0):         # the first third comes last
        rows.filter(F.pmod("id", F.lit(3)) == i).coalesce(1).write.mode("append").parquet(arrivals)
    got = jobs.reevaluation(file_stream(spark, arrivals, rows, files_per_batch=1), ["subject"], ["day", "id"], F.floor(F.col("day") / 3), folder=str(tmp_path / "w"))
    assert {r["subject"]: r["effect"] for r in got.collect()} == whole


def cells(spark, n, late_from):
    """Rows with cells of ten days; those of the last deliveries lie days behind."""
    rows = evidence(spark, n).withColumn("effect", nt.effects_of_row()).withColumn("cell", F.floor(F.col("day") / 10))
    due = F.timestamp_seconds((F.col("cell") + 1) * 864_000)
    part = F.when(F.pmod("id", F.lit(5)) == 0, late_from + F.pmod("id", F.lit(2))).otherwise(F.floor(F.col("id") * late_from / n))
    return rows.select("subject", "cell", F.col("day").cast("bigint").alias("at"), F.format_string("%06d", "id").alias("id"), "effect", due.alias("due"), part.cast("int").alias("part"))


def test_late_rows_reopen_their_cells(spark, tmp_path):
    """Five deliveries, each drained by a restart of the job; the last two hold rows of closed cells only."""
    n, parts = 600, 2
    rows = cells(spark, n, parts).persist()
    whole = {r["subject"]: r["effect"] for r in nt.evidence_effects(evidence(spark, n), ["subject"], ["day", "id"]).collect()}
    arrivals, work, progress, seen = str(tmp_path / "in"), str(tmp_path / "work"), [], []
    for i in range(parts + 2):
        rows.filter(F.col("part") == i).drop("part").repartition(2).write.mode("append").parquet(arrivals)
        stream = file_stream(spark, arrivals, rows.drop("part"))
        out = jobs.late_evidence(stream, ["subject"], "cell", "due", 5 * 86_400, work, progress)
        seen.append({r["subject"]: r["effect"] for r in jobs.effects_of_cells(out, ["subject"], "cell").collect()})
        # the batch fold over what has come so far
        so_far = rows.filter(F.col("part") <= i).select("id")
        batch = evidence(spark, n).withColumn("key", F.format_string("%06d", "id")).join(so_far.withColumnRenamed("id", "key"), "key", "left_semi")
        assert seen[-1] == {r["subject"]: r["effect"] for r in nt.evidence_effects(batch, ["subject"], ["day", "id"]).collect()}
    assert seen[-1] == whole and seen[-2] != seen[parts - 1]
    late = read_batches(spark, f"{work}/late/side")
    assert late.filter(F.pmod(F.col("id").cast("int"), F.lit(5)) != 0).count() == 0 and late.count() > n / 10
    # a last drain without new rows changes nothing
    stream = file_stream(spark, arrivals, rows.drop("part"))
    assert {r["subject"]: r["effect"] for r in jobs.effects_of_cells(jobs.late_evidence(stream, ["subject"], "cell", "due", 5 * 86_400, work), ["subject"], "cell").collect()} == whole
    rows.unpersist()


def test_state_of_closed_cells_is_gone(spark, tmp_path):
    arrivals, work = str(tmp_path / "in"), str(tmp_path / "work")
    rows = cells(spark, 700, 4).filter("part < 4").persist()
    held = []
    for i in range(4):
        rows.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(arrivals)
        out = jobs.late_evidence(file_stream(spark, arrivals, rows.drop("part")), ["subject"], "cell", "due", 5 * 86_400, work)
        held.append({(r["subject"], r["cell"]) for r in out.filter("state = 'open'").collect()})
    assert out.select("subject", "cell").distinct().count() == out.count() == rows.select("subject", "cell").distinct().count()
    # after a delivery only its own cells, and those that it didn't close, are in state
    assert all(min(c for _, c in open_) >= 2 * i - 1 for i, open_ in enumerate(held)), held
    rows.unpersist()


def test_copies_a_year_apart_are_found_with_bounded_state(spark, tmp_path):
    arrivals, work, sizes, got = str(tmp_path / "in"), str(tmp_path / "work"), [], []
    year, base = 31_536_000, 1_700_000_000
    for i in range(6):
        # 40 keys of their own, 10 of the delivery before, 5 of the first one, each twice within the delay, and one row that comes years late
        keys = [f"own {i} {j}" for j in range(40)] + [f"own {i - 1} {j}" for j in range(10) if i] + [f"own 0 {j}" for j in range(5)]
        rows = [(k, base + i * year + t) for k in keys for t in (0, 600)] + [(f"late {i // 2}", base - 5 * year)]
        like = spark.createDataFrame(rows, "k string, s bigint").select("k", F.timestamp_seconds("s").alias("ts"))
        like.repartition(3).write.mode("append").parquet(arrivals)
        progress = []
        once = jobs.first_copies(file_stream(spark, arrivals, like), "ts", ["k"], 7_200, work, progress)
        sizes += [op["numRowsTotal"] for p in progress for op in p["stateOperators"]][-1:]
        got = [r["k"] for r in once.collect()]
        assert len(got) == len(set(got))
    assert set(got) == {f"own {i} {j}" for i in range(6) for j in range(40)} | {f"late {i}" for i in range(3)}
    assert max(sizes) <= 120, sizes


def test_store_versions(spark, tmp_path):
    folder = str(tmp_path / "s")
    schema = spark.sql("SELECT 1L AS k, 'a' AS v").schema
    store = BucketStore(spark, folder, schema, ["k"], buckets=4, pieces=3)
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    read = lambda: sorted(tuple(r) for r in BucketStore(spark, folder, schema, ["k"], buckets=4).read().collect())
    assert read() == [] and store.batch() == -1
    store.write(rows(*[(i, "a") for i in range(20)]), batch=0)
    store.write(rows((3, "again"), (99, "new")), batch=0)       # a replayed batch
    assert len(read()) == 20 and store.batch() == 0
    store.write(rows((3, "b"), (50, "b")), batch=1, replace=True)
    assert (3, "b") in read() and (3, "a") not in read() and len(read()) == 21
    untouched = {p for p in all_paths(folder.replace("/s", "")) if "/rows/" in p}
    store.write(gone=rows((4, ""), (5, "")), change=lambda df: df.withColumn("v", F.lit("[erased]")))
    assert {(4, "[erased]"), (5, "[erased]")} < set(read()) and len(read()) == 21 and not untouched
    for i in range(6):       # buckets of many pieces are written as one
        store.write(rows((100 + i, "c")), batch=2 + i)
    assert len(read()) == 27 and max(sum(1 for b, _ in store.manifest() if b == x) for x in range(4)) <= 4
    store.write(gone=rows(*[(i, "") for i in range(200)]))
    assert read() == [] and all_files(spark, f"{folder}/data") == [] and store.batch() == 7


def test_an_interrupted_version_is_not_seen_and_swept(spark, tmp_path):
    folder = str(tmp_path / "s")
    schema = spark.sql("SELECT 1L AS k, 'a' AS v").schema
    store = BucketStore(spark, folder, schema, ["k"], buckets=2)
    store.write(spark.createDataFrame([(i, "a") for i in range(6)], schema), batch=0)
    # files of a version whose manifest was never completed
    spark.createDataFrame([(1, "half")], schema).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(f"{folder}/data/version=1")
    assert sorted(r["v"] for r in store.read().collect()) == ["a"] * 6
    store.write(gone=spark.createDataFrame([(1, "")], schema), batch=1)
    assert sorted(r["k"] for r in store.read().collect()) == [0, 2, 3, 4, 5]
    assert {r["v"] for r in all_files(spark, f"{folder}/data")} == {"a"}


def test_excerpts_of_erased_candidates_are_gone_from_the_files(spark, tmp_path):
    folder = str(tmp_path / "s")
    rows = spark.createDataFrame([(i % 4, i, f"excerpt {i}") for i in range(40)], "candidate_id bigint, doc_id bigint, excerpt string")
    store = BucketStore(spark, folder, rows.schema, ["candidate_id"], buckets=8)
    store.write(rows)
    doomed = spark.createDataFrame([(2,)], "candidate_id bigint")
    store.write(gone=doomed, change=lambda df: gv.redact(df, doomed, ["excerpt"]))
    kept = all_files(spark, f"{folder}/data")
    assert len(kept) == 40 and {r["excerpt"] for r in kept if r["candidate_id"] == 2} == {gv.ERASED}
    assert all(r["excerpt"] == f"excerpt {r['doc_id']}" for r in kept if r["candidate_id"] != 2)


def test_a_delivery_is_as_many_files_as_its_table_has_parts(spark, tmp_path, monkeypatch):
    from proofgrid.plans import stream_queries as sq

    path, seen = str(tmp_path / "documents.parquet"), []
    spark.range(400).selectExpr("id AS doc_id", "concat('Un texte court, numero ', id) AS text").repartition(4).write.parquet(path)
    stream = sq.file_stream
    monkeypatch.setattr(sq, "file_stream", lambda spark, folder, like, **more: seen.append(folder) or stream(spark, folder, like, **more))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert sq.str_1(spark, str(tmp_path)).count() == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # three deliveries; one task for each would read the whole table
    assert len(list(pathlib.Path(seen[-1]).glob("*.parquet"))) > 3


class Held:
    """A list or value of state, as a handle gives it."""

    def __init__(self):
        self.values = []

    def exists(self):
        return bool(self.values)

    def get(self):
        return iter(self.values)

    def put(self, values):
        self.values = list(values)

    def clear(self):
        self.values = []


class Due(Held):
    def get(self):
        return self.values[0]

    def update(self, value):
        self.values = [value]


def test_a_cell_keeps_its_rows_as_few_state_values(monkeypatch):
    import numpy as np
    import pandas as pd

    from proofgrid.streaming import keyed

    class Handle:
        def __init__(self):
            self.lists, self.timers = [], []

        def getListState(self, name, schema):  # noqa: N802
            self.lists.append(Held())
            return self.lists[-1]

        def getValueState(self, name, schema):  # noqa: N802
            return Due()

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

        def deleteTimer(self, at):  # noqa: N802
            self.timers.remove(at)

    rng = np.random.default_rng(4)
    effects = rng.integers(0, 5, (3000, 5))
    effects[:, 4] = 4
    rows = pd.DataFrame({"at": rng.integers(0, 50, 3000), "id": [f"{i}_x" for i in rng.permutation(3000)], "effect": effects @ 5 ** np.arange(5), "due_ms": 7})
    cell, handle = keyed.Cell(), Handle()
    cell.init(handle)
    done = lambda part: [r.iloc[0] for r in cell.handleInputRows((1, 2), iter([part]), None)]
    assert done(rows[:1000])[0]["n"] == 1000
    last = done(rows[500:].sample(frac=1, random_state=1))[0]          # 500 rows come again
    want = list(range(5))
    for i in rows.sort_values(["at", "id"]).index:
        want = [int(effects[i][x]) for x in want]
    assert last["n"] == 3000 and last["effect"] == want and last["state"] == "open"
    assert done(rows[:10]) == [] and handle.timers == [7]
    assert sum(len(h.values) for h in handle.lists) == 1
    closed = next(iter(cell.handleExpiredTimer((1, 2), None, None))).iloc[0]
    assert (closed["n"], closed["effect"], closed["state"]) == (3000, want, "closed") and not any(h.values for h in handle.lists)
