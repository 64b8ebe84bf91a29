"""Structured Streaming runs over the input files; each drains what is available and returns its output table."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.functions.hashing import text_key
from proofgrid.operators import notes as nt
from proofgrid.plans import governance_queries as gq
from proofgrid.plans.base import TODAY, fold_sql, query, table
from proofgrid.plans.note_queries import FOLD_SQL, line_evidence
from proofgrid.plans.text_queries import ADMIT_SQL
from proofgrid.sources import documents as src
from proofgrid.sources.archives import DOCUMENT_ENTRY, stored_archive
from proofgrid.streaming import jobs
from proofgrid.streaming.runtime import arrivals, file_stream, read_batches, work_folder


def drained(spark, rows, delivery, n, job):
    """What ``job`` returns after ``n`` deliveries, each drained by a run that goes on in the same folder."""
    work = work_folder(spark, "drained")
    for folder in arrivals(rows, delivery, n):
        out = job(file_stream(spark, folder, rows), work)
    return out


def mixed(key, n=3):
    """Deliveries that mix all keys of a table."""
    return F.pmod(F.xxhash64(key), F.lit(n)), n


def as_files(batch):
    k = F.pmod("doc_id", F.lit(8))
    utf8 = F.encode("text", "UTF-8")
    content = (
        F.when(k == 0, F.concat(F.unhex(F.lit(src.PDF_MAGIC)), utf8)).when(k == 1, stored_archive("xl/workbook.xml", utf8))
        .when(k == 2, stored_archive(DOCUMENT_ENTRY, utf8)).when(k == 3, F.concat(F.unhex(F.lit(src.OLE_MAGIC)), utf8))
        .when(k == 4, F.concat(F.unhex(F.lit("00")), utf8)).when(k == 5, F.unhex(F.lit(""))).otherwise(utf8)
    )
    return batch.select("doc_id", content.alias("content"))


@query("str_1_document_intake", ADMIT_SQL + "SELECT doc_id, error_code, CASE WHEN error_code IS NULL THEN 'queued' ELSE 'failed' END AS status FROM c")
def str_1(spark, sf):
    admitted = drained(spark, table(spark, sf, "documents"), *mixed("doc_id"), lambda stream, work: jobs.intake(stream, as_files, work))
    return admitted.select("doc_id", "error_code", "status")


@query("str_2_streaming_copies", f"SELECT DISTINCT sha256(trim(regexp_replace({fold_sql('text')}, '\\s+', ' ', 'g'))) AS text_key FROM documents")
def str_2(spark, sf):
    # three deliveries, each a year after the one before, a document a minute inside: recent copies meet in state, old ones in the key table
    docs, work = table(spark, sf, "documents"), work_folder(spark, "str-2")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    dated = docs.select(text_key(F.col("text")).alias("text_key"), F.timestamp_seconds(F.lit(1_700_000_000) + part * 31_536_000 + 60 * F.col("doc_id")).alias("arrived"), part.alias("part"))
    for folder in arrivals(dated, F.col("part"), 3):
        once = jobs.first_copies(file_stream(spark, folder, dated).select("text_key", "arrived"), "arrived", ["text_key"], 7_200, work)
    return once.select("text_key")


@query("str_3_sliding_request_counts", """
WITH w AS (SELECT user_id, epoch_us(ts) // 10000000 * 10 - k * 10 AS s FROM events, (VALUES (0), (1), (2), (3), (4), (5)) AS v(k))
SELECT strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start, user_id, count(*) AS requests, count(*) > 1 AS limited FROM w GROUP BY s, user_id""")
def str_3(spark, sf):
    def counts(stream, work):
        return jobs.sliding_counts(stream.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "ts", "user_id", "60 seconds", "10 seconds", "40 days", 1, work)

    c = drained(spark, table(spark, sf, "events"), *mixed("event_id"), counts)
    return c.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "user_id", "requests", "limited")


@query("str_4_incremental_reevaluation", f"WITH {FOLD_SQL} SELECT subject, array_to_string(fx, ',') AS effect FROM fold")
def str_4(spark, sf):
    def prepare(batch):
        return line_evidence(spark, sf, batch)

    month = F.year("created_at") * 12 + F.month("created_at")
    lines = table(spark, sf, "lineitem")
    e = drained(spark, lines, *mixed("l_orderkey"), lambda stream, work: jobs.reevaluation(stream, ["subject"], ["created_at", "id"], month, prepare, work))
    return e.select("subject", F.array_join("effect", ",").alias("effect"))


@query("str_5_continuous_audit", f"WITH {gq.CHAIN_SQL} SELECT seg, head_seq, broken_at FROM c")
def str_5(spark, sf):
    # every chain arrives in three parts, so the second and third start from the head carried before them
    log = gq.log_of(table(spark, sf, "events"))
    part = F.floor(3 * F.pmod("seq", F.lit(gq.SEGMENT)) / gq.SEGMENT)
    heads = drained(spark, log, part, 3, lambda stream, work: jobs.audit_heads(stream, ["seg"], gq.KEY, lambda batch: batch, work))
    return heads.select("seg", "head_seq", "broken_at")


@query("str_6_retention_pass", f"WITH {gq.RETENTION_SQL} SELECT doc_id FROM x WHERE candidate_id NOT IN (SELECT candidate_id FROM dm)")
def str_6(spark, sf):
    docs, work = table(spark, sf, "documents"), work_folder(spark, "str-6")
    for folder in arrivals(docs, F.pmod(F.xxhash64("doc_id"), F.lit(3)), 3):
        kept = jobs.retention_pass(file_stream(spark, folder, docs), TODAY, gq.retention_rows, folder=work)
    return kept.select("doc_id")


@query("str_7_late_evidence", """
WITH a AS (SELECT event_id, ts, CASE WHEN event_id % 13 = 0 THEN 3 ELSE event_id % 3 END AS arrival FROM events), m AS (SELECT arrival, max(ts) AS newest FROM a GROUP BY 1),
k AS (SELECT a.arrival, (SELECT max(newest) FROM m WHERE m.arrival < a.arrival) AS mark FROM (SELECT DISTINCT arrival FROM a) a)
SELECT event_id, coalesce(ts < mark - INTERVAL 864000 SECONDS, FALSE) AS late FROM a JOIN k USING (arrival)""")
def str_7(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", F.when(F.pmod("event_id", F.lit(13)) == 0, 3).otherwise(F.pmod("event_id", F.lit(3))).alias("arrival"))
    on_time, late = drained(spark, e, F.col("arrival"), 4, lambda stream, work: jobs.split_late(stream, "ts", 864_000, ["event_id", "ts"], work))
    return on_time.unionByName(late).select("event_id", "late")


LATE_DAYS = 60
LATE_SQL = f"""
{FOLD_SQL}, y AS (SELECT e2.*, CASE WHEN CAST(split_part(id, '_', 1) AS BIGINT) % 13 = 0 THEN 3 WHEN year(created_at) < 1994 THEN 0 WHEN year(created_at) < 1996 THEN 1 ELSE 2 END AS arrival, make_timestamp(year(created_at) + 1, 1, 1, 0, 0, 0) AS due FROM e2),
mk AS (SELECT max(due) - INTERVAL {LATE_DAYS} DAYS AS edge FROM y WHERE arrival < 3),
lt AS (SELECT subject, count(*) FILTER (due <= edge) AS late_rows FROM y, mk WHERE arrival = 3 GROUP BY subject)"""


@query("str_7_late_effects", f"WITH {LATE_SQL} SELECT fold.subject, array_to_string(fx, ',') AS effect, coalesce(late_rows, 0) AS late_rows FROM fold LEFT JOIN lt USING (subject)")
def str_7b(spark, sf):
    """Evidence in the order of its time, but for every thirteenth order, which comes at the end; each delivery is a restart of the job."""
    e = line_evidence(spark, sf).withColumn("effect", nt.effects_of_row())
    year = F.year("created_at")
    order = F.split("id", "_")[0].cast("bigint")
    arrival = F.when(F.pmod(order, F.lit(13)) == 0, 3).when(year < 1994, 0).when(year < 1996, 1).otherwise(2)
    rows = e.select("subject", year.cast("bigint").alias("year"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), "id", "effect", F.make_timestamp(year + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("due"), arrival.alias("arrival"))
    work = work_folder(spark, "str-7")
    for folder in arrivals(rows, F.col("arrival"), 4):
        cells = jobs.late_evidence(file_stream(spark, folder, rows).drop("arrival"), ["subject"], "year", "due", LATE_DAYS * 86_400, work)
    late = read_batches(spark, f"{work}/late/side").groupBy("subject").agg(F.count(F.lit(1)).alias("late_rows"))
    effects = jobs.effects_of_cells(cells, ["subject"], "year").join(late, "subject", "left")
    return effects.select("subject", F.array_join("effect", ",").alias("effect"), F.coalesce("late_rows", F.lit(0)).cast("bigint").alias("late_rows"))
