"""Continuous forms of the batch operators: intake, copies, rates, re-evaluation, audit, retention, late evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from proofgrid.operators import governance as gv
from proofgrid.operators import notes as nt
from proofgrid.sources import documents as src
from proofgrid.streaming import keyed
from proofgrid.streaming.runtime import drop_batches, read_batches, rocksdb, run_batches, work_folder, write_batch
from proofgrid.streaming.store import BucketStore


def intake(stream: DataFrame, to_files, folder: str | None = None) -> DataFrame:
    """Admission of arriving documents; the checkpoint takes the place of a queue."""
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession, "intake", folder)

    def step(batch: DataFrame, n: int) -> None:
        write_batch(src.admit(to_files(batch)).select("doc_id", "kind", "error_code", "status"), f"{folder}/out", n)

    run_batches(stream, folder, step)
    return read_batches(spark, f"{folder}/out").drop("batch")


def divided(stream: DataFrame, due: str, delay_seconds: int, folder: str, step=lambda on_time, late, newest, n: None) -> None:
    """Write the rows of every batch to ``hot`` or, if ``due`` isn't after the newest time of the earlier batches less the delay,
    to ``side``: what a watermark on ``hot`` would drop. ``step`` may add rows to ``hot`` (it returns a table or None)."""
    spark = stream.sparkSession
    epoch = F.lit(0).cast("timestamp")

    def deal(batch: DataFrame, n: int) -> None:
        mark = spark.read.parquet(f"{folder}/marks/batch={n - 1}").first()["newest"] if n > 0 else None
        edge = epoch if mark is None else F.greatest(F.lit(mark) - F.expr(f"INTERVAL {delay_seconds} SECONDS"), epoch)
        flagged = batch.persist()
        newest = flagged.agg(F.max(due).alias("newest")).first()["newest"]
        newest = mark if newest is None else newest if mark is None else max(mark, newest)
        on_time, late = flagged.filter(F.col(due) > edge), flagged.filter(~(F.col(due) > edge) | F.col(due).isNull())
        more = step(on_time, late, newest, n)
        write_batch(on_time if more is None else on_time.unionByName(more), f"{folder}/hot", n)
        write_batch(late, f"{folder}/side", n)
        write_batch(spark.createDataFrame([(newest,)], "newest timestamp").coalesce(1), f"{folder}/marks", n)
        flagged.unpersist()

    run_batches(stream, f"{folder}/divide", deal)


def first_copies(stream: DataFrame, ts: str, keys: Sequence[str], delay_seconds: int, folder: str | None = None, progress: list | None = None) -> DataFrame:
    """Each content key once, however far apart its copies come.

    Copies that follow each other within the delay are recognised by the state of their key, which expires with the
    watermark. What passes that, and rows later than the watermark, are held against the keys of all earlier batches in
    a table dealt by hash: a batch reads the buckets of its own keys and adds its new ones.
    """
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession, "copies", folder)
    divided(stream, ts, delay_seconds, folder)
    rows, schema, by = stream.schema, stream.select(*keys).schema, list(keys)
    seen = BucketStore(spark, f"{folder}/seen", schema, by)
    hot = spark.readStream.schema(rows).parquet(f"{folder}/hot").select(*rows.names)
    recent = hot.withWatermark(ts, f"{delay_seconds} seconds").dropDuplicatesWithinWatermark(by)
    old = spark.readStream.schema(rows).parquet(f"{folder}/side").select(*rows.names)

    def step(batch: DataFrame, n: int) -> None:
        if seen.batch() < n:
            once = batch.dropDuplicates(by).persist()
            write_batch(once.join(seen.read(seen.touched(once)), by, "left_anti"), f"{folder}/out", n)
            once.unpersist()
        seen.write(spark.read.schema(rows).parquet(f"{folder}/out/batch={n}"), batch=n)

    done = run_batches(recent.unionByName(old), folder, step)
    if progress is not None:
        progress += done
    drop_batches(spark, f"{folder}/hot")
    drop_batches(spark, f"{folder}/side")
    return read_batches(spark, f"{folder}/out").drop("batch")


def sliding_counts(stream: DataFrame, ts: str, identity: str, window: str, slide: str, delay: str, limit: int, folder: str | None = None) -> DataFrame:
    """Requests per identity and sliding window; a later update of a window replaces the earlier one."""
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession, "rates", folder)
    counts = stream.withWatermark(ts, delay).groupBy(F.window(ts, window, slide), identity).agg(F.count("*").alias("requests"))
    flat = counts.select(F.col("window.start").alias("window_start"), identity, "requests")
    run_batches(flat, folder, lambda batch, n: write_batch(batch, f"{folder}/out", n), "update")
    last = read_batches(spark, f"{folder}/out").groupBy("window_start", identity).agg(F.max_by("requests", "batch").alias("requests"))
    return last.withColumn("limited", F.col("requests") > limit)


def reevaluation(stream: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, prepare=lambda df: df, folder: str | None = None) -> DataFrame:
    """Effects of the evidence received so far, computed again for the (key, bucket) cells a batch touches.

    The evidence is kept in a table partitioned by bucket. A batch, late rows included, reads back its own buckets only
    and replaces the effects of its own cells; the effect of a key is composed from its cells.
    """
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession, "evidence", folder)
    cell = [*keys, "_b"]

    def step(batch: DataFrame, n: int) -> None:
        rows = prepare(batch).withColumn("_b", bucket)
        write_batch(rows, f"{folder}/evidence", n, "_b")
        known = read_batches(spark, f"{folder}/evidence").filter(F.col("batch") <= n)
        touched = known.filter(F.col("batch") == n).select(*cell).distinct()
        write_batch(nt.bucket_effects(known.join(touched, cell, "left_semi"), keys, order, F.col("_b")), f"{folder}/out", n)

    run_batches(stream, folder, step)
    return nt.composed_buckets(gv.latest_per_key(read_batches(spark, f"{folder}/out"), cell, ["batch"]).drop("batch"), keys)


def audit_heads(stream: DataFrame, keys: Sequence[str], key_hex: str, to_log, folder: str | None = None) -> DataFrame:
    """Each batch is verified against the heads carried from the batch before; the newest head per chain is published.

    A chain that continues in a later batch is checked through its last verified row. Every batch writes the heads of all
    chains, so it reads one table of heads, never the history.
    """
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession, "audit", folder)

    def step(batch: DataFrame, n: int) -> None:
        log = to_log(batch).select(*keys, "seq", "payload", "prev_hash", "hash")
        bad = gv.broken_links(log, keys, key_hex)
        heads = None
        if n > 0:
            heads = spark.read.parquet(f"{folder}/heads/batch={n - 1}")
            first = log.groupBy(*keys).agg(F.min("seq").alias("_first"))
            carried = log.join(first, list(keys)).join(heads.select(*keys, F.col("head_hash").alias("_head")), list(keys), "left")
            start = F.coalesce("_head", F.lit(""))
            digest_ok = gv.digest(key_hex, F.col("prev_hash"), F.col("payload")) == F.col("hash")
            joint = carried.filter((F.col("seq") == F.col("_first")) & ((F.col("prev_hash") != start) | ~digest_ok)).select(*keys, "seq")
            inner = bad.join(first, list(keys)).filter(F.col("seq") != F.col("_first")).select(*keys, "seq")
            bad = inner.unionByName(joint)
        broken = bad.groupBy(*keys).agg(F.min("seq").alias("broken_at"))
        head = log.groupBy(*keys).agg(F.max("seq").alias("head_seq"), F.max_by("hash", "seq").alias("head_hash")).join(broken, list(keys), "left")
        if heads is not None:
            both = head.unionByName(heads)
            head = both.groupBy(*keys).agg(F.max("head_seq").alias("head_seq"), F.max_by("head_hash", "head_seq").alias("head_hash"), F.min("broken_at").alias("broken_at"))
        write_batch(head, f"{folder}/heads", n)

    run_batches(stream, folder, step)
    return gv.latest_per_key(read_batches(spark, f"{folder}/heads"), keys, ["batch"]).drop("batch")


def retention_pass(stream: DataFrame, today: str, to_rows, key: str = "candidate_id", folder: str | None = None, buckets: int = 64) -> DataFrame:
    """Scheduled purge: an expired row erases its candidate in every delivery, before and after, and in every stored file.

    Rows are kept by the hash of their candidate. New rows are added to their buckets; then the candidates with an
    expired row, new or stored, are looked up once a pass, and only their buckets are written anew without them. The keys
    of erased candidates are kept, so that a later delivery can't bring them back. Running the pass again on the same
    input changes nothing.
    """
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession, "retention", folder)
    schema = to_rows(spark.createDataFrame([], stream.schema)).schema
    rows = BucketStore(spark, f"{folder}/rows", schema, [key], buckets)
    erased = BucketStore(spark, f"{folder}/erased", StructType([schema[key]]), [key], buckets)

    def step(batch: DataFrame, n: int) -> None:
        new = to_rows(batch)
        if rows.batch() < n:
            known = erased.read(erased.touched(new))
            new = new.join(known, key, "left_anti")
        rows.write(new, batch=n)

    run_batches(stream, folder, step)
    doomed = gv.expired(rows.read(), today).filter(F.col(key).isNotNull()).select(key).distinct().persist()
    if not doomed.isEmpty():
        erased.write(doomed, replace=True)
        rows.write(gone=doomed)
    doomed.unpersist()
    return rows.read()


def split_late(stream: DataFrame, ts: str, delay_seconds: int, keep: Sequence[str], folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """On-time rows, and the rows later than the delay behind the newest time of the earlier batches (kept in a side table)."""
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession, "late", folder)

    def step(batch: DataFrame, n: int) -> None:
        rows = batch.select(*keep)
        mark = None
        if n > 0:
            mark = spark.read.parquet(f"{folder}/marks/batch={n - 1}").first()["newest"]
        late = F.lit(False) if mark is None else F.col(ts) < F.lit(mark) - F.expr(f"INTERVAL {delay_seconds} SECONDS")
        flagged = rows.withColumn("late", late)
        write_batch(flagged.filter(~F.col("late")), f"{folder}/out", n)
        write_batch(flagged.filter("late"), f"{folder}/side", n)
        write_batch(rows.agg(F.greatest(F.max(ts), F.lit(mark).cast("timestamp") if mark is not None else F.max(ts)).alias("newest")), f"{folder}/marks", n)

    run_batches(stream, folder, step)
    return read_batches(spark, f"{folder}/out").drop("batch"), read_batches(spark, f"{folder}/side").drop("batch")


def late_evidence(stream: DataFrame, keys: Sequence[str], cell: str, due: str, delay_seconds: int, folder: str | None = None, progress: list | None = None) -> DataFrame:
    """(keys, cell, effect, n, state): the ordered effect of the evidence of every cell, late evidence included.

    stream(keys, ``cell`` long that grows with time, ``due`` timestamp of the end of the cell, at long, id string, effect).
    Cells that can still get rows in time are open: keyed state folds them. A row for a closed cell goes to the side table,
    and its cell is read back from the stored evidence (its own bucket only) and reopened with all its rows, so the effect
    changes as if the row had come in time. All tables and the state stay in ``folder``: a later call with the same one
    takes what is new.
    """
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession, "late", folder)
    by, columns = [*keys, cell], [*keys, cell, "at", "id", "effect", "due_ms", due]
    rows = stream.withColumn("due_ms", F.unix_millis(due)).select(*columns)
    stored = BucketStore(spark, f"{folder}/evidence", rows.schema, by)

    def reopened(on_time: DataFrame, late: DataFrame, newest, n: int) -> DataFrame | None:
        stored.write(on_time.unionByName(late), batch=n)
        cells = late.select(*by).distinct().persist()
        if cells.isEmpty():
            return None
        now = F.greatest(F.lit(newest), F.lit(86_400).cast("timestamp"))
        return stored.read(stored.touched(cells)).join(cells, by, "left_semi").withColumns({due: now, "due_ms": F.unix_millis(now)}).select(*columns)

    divided(rows, due, delay_seconds, folder, reopened)
    hot = spark.readStream.schema(rows.schema).parquet(f"{folder}/hot").select(*columns)
    effects = keyed.cell_effects(hot, keys, cell, due, f"{delay_seconds} seconds")
    out = BucketStore(spark, f"{folder}/effects", effects.schema, by)

    def step(batch: DataFrame, n: int) -> None:
        out.write(gv.latest_per_key(batch, by, ["n", "state"]).select(*effects.columns), batch=n, replace=True)

    with rocksdb(spark):
        done = run_batches(effects, folder, step, "update")
    if progress is not None:
        progress += done
    drop_batches(spark, f"{folder}/hot")
    return out.read()


def effects_of_cells(cells: DataFrame, keys: Sequence[str], cell: str) -> DataFrame:
    """(keys, effect) from the effects of the cells of each key, in order."""
    return nt.composed_buckets(cells.withColumnRenamed(cell, "_b"), keys)
