"""Removal of lines that other documents hold already, as compressed keep bitmaps. DataFrame functions only.

A text is split at line feeds; a line's key is the line without ASCII white space at its ends, A-Z in lower case.
Keys of at least ``min_chars`` code points are hashed to 128 bits, and only (hashes, document, position) travel. These
rows are range-partitioned by hash and cell (a hash bucket of the document, which splits a key that a third of all
documents share), sorted inside the partition by hash, document and position, and streamed: the first document of a
(key, cell) is its head, the others lose these lines. The heads of a key, one document per cell at most, are ordered
once more: all but the first lose their lines. What returns is one compressed bitmap per document, not text: the runs
of kept lines.

Documents without a bitmap row keep all lines. Null and empty texts are one empty line. Rows with a null id take part
in nothing and keep all lines. Repeated rows of one id count as one document and get the same bitmap by position, so
ids should be unique. An empty table gives no rows. Extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.functions.text import let

MIN_CHARS = 10
CELLS = 256
# ASCII white space stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def keyed_lines(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """(doc, h1, h2, pos): one row per line whose key has at least ``min_chars`` code points."""
    keys = F.transform(
        lines_of(F.col(text)),
        lambda line, i: let(key_of(line), lambda k: F.when(F.length(k) >= min_chars, F.struct(
            F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("second"), k).alias("h2"), i.alias("pos")))),
    )
    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.inline(F.filter(keys, lambda x: x.isNotNull())))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, cells: int = CELLS) -> DataFrame:
    """(doc, pos) of the lines to drop."""
    entries = keyed_lines(docs, id_col, text, min_chars).withColumn("cell", F.pmod(F.xxhash64("doc"), F.lit(cells)).cast("int"))
    dealt = entries.repartitionByRange("h1", "h2", "cell").sortWithinPartitions("h1", "h2", "cell", "doc", "pos")
    inside, across = Window.partitionBy("h1", "h2", "cell").orderBy("doc", "pos"), Window.partitionBy("h1", "h2").orderBy("doc", "pos")
    led = dealt.withColumn("head", F.first("doc").over(inside))
    late = led.filter(F.col("doc") > F.col("head"))
    heads = led.filter(F.col("doc") == F.col("head")).select("h1", "h2", "doc", "pos")
    beaten = heads.withColumn("head", F.first("doc").over(across)).filter(F.col("doc") > F.col("head"))
    return late.select("doc", "pos").unionByName(beaten.select("doc", "pos"))


def kept_runs(dropped: Column) -> Column:
    """Runs (at, n) of kept lines between the dropped ones (sorted positions); the last run has no end (n is null)."""
    starts = lambda d: F.filter(d, lambda p, i: (i == 0) | (F.get(d, i - 1) != p - 1))
    ends = lambda d: F.filter(d, lambda p, i: (i == F.size(d) - 1) | (F.get(d, i + 1) != p + 1))
    runs = lambda s, e: F.transform(
        F.sequence(F.lit(0), F.size(s)),
        lambda i: let(F.coalesce(F.get(e, i - 1) + 1, F.lit(0)), lambda at: F.struct(at.alias("at"), (F.get(s, i) - at).alias("n"))),
    )
    found = let(dropped, lambda d: let(starts(d), lambda s: let(ends(d), lambda e: runs(s, e))))
    return F.filter(found, lambda r: r["n"].isNull() | (r["n"] > 0))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, cells: int = CELLS) -> DataFrame:
    """(doc, n_dropped, keep_runs): one run-length compressed bitmap per document that loses lines."""
    dropped = dropped_lines(docs, id_col, text, min_chars, cells)
    at = dropped.groupBy("doc").agg(F.sort_array(F.collect_set("pos")).alias("_at"))
    return at.select("doc", F.size("_at").cast("bigint").alias("n_dropped"), kept_runs(F.col("_at")).alias("keep_runs"))


def kept_text(text: Column, runs: Column) -> Column:
    """The lines of the kept runs joined by line feeds."""
    kept = let(lines_of(text), lambda lines: F.flatten(F.transform(runs, lambda r: F.slice(lines, r["at"] + 1, F.coalesce(r["n"], F.size(lines))))))
    return F.when(runs.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))


def joined_bitmaps(docs: DataFrame, id_col: str, text: str, min_chars: int, cells: int) -> DataFrame:
    """(_row, _text, _dropped, _runs): whole rows, so that no column name can clash."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    maps = keep_bitmaps(docs, id_col, text, min_chars, cells).select("doc", F.col("n_dropped").alias("_dropped"), F.col("keep_runs").alias("_runs"))
    return rows.join(maps, F.col("_id") == F.col("doc"), "left").select("_row", "_text", "_dropped", "_runs")


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, cells: int = CELLS) -> DataFrame:
    """The documents with ``n_lines``, ``n_dropped`` and ``keep_runs`` (null: all kept), which replace columns of these names."""
    found = joined_bitmaps(docs, id_col, text, min_chars, cells)
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped", "keep_runs")]
    n_lines = F.size(lines_of(F.col("_text"))).cast("bigint")
    return found.select(*own, n_lines.alias("n_lines"), F.coalesce("_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), F.col("_runs").alias("keep_runs"))


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, cells: int = CELLS, length_col: str = "n_chars"
) -> DataFrame:
    """The documents, same columns, with the kept lines as text; a text that loses nothing stays as it was (null too).

    ``length_col``, if the table has it, becomes the length of a changed text.
    """
    found = joined_bitmaps(docs, id_col, text, min_chars, cells)
    changed = F.col("_runs").isNotNull()
    found = found.withColumn("_kept", F.when(changed, kept_text(F.col("_text"), F.col("_runs"))))
    new = {text: F.col("_kept"), **({length_col: F.length("_kept").cast(docs.schema[length_col].dataType)} if length_col in docs.columns else {})}
    return found.select(*[(F.when(changed, new[c]).otherwise(F.col("_row")[c]) if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])


__all__ = ["deduplicated", "dropped_lines", "keep_bitmaps", "kept_text", "with_bitmaps"]
