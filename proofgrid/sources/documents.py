"""Document batches: type by magic bytes, decoding, admission, page assembly. Rows are routed by a status, never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofgrid.functions.text import WS_CLASS, garbled, let, normalize_text
from proofgrid.sources.archives import archive_kind

# Magic numbers, size and length limits.
PDF_MAGIC = "255044462D"
ZIP_MAGIC = "504B0304"
OLE_MAGIC = "D0CF11E0A1B11AE1"
MAX_BYTES = 10 * 1024 * 1024
MIN_CHARS = 250
MAX_CHARS = 150_000
SNIFF_BYTES = 4000
PRINTABLE = "[\\x20-\\x7e\\t\\n\\r\\u00a0-\\u00ff]"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with their bytes; one row per file."""
    return (
        spark.read.format("binaryFile")
        .load(path)
        .select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "content")
    )


def sniff(content: Column) -> Column:
    """pdf, docx, doc, txt, unsupported, or corrupt for a broken archive: from the first bytes, and the directory of an archive."""
    head = F.substring(content, 1, SNIFF_BYTES)
    latin = F.decode(head, "ISO-8859-1")
    # the first bytes may end inside a character: up to three trailing bytes are left out then
    cut = F.when(F.length(content) > SNIFF_BYTES, 3).otherwise(0)
    valid = F.exists(F.sequence(F.lit(0), cut), lambda k: F.is_valid_utf8(F.substring(content, F.lit(1), F.least(F.length(content), F.lit(SNIFF_BYTES)) - k).cast("string")))
    printable = F.regexp_count(latin, F.lit(PRINTABLE)) / F.greatest(F.length(latin), F.lit(1))
    starts = F.hex(F.substring(content, 1, 8))
    archive = lambda kind: F.when(kind == "zip", "unsupported").otherwise(kind)
    return (
        F.when(starts.startswith(PDF_MAGIC), "pdf")
        .when(starts.startswith(ZIP_MAGIC), let(archive_kind(content), archive))
        .when(starts == OLE_MAGIC, "doc")
        .when(F.contains(latin, F.lit("\x00")), "unsupported")
        .when(valid | (printable > 0.95), "txt")
        .otherwise("unsupported")
    )


def decode_text(content: Column) -> Column:
    """UTF-8, or ISO-8859-1 when the bytes are not valid UTF-8."""
    utf8 = content.cast("string")
    return F.when(F.is_valid_utf8(utf8), utf8).otherwise(F.decode(content, "ISO-8859-1"))


def text_error(text: Column, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """Code of the first failed check on a decoded text, or null."""
    n = F.length(text)
    return (
        F.when(n == 0, "no_text_layer")
        .when(garbled(text), "garbled")
        .when(n > max_chars, "too_long")
        .when(n < min_chars, "insufficient_content")
    )


def admit(files: DataFrame, max_bytes: int = MAX_BYTES, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Adds kind, text, error_code and status (queued or failed) to files(doc_id, content)."""
    size = F.length("content")
    typed = files.withColumn("kind", F.when(size > 0, sniff(F.col("content")))).withColumn(
        "text", F.when(F.col("kind") == "txt", normalize_text(decode_text(F.col("content"))))
    )
    code = (
        F.when(size == 0, "empty")
        .when(size > max_bytes, "too_large")
        .when(F.col("kind") == "corrupt", "corrupt")
        .when(F.col("kind").isin("unsupported", "doc"), "unsupported_type")
        .when(F.col("kind") == "txt", text_error(F.col("text"), min_chars, max_chars))
    )
    return typed.withColumn("error_code", code).withColumn("status", F.when(code.isNotNull(), "failed").otherwise("queued"))


def page_offsets(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """Offsets of every page in the document joined by blank lines; only lengths are shuffled."""
    sized = pages.select(doc, page, F.length(normalize_text(F.col(text))).alias("chars"))
    before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("chars") + 2).over(before), F.lit(0))
    return sized.select(doc, page, start.cast("bigint").alias("start"), (start + F.col("chars")).cast("bigint").alias("end"))


def solid_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, WS_CLASS, ""))
