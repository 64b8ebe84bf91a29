"""ZIP archives on a binary column: the end record and the central directory are walked, the file is never searched as a whole."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofgrid.functions.text import let

# Signatures and lengths of the format, the entry that makes an archive a Word document.
LOCAL, CENTRAL, END = "504B0304", "504B0102", "504B0506"
LOCAL_BYTES, CENTRAL_BYTES, END_BYTES, COMMENT_BYTES = 30, 46, 22, 65_535
DOCUMENT_ENTRY = "word/document.xml"


def number_at(content: Column, at: Column, size: int) -> Column:
    """Unsigned number of ``size`` bytes, lowest byte first, at the offset ``at``; null beyond the end."""
    digits = F.hex(F.substring(content, (at + 1).cast("int"), F.lit(size)))
    swapped = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.when(F.length(digits) == 2 * size, F.conv(swapped, 16, 10).cast("bigint"))


def end_record(content: Column) -> Column:
    """Offset of the end record, from the last bytes only: it is followed by its comment and nothing else. Null if there is none."""
    size = F.length(content)
    tail = F.decode(F.substring(content, F.greatest(size - (END_BYTES + COMMENT_BYTES) + 1, F.lit(1)), F.lit(END_BYTES + COMMENT_BYTES)), "ISO-8859-1")
    behind = F.instr(F.reverse(tail), "\x06\x05KP")
    return F.when(behind > 0, size - behind - 3)


def archive_kind(content: Column) -> Column:
    """docx, zip, or corrupt if the directory doesn't stand where the end record says or doesn't hold what it counts."""
    here = lambda at, n: number_at(content, at, n)
    signature = lambda at: F.hex(F.substring(content, (at + 1).cast("int"), F.lit(4)))

    def directory(end: Column) -> Column:
        record = F.struct(here(end + 10, 2).alias("n"), here(end + 12, 4).alias("size"), here(end + 16, 4).alias("start"), here(end + 20, 2).alias("comment"))

        def checked(r: Column) -> Column:
            placed = (r["start"] + r["size"] == end) & (end + END_BYTES + r["comment"] == F.length(content))
            start = F.struct(r["start"].alias("at"), F.lit(True).alias("ok"), F.lit(False).alias("word"))

            def entry(a: Column, _: Column) -> Column:
                lengths = F.struct(*[here(a["at"] + 28 + 2 * i, 2).alias(k) for i, k in enumerate(("name", "extra", "comment"))], here(a["at"] + 42, 4).alias("local"))

                def taken(s: Column) -> Column:
                    name = F.substring(content, (a["at"] + CENTRAL_BYTES + 1).cast("int"), s["name"].cast("int"))
                    after = a["at"] + CENTRAL_BYTES + s["name"] + s["extra"] + s["comment"]
                    good = (signature(a["at"]) == CENTRAL) & (after <= end) & (signature(s["local"]) == LOCAL)
                    return F.struct(F.coalesce(after, a["at"]).alias("at"), F.coalesce(good, F.lit(False)).alias("ok"), (a["word"] | (F.coalesce(name.cast("string"), F.lit("")) == DOCUMENT_ENTRY)).alias("word"))

                return F.when(a["ok"], let(lengths, taken)).otherwise(a)

            steps = F.when(r["n"] > 0, F.sequence(F.lit(1), r["n"].cast("int"))).otherwise(F.array().cast("array<int>"))
            walked = F.aggregate(steps, start, entry)
            verdict = let(walked, lambda w: F.when(~w["ok"] | (w["at"] != end), "corrupt").when(w["word"], "docx").otherwise("zip"))
            return F.when(F.coalesce(placed, F.lit(False)), verdict).otherwise("corrupt")

        return let(record, checked)

    return F.coalesce(let(end_record(content), lambda end: F.when(end.isNotNull(), directory(end))), F.lit("corrupt"))


def low_first(value: Column, size: int) -> Column:
    """A number as ``size`` bytes, lowest byte first."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def stored_archive(name: str, data: Column) -> Column:
    """An archive of one uncompressed entry."""
    title, zero = F.encode(F.lit(name), "UTF-8"), lambda n: F.unhex(F.lit("00" * n))
    sizes = F.concat(low_first(F.crc32(data), 4), low_first(F.length(data), 4), low_first(F.length(data), 4), low_first(F.length(title), 2))
    local = F.concat(F.unhex(F.lit(LOCAL + "1400")), zero(8), sizes, zero(2), title, data)
    central = F.concat(F.unhex(F.lit(CENTRAL + "14001400")), zero(8), sizes, zero(16), title)
    end = F.concat(F.unhex(F.lit(END + "0000000001000100")), low_first(F.length(central), 4), low_first(F.length(local), 4), zero(2))
    return F.concat(local, central, end)
