"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Every partition tokenises its documents, cuts only those longer than a sequence, and packs its pieces best-fit
decreasing. Nearly full bins are final. The underfull bins travel on as items, as (bin, fill) pairs only: groups of
about ``bins_per_task`` of them are packed best-fit again, what stays underfull is grouped again, until one group
remains or a round no longer helps. The moves of the rounds are composed on these small tables and joined to the
pieces once, so no task ever holds more than its own partition or one group of bins.

Null text counts as empty; every document ends with the end id, so an empty one has one token. Null ids, repeated
rows and repeated ids are packed like any other row. An empty table gives no rows. Columns other than the id and the
text are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import chunks, one_thread, saved

CACHE_LIMIT = 400_000
PIECES_AT_ONCE = 200_000
_worker: dict = {}

# Characters whose case, composition and class are the same in every Unicode version, and the cuts that
# the word tokenizer makes among them. Everything else is left to the library as a whole.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
CUTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
CUT_RULE = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
#: Bytes that are no printable Latin-1 letters are written as letters from U+0100 on, in order.
BYTE_LETTERS = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
STEPS = ["NFC", "Replace", "Lowercase"]


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: for each item its bin and its place in the bin, and the fill of each bin.

    Open bins are kept by their free space, and a bit mask of the spaces in use finds the tightest one.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fills = 0, []
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[i]
        fitting = mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                mask &= ~(1 << free)
        else:
            b, free = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if left := free - size:
            open_bins[left].append(b)
            mask |= 1 << left
    return bins, offsets, fills


class WordEncoder:
    """Little-endian 32-bit ids of texts, for tokenizers that drop white space and never join across it.

    A text is cut at ASCII white space. The ids of a run are kept in a cache; a run of plain characters that is not in it
    is lower-cased and cut as the tokenizer does it, and the library's model encodes the parts, which are kept as well.
    Other runs, and tokenizers with other rules, are encoded by the library as a whole.
    """

    def __init__(self, path: str):
        one_thread()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        rules = json.loads(self.library.to_str())
        steps = [x["type"] for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        cuts = [x.get("pattern") for x in (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_parts = steps == STEPS and cuts[:1] == [CUT_RULE] and all(t["content"].startswith("<|") for t in rules["added_tokens"])
        self.runs: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_runs, self.old_parts = self.runs, self.parts       # a full cache is kept until the next one is full

    def part(self, part: str) -> bytes:
        ids = self.old_parts.get(part) or array("I", [t.id for t in self.model.tokenize(byte_letters(part))]).tobytes()
        self.parts[part] = ids
        return ids

    def run(self, run: bytes) -> bytes | None:
        text = run.decode("utf-8", "replace")
        if not self.by_parts or "<|" in text or not PLAIN.fullmatch(text):
            return None
        return b"".join([self.parts.get(p) or self.part(p) for p in CUTS.findall(text.lower())])

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        words = [t.split() for t in texts]
        here = set().union(*words)
        if len(self.runs) > CACHE_LIMIT:
            self.runs, self.old_runs = {}, self.runs
        if len(self.parts) > CACHE_LIMIT:
            self.parts, self.old_parts = {}, self.parts
        ids = {w: self.runs.get(w) or self.old_runs.get(w) or self.run(w) for w in here}
        rest = [w for w, x in ids.items() if x is None]
        for e, w in zip(self.library.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False), rest, strict=True):
            ids[w] = array("I", e.ids).tobytes()
        self.runs |= ids
        return [b"".join(map(ids.__getitem__, ws)) for ws in words]


def byte_letters(text: str) -> str:
    """The printable letters that byte-level vocabularies write for the bytes of a text."""
    return text if text.isascii() else text.encode().decode("latin-1").translate(BYTE_LETTERS)


def encoder(path: str) -> WordEncoder:
    if path not in _worker:
        _worker[path] = WordEncoder(path)
    return _worker[path]


def packed_pieces(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, slack: int = 4, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of the documents with their bin of the first, partition-wise round and its fill."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held = TaskContext.get().partitionId() << 32, []
        made = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, made
            bins, offsets, fills = best_fit([p[3] for p in held], capacity)
            ids, piece, start, length, crc = zip(*held, strict=True)
            out = pa.RecordBatch.from_pydict(
                {
                    "_id": pa.array(ids, id_type), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                    "_bin": pa.array([base + made + b for b in bins], pa.int64()), "_offset": pa.array(offsets, pa.int64()),
                    "_fill": pa.array([fills[b] for b in bins], pa.int64()),
                }
            )
            made, held = made + len(fills), []
            return out

        id_type, encode = None, encoder(path)
        for batch, texts in chunks(batches, 1):
            id_type = batch.schema.field(0).type
            for i, ids in zip(batch.column(0).to_pylist(), encode([t or b"" for t in texts]), strict=True):
                ids += end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    held.append((i, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            if len(held) >= PIECES_AT_ONCE:
                yield flush()
        if held:
            yield flush()

    whole = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").cast("binary").alias("_text"))
    kind = whole.schema["_id"].dataType.simpleString()
    return whole.mapInArrow(
        run, f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, _bin bigint, _offset bigint, _fill bigint"
    )


def merge_round(bins: DataFrame, groups: int, capacity: int, level: int) -> DataFrame:
    """Pack the underfull bins of each group as items: (bin, to, off, to_fill)."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        to, off, fills = best_fit(rows["fill"].tolist(), capacity)
        base = (level << 56) + (key[0] << 32)
        return pd.DataFrame({"bin": rows["bin"], "to": [base + b for b in to], "off": off, "to_fill": [fills[b] for b in to]})

    grouped = bins.withColumn("grp", F.pmod(F.xxhash64("bin"), F.lit(groups))).groupBy("grp")
    return grouped.applyInPandas(pack, "bin bigint, to bigint, off bigint, to_fill bigint")


def pack(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, slack: int = 4, bins_per_task: int = 1000,
    id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id and offset in the sequence.

    ``slack``: a bin with at most so many free places is final. A merge round gives ``bins_per_task`` bins to a task on
    average; the rounds end with one group, or when a round saves less than a twentieth of its bins.
    """
    pieces = saved(packed_pieces(docs, path, capacity, end_id, slack, id_col, text))
    bins = saved(pieces.filter(F.col("_fill") < capacity - slack).groupBy(F.col("_bin").alias("bin")).agg(F.max("_fill").alias("fill")))
    moves, level, count = None, 1, bins.count()
    while count > 1:
        groups = -(-count // bins_per_task)
        step = saved(merge_round(bins, groups, capacity, level))
        if moves is None:
            moves = step.select("bin", "to", "off")
        else:
            then = step.select(F.col("bin").alias("_b"), F.col("to").alias("_to"), F.col("off").alias("_off"))
            moves = moves.join(then, F.col("to") == F.col("_b"), "left").select(
                "bin", F.coalesce("_to", "to").alias("to"), (F.col("off") + F.coalesce("_off", F.lit(0))).alias("off")
            )
        bins = step.filter(F.col("to_fill") < capacity - slack).groupBy(F.col("to").alias("bin")).agg(F.max("to_fill").alias("fill"))
        left = bins.count()
        if groups == 1 or left > 0.95 * count:
            break
        count, level = left, level + 1
    if moves is None:
        placed = pieces.withColumn("sequence_id", F.col("_bin")).withColumn("offset", F.col("_offset"))
    else:
        placed = pieces.join(moves, F.col("_bin") == F.col("bin"), "left")
        placed = placed.withColumn("sequence_id", F.coalesce("to", "_bin")).withColumn("offset", F.col("_offset") + F.coalesce("off", F.lit(0)))
    return placed.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
