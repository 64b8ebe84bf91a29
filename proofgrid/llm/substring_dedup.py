"""Repeated passages of whole texts, by relative Lempel-Ziv factors over a distributed reference index.

A window of ``window`` words that starts anywhere else too is a repeat. The corpus itself is the reference: of every
window the ``ANCHOR``-word gram with the smallest hash is its anchor, so equal windows have equal anchors at equal
places, whatever surrounds them. Consecutive windows with one anchor form a factor: the words from the first window's
start to the last one's end. Anchors are the index, dealt into blocks by hash; a document is parsed against every
block by sending its factors there, about one per dozen words and 40 bytes each.

A factor that occurs twice in its block is a copy as a whole: it is in the reference, all its windows are repeats.
Inside a long repeat all factors are. At the boundaries of repeats a factor is the only one of its text while another
text has the same anchor; only these are checked window by window: one occurrence of every different factor of such
an anchor returns to its text, its windows are hashed, and windows found under two factors are repeats. Anchors of a
single factor never travel further. Repeats become runs of words per document.

Counts are aggregated on the map side first, factors of a passage that very many documents share are split by Spark's
skewed join, and the window check sees each different factor once. Hashes have 128 bits (64 for an anchor, 64 for the
factor or window below it).

Null and empty texts have no words. Rows with a null id take no part and keep all their words. Ids should
be unique: rows that share an id are one document to the last join, each gets the runs of all. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import chunks, saved

WINDOW = 35
ANCHOR = 10
BASE, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of word spans of some texts that stand one after the other: a polynomial modulo 2**64 by running sums."""

    def __init__(self, words: list[bytes], base: np.uint64 = BASE):
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * self.powers(base, len(words)))))
        self.inverse = self.powers(inverse, len(words) + 1)

    @staticmethod
    def powers(base: np.uint64, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        if n:
            out[0] = 1
        return np.cumprod(out)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` values the place of its least one, the leftmost of equals, by doubling."""
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        have += step
    return at


def factors_of(texts: list[list[bytes]], window: int, anchor: int) -> dict[str, np.ndarray]:
    """Factors of some texts: row (which text), first window start, last window start, anchor hash, factor hash."""
    sizes = np.array([len(t) for t in texts])
    begin = np.concatenate(([0], np.cumsum(sizes)))
    words = [w for t in texts for w in t]
    empty = {k: np.empty(0, np.int64) for k in ("row", "first", "last", "a", "s")}
    if len(words) < window:
        return empty
    rolling = Rolling(words)
    at = np.arange(len(words) - anchor + 1)
    grams = rolling.spans(at, at + anchor)
    least = leftmost_least(grams, window - anchor + 1)      # per window start
    row = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    inside = np.arange(len(least)) + window <= begin[row + 1]
    new = inside & np.concatenate(([True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])))
    first = np.flatnonzero(new)
    if not len(first):
        return empty
    group = np.cumsum(new) - 1
    last = np.zeros(len(first), np.int64)
    valid = np.flatnonzero(inside)
    last[group[valid]] = valid                              # the largest start of each group stays
    a = grams[least[first]]
    s = rolling.spans(first, last + window)
    r = row[first]
    return {"row": r, "first": first - begin[r], "last": last - begin[r], "a": a.view(np.int64), "s": s.view(np.int64)}


def words_of(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def factors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, first, last, a, s): the factors of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, 1):
            f = factors_of([words_of(t) for t in texts], window, anchor)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(f["row"])), *(pa.array(f[k].astype(np.int32)) for k in ("first", "last")), pa.array(f["a"]), pa.array(f["s"])],
                ["doc", "first", "last", "a", "s"],
            )

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text).cast("string").cast("binary").alias("_text")).filter("doc is not null")
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, first int, last int, a bigint, s bigint")


def windows_of(texts: DataFrame, window: int) -> DataFrame:
    """(a, doc, start, h): the windows of the factors listed beside each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts in chunks(batches, 1):
            asked = batch.column(2)
            for i, t in enumerate(parts):
                rolling, out = Rolling(words_of(t), OTHER), []
                for f in asked[i].as_py():
                    start = np.arange(f["first"], f["last"] + 1)
                    h = rolling.spans(start, start + window).view(np.int64)
                    out.append((np.full(len(start), f["a"]), start.astype(np.int32), h))
                a, start, h = map(np.concatenate, zip(*out, strict=True))
                doc = batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(a), np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(a), doc, pa.array(start), pa.array(h)], ["a", "doc", "start", "h"])

    kind = texts.schema["doc"].dataType.simpleString()
    return texts.mapInArrow(run, f"a bigint, doc {kind}, start int, h bigint")


def repeated_runs(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, at, n): runs of words that repeated windows cover; they may overlap."""
    every = saved(factors(docs, window, anchor, id_col, text))
    # the anchors are written first: then both sides of the join are plain shuffles, and Spark splits a hot anchor's factors
    anchors = saved(every.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("a"))
    shared = saved(every.join(anchors, "a", "left_semi"))
    different = saved(shared.groupBy("a", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "first", "last")).alias("ref")))
    copies = shared.join(different.filter("n > 1").select("a", "s"), ["a", "s"], "left_semi")
    whole = copies.select("doc", F.col("first").alias("at"), (F.col("last") - F.col("first") + window).alias("n"))

    mixed_anchors = saved(different.groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("rarest")).filter("m > 1 and rarest = 1").select("a"))
    asked = different.join(mixed_anchors, "a", "left_semi").groupBy(F.col("ref.doc").alias("_doc")).agg(
        F.collect_list(F.struct("a", F.col("ref.first").alias("first"), F.col("ref.last").alias("last"))).alias("asked")
    )
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text).cast("string").cast("binary").alias("_text"))
    found = saved(windows_of(texts.join(asked, F.col("doc") == F.col("_doc")).select("doc", "_text", "asked"), window))
    twice = saved(found.groupBy("a", "h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("a", "h"))
    edges = found.join(twice, ["a", "h"], "left_semi").select("doc", F.col("start").alias("at"), F.lit(window).alias("n"))
    return whole.unionByName(edges)


def covered(n_words: int, runs: list[dict]) -> np.ndarray:
    """Which words lie in a run."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, [r["at"] for r in runs], 1)
    np.add.at(steps, [r["at"] + r["n"] for r in runs], -1)
    return np.cumsum(steps[:-1]) > 0


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_words, spans (removed runs of words: at, n; disjoint, in order), kept (text, words joined by one space)."""
    runs = repeated_runs(docs, window, anchor, id_col, text)
    runs = runs.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text).cast("string").cast("binary").alias("_text"))
    joined = texts.join(runs, F.col("doc") == F.col("_doc"), "left").select("doc", "_text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts in chunks(batches, 1):
            n_words, spans, kept = [], [], []
            for i, t in enumerate(parts):
                words, own = words_of(t), batch.column(2)[i].as_py() or []
                gone = covered(len(words), own) if own else np.zeros(len(words), bool)
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])))).tolist() if own else []
                spans.append([{"at": a, "n": z - a} for a, z in zip(edge[::2], edge[1::2], strict=True)])
                n_words.append(len(words))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if own else words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))), pa.array(kept, pa.binary())],
                ["_id", "n_words", "spans", "kept"],
            )

    kind = joined.schema["doc"].dataType.simpleString()
    out = joined.mapInArrow(run, f"_id {kind}, n_words bigint, spans array<struct<at:int,n:int>>, kept binary")
    return out.select(F.col("_id").alias(id_col), "n_words", "spans", F.col("kept").cast("string").alias("kept"))
