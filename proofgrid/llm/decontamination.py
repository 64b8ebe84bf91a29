"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

An item is its windows of ``window`` consecutive words (a shorter item is one window). A window counts as the set of
its shingles of three words; it can lie in a document only if all of them do, so its necessary prefix is one shingle,
and the rarest one by document frequency over the whole corpus is taken. Documents are joined on that shingle. Its
place in the window gives where the window has to start; starts outside the document are out by length, and the words
there are compared one by one.

The items are dealt into blocks of bounded size by a hash of their ids; each block is broadcast once and meets every
document, so documents are neither shuffled nor joined, and a large benchmark costs passes, not memory.

Null and empty texts have no words. Items with a null id or no word take no part; rows of one item id are its texts.
Null document ids and repeated rows get a row each. Without items no document is hit. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import chunks, saved

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 8_000_000
# Bytes between words; A-Z become a-z first.
FOLD = bytes(0x20 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Block:
    """Distinct windows of some items: word numbers, windows, and the items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1)) if ids else ():
                owners[tuple(ids[i : i + window])].add(item)
        self.windows = list(owners)
        self.owners = [sorted(owners[w]) for w in self.windows]
        self.base = len(self.vocabulary) + 1
        if self.base >= 2_000_000:
            raise ValueError("a block holds too many different words")
        #: shingle size -> sorted keys of all shingles; windows shorter than a shingle are their own shingle
        self.keys = {s: np.unique([self.key(g) for w in self.windows for g in self.shingles(w) if len(g) == s]).astype(np.int64) for s in range(1, SHINGLE + 1)}
        self.prefix: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = {}

    @staticmethod
    def shingles(window: tuple[int, ...]) -> list[tuple[int, ...]]:
        s = min(SHINGLE, len(window))
        return [window[i : i + s] for i in range(len(window) - s + 1)]

    def key(self, shingle: tuple[int, ...]) -> int:
        k = 0
        for x in shingle:
            k = k * self.base + x
        return k

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words], dtype=np.int64)

    def places(self, numbers: np.ndarray, size: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where shingles of ``size`` of the given keys start, and which key each is."""
        n = len(numbers) - size + 1
        if n <= 0 or not len(keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = numbers > 0
        whole = known[:n].copy()
        for i in range(1, size):
            whole &= known[i : n + i]
        at = np.flatnonzero(whole)
        k = numbers[at]
        for i in range(1, size):
            k = k * self.base + numbers[at + i]
        spot = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        hit = keys[spot] == k
        return at[hit], spot[hit]

    def choose(self, frequency: dict[tuple[int, int], int]) -> None:
        """Take every window's rarest shingle (the first of equals) as its prefix."""
        chosen: dict[int, dict[int, list[tuple[int, int]]]] = {s: defaultdict(list) for s in range(1, SHINGLE + 1)}
        for w, window in enumerate(self.windows):
            s = min(SHINGLE, len(window))
            keys = [self.key(g) for g in self.shingles(window)]
            offset = min(range(len(keys)), key=lambda i: (frequency.get((s, keys[i]), 0), i))
            chosen[s][keys[offset]].append((w, offset))
        for s, by in chosen.items():
            keys = sorted(by)
            self.prefix[s] = (np.array(keys, np.int64), [by[k] for k in keys])

    def matches(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie inside an occurrence of a window, and the items of the windows that occur."""
        numbers, hit, items = self.numbers(words), np.zeros(len(words), bool), set()
        for s, (keys, entries) in self.prefix.items():
            for at, k in zip(*map(np.ndarray.tolist, self.places(numbers, s, keys)), strict=True):
                for w, offset in entries[k]:
                    window, start = self.windows[w], at - offset
                    if start >= 0 and start + len(window) <= len(words) and tuple(numbers[start : start + len(window)].tolist()) == window:
                        hit[start : start + len(window)] = True
                        items.update(self.owners[w])
        return hit, items


def document_frequencies(docs: DataFrame, text: str, block: Block) -> dict[tuple[int, int], int]:
    """In how many documents each shingle of the block occurs; every task reports a count per shingle at most."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = sent.value
        totals = {s: np.zeros(len(k), np.int64) for s, k in b.keys.items()}
        for _, texts in chunks(batches, 0):
            for t in texts:
                numbers = b.numbers(words_of(t))
                for s, keys in b.keys.items():
                    totals[s][np.unique(b.places(numbers, s, keys)[1])] += 1
        for s, n in totals.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"s": pa.array(np.full(len(some), s, np.int32)), "k": pa.array(b.keys[s][some]), "n": pa.array(n[some])})

    found = docs.select(F.col(text).cast("binary")).mapInArrow(count, "s int, k bigint, n bigint").groupBy("s", "k").agg(F.sum("n").alias("n"))
    return {(r["s"], r["k"]): r["n"] for r in found.collect()}       # bounded: the shingles of one block


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES, whole_rows: bool = False,
) -> DataFrame:
    """One row per document: id, n_words, spans (hit runs of words: at, n) and items (ids as strings, sorted).

    ``whole_rows``: the rows of the documents as a struct column ``row`` in place of the id.
    """
    items = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").cast("binary").alias("text")).dropna()
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    first = F.struct(*docs.columns) if whole_rows else F.col(id_col)
    found = docs.select(
        first.alias("_id"), F.col(text).cast("string").cast("binary").alias("_text"), F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<at:int,n:int>>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    schema = found.schema
    for i in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i)
        block = Block(sorted((r["item"], bytes(r["text"])) for r in mine.collect()), window)
        block.choose(document_frequencies(found, "_text", block))
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def match(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            b: Block = sent.value
            for batch, texts in chunks(batches, 1):
                n_words, spans, names = [], [], []
                before = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
                for t, (old_spans, old_items) in zip(texts, before, strict=True):
                    words = words_of(t)
                    hit, own = b.matches(words)
                    for span in old_spans:
                        hit[span["at"] : span["at"] + span["n"]] = True
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])))).tolist() if len(hit) else []
                    n_words.append(len(words))
                    spans.append([{"at": a, "n": z - a} for a, z in zip(edges[::2], edges[1::2], strict=True)])
                    names.append(sorted(own.union(old_items)))
                kinds = [batch.schema.field(k).type for k in (3, 4)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, kinds[0]), pa.array(names, kinds[1])], schema=batch.schema
                )

        found = found.mapInArrow(match, schema)
        if i + 1 < blocks:
            found = saved(found)
    return found.select(F.col("_id").alias("row" if whole_rows else id_col), "n_words", "spans", "items")


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, **names: str) -> DataFrame:
    """The documents that hold no window of any item, same columns."""
    return contamination(docs, items, window, whole_rows=True, **names).filter(F.size("spans") == 0).select("row.*")
