"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into four segments of 16. Every 23-bit word lies within three bits of exactly one word
of the binary Golay code, so a segment (padded with zeros) decodes to one codeword, and the segments one bit away
decode to a few more: about five indices of 12 bits each. Two segments that differ in two bits or fewer share an
index, because the word between them is one bit from both. Of two fingerprints that differ in ``d`` bits at most d // 3
segments differ in more, so up to five bits the pair (0,1) or (2,3) of segments is close on both sides, and up to eight
bits one of the six pairs is. The keys of a fingerprint are the combinations of the indices of such a pair, 24 bits
and the number of the pair; fingerprints with a common key are candidates and are compared bit by bit.

Equal fingerprints are one node. Keys are shuffled and sorted, a task streams its keys and keeps only a spanning forest
of a key's links, so groups of many near copies give as many rows as they have members. A key with more members than
``bucket_limit`` is dealt to tiles: every pair of stripes meets in one tile, no pair is lost and no task holds more than
two stripes. Components of the links are found by joins.

Null and empty texts have no words and the fingerprint zero, linked like any other. Null ids form no component: such rows
are fingerprinted and get a null component_id. Repeated rows share their component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import chunks, saved
from proofgrid.llm.components import components
from proofgrid.llm.jaccard_links import nodes_and_links

SHINGLE = 3
MAX_BITS = 3
BUCKET_LIMIT = 20_000
SEED, WITNESS_SEED = 42, 43
PAIRS_TO_5 = ((0, 1), (2, 3))
PAIRS_TO_8 = ((0, 1), (2, 3), (0, 2), (0, 3), (1, 2), (1, 3))
# A-Z to a-z, and the generator polynomial of the binary Golay code of length 23.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
GOLAY = 0b101011100011
_worker: dict = {}


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    r = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GOLAY << (bit - 11)), r)
    return r


def segment_keys() -> np.ndarray:
    """For every 16-bit segment its codeword indices: rows of equal width, filled up with -1."""
    one = [1 << i for i in range(23)]
    errors = np.array([0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]), *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])], np.uint32)
    leader = np.zeros(2048, np.uint32)
    leader[syndrome(errors)] = errors               # perfect code: every remainder has one leader of weight 3 at most
    words = np.arange(1 << 16, dtype=np.uint32)
    near = np.stack([words, *(words ^ (1 << i) for i in range(16))], axis=1)
    index = np.sort((near ^ leader[syndrome(near)]) >> 11, axis=1).astype(np.int64)
    index[:, 1:][index[:, 1:] == index[:, :-1]] = -1
    index = -np.sort(-index, axis=1)
    return index[:, : int((index >= 0).sum(axis=1).max())]


def fingerprints_of(texts: list[bytes | None], shingle: int, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """SimHash of each text for each seed: a bit is set if it is in over half of the shingles' hashes."""
    grams, sizes = [], []
    for t in texts:
        words = t.translate(FOLD).split() if t else []
        own = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
        grams += own
        sizes.append(len(own))
    out = []
    sizes_, starts = np.array(sizes), np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    for seed in seeds:
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64, len(grams))
        prints, some = np.zeros(len(texts), np.uint64), np.flatnonzero(sizes_)
        if len(some):
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts = np.add.reduceat(bits, starts[some], axis=0, dtype=np.int32)
            set_ = (2 * counts > sizes_[some, None]).astype(np.uint8)
            prints[some] = np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()
        out.append(prints)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text: str = "text", witness: bool = False) -> DataFrame:
    """(id, fp, fp2): fingerprints as signed 64-bit numbers; ``fp2`` has another hash, or is 0 without a witness."""
    seeds = (SEED, WITNESS_SEED) if witness else (SEED,)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, 1, 500_000):
            found = [p.view(np.int64) for p in fingerprints_of(texts, shingle, seeds)]
            found += [np.zeros(len(texts), np.int64)] * (2 - len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], ["_id", "fp", "fp2"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").cast("binary").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, fp bigint, fp2 bigint").withColumnRenamed("_id", id_col)


def keyed(nodes: DataFrame, pairs: tuple[tuple[int, int], ...]) -> DataFrame:
    """(key, node, fp, fp2): a row per key of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "keys" not in _worker:
            _worker["keys"] = segment_keys()
        table = _worker["keys"]
        for whole in batches:
            for batch in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
                segments = [table[(fp >> np.uint64(16 * s) & np.uint64(0xFFFF)).astype(np.int64)] for s in range(4)]
                keys, rows = [], []
                for p, (a, b) in enumerate(pairs):
                    k = (segments[a][:, :, None] << 12 | segments[b][:, None, :]) | p << 24
                    good = (segments[a][:, :, None] >= 0) & (segments[b][:, None, :] >= 0)
                    rows.append(np.nonzero(good)[0])
                    keys.append(k[good])
                at = np.concatenate(rows)
                node, prints, second = (batch.column(i).to_numpy(zero_copy_only=False)[at] for i in range(3))
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (np.concatenate(keys), node, prints, second))), ["key", "node", "fp", "fp2"])

    return nodes.select("node", "fp", "fp2").mapInArrow(run, "key bigint, node bigint, fp bigint, fp2 bigint")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def forest(fp: np.ndarray, fp2: np.ndarray, max_bits: int, max_both: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among some fingerprints.

    From an unreached one outwards: each reached one is compared with all that are still unreached, so a dense group is
    reached after few comparisons, and no link leads to one that is reached already.
    """
    links, left = [], np.arange(len(fp))
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            i = reached.pop()
            near = distance(fp[left], fp[i]) <= max_bits
            if max_both < 128:
                near &= distance(fp[left], fp[i]) + distance(fp2[left], fp2[i]) <= max_both
            if near.any():
                links += [(i, int(j)) for j in left[near]]
                reached += left[near].tolist()
                left = left[~near]
    return links


def linked(rows: DataFrame, max_bits: int, max_both: int) -> DataFrame:
    """(a, b): links inside each (key, tile), found in one pass over partitions sorted by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links_of(block: np.ndarray) -> pa.RecordBatch:
            change = np.flatnonzero((block[1:, :2] != block[:-1, :2]).any(axis=1)) + 1
            starts = np.concatenate(([0], change))
            sizes = np.diff(np.concatenate((starts, [len(block)])))
            fp, fp2, found = block[:, 3].view(np.uint64), block[:, 4].view(np.uint64), []
            two = starts[sizes == 2]                # most shared keys have two members: all at once
            d = distance(fp[two], fp[two + 1])
            near = (d <= max_bits) & (d + distance(fp2[two], fp2[two + 1]) <= max_both)
            found.append(np.stack([block[two[near], 2], block[two[near] + 1, 2]], axis=1))
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                own = forest(fp[s : s + n], fp2[s : s + n], max_bits, max_both)
                if own:
                    found.append(block[s + np.array(own)][:, :, 2])
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)], axis=1))
            last = held[-1][-1, :2]
            if (held[0][0, :2] == last).all() and len(held) > 0 and (held[-1][0, :2] == last).all():
                continue                            # one key so far: it may go on
            block = np.ascontiguousarray(np.concatenate(held))
            cut = int(np.flatnonzero((block[:, :2] != last).any(axis=1))[-1]) + 1
            held = [block[cut:]]
            yield links_of(block[:cut].copy())
        if held:
            yield links_of(np.ascontiguousarray(np.concatenate(held)))

    return rows.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(run, "a bigint, b bigint")


def tiled(rows: DataFrame, bucket_limit: int) -> DataFrame:
    """(key, tile, node, fp, fp2): tile 0, or for keys beyond the limit every tile that a member's stripe takes part in."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket_limit)
    stripes = saved(sizes.select("key", F.ceil(2 * F.col("n") / bucket_limit).cast("int").alias("t")))
    if stripes.isEmpty():
        return rows.select("key", F.lit(0).cast("bigint").alias("tile"), "node", "fp", "fp2")
    stripe = F.pmod(F.xxhash64("node"), F.col("t")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda j: F.least(stripe, j).cast("bigint") * F.col("t") + F.greatest(stripe, j))
    joined = rows.join(stripes, "key", "left")
    tiles = F.when(F.col("t").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.array_distinct(others))
    return joined.select("key", F.explode(tiles).alias("tile"), "node", "fp", "fp2")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, max_both: int | None = None, id_col: str = "doc_id", text: str = "text",
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """One row per document: id, fp (signed), component_id (the smallest id reachable).

    ``max_bits``: the search is complete up to 8; of fingerprints that differ in more, most still share a key (19 of 20
    at 13 bits), and those are linked as well. ``max_both``: links also need so many differing bits at most over two
    independent fingerprints together, which random pairs never meet.
    """
    prints = saved(fingerprints(docs, shingle, id_col, text, max_both is not None))
    nodes = saved(prints.filter(F.col(id_col).isNotNull()).groupBy("fp", "fp2").agg(F.min(id_col).cast("bigint").alias("node")))
    rows = tiled(keyed(nodes, PAIRS_TO_5 if max_bits <= 5 else PAIRS_TO_8), bucket_limit)
    links = saved(linked(rows, max_bits, 128 if max_both is None else max_both).distinct())
    labels = nodes.join(components(links).withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    labels = labels.select(F.col("fp").alias("_fp"), F.col("fp2").alias("_fp2"), F.coalesce("label", "node").alias("component_id"))
    out = prints.join(labels, (F.col("fp") == F.col("_fp")) & (F.col("fp2") == F.col("_fp2")), "left")
    return out.select(id_col, "fp", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, same columns, of which each component keeps the one with the smallest id.

    Components are those of the pairs with a Jaccard similarity of ``similarity`` or more between their sets of shingles,
    verified on the whole sets: so many bits of a fingerprint stand for too wide a range of similarities to decide this.
    Documents with a null id stay. Repeated rows of the kept id stay as they are.
    """
    prints, nodes, links = nodes_and_links(docs, shingle, similarity, id_col, text)
    labels = nodes.join(components(links).withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    labels = labels.select("fp", "fp2", F.coalesce("label", "node").alias("_component"))
    gone = prints.join(labels, ["fp", "fp2"]).filter(F.col("_id") > F.col("_component")).select(F.col("_id").alias("_gone"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"))       # no column of the input can clash
    return rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
