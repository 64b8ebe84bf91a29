"""Prefix trie of rebuilt conversations, from fingerprints that are composed and never from rebuilt texts.

A rebuilt conversation is the head of its base conversation followed by its own turns after the head. A sequence of
turns has the fingerprint sum(turn_i * R^i), in four lanes modulo 2^31 - 1 with a base R each. Sequences form a monoid:
``(length a, x) * (length b, y) = (a + b, x + R^a y)``, and prefixes can be taken off again, since R has an inverse. So
one ordered scan gives the prefix products of the stored conversations, and every prefix of a rebuilt one is
``head * (own prefix before the cut)^-1 * own prefix``: three numbers a lane, no text, no copy of a turn.

* The scan: turns become rows of numbers (two content hashes, the bytes), are range-partitioned by conversation and turn,
  and each task multiplies up its stretch. A conversation that spans several stretches gets the products of the earlier
  ones from a table of at most two rows a task. A conversation of any length is thus spread over many tasks.
* Groups of equal (depth, fingerprint) are the nodes. They are verified: all members must come from one parent node and
  end with one pair of content hashes, and where their last turns are different stored turns (references), the texts that
  the references name must be equal, character for character. If anything fails, the whole work is done again with other
  bases and seeds; results never rest on fingerprints alone.
* Sums over subtrees are sums over members. Let a node belong to its smallest member. Along the path of a conversation
  the nodes that belong to it are the last ones, so each member knows, from two numbers of its own, what it adds to every
  node of its path: childless nodes, children, and the bytes it shares. No level-by-level pass, one grouping for all.
* The ids that end in a node are cut into pieces by a range partition and hashed piece after piece: one node with very
  many ids is a few rows for the task that hashes it.

Order: by turn, null first; turns of one conversation with the same turn number by their content hashes. Null role and
text are empty. Rows without a conversation id belong to none and are left out. The remainder of a negative id has its
sign, as in SQL. Repeated rows are turns like others. Very long texts are hashed where they lie and travel only to be
compared. An empty table has no nodes, not even a root. Extra columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import saved
from proofgrid.operators.scale import broadcast_if_small

P = 2**31 - 1
LANES = 4
BLOCK = 10_000          # positions of a conversation that meet its row in one join key
IDS_PER_PIECE = 50_000
NODE = ("depth", "fa", "fb")


@dataclass(frozen=True)
class Bases:
    """Hash seeds and lane bases of one attempt."""

    seed: int

    @property
    def lanes(self) -> tuple[int, ...]:
        return tuple(int(x) for x in np.random.default_rng([self.seed, LANES]).integers(2**16, P - 1, LANES))


def turns_of(conversations: DataFrame, bases: Bases, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, t, r, x, h1, h2): the turns with their content hashes."""
    rows = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x")
    )
    return rows.withColumns({"h1": F.xxhash64(F.lit(bases.seed), "r", "x"), "h2": F.xxhash64(F.lit(~bases.seed), "x", "r")})


SCAN = "c bigint, part int, total boolean, pos bigint, fa bigint, fb bigint, pa bigint, pb bigint, h1 bigint, h2 bigint, bytes bigint, cum bigint"


def scanner(bases: Bases):
    """Prefix products of the stretches of one task, which holds its rows in order; then the totals of its first and last conversation."""
    lanes = np.array(bases.lanes, dtype=np.int64)

    def powers(n: int) -> np.ndarray:
        out = np.ones((n + 1, LANES), dtype=np.int64)
        for i in range(1, n + 1):
            out[i] = out[i - 1] * lanes % P
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        table = powers(1)
        now, pos, cum, product = None, 0, 0, np.zeros(LANES, dtype=np.int64)
        first = None

        def rows(c, pos, product, before, h1, h2, size, cum, total):
            pack = lambda m, i: (m[:, i] << 31) | m[:, i + 1]
            n = len(c)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(c), pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.full(n, total)), pa.array(pos), pa.array(pack(product, 0)), pa.array(pack(product, 2)),
                    pa.array(pack(before, 0)), pa.array(pack(before, 2)), pa.array(h1), pa.array(h2), pa.array(size), pa.array(cum),
                ],
                ["c", "part", "total", "pos", "fa", "fb", "pa", "pb", "h1", "h2", "bytes", "cum"],
            )

        def closing(c, pos, product, cum):
            one = lambda v: np.array([v], dtype=np.int64)
            m = product.reshape(1, LANES)
            return rows(one(c), one(pos), m, m, one(0), one(0), one(0), one(cum), True)

        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            if n >= len(table):
                table = powers(n)
            c, h1, h2, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("c", "h1", "h2", "bytes"))
            head = np.r_[True, c[1:] != c[:-1]]
            start = np.maximum.accumulate(np.where(head, np.arange(n), 0))     # where the conversation of a row starts in this batch
            inner = np.arange(n) - start + 1
            goes_on = now is not None and c[0] == now
            same = goes_on & (start == 0)
            if not goes_on:
                if now is not None and first is None:
                    first = (now, pos, product, cum)
                pos, cum, product = 0, 0, np.zeros(LANES, dtype=np.int64)
            if first is None and start[-1] > 0:      # the conversation of the first row ends in this batch
                first = True
            token = np.stack([h1 & P, (h1 >> 32) & P, h2 & P, (h2 >> 32) & P], axis=1) % P
            lift = np.array([pow(int(b), pos, P) for b in lanes], dtype=np.int64) if goes_on else None
            term = token * table[inner] % P
            if goes_on:
                term[same] = term[same] * lift % P
            run = np.cumsum(term, axis=0)
            run = run - (run - term)[start]
            sizes = np.cumsum(size)
            sizes = sizes - (sizes - size)[start]
            if goes_on:
                run[same] += product
                sizes = sizes + np.where(same, cum, 0)
                inner = inner + np.where(same, pos, 0)
            run %= P
            yield rows(c, inner, run, (run - term) % P, h1, h2, size, sizes, False)
            if first is True:
                end = int(np.flatnonzero(head)[1]) - 1
                first = (int(c[end]), int(inner[end]), run[end].copy(), int(sizes[end]))
            now, pos, cum, product = int(c[-1]), int(inner[-1]), int(sizes[-1]), run[-1].copy()
        if first is not None:
            yield closing(*first)
        if now is not None:
            yield closing(now, pos, product, cum)

    return scan


def lanes_of(a: Column, b: Column) -> list[Column]:
    return [F.shiftright(a, 31), a.bitwiseAND(P), F.shiftright(b, 31), b.bitwiseAND(P)]


def packed(lanes: Sequence[Column]) -> tuple[Column, Column]:
    return F.shiftleft(lanes[0], 31).bitwiseOR(lanes[1]), F.shiftleft(lanes[2], 31).bitwiseOR(lanes[3])


def joined(left: tuple[Column, Column], weights: Sequence[Column], right: tuple[Column, Column], off: tuple[Column, Column] | None = None) -> tuple[Column, Column]:
    """left * right, where ``weights`` are R^length(left) of the lanes; ``off`` is a prefix that is first taken off ``right``."""
    inner = lanes_of(*right)
    if off is not None:
        inner = [(r - o + P) % P for r, o in zip(inner, lanes_of(*off))]
    return packed([(x + w * r) % P for x, w, r in zip(lanes_of(*left), weights, inner)])


def prefix_products(turns: DataFrame, bases: Bases) -> DataFrame:
    """(c, pos from 1, fa, fb, pa, pb, h1, h2, bytes, cum): every turn with the product up to it, up to the one before, and bytes up to it."""
    small = saved(turns.select("c", "t", "h1", "h2", F.octet_length("x").cast("bigint").alias("bytes")))
    order = ("c", "t", "h1", "h2")
    stretches = small.repartitionByRange(*order).sortWithinPartitions(*order).select("c", "h1", "h2", "bytes")
    found = saved(stretches.mapInArrow(scanner(bases), SCAN))

    lanes = bases.lanes

    def carry(stretch):     # the totals of one conversation, at most one row for each task it spans
        stretch = stretch.drop_duplicates("part").sort_values("part")
        pos, cum, product, out = 0, 0, [0] * LANES, []
        for r in stretch.itertuples():
            lift = [pow(b, pos, P) for b in lanes]
            out.append((r.c, r.part, pos, cum, (product[0] << 31) | product[1], (product[2] << 31) | product[3], *lift))
            own = [r.fa >> 31, r.fa & P, r.fb >> 31, r.fb & P]
            product = [(x + w * y) % P for x, w, y in zip(product, lift, own)]
            pos, cum = pos + r.pos, cum + r.cum
        return stretch.iloc[:0].from_records(out[1:], columns=["c", "part", "pos0", "cum0", "fa0", "fb0", "w0", "w1", "w2", "w3"])

    carried = found.filter("total").groupBy("c").applyInPandas(
        carry, "c bigint, part int, pos0 bigint, cum0 bigint, fa0 bigint, fb0 bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint"
    )
    # two rows a task at most, so the side is small for any table
    rows = found.filter(~F.col("total")).join(F.broadcast(saved(carried)), ["c", "part"], "left")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    before = (F.coalesce("fa0", zero), F.coalesce("fb0", zero))
    weights = [F.coalesce(f"w{i}", one) for i in range(LANES)]
    whole = joined(before, weights, (F.col("fa"), F.col("fb")))
    parent = joined(before, weights, (F.col("pa"), F.col("pb")))
    return rows.select(
        "c", (F.col("pos") + F.coalesce("pos0", zero)).alias("pos"), whole[0].alias("fa"), whole[1].alias("fb"), parent[0].alias("pa"), parent[1].alias("pb"),
        "h1", "h2", "bytes", (F.col("cum") + F.coalesce("cum0", zero)).alias("cum"),
    )


def rebuilt(turns: DataFrame, bases: Bases, family: int, modulus: int) -> DataFrame:
    """A row per conversation: c, head (array of the base's turns that it takes), g (their number), n (own turns), h, the product of
    the head (xa, xb), the own product before the cut (ha, hb), lane weights w, length, bytes, and the fingerprint of the whole."""
    cut = (F.crc32(F.col("c").cast("string").cast("binary")) % modulus).cast("int")
    t = turns.withColumn("h", cut)
    point = F.struct("fa", "fb", "cum")
    head = F.struct("pos", "fa", "fb", "pa", "pb", "h1", "h2", "bytes", "cum")
    # the head of a base has at most ``modulus - 1`` turns, so the list is short
    convs = saved(t.groupBy("c").agg(
        F.first("h").alias("h"), F.max("pos").alias("n"), F.max_by(point, F.col("pos")).alias("last"),
        F.max(F.when(F.col("pos") == F.col("h"), point)).alias("before"),
        F.sort_array(F.collect_list(F.when((F.col("pos") < modulus) & (F.col("c") % family == 0), head))).alias("heads"),
    ))
    base = convs.filter(F.col("c") % family == 0).select(F.col("c").alias("b"), "heads")
    m = convs.drop("heads").withColumn("b", F.col("c") - F.col("c") % family).join(base, "b", "left")
    m = m.withColumn("head", F.coalesce(F.slice("heads", F.lit(1), F.col("h")), F.expr("array()").cast(base.schema["heads"].dataType))).drop("heads")
    zero = F.lit(0).cast("bigint")
    end = F.get("head", F.size("head") - 1)
    m = m.withColumns({
        "g": F.size("head").cast("bigint"), "xa": F.coalesce(end["fa"], zero), "xb": F.coalesce(end["fb"], zero), "xc": F.coalesce(end["cum"], zero),
        "ha": F.coalesce("before.fa", zero), "hb": F.coalesce("before.fb", zero), "hc": F.coalesce("before.cum", zero),
    })
    # weights R^(g - h), an exponent between 1 - modulus and 0
    table = F.array(*(F.array(*(F.lit(pow(b, -e, P)).cast("bigint") for b in bases.lanes)) for e in range(modulus)))
    m = m.withColumn("w", F.get(table, (F.col("h") - F.col("g")).cast("int")))
    more = F.col("n") > F.col("h")
    whole = joined((F.col("xa"), F.col("xb")), [F.get("w", F.lit(i)) for i in range(LANES)], (F.col("last.fa"), F.col("last.fb")), (F.col("ha"), F.col("hb")))
    return m.select(
        "c", "b", "h", "n", "g", "head", "xa", "xb", "xc", "ha", "hb", "hc", "w",
        (F.col("g") + F.when(more, F.col("n") - F.col("h")).otherwise(0)).alias("length"),
        (F.col("xc") + F.when(more, F.col("last.cum") - F.col("hc")).otherwise(0)).alias("size"),
        F.when(more, whole[0]).otherwise(F.col("xa")).alias("ea"), F.when(more, whole[1]).otherwise(F.col("xb")).alias("eb"),
    )


def members(convs: DataFrame, turns: DataFrame, *info: str) -> DataFrame:
    """A row per conversation and node on its path: depth, fa, fb, pa, pb (parent), h1, h2, bytes, upto (bytes before the node's own),
    rc, rp (reference to the stored turn) and the columns ``info`` of the conversation.

    The own turns meet the row of their conversation by (id, block of positions), so a conversation of very many turns is many keys.
    """
    zero = F.lit(0).cast("bigint")
    root = convs.select("c", *info, zero.alias("depth"), *(zero.alias(x) for x in ("fa", "fb", "pa", "pb", "h1", "h2", "bytes", "upto", "rc", "rp")))
    top = convs.select("c", *info, "b", F.explode("head").alias("t")).select(
        "c", *info, F.col("t.pos").alias("depth"), "t.fa", "t.fb", "t.pa", "t.pb", "t.h1", "t.h2", "t.bytes", (F.col("t.cum") - F.col("t.bytes")).alias("upto"),
        F.col("b").alias("rc"), F.col("t.pos").alias("rp"),
    )
    block = lambda p: F.floor(p / BLOCK).cast("int")
    own = convs.filter(F.col("n") > F.col("h")).select(
        "c", *info, "h", "g", "xa", "xb", "xc", "ha", "hb", "hc", "w", F.explode(F.sequence(block(F.col("h")), block(F.col("n") - 1))).alias("k")
    )
    rows = turns.withColumn("k", block(F.col("pos") - 1)).join(own, ["c", "k"]).filter(F.col("pos") > F.col("h"))
    head, weights, before = (F.col("xa"), F.col("xb")), [F.get("w", F.lit(i)) for i in range(LANES)], (F.col("ha"), F.col("hb"))
    here, parent = joined(head, weights, (F.col("fa"), F.col("fb")), before), joined(head, weights, (F.col("pa"), F.col("pb")), before)
    suffix = rows.select(
        "c", *info, (F.col("g") + F.col("pos") - F.col("h")).alias("depth"), here[0].alias("fa"), here[1].alias("fb"), parent[0].alias("pa"), parent[1].alias("pb"),
        "h1", "h2", "bytes", (F.col("xc") + F.col("cum") - F.col("bytes") - F.col("hc")).alias("upto"), F.col("c").alias("rc"), F.col("pos").alias("rp"),
    )
    return root.unionByName(top).unionByName(suffix)


def nodes_of(rows: DataFrame) -> DataFrame:
    """Groups of equal depth and fingerprint: smallest member, parent, bytes; ``torn`` if parents or content hashes differ, ``several``
    if the last turns are different stored turns."""
    same = lambda *cs: F.lit(True) if not cs else (F.min(cs[0]) == F.max(cs[0])) & same(*cs[1:])
    return rows.groupBy(*NODE).agg(
        F.min("c").alias("owner"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("h1").alias("h1"), F.min("h2").alias("h2"), F.min("bytes").alias("bytes"),
        (~same("pa", "pb", "h1", "h2", "bytes", "upto")).alias("torn"), (~same("rc", "rp")).alias("several"),
    )


def verified(nodes: DataFrame, turns: DataFrame) -> bool:
    """No node is torn, and turns with the hashes of a node that different references meet in have one role and text."""
    if not nodes.filter("torn").isEmpty():
        return False
    met = broadcast_if_small(nodes.filter("several").select("h1", "h2").distinct())
    texts = turns.join(met, ["h1", "h2"], "left_semi").groupBy("h1", "h2")
    return texts.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("x").alias("x0"), F.max("x").alias("x1")).filter("r0 <> r1 OR x0 <> x1").isEmpty()


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, fa, fb, digest): SHA-256 of the ids that end in a node, in order, joined by commas."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def row():
            return (*key, ids[0], ",".join(map(str, ids)))

        def batch_of(rows):
            return pa.RecordBatch.from_pylist([dict(zip(("depth", "fa", "fb", "first", "ids"), r)) for r in rows])

        for batch in batches:
            out = []
            for d, a, b, c in zip(*(batch.column(k).to_pylist() for k in (*NODE, "c"))):
                if key != (d, a, b) or len(ids) >= IDS_PER_PIECE:
                    if ids:
                        out.append(row())
                    key, ids = (d, a, b), []
                ids.append(c)
            if out:
                yield batch_of(out)
        if ids:
            yield batch_of([row()])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        names = (*NODE, "digest")
        for batch in batches:
            out = []
            for d, a, b, ids in zip(*(batch.column(k).to_pylist() for k in (*NODE, "ids"))):
                if key == (d, a, b):
                    state.update(b",")
                else:
                    if key:
                        out.append(dict(zip(names, (*key, state.hexdigest()))))
                    key, state = (d, a, b), hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist(out)
        if key:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, state.hexdigest())))])

    dealt = ends.repartitionByRange(*NODE, "c").sortWithinPartitions(*NODE, "c")
    cut = dealt.mapInArrow(pieces, "depth bigint, fa bigint, fb bigint, first bigint, ids string")
    return cut.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, "depth bigint, fa bigint, fb bigint, digest string")


def described(convs: DataFrame, turns: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of the trie from verified nodes."""
    least = nodes.filter("depth = 0").select("owner").first()["owner"]
    # what belongs to a conversation: the last nodes of its path. ``hook`` is the node they hang from, another's or the root.
    owned = saved(nodes.filter("depth > 0").groupBy(F.col("owner").alias("c")).agg(
        F.count(F.lit(1)).alias("k"), F.sum("bytes").alias("u"), F.min_by(F.struct((F.col("depth") - 1).alias("depth"), F.col("pa").alias("fa"), F.col("pb").alias("fb")), "depth").alias("hook"),
    ))
    hooks = owned.select("c", "hook.*")
    holders = hooks.select(*NODE).distinct().join(nodes.select(*NODE, "owner"), list(NODE))
    hung = saved(hooks.join(holders, list(NODE)).select("c", F.col("owner").alias("above")))     # many may hang from one node: only this join is uneven
    at_end = convs.select("c", F.col("length").alias("depth"), F.col("ea").alias("fa"), F.col("eb").alias("fb"), "length")
    leaves = at_end.join(owned.select("c"), "c", "left_semi").join(hooks.select(*NODE).distinct(), list(NODE), "left_anti").select("c", F.lit(1).alias("leaf"))
    zero = F.lit(0).cast("bigint")
    info = convs.join(owned.select("c", "k", "u"), "c", "left").join(hung, "c", "left").join(leaves, "c", "left")
    # with no turn in any conversation the root is the leaf, and its owner counts it
    lone = (F.col("c") == least) & F.lit(nodes.filter("depth > 0").isEmpty())
    info = saved(info.withColumns({
        "u": F.coalesce("u", zero), "o": F.col("length") - F.coalesce("k", zero), "leaf": F.when(lone, 1).otherwise(F.coalesce("leaf", zero)).cast("bigint"),
    }))
    rows = members(info, turns, "length", "size", "u", "o", "leaf", "above")
    own = F.when(F.col("depth") == 0, F.col("c") == least).otherwise(F.col("depth") > F.col("o"))
    parent = F.when(own & (F.col("depth") > 0), F.when(F.col("depth") == F.col("o") + 1, F.col("above")).otherwise(F.col("c")))
    adds = rows.select(
        *NODE, F.col("c").alias("conv"), parent.alias("parent"), F.lit(1).cast("bigint").alias("one"),
        ((F.col("depth") + 1 > F.col("o")) & (F.col("length") > F.col("depth"))).cast("bigint").alias("child"), F.col("leaf"),
        F.when(own, zero).otherwise(F.col("size") - F.col("upto") - F.col("u")).alias("shared"), F.lit(None).cast("string").alias("digest"),
    )
    none = lambda t, name: F.lit(None).cast(t).alias(name)
    ends = end_digests(at_end.select("c", *NODE)).select(
        *NODE, none("bigint", "conv"), none("bigint", "parent"), zero.alias("one"), zero.alias("child"), zero.alias("leaf"), zero.alias("shared"), "digest"
    )
    empty = hashlib.sha256().hexdigest()
    return adds.unionByName(ends).groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.max("parent").alias("parent_conv_id"), F.sum("one").alias("n_convs"), F.sum("child").alias("n_children"),
        F.sum("leaf").alias("n_leaves"), F.sum("shared").alias("saved_tokens"), F.coalesce(F.max("digest"), F.lit(empty)).alias("ends_sha256"),
    ).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(
    conversations: DataFrame, family: int = 5, modulus: int = 9, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", seeds: Sequence[int] = (1, 2, 3, 4)
) -> DataFrame:
    """The nodes of the trie over all rebuilt conversations (bigint ids)."""
    for seed in seeds:
        bases = Bases(seed)
        read = turns_of(conversations, bases, conv, turn, role, text)
        products = prefix_products(read, bases)
        convs = saved(rebuilt(products, bases, family, modulus))
        nodes = saved(nodes_of(members(convs, products)))
        if nodes.isEmpty():
            return conversations.sparkSession.createDataFrame(
                [], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
            )
        if verified(nodes, read):
            return described(convs, products, nodes)
    raise RuntimeError(f"fingerprints collided for all of {len(seeds)} seeds")
