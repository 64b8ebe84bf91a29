import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from proofgrid.llm import prefix_trie
from proofgrid.llm.common import table
from proofgrid.llm.queries import op12_conversation_prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    """The trie by materialised texts: every prefix is a tuple of turns."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda q: q[:2])] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    nodes = defaultdict(list)
    for c, v in sorted(built.items()):
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    inner = {k[:-1] for k in nodes if k}
    for k, m in nodes.items():
        if k:
            children[k[:-1]] += 1
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in inner
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1].encode()) if k else 0)
    out = []
    for k, m in nodes.items():
        ends = hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(k)).encode()).hexdigest()
        out.append((m[0], len(k), nodes[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], ends))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


SCHEMA = "conv_id bigint, turn bigint, role string, text string, c string, pos int, fa string, owner int"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x", 1, None, 2) for r in rows], SCHEMA).repartition(parts)


def made(seed, convs, longest, words):
    r = random.Random(seed)
    ids = r.sample(range(convs * 2), convs)
    return [(c, t if t or r.random() < 0.5 else None, r.choice(["user", "assistant", None]), r.choice(words)) for c in ids for t in range(r.randint(1, longest))]


def test_small_table(spark, sf):
    conversations = table(spark, sf, "conversations")
    want = brute([tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()])
    assert rows_of(op12_conversation_prefix_trie(spark, sf)) == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_many_shared_prefixes(spark, seed):
    """Few different texts, so that prefixes meet, branch and end in one another; nulls; ids on both sides of bases."""
    rows = made(seed, 40, 14, ["a", "", None, "é longer text", "b" * 30])
    assert rows_of(prefix_trie.trie(frame(spark, rows))) == brute(rows)


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    """A conversation that holds most rows is scanned in stretches, and meets its row in blocks of positions."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 50)
    rows = [(10, t, "user", f"turn {t % 7}") for t in range(900)] + [(12, t, "user", f"turn {t % 7}") for t in range(700)] + made(4, 20, 10, ["turn 0", "turn 1", "z"])
    df = frame(spark, [r for r in rows if r[0] is not None], 8)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        bases = prefix_trie.Bases(1)
        products = prefix_trie.prefix_products(prefix_trie.turns_of(df, bases, "conv_id", "turn", "role", "text"), bases)
        found = {(r["c"], r["pos"]): (r["fa"], r["fb"], r["pa"], r["pb"], r["cum"]) for r in products.filter("c IN (10, 12)").collect()}
        assert max(p for c, p in found if c == 10) == len([r for r in rows if r[0] == 10])
        for (c, p), v in found.items():
            if p > 1:
                assert found[c, p - 1][:2] == v[2:4]
        got = rows_of(prefix_trie.trie(df))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got == brute(rows)


def test_products_are_the_polynomial(spark):
    bases = prefix_trie.Bases(3)
    rows = [(1, t, "r", f"x{t}") for t in range(25)]
    turns = prefix_trie.turns_of(frame(spark, rows, 3), bases, "conv_id", "turn", "role", "text")
    hashes = [(r["h1"], r["h2"]) for r in turns.orderBy("t").collect()]
    for r in prefix_trie.prefix_products(turns, bases).collect():
        for lane, (take, shift) in enumerate(((0, 0), (0, 32), (1, 0), (1, 32))):
            want = sum(((h[take] >> shift) & prefix_trie.P) % prefix_trie.P * pow(bases.lanes[lane], i + 1, prefix_trie.P) for i, h in enumerate(hashes[: r["pos"]])) % prefix_trie.P
            got = (r["fa"] if lane < 2 else r["fb"]) >> (31 if lane % 2 == 0 else 0) & prefix_trie.P
            assert got == want


def test_collisions_are_found_and_tried_again(spark, monkeypatch):
    """With content hashes of two values, different texts share a node: the texts that the references name give it away."""
    rows = made(5, 25, 6, ["a", "bb", "ccc", "dddd"])
    true_hash = prefix_trie.turns_of

    def coarse(conversations, bases, *columns):
        out = true_hash(conversations, bases, *columns)
        return out if bases.seed > 1 else out.withColumns({"h1": F.pmod("h1", F.lit(2)), "h2": F.lit(0).cast("bigint")})

    monkeypatch.setattr(prefix_trie, "turns_of", coarse)
    assert rows_of(prefix_trie.trie(frame(spark, rows))) == brute(rows)
    with pytest.raises(RuntimeError):
        prefix_trie.trie(frame(spark, rows), seeds=(1,))


def test_edges(spark):
    assert rows_of(prefix_trie.trie(frame(spark, []))) == []
    assert rows_of(prefix_trie.trie(frame(spark, [(None, 0, "user", "no id")]))) == []
    # turnless rebuilt conversations only: no base, and fewer own turns than the head takes
    lonely = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2][:3]
    rows = [(c, 0, "user", "x") for c in lonely]
    assert rows_of(prefix_trie.trie(frame(spark, rows))) == brute(rows)
    assert brute(rows)[0][:6] == (lonely[0], 0, None, 3, 0, 1)
    # repeated rows, a very long text, equal conversations
    rows = [(c, t, "user", "w " * 300_000 if t == 2 else f"t{t}") for c in (5, 6, 7, 8, 9, 10) for t in (0, 1, 1, 2, 3)]
    assert rows_of(prefix_trie.trie(frame(spark, rows))) == brute(rows)


def test_pieces_of_ids(spark, monkeypatch):
    """A node where more ids end than fit a piece."""
    monkeypatch.setattr(prefix_trie, "IDS_PER_PIECE", 7)
    rows = [(c, t, "user", f"t{t}") for c in range(0, 120) for t in range(3)]
    assert rows_of(prefix_trie.trie(frame(spark, rows))) == brute(rows)
