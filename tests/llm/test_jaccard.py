"""The near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

import re

import numpy as np
import pytest

import corpus_pipeline
from proofgrid.llm import simhash_dedup
from proofgrid.llm.jaccard_links import nodes_and_links

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall((text or "").encode().lower().decode())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(texts, least=0.8):
    """The smallest id of every component of the pairs with such a similarity."""
    sets, ids, label = {i: grams(t) for i, t in texts.items()}, sorted(texts), {i: i for i in texts}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or min(len(x), len(y)) >= least * max(len(x), len(y)) > 0 and len(x & y) >= least * len(x | y) - 1e-9:
                low, high = sorted((label[a], label[b]))
                label = {i: low if v == high else v for i, v in label.items()}
    return {i for i in ids if label[i] == i}


def corpus():
    """Pairs with a similarity from 0.6 to 1, short and long texts, some in chains."""
    rng, texts = np.random.default_rng(3), {}
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    for i in range(120):
        base = [word() for _ in range(int(rng.choice([6, 20, 80, 300])))]
        texts[10 * i] = " ".join(base)
        for j in range(1, 4):
            base = list(base)
            for p in rng.choice(len(base), max(1, int(len(base) * rng.uniform(0, 0.05))), replace=False):
                base[int(p)] = word()
            texts[10 * i + j] = " ".join(base)
        cut = int(rng.uniform(0.7, 1) * len(base))
        texts[10 * i + 4] = " ".join(base[:cut])
    return texts


@pytest.mark.parametrize("limit", [2_000, 3])
def test_all_pairs_of_the_similarity_and_no_others(spark, limit):
    texts = corpus() | {5001: "", 5002: None, 5003: " "}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = kept(texts)
    if limit == 2_000:
        assert {r["doc_id"] for r in simhash_dedup.representatives(docs).collect()} == want
    _, _, links = nodes_and_links(docs, 5, 0.8, bucket_limit=limit)
    for a, b in links.collect():
        x, y = grams(texts[a]), grams(texts[b])
        assert len(x & y) >= 0.8 * len(x | y) - 1e-9
    parts = {i: i for i in texts}
    for a, b in links.collect():
        low, high = sorted((parts[a], parts[b]))
        parts = {i: low if v == high else v for i, v in parts.items()}
    assert {i for i in texts if parts[i] == i} - {5002, 5003} == want


def test_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert {r["doc_id"] for r in got.collect()} == kept({r["doc_id"]: r["text"] for r in docs.collect()})


def test_repeated_ids_with_other_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " end"), (3, b + " end"), (None, a)], "doc_id bigint, text string")
    assert sorted(r["doc_id"] or 0 for r in simhash_dedup.representatives(docs).collect()) == [0, 1, 1]


def test_clashing_columns_and_repeated_rows(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long, 7, "a", 1), (2, long + " tail", 8, "b", 2), (3, "something else entirely", 9, None, 3), (1, long, 7, "a", 1), (None, long, 0, "n", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _gone int, _row string, _id int")
    kept = simhash_dedup.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted([r for r in docs.collect() if r["doc_id"] != 2], key=str)
