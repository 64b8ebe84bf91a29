import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash

from proofgrid.llm import components, decontamination, language_id, licenses, lm_scoring, queries, simhash_dedup, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: t.encode().lower().decode()


# SimHash


def fingerprint(text, shingle=3, seed=42):
    w = WORD.findall(lower(text or ""))
    grams = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, bits):
    """Smallest id reachable by links of so many differing bits at most."""
    label = {i: i for i in prints}
    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in ids}


def test_simhash_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    want = classes(prints, 3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op6_simhash_dedup(spark, sf).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


@pytest.mark.parametrize(("bits", "limit"), [(3, 20_000), (3, 6), (5, 20_000), (8, 10)])
def test_links_are_complete(spark, bits, limit):
    rng = np.random.default_rng(bits)
    prints = {}
    for i in range(60):                             # groups around a centre, chains and loners
        centre = int(rng.integers(1 << 62)) * 2 + 1
        for j in range(int(rng.integers(1, 9))):
            prints[len(prints)] = centre
            for b in rng.choice(64, int(rng.integers(0, bits + 2)), replace=False):
                centre ^= (1 << int(b)) if j % 2 else 0
                prints[len(prints) - 1] ^= 1 << int(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    first = {}
    for i, p in prints.items():
        first.setdefault(p, i)
    nodes = spark.createDataFrame([(i, signed(p), 0) for p, i in first.items()], "node bigint, fp bigint, fp2 bigint")
    pairs = simhash_dedup.PAIRS_TO_5 if bits <= 5 else simhash_dedup.PAIRS_TO_8
    links = simhash_dedup.linked(simhash_dedup.tiled(simhash_dedup.keyed(nodes, pairs), limit), bits, 128).distinct()
    labels = {r["node"]: r["label"] for r in components.components(links).collect()}
    want = classes({i: prints[i] for i in first.values()}, bits)
    assert {i: labels.get(i, i) for i in first.values()} == want


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500, 502: 500}


def test_simhash_odd_rows(spark, odd):
    got = simhash_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    want = classes({r["doc_id"]: fingerprint(r["text"]) for r in odd.collect() if r["doc_id"] is not None}, 3)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    kept = simhash_dedup.representatives(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id is null").count() == 1
    assert simhash_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_similar_documents_go_and_others_stay(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base = [[word() for _ in range(300)] for _ in range(40)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base[:20]):
        c = list(b)
        c[150] = "changed"
        rows += [(100 + i, " ".join(c)), (200 + i, " ".join(b))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in simhash_dedup.representatives(docs).collect()) == list(range(40))


# Repeated passages


def repeats(texts, window):
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    seen = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), sha256(kept.encode()).hexdigest())
    return out


def test_substring_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op7_substring_dedup(spark, sf).collect()}
    assert got == repeats(texts, 35)


def test_substring_boundaries(spark):
    """One passage of exactly the window and a few more, in very many documents, at every place."""
    passage = [f"p{i}" for i in range(9)]
    texts = {i: " ".join([f"u{i}x{j}" for j in range(i % 13)] + passage[: 8 + i % 2] + [f"v{i}y{j}" for j in range(i % 7)]) for i in range(300)}
    texts |= {1000: "a " * 50, 1001: "a " * 7, 1002: None, 1003: ""}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(None, "a " * 50, 1)], "doc_id bigint, text string, runs int")
    found = substring_dedup.without_repeats(docs, window=8, anchor=3).collect()
    got = {r["doc_id"]: (r["n_words"], sum(s["n"] for s in r["spans"]), sha256(r["kept"].encode()).hexdigest()) for r in found if r["doc_id"] is not None}
    assert got == repeats(texts, 8)
    assert [r["n_words"] for r in found if r["doc_id"] is None] == [50]
    assert substring_dedup.without_repeats(docs.limit(0)).count() == 0


# Benchmark passages


def contaminated(texts, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    owners = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - window + 1)) if w and i is not None else ():
            owners[tuple(w[k : k + window])].add(str(i))
    out = []
    for d, t in texts:
        w, hit, found = split(t), set(), set()
        for n in {len(o) for o in owners}:
            for k in range(len(w) - n + 1):
                if own := owners.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_query(spark, sf):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = [tuple(r) for r in queries.op9_decontamination(spark, sf).select(columns).collect()]
    assert sorted(got) == sorted(contaminated(texts, items, 10))
    assert any(r[-1] for r in got)


@pytest.mark.parametrize("block_bytes", [8_000_000, 60])
def test_decontamination_odd_rows(spark, odd, block_bytes):
    items = [(1, "line number 3 of the text LINE-number 4"), (2, "zzz"), (3, None), (None, "a b c"), (4, "..."), (5, "C a"), (10, "word word word word word"), (11, "a b c a")]
    table = spark.createDataFrame([(*x, "q") for x in items], "item_id bigint, text string, doc_id string")
    found = decontamination.contamination(odd, table, window=4, block_bytes=block_bytes).collect()
    got = [(r["doc_id"], r["n_words"], sum(s["n"] for s in r["spans"]), len(r["items"]), sha256(",".join(r["items"]).encode()).hexdigest(), bool(r["spans"])) for r in found]
    assert sorted(got, key=str) == sorted(contaminated([(r["doc_id"], r["text"]) for r in odd.collect()], items, 4), key=str)
    clean = decontamination.clean_documents(odd, table, window=4)
    assert clean.columns == odd.columns and clean.count() == sum(not r["spans"] for r in found)
    assert decontamination.contamination(odd.limit(0), table).count() == 0
    assert decontamination.contamination(odd, table.limit(0)).filter("size(spans) > 0").count() == 0


# Languages


def test_language_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op10_language_id(spark, sf).collect()}
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert {r["doc_id"] for r in held} == {i for i, r in got.items() if r["held_out"]} and len(got) == len(rows)
    long = [r for r in held if len(r["text"]) >= 40]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in long) >= 0.97 * len(long)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_odd_rows(spark, odd):
    model = language_id.dictionaries(odd)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.classify(odd, model).collect()}
    assert got[0] == got[1] == got[2] == got[3] == "und" and got[5] != "und"
    assert language_id.classify(odd, {}).filter("lang_pred <> 'und'").count() == 0
    assert language_id.classify(odd.limit(0), model).count() == 0 and language_id.dictionaries(odd.limit(0)) == {}


# Licences


def test_licences(spark, odd):
    mit = dict(licenses.TEXTS)["MIT"]
    rows = [
        (1, "MIT LICENCE\n\nCopyright (c) 2020 Some Body\n\n" + mit.removeprefix("MIT License ").replace(". ", ".\n\n")), (2, "Text.\n  RELEASED under the MIT Licence!\nlicensed under CC BY-NC 4.0"),
        (3, "Released under the MIT License, mostly."), (4, None), (None, "SPDX-License-Identifier: Apache-2.0"),
    ]
    got = {r["doc_id"]: (r["text_licence"], r["line_licences"], r["n_licence_lines"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: ("MIT", [], 0), 2: (None, ["CC-BY-NC-4.0", "MIT"], 2), 3: (None, [], 0), 4: (None, [], 0), None: ("Apache-2.0", ["Apache-2.0"], 1)}
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(odd.limit(0)).count() == 0


# Pseudo-likelihood


def test_scores(spark, odd):
    rng = np.random.default_rng(0)
    follow = {f"w{i}": [f"w{(3 * i + k) % 50}" for k in (1, 2)] for i in range(50)}
    def sentence():
        w = ["w0"]
        while len(w) < 120:
            w.append(str(rng.choice(follow[w[-1]])))
        return w
    rows = [(i, " ".join(sentence())) for i in range(400)]
    mixed = [(1000 + i, " ".join(rng.permutation(rows[i][1].split()))) for i in range(20)]
    docs = spark.createDataFrame(rows + mixed, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, stride=1).collect()}
    assert all(r["n_tokens"] == 120 and r["log_prob"] < 0 for r in got.values())
    assert np.mean([got[i]["per_token"] for i in range(20)]) > np.mean([got[1000 + i]["per_token"] for i in range(20)]) + 0.3
    scores = lm_scoring.score(odd).collect()
    assert len(scores) == odd.count() and {r["doc_id"]: r["n_tokens"] for r in scores}[0] == 0 and [r["log_prob"] for r in scores if r["doc_id"] == 1] == [0.0]
    assert lm_scoring.score(odd.limit(0)).count() == 0
    assert all(np.isfinite(r["log_prob"]) for r in [*got.values(), *scores])
