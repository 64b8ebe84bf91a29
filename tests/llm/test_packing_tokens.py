import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from proofgrid.llm import packing, queries, token_counts

ODD = [
    None, "", " ", "a", "a  b\n\n c\t", "<|endoftext|>", "x <|endoftext|> y<|startoftext|>z", "it's WE'LL　z q", "é ́a İı ſ ΑΣ Σ", "a\x00b c\x1cd", "ab " * 3000,
    "'  's ' s\n's", "12 345,6 ...!! 中文 ñandú \U0001f600", "word " * 20_000,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(ODD)] + [(1, "", "x", "y"), (None, "null id", None, None), (3, "a", "p", "q")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, _text string, n bigint".replace("n bigint", "fill string"))


def check_packing(rows, texts, capacity):
    """Pieces are those of the library, gapless in their sequences, none longer than a sequence."""
    tok = Tokenizer.from_file(queries.WORD_TOKENIZER)
    want = []
    for i, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], dtype="<u4").tobytes()
            want.append((i, k // capacity, k, len(part) // 4, zlib.crc32(part)))
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for off, length in sorted(parts):
            assert off == at
            at += length
        assert at <= capacity
    return len(by), sum(r["length"] for r in rows)


def test_packing_odd_texts(spark, odd):
    rows = packing.pack(odd, queries.WORD_TOKENIZER).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in odd.collect()], 2048)


def test_packing_rounds_and_density(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(16)
    rows = packing.pack(docs, queries.WORD_TOKENIZER, capacity=512, bins_per_task=8).collect()
    n, tokens = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 512)
    whole = packing.best_fit([r["length"] for r in rows], 512)[2]
    assert n <= 1.05 * len(whole) + 1        # partitions of a dozen documents, groups of 8 bins
    rows = packing.pack(docs, queries.WORD_TOKENIZER).collect()
    assert len({r["sequence_id"] for r in rows}) <= 1.06 * -(-sum(r["length"] for r in rows) // 2048) + 1


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fills = packing.best_fit([6, 5, 4, 4, 1], 10)
    assert fills == [10, 10] and bins == [0, 1, 0, 1, 1] and offsets == [0, 0, 6, 5, 9]


def test_packing_empty(spark, odd):
    assert packing.pack(odd.limit(0), queries.WORD_TOKENIZER).count() == 0


@pytest.mark.parametrize("frequent", [None, {}])
def test_token_counts(spark, odd, frequent):
    rows = token_counts.count_tokens(odd, queries.BYTE_TOKENIZER, frequent=frequent).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in odd.collect():
        t = r["text"] or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        want.append((r["doc_id"], len(t.encode()), n, n > 512))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(odd.limit(0), queries.BYTE_TOKENIZER).count() == 0


def test_token_counts_query(spark, sf):
    tok = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op2_token_counts(spark, sf).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_units_join_to_the_text():
    for t in ODD:
        assert "".join(token_counts.units(t or "", None)) == (t or "")


def test_heaviest_keys(spark):
    from proofgrid.llm.common import heaviest

    rows = [(f"k{i:03}", n) for i, n in enumerate([900, 800, 70, 60, 50] + [3] * 30 + [1] * 200)]
    counts = spark.createDataFrame(rows, "unit string, n bigint")
    assert [r["unit"] for r in heaviest(counts, "unit", 2).collect()] == ["k000", "k001"]
    assert [r["n"] for r in heaviest(counts, "unit", 10).collect()] == [900, 800, 70, 60, 50] + [3] * 5
    assert heaviest(counts, "unit", 6).count() == 5 and heaviest(counts, "unit", 1000).count() == 35     # no magnitude is cut apart beyond four times the limit
    assert heaviest(counts.limit(0), "unit", 5).count() == 0
