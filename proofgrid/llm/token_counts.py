"""Token counts of whole texts by a two-tier lookup, without a shuffle of pre-tokens.

A text is cut into units: a run of characters that are not white space, with the one space before it, or a run of
white space. The tokenizer cuts at all of these places as well, so the number of tokens of a text is the sum over its
units. Tier one is a broadcast table of the most frequent units with their token counts; every task reports only the
heaviest units of its partition, so the table costs a few thousand rows a task. Tier two is a cache in every Python
worker; what it doesn't hold is encoded by the library, a batch at a time. Neither tier changes a result.

Null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids give a row each. An empty table gives no
rows. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import chunks, heaviest, one_thread, saved

# White space as Unicode defines it.
SPACE = "\t-\r \x85\xa0  -     　"
UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
IRREGULAR = re.compile(r"\s\s|\A\s|\s\Z|[^\S \n]|\x00")

FREQUENT_UNITS = 65_536
UNITS_PER_TASK = 8_192
COUNTER_LIMIT = 400_000
CACHE_LIMIT = 400_000
_worker: dict = {}


def units(text: str, specials: re.Pattern | None) -> list[str]:
    """The units of a text, in order; their concatenation is the text."""
    if not text:
        return []
    if not IRREGULAR.search(text):          # words between single spaces and line ends: the same cuts, by plain splitting
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    out: list[str] = []
    for i, part in enumerate(specials.split(text) if specials else [text]):
        out += [part] if i % 2 else UNIT.findall(part)
    return out


def special_pattern(tokenizer) -> re.Pattern | None:
    words = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return re.compile("(" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + ")") if words else None


def tokenizer_of(path: str):
    """The worker's tokenizer, its special strings and its cache of unit lengths."""
    if path not in _worker:
        one_thread()
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _worker[path] = (t, special_pattern(t), {})
    return _worker[path]


def encoded_lengths(tokenizer, words: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def frequent_units(docs: DataFrame, path: str, text: str = "text", limit: int = FREQUENT_UNITS) -> dict[str, int]:
    """The heaviest units of the corpus with their token counts, at most ``limit``.

    Every partition counts all of its units (rare ones are dropped when the counter is full) and reports its heaviest.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials, seen = tokenizer_of(path)[1], Counter()
        for _, texts in chunks(batches, 0):
            for t in texts:
                seen.update(units(t, specials))
            floor = 1
            while len(seen) > COUNTER_LIMIT:
                seen = Counter({k: n for k, n in seen.items() if n > floor})
                floor *= 2
        top = seen.most_common(UNITS_PER_TASK)
        yield pa.RecordBatch.from_pydict(
            {"unit": pa.array([k for k, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())}
        )

    counted = docs.select(F.col(text).cast("string")).mapInArrow(report, "unit string, n bigint")
    counts = saved(counted.groupBy("unit").agg(F.sum("n").alias("n")))
    words = [r["unit"] for r in heaviest(counts, "unit", limit).select("unit").collect()]
    return dict(zip(words, encoded_lengths(tokenizer_of(path)[0], words), strict=True))


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = 512, frequent: dict[str, int] | None = None
) -> DataFrame:
    """One row per document: id, UTF-8 bytes, tokens, and whether the tokens exceed ``limit``."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent if frequent is not None else frequent_units(docs, path, text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, specials, cache = tokenizer_of(path)
        known = table.value
        for batch, texts in chunks(batches, 2):
            cut = [units(t, specials) for t in texts]
            rare = set().union(*cut) - known.keys()
            if len(cache) > CACHE_LIMIT:
                cache.clear()
            new = list(rare - cache.keys())
            cache.update(zip(new, encoded_lengths(tokenizer, new), strict=True))
            n = [sum(known.get(u) or cache[u] for u in us) for us in cut]      # no unit has length 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["_id", "n_bytes", "n_tokens"])

    whole = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint").alias("n_bytes"), F.col(text).cast("string").alias("_text")
    )
    kind = whole.schema["_id"].dataType.simpleString()
    out = whole.mapInArrow(count, f"_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

