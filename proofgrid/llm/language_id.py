"""Language identification by compression: the language whose dictionary compresses a text best.

For every language a bounded sample of labelled documents, in hash order of their ids, is joined to one raw-content
dictionary. A text is folded (lower case, letters only, single spaces) and compressed with each dictionary; the
smallest result names the language. Where two results lie close together the text is compressed again at a level that
searches longer for matches, and those sizes decide; sizes are whole bytes, so among nearly equal ones the share of
the text's words that a dictionary holds is taken off. ``score`` is the winner's share when every two bytes more halve
the weight of a language; a text is marked ``rejected`` when the margin to the second stays narrow.

Null text and text without a letter is ``und`` with score 0. Null ids, repeated rows and empty tables are no special
cases; without any labelled document everything is ``und``. Labels are taken as they are (null ones are left out); the
sample is bounded by ``sample_docs`` documents and ``sample_bytes`` bytes a language and ``max_languages`` languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.llm.common import chunks

SAMPLE_DOCS = 400
SAMPLE_BYTES = 110_000
MAX_LANGUAGES = 512
LEVEL, CLOSE_LEVEL = 3, 12
CLOSE, CLOSE_BYTES, NARROW = 0.05, 8, 0.02
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_worker: dict = {}


def folded(text: str) -> str:
    return NOT_LETTERS.sub(" ", text.lower()).strip()


def dictionaries(labelled: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Language -> dictionary content, from a bounded sample: documents in hash order as long as they fit.

    The documents of a language are counted first, and only those with a hash below the share that holds about twice the
    sample are ranked: what is shuffled does not grow with the corpus.
    """
    usable = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.octet_length(text) <= sample_bytes))
    usable = usable.select(F.col(lang).alias("_lang"), F.xxhash64(order, text).alias("_h"), F.col(text).alias("_text"))
    sizes = usable.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels are no languages")
    shares = labelled.sparkSession.createDataFrame([(r["_lang"], 2 * sample_docs / r["n"] + 40 / r["n"]) for r in sizes], "_lang string, share double")
    drawn = usable.join(F.broadcast(shares), "_lang").filter(F.pmod("_h", F.lit(1 << 31)) < F.col("share") * (1 << 31))
    rows = drawn.withColumn("_rn", F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))).filter(F.col("_rn") <= sample_docs)
    running = F.sum(F.octet_length("_text")).over(Window.partitionBy("_lang").orderBy("_rn"))
    rows = rows.withColumn("_sum", running).filter(F.col("_sum") <= 2 * sample_bytes)
    out: dict[str, list[str]] = {}
    for r in rows.orderBy("_lang", "_rn").toLocalIterator():
        out.setdefault(r["_lang"], []).append(folded(r["_text"]))
    return {k: " ".join(dict.fromkeys(v)).encode()[-sample_bytes:] for k, v in sorted(out.items()) if any(v)}


class Classifier:
    """Compressors of all languages; one per worker and model."""

    def __init__(self, contents: dict[str, bytes]):
        self.names = list(contents)
        self.quick = [compressor(c, LEVEL) for c in contents.values()]
        self.close = [compressor(c, CLOSE_LEVEL) for c in contents.values()]
        self.known = [frozenset(c.split()) for c in contents.values()]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        plain = folded(text) if text else ""
        if not plain or not self.names or not regex.search(r"\p{L}", plain):
            return "und", 0.0, True
        data = plain.encode()
        sizes = np.array([len(c(data)) for c in self.quick], dtype=float)
        best, second = np.sort(sizes)[:2] if len(sizes) > 1 else (sizes[0], np.inf)
        if second - best <= max(CLOSE_BYTES, CLOSE * best):
            sizes = np.array([len(c(data)) for c in self.close], dtype=float)
            words = data.split()
            sizes -= [2 * sum(w in known for w in words) / len(words) for known in self.known]
        order = np.argsort(sizes, kind="stable")
        best = sizes[order[0]]
        margin = (sizes[order[1]] - best) / max(best, 1) if len(order) > 1 else 1.0
        return self.names[order[0]], float(1 / np.exp2(-(sizes - best) / 2).sum()), bool(margin < NARROW)


def compressor(content: bytes, level: int):
    import zstandard

    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress


def classify(docs: DataFrame, contents: dict[str, bytes], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score, rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(contents)
    token = hash(tuple(sorted(contents.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _worker:
            _worker.clear()
            _worker[token] = Classifier(sent.value)
        model = _worker[token]
        for batch, texts in chunks(batches, 1):
            names, scores, narrow = zip(*map(model, texts), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(narrow, pa.bool_())],
                ["_id", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("_id", id_col)
