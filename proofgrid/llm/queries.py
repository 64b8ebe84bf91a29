"""The registered queries of this subpackage, one per operator, and the pipeline; SQL where it can state the result.

Queries apply an operator with production parameters to whole tables; digests are derived from its outputs here.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from proofgrid.llm import (
    decontamination, language_id, licenses, line_dedup, lm_scoring, packing, quality_rules, simhash_dedup, substring_dedup, token_counts,
    prefix_trie, url_filters, whitening,
)
from proofgrid.llm.common import table
from proofgrid.llm.oracles import LICENSES_SQL, LINES_SQL, QUALITY_SQL, TRIE_SQL

Query = Callable[[SparkSession, str], DataFrame]
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER, capacity=2048, end_id=0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, limit=512)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents")).select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.with_bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(line_dedup.kept_text(F.col("text"), F.col("keep_runs")), 256).alias("kept_sha256"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.without_repeats(table(spark, sf_dir, "documents"), window=35)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["n"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "digest", "text_licence", F.array_join("line_licences", ",").alias("line_licences"), "n_licence_lines")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["n"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = language_id.dictionaries(docs.filter(F.col("doc_id").isNotNull() & ~held_out))
    return language_id.classify(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score", "rejected")


URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filters.train(url_filters.labelled_urls(spark))
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES, model)


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), family=5, modulus=9)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)
    return found.withColumn("deviation", F.col("deviation").cast("bigint"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_best_fit_packing, op2_token_counts, op3_quality_rules, op4_line_dedup, op5_lm_scoring, op6_simhash_dedup, op7_substring_dedup,
        op8_license_scans, op9_decontamination, op10_language_id, op11_url_filters,
        op12_conversation_prefix_trie, op13_embedding_whitening, pipeline,
    )
}
ORACLES: dict[str, str] = {"op3_quality_rules": QUALITY_SQL, "op4_line_dedup": LINES_SQL, "op8_license_scans": LICENSES_SQL, "op12_conversation_prefix_trie": TRIE_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
