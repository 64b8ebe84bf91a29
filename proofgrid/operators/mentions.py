"""Mentions of lexicon entries in texts, with offsets, homonym guards and pruning of nested hits.

The lexicon is a DataFrame: skill_key, label, kind, rarity, aliases, depth_terms,
advanced_terms, context_needed, context_forbidden, exclude_after, case_sensitive,
umbrella_of and so on. Any producer of such rows extends the detection.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.functions import text as tx
from proofgrid.operators import alias_rows as ar
from proofgrid.operators.intervals import contained_in_longer
from proofgrid.operators.scale import broadcast_if_small
from proofgrid.session import durable

TOKEN = "[a-z0-9+#]+"
BLOCK_ROWS, BLOCK_BYTES = 100_000, 32 * 1024 * 1024
CONTEXT_WINDOW = 160
NEVER = "(?!)"

LEXICON_SCHEMA = (
    "skill_key string, label string, kind string, rarity int, volatile boolean, aliases array<string>, depth_terms array<string>, "
    "advanced_terms array<string>, context_needed array<string>, context_forbidden array<string>, exclude_after array<string>, "
    "case_sensitive array<string>, narrowers array<string>, related array<string>, umbrella_of array<string>"
)


def _quoted(part: Column) -> Column:
    return F.regexp_replace(part, "([^\\p{L}\\p{N}])", "\\\\$1")


def term_pattern(term: Column) -> Column:
    """Pattern of a term held in a column (same rule as for constant terms)."""
    parts = F.filter(F.split(tx.fold(F.trim(term)), "[\\s\\-_]+"), lambda p: p != "")
    last = F.try_element_at(parts, F.lit(-1))
    plural = F.when(last.rlike("\\p{L}$") & ~last.rlike("[sx]$") & (F.length(last) > 3), "(?:s|x)?").otherwise("")
    body = F.array_join(F.transform(parts, _quoted), tx.SEPARATORS)
    return F.concat(F.lit(f"(?<!{tx.WORD})"), body, plural, F.lit(f"(?!{tx.WORD})"))


def exact_pattern(term: Column) -> Column:
    parts = F.filter(F.split(F.trim(term), "[\\s\\-_]+"), lambda p: p != "")
    return F.concat(F.lit("(?<![A-Za-z0-9+#])"), F.array_join(F.transform(parts, _quoted), tx.SEPARATORS), F.lit("(?![A-Za-z0-9+#])"))


def any_pattern(terms: Column) -> Column:
    """One pattern that matches any of the terms; a pattern that never matches when there is none."""
    return F.when(F.coalesce(F.size(terms), F.lit(0)) > 0, F.array_join(F.transform(terms, term_pattern), "|")).otherwise(F.lit(NEVER))


def alias_table(lexicon: DataFrame) -> DataFrame:
    """One row per alias and join key (the plural forms have their own keys)."""
    a = lexicon.select("*", F.explode("aliases").alias("alias")).filter(F.trim("alias") != "")
    words = F.regexp_extract_all(tx.fold(F.col("alias")), F.lit(TOKEN), F.lit(0))
    sensitive = F.array_contains(F.coalesce("case_sensitive", F.array().cast("array<string>")), F.col("alias"))
    has_context = (F.coalesce(F.size("context_needed"), F.lit(0)) > 0) | (F.coalesce(F.size("context_forbidden"), F.lit(0)) > 0)
    a = a.select(
        "skill_key", "alias",
        sensitive.alias("sensitive"),
        F.when(sensitive, exact_pattern(F.col("alias"))).otherwise(term_pattern(F.col("alias"))).alias("rx"),
        F.when(F.coalesce(F.size("exclude_after"), F.lit(0)) > 0, F.concat(F.lit("^\\s+(?:"), F.array_join(F.transform("exclude_after", _quoted), "|"), F.lit(")\\b")))
        .otherwise(F.lit(NEVER)).alias("after_rx"),
        (has_context & ~F.col("alias").rlike("[ \\-]")).alias("guarded"),
        F.when(F.coalesce(F.size("context_needed"), F.lit(0)) > 0, any_pattern(F.col("context_needed"))).otherwise(F.lit("")).alias("needed_rx"),
        any_pattern(F.col("context_forbidden")).alias("forbidden_rx"),
        F.array_join(words, "").alias("key"),
        F.size(words).alias("n_tokens"),
    )
    keys = F.array(F.col("key"), F.concat("key", F.lit("s")), F.concat("key", F.lit("x")))
    return a.withColumn("key", F.explode(F.when(F.col("rx").contains("(?:s|x)?"), keys).otherwise(F.array("key"))))


def ngram_keys(folded: Column, longest: int) -> Column:
    """Distinct token n-grams without separators: a term and its spellings share one key."""
    tokens = F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))

    def sized(t: Column, n: int) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, F.lit(n)), ""))

    def grams(t: Column) -> Column:
        return F.array_distinct(F.concat(t, *[sized(t, n) for n in range(2, longest + 1)]))

    return tx.let(tokens, grams)


def blocks_of(aliases: DataFrame) -> tuple[list[DataFrame], int]:
    """The aliases in blocks of bounded rows and bytes, dealt by hash, and the most tokens of one. A lexicon of more than one
    block costs a pass over the texts for each."""
    size = aliases.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("b"), F.max("n_tokens").alias("longest")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ROWS), -(-(size["b"] or 0) // BLOCK_BYTES))
    if blocks > 1:
        aliases = durable(aliases.withColumn("_block", F.pmod(F.xxhash64("skill_key", "alias", "key"), F.lit(blocks))))
    return [aliases] if blocks == 1 else [aliases.filter(F.col("_block") == i).drop("_block") for i in range(blocks)], size["longest"] or 1


def candidates(docs: DataFrame, aliases: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(document, alias) pairs that can match, with the text still in the row.

    One plan for a lexicon of any size: the n-grams of a text meet the alias keys where the text lies, and no text is
    shuffled.
    """
    dealt, longest = blocks_of(aliases)
    grams = docs.withColumn("_f", tx.fold(F.col(text)))
    grams = grams.withColumn("key", F.explode(ngram_keys(F.col("_f"), longest)))
    return reduce(DataFrame.unionByName, [grams.join(F.broadcast(block), "key") for block in dealt])


def raw_mentions(docs: DataFrame, lexicon: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """All guarded occurrences of all aliases: keys, skill_key, start, end, alias.

    Texts are read where they lie, in Arrow batches: their n-grams meet the keys of a block of aliases in a dictionary.
    """
    dealt, longest = blocks_of(alias_table(lexicon))
    rows = docs.select(F.col(text).cast("string").alias("_t"), *keys)
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + f", {ar.SQL_TYPE}"

    def of_block(block: DataFrame) -> DataFrame:
        own = [ar.Alias(*r) for r in block.select("skill_key", "alias", "sensitive", "rx", "after_rx", "guarded", "needed_rx", "forbidden_rx", "key").collect()]
        sent = docs.sparkSession.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return ar.occurrence_batches(batches, ar.Finder(sent.value, longest, CONTEXT_WINDOW))

        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, map(of_block, dealt))


def prune_nested(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop a hit that lies inside a longer (or equal, listed earlier) hit of the same group."""
    w = Window.partitionBy(*keys).orderBy(F.col("start"), F.col("end").desc(), F.col("alias"))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return hits.withColumn("_reach", reach).filter(F.col("_reach").isNull() | (F.col("end") > F.col("_reach"))).drop("_reach")


def mentions(docs: DataFrame, lexicon: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    hits = raw_mentions(docs, lexicon, keys, text).repartition(*keys)
    return prune_nested(hits, [*keys, "skill_key"])


def with_umbrella(hits: DataFrame, lexicon: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A parent entry also takes the hits of its member entries (their guards included)."""
    members = lexicon.select(F.col("skill_key").alias("parent"), F.explode("umbrella_of").alias("skill_key"))
    taken = hits.join(broadcast_if_small(members), "skill_key").select(*keys, F.col("parent").alias("skill_key"), "start", "end", "alias")
    return prune_nested(hits.unionByName(taken), [*keys, "skill_key"])


def uncovered_skills(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Skills of a text that have at least one hit not inside a longer hit of another skill."""
    flagged = hits.withColumn("_inside", contained_in_longer(hits, keys))
    return flagged.groupBy(*keys, "skill_key").agg(
        F.count("*").alias("hits"), F.sum(F.col("_inside").cast("int")).alias("covered")
    ).filter(F.col("covered") < F.col("hits")).drop("covered")


def best_role(titles: DataFrame, roles: DataFrame, key: str, title: str) -> DataFrame:
    """Role family whose title or trigger is the longest one found in a title."""
    words = roles.select(
        F.col("role_key").alias("skill_key"), F.explode(F.concat("titles", "triggers")).alias("alias"), F.col("ord"),
    )
    lex = words.groupBy("skill_key", "ord").agg(F.collect_list("alias").alias("aliases"))
    for c, t in (("case_sensitive", "array<string>"), ("context_needed", "array<string>"), ("context_forbidden", "array<string>"), ("exclude_after", "array<string>")):
        lex = lex.withColumn(c, F.array().cast(t))
    hits = raw_mentions(titles.select(key, title), lex, (key,), title).join(F.broadcast(roles.select(F.col("role_key").alias("skill_key"), "ord")), "skill_key")
    # the longest wording wins, the first family in case of a tie
    pick = F.max_by("skill_key", F.struct(F.length("alias"), -F.col("ord")))
    return hits.groupBy(key).agg(pick.alias("role_key"))


def pruned_aliases(terms: Column) -> Column:
    """Aliases without those that contain a shorter one as a phrase (they add no recall)."""
    word_list = lambda t: F.array_join(F.regexp_extract_all(tx.fold(t), F.lit(TOKEN), F.lit(0)), " ")
    padded = F.transform(terms, lambda t: F.struct(t.alias("t"), F.concat(F.lit(" "), word_list(t), F.lit(" ")).alias("w")))

    def kept(all_terms: Column) -> Column:
        shorter = lambda a: F.exists(all_terms, lambda b: (b["w"] != a["w"]) & (b["w"] != "  ") & F.contains(a["w"], b["w"]))
        return F.transform(F.filter(all_terms, lambda a: ~shorter(a)), lambda a: a["t"])

    return tx.let(padded, kept)
