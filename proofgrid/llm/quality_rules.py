"""Quality rules with host verdicts. DataFrame functions only.

Base measures are computed inside the row of a document; no text is shuffled. Failures are then aggregated by host: a
document fails for its host if it fails a base rule, or has too many symbols, too many repeated lines, or words of an
unusual length. A host's failure rate is shrunk with a beta prior fitted to all hosts by the method of moments, so a host
with few documents is judged mostly by what is usual, and a host with many by its own record. The prior weighs at most
``max_strength`` documents: many like hosts can't make it so strong that no host is ever judged by its own record. A host
is rejected when its rate is high beyond doubt: when the posterior mean less ``deviations`` posterior standard deviations
exceeds ``max_host_rate`` and the common rate. The verdicts come back to the documents by a join of small rows. Counts
are aggregated on the map side first, so a host that holds a third of the rows costs one row a task.

Null and empty texts have no words and fail. A null host is a host of its own kind: its documents are counted in no
host and get no host verdict. Repeated rows count each. An empty table gives no rows. Extra columns stay where the
operator returns documents; where their names clash with a measure the measure replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.functions.text import let
from proofgrid.llm.common import saved

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Fixed values of the measures.
WORD = r"[^\x20\x09-\x0D]+"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10
    words_per_dup_line: int = 20
    min_word_chars: int = 3
    max_word_chars: int = 12
    max_host_rate: float = 0.5
    max_strength: float = 20.0
    deviations: float = 2.0


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN, -1), lambda w: w != "")


def repeated_window_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: windows are sorted with their places, equal neighbours found."""
    windows = lambda w: F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), F.xxhash64(F.lit(1), x, F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")),
    )
    same = lambda x, y: (x["h"] == y["h"]) & (x["g"] == y["g"])
    twice = lambda s: F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)))
    covered = lambda t: F.size(F.array_distinct(F.flatten(F.transform(t, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return let(words, lambda w: let(F.sort_array(windows(w)), lambda s: covered(twice(s))))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their base measures (bigint)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda line: F.length(F.translate(line, "\x20\x09\x0a\x0b\x0c\x0d", "")) > 0)
    kept = [c for c in docs.columns if c not in MEASURES]
    out = let(words_of(F.col(text)), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_window_words(w).cast("bigint").alias("n_repeat_words")))
    squeezed = F.translate(t, "\x20\x09\x0a\x0b\x0c\x0d", "")
    found = docs.select(*kept, F.inline(F.array(F.struct(
        out.alias("m"),
        F.length(squeezed).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("bigint").alias("n_dup_lines"),
    ))))
    return found.select(*kept, "m.n_words", "word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words")


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def host_failed(rules: Rules) -> Column:
    """What counts against the host of a document: the base rules, symbols, repeated lines, word length."""
    words = F.col("n_words")
    return (
        base_failed(rules) | (100 * F.col("n_symbols") > rules.max_symbol_percent * F.col("word_chars")) | (rules.words_per_dup_line * F.col("n_dup_lines") > words)
        | (F.col("word_chars") < rules.min_word_chars * words) | (F.col("word_chars") > rules.max_word_chars * words)
    )


def beta_prior(hosts: DataFrame, max_strength: float) -> tuple[float, float]:
    """Parameters of the beta prior from the hosts' counts (n, failed): moments of the rates of hosts with two documents or more.

    The variance of a rate also holds the chance of drawing its documents, which is taken off first. Without spread
    between hosts the prior is as strong as it may be.
    """
    rate = F.col("failed") / F.col("n")
    m = hosts.filter(F.col("n") >= 2).agg(
        F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"), F.avg(rate * (1 - rate) / (F.col("n") - 1)).alias("noise"), F.count(F.lit(1)).alias("k")
    ).first()
    if not m["k"]:
        return 1.0, 1.0
    mean = min(max(m["mean"], 1e-6), 1 - 1e-6)
    spread = max(m["var"] - m["noise"], 1e-9)
    strength = min(max(mean * (1 - mean) / spread - 1, 1e-3), max_strength)
    return mean * strength, (1 - mean) * strength


def host_verdicts(judged: DataFrame, host: str, rules: Rules) -> DataFrame:
    """(host, host_n, host_failed, host_rate, host_bound, host_rejected) from documents with ``host_failed``."""
    hosts = judged.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("_host")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("host_failed").cast("bigint")).alias("failed")
    )
    hosts = saved(hosts)
    a, b = beta_prior(hosts, rules.max_strength)
    weight = F.col("n") + F.lit(a + b)
    rated = hosts.withColumn("host_rate", (F.col("failed") + F.lit(a)) / weight)
    bound = F.col("host_rate") - rules.deviations * F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (weight + 1))
    return rated.select("_host", F.col("n").alias("host_n"), F.col("failed").alias("host_failed"), "host_rate", bound.alias("host_bound")).withColumn(
        "host_rejected", F.col("host_bound") > max(rules.max_host_rate, a / (a + b))
    )


def verdicts(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """One row per document: id, host, measures, base_failed, counts, rate and bound of the host, kept."""
    judged = measures(docs.select(F.col(id_col).alias("_id"), F.col(host).alias("_source"), F.col(text).alias("_text")), "_text").drop("_text")
    judged = saved(judged.withColumns({"base_failed": base_failed(rules), "host_failed": host_failed(rules)}))
    out = judged.drop("host_failed").join(host_verdicts(judged, "_source", rules), F.col("_source") == F.col("_host"), "left")
    kept = ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))
    return out.select(F.col("_id").alias(id_col), F.col("_source").alias(host), *MEASURES, "base_failed", "host_n", "host_failed", "host_rate", "host_bound", kept.alias("kept"))


def kept_documents(docs: DataFrame, rules: Rules = Rules(), host: str = "source", text: str = "text") -> DataFrame:
    """The documents that pass, same columns. Only the rejected hosts are joined; texts are judged where they lie."""
    small = measures(docs.select(F.col(host).alias("_source"), F.col(text).alias("_text")), "_text").withColumn("host_failed", host_failed(rules))
    bad = host_verdicts(small.select("_source", "host_failed"), "_source", rules).filter("host_rejected").select("_host")
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"), F.col(host).alias("_source"))
    passed = measures(row, "_text").filter(~base_failed(rules))
    return passed.join(bad, F.col("_source") == F.col("_host"), "left_anti").select("_row.*")
