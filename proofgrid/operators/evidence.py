"""From mentions to evidence levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.functions import scope as sp
from proofgrid.functions import signals as sg
from proofgrid.functions import text as tx
from proofgrid.functions.levels import lookup
from proofgrid.operators import mention_rows as mr
from proofgrid.operators.mentions import alias_table, candidates, term_pattern
from proofgrid.operators.scale import broadcast_if_small, by_shuffle

# Mentions analysed per criterion and document; versions cited after a name.
MENTION_CAP = 300
VERSION_LIST = (
    "^\\s*(?:v|version\\s*)?(\\d{1,2}(?:\\.\\d+)*(?:\\s*(?:,|/|et|and|ou|or|\\+|->|→|vers|to)\\s*\\d{1,2}(?:\\.\\d+)*)*)"
    "(?![\\d.]*\\s*(?:ans|an|years?|mois|brokers?|topics?|partitions?|serveurs?|baies?|%))"
)


def sentence_rows(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per sentence with its offsets; no shuffle."""
    s = docs.select(*keys, F.posexplode(tx.sentences(F.col(text))).alias("sent_no", "s"))
    return s.select(*keys, "sent_no", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("sentence"))


def depth_patterns(lexicon: DataFrame, column: str = "depth_terms") -> DataFrame:
    return lexicon.select("skill_key", F.transform(column, lambda t: F.struct(t.alias("term"), term_pattern(t).alias("rx"))).alias("clues"))


def distinct_clues(folded: Column, clues: Column) -> Column:
    """Canonical forms of the clue terms found in a folded text, each counted once."""
    hit = F.filter(clues, lambda c: F.rlike(folded, c["rx"]))
    return F.array_sort(F.array_distinct(F.transform(hit, lambda c: stem(c["term"]))))


def stem(term: Column) -> Column:
    """Canonical form of a clue: plural dropped, synonyms merged, word by word."""

    def canon(w: Column) -> Column:
        return F.coalesce(lookup(mr.CANONICAL, w), w)

    def one(w: Column) -> Column:
        a = canon(w)
        b = F.when((F.length(a) > 3) & a.rlike("[sx]$"), F.substring(a, F.lit(1), F.length(a) - 1)).otherwise(a)
        return canon(b)

    return F.array_join(F.transform(F.split(F.trim(tx.fold(term)), "[\\s\\-_]+"), one), " ")


def depth_level(n_clues: Column) -> Column:
    """Level order from the distinct depth clues around a mention: none, one or two, three and more."""
    return F.when(n_clues >= 3, 4).when(n_clues >= 1, 3).otherwise(2)


def sentence_mentions(docs: DataFrame, lexicon: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """(sentence, skill) pairs with the distinct depth clues of the sentence; computed inside the sentence rows, without a shuffle."""
    sent = sentence_rows(docs, keys, text)
    cand = candidates(sent, alias_table(lexicon), [*keys, "sent_no"], "sentence")
    hit = cand.filter(F.rlike(F.when(F.col("sensitive"), F.col("sentence")).otherwise(F.col("_f")), F.col("rx")))
    with_clues = hit.join(broadcast_if_small(depth_patterns(lexicon)), "skill_key")
    return with_clues.select(
        *keys, "sent_no", "start", "end", "sentence", "skill_key", distinct_clues(F.col("_f"), F.col("clues")).alias("clues")
    )


def best_levels(items: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Best level per (document, criterion); earliest sentence in case of a tie."""
    ranked = items.withColumn("level_ord", depth_level(F.size("clues")))
    return ranked.groupBy(*keys, F.col("skill_key").alias("key")).agg(
        F.max("level_ord").alias("level_ord"),
        F.max_by(F.struct("sent_no", "start", "end"), F.struct(F.col("level_ord"), -F.col("start"))).alias("best"),
        F.count("*").alias("items"),
    )


def first_mentions(hits: DataFrame, keys: Sequence[str], cap: int = MENTION_CAP) -> DataFrame:
    """Only the first mentions of a criterion in a document are analysed: repetition earns nothing."""
    w = Window.partitionBy(*keys).orderBy("start", F.col("end").desc())
    return hits.withColumn("mention_no", F.row_number().over(w)).withColumn("analysed", F.col("mention_no") <= cap)


def described_activities(items: DataFrame, named: DataFrame, lexicon: DataFrame, keys: Sequence[str], folded: str) -> DataFrame:
    """Items that show at least two distinct depth clues of an activity although its name is absent from them.

    The clue terms are looked up like aliases: token groups find the candidates, the pattern decides.
    """
    acts = lexicon.filter(F.col("kind") == "activity").withColumn("aliases", F.col("depth_terms")).withColumn("case_sensitive", F.array().cast("array<string>"))
    terms = alias_table(acts).withColumn("clue", stem(F.col("alias")))
    found = candidates(items.select(*keys, folded), terms, keys, folded).filter(F.rlike(F.col(folded), F.col("rx")))
    enough = found.groupBy(*keys, "skill_key").agg(F.count_distinct("clue").alias("clues")).filter(F.col("clues") >= 2)
    return enough.join(by_shuffle(named.select(*keys, "skill_key")), [*keys, "skill_key"], "left_anti")


def sentence_windows(rows: DataFrame, keys: Sequence[str], flat: str) -> DataFrame:
    """Every sentence of an item with the span from the sentence before it to the one after it."""
    s = rows.select(*keys, F.posexplode(tx.item_sentences(F.col(flat))).alias("sent_no", "s"))
    s = s.select(*keys, "sent_no", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("sentence"))
    w = Window.partitionBy(*keys).orderBy("sent_no").rowsBetween(-1, 1)
    return s.withColumn("window_start", F.min("start").over(w)).withColumn("window_end", F.max("end").over(w))


def analyse_mentions(rows: DataFrame, today: str, item: str = "item", at: str = "at", clues: str = "clues", kind: str = "kind") -> DataFrame:
    """Signals and level of mentions inside their items.

    rows carries the item text, the position of the mention in it, the depth clues of
    the skill (term and pattern) and the kind of criterion. The action is read in the
    clause of the mention; depth, figures, results and deliverables in its sentence and
    the ones around it, without what is negated, planned, done by others or learned. All is read in Arrow batches; the other
    columns stay where they are.
    """
    run = F.arrow_udf(mr.analysis(today), mr.SQL_TYPE).asNondeterministic()            # evaluated once, whatever reads its fields
    d = rows.withColumn("_a", run(F.col(item).cast("string"), F.col(at).cast("int"), F.col(clues), F.col(kind).cast("string")))
    return d.select(*rows.columns, "_a.*")


def scope_limited(level_ord: Column, window: Column, scope_terms: Column) -> Column:
    """At most partial when none of the scope terms stands in the window."""
    seen = F.exists(scope_terms, lambda t: F.rlike(tx.fold(window), term_pattern(t)))
    return F.when((F.size(scope_terms) > 0) & ~seen, F.least(level_ord, F.lit(3))).otherwise(level_ord)


def document_levels(items: DataFrame, keys: Sequence[str], today: int, window_years: int = 7, commodity: int = 3) -> DataFrame:
    """Level of a criterion in a document from its items: best item, then upgrades, caps and recency, in this order.

    items: exp_idx, location, level_ord, negated, role, action, scoped, months, workish,
    end_ord, clues (advanced), versions, and per criterion rarity, advanced, need_version, volatile.
    """
    per_criterion = ["rarity", "advanced", "need_version", "volatile"]
    seen = ~F.col("negated")
    practice = seen & (F.col("location") == "experience")
    order = F.struct(F.col("level_ord"), F.coalesce("end_ord", F.lit(-1)), F.col("item_id"))
    exp = items.groupBy(*keys, "exp_idx").agg(
        *[F.max(c).alias(c) for c in per_criterion],
        F.count("*").alias("n"), F.count_if(seen).alias("n_seen"),
        F.max(F.when(practice, F.col("level_ord"))).alias("practice_level"), F.max(F.when(seen, F.col("level_ord"))).alias("any_level"),
        F.bool_or(seen & (F.col("location") == "env_list")).alias("env"), F.bool_or(seen & (F.col("role") == "participant")).alias("participant"),
        F.max("months").alias("months"), F.bool_or("workish").alias("workish"), F.max("end_ord").alias("end_ord"),
        F.max_by(F.struct("level_ord", "location", "action", "role", "scoped", "months", "exp_idx"), F.when(seen, order)).alias("best"),
        F.max(F.when(seen, order)).alias("best_order"),
        F.flatten(F.collect_list(F.when(practice, F.col("clues")))).alias("clues"), F.array_max(F.flatten(F.collect_list("versions"))).alias("version"),
    )
    is_practice = F.col("practice_level") >= 3
    support = (F.col("n_seen") > 0) & (F.col("months") > 0) & F.col("workish")
    doc = exp.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in per_criterion],
        F.sum("n").alias("items"), F.sum("n_seen").alias("seen"), F.max_by("best", "best_order").alias("best"),
        F.count_if(is_practice).alias("practised"), F.count_if(support).alias("supported"), F.bool_or("participant").alias("participant"),
        F.max(F.when(F.col("env"), F.struct("exp_idx"))).alias("_e"), F.collect_set(F.when(F.col("env"), F.col("exp_idx"))).alias("env_exps"),
        F.size(F.array_distinct(F.flatten(F.collect_list("clues")))).alias("n_clues"), F.max("version").alias("version"),
        F.max(F.when((F.col("any_level") >= 3) | is_practice, F.col("end_ord"))).alias("last_partial"),
        F.max(F.when((F.col("any_level") >= 2) | is_practice, F.col("end_ord"))).alias("last_any"),
        F.max(F.when(support, F.col("end_ord"))).alias("last_support"),
    )
    lone = ~F.col("participant")
    d = doc.withColumn("best_level", F.coalesce("best.level_ord", F.lit(1)))
    d = d.withColumn("repeated", (F.col("rarity") <= commodity) & (F.col("practised") >= 2) & (F.col("best_level") == 3) & lone)
    d = d.withColumn("_l1", F.when(F.col("repeated"), 4).otherwise(F.col("best_level")))
    common = (F.col("rarity") <= 2) & lone & (F.col("seen") > 0)
    d = d.withColumn("commodity", F.when(common & (F.col("supported") >= 2) & (F.col("_l1") < 4), 4).when(common & (F.col("supported") == 1) & (F.col("_l1") == 2), 3))
    d = d.withColumn("_l2", F.coalesce("commodity", "_l1"))
    b = F.col("best")
    d = d.withColumn(
        "corroborated",
        (F.col("rarity") <= commodity) & (b["location"] == "experience") & (F.col("_l2") == 3) & (b["action"] == "strong") & (b["role"] != "participant") & ~b["scoped"]
        & (b["months"] >= 24) & F.array_contains("env_exps", b["exp_idx"]) & ~F.col("advanced"),
    )
    d = d.withColumn("_l3", F.when(F.col("corroborated"), 4).otherwise(F.col("_l2")))
    d = d.withColumn("depth_capped", F.col("advanced") & (F.col("n_clues") < 2) & (F.col("_l3") > 3)).withColumn("_l4", F.when(F.col("depth_capped"), 3).otherwise(F.col("_l3")))
    d = d.withColumn("version_capped", F.coalesce((F.col("version") < F.col("need_version")) & (F.col("_l4") > 3), F.lit(False))).withColumn("_l5", F.when(F.col("version_capped"), 3).otherwise(F.col("_l4")))
    last = F.greatest(F.when(F.col("_l5") >= 3, F.col("last_partial")).otherwise(F.col("last_any")), F.when(F.col("commodity").isNotNull(), F.col("last_support")))
    d = d.withColumn("last_used", last)
    old = F.col("volatile") & (F.lit(today) - F.col("last_used") > window_years * 12) & (F.col("_l5") >= 3)
    d = d.withColumn("downgraded", F.coalesce(old, F.lit(False))).withColumn("level_ord", F.col("_l5") - F.col("downgraded").cast("int"))
    d = d.withColumn("declared_absence", (F.col("seen") == 0) & (F.col("items") > 0))
    return d.drop("_l1", "_l2", "_l3", "_l4", "_l5", "_e", "best", "env_exps")


def versions_after(folded: Column, end: Column) -> Column:
    """Major versions cited right after a product name."""
    listed = F.regexp_extract(F.substring(folded, end + 1, F.lit(40)), VERSION_LIST, 1)
    return F.transform(F.regexp_extract_all(listed, F.lit("(?<![\\d.])(\\d{1,2})(?:\\.\\d+)*"), F.lit(1)), lambda v: v.cast("int"))


def volume_levels(segments: DataFrame, keys: Sequence[str], text: str, scope_terms: list[str]) -> DataFrame:
    """Largest throughput of an item; a figure counts only in a segment that also names the scope."""
    s = segments.select(*keys, F.explode(F.split(F.regexp_replace(text, "\\s+", " "), sp.VOLUME_SPLIT)).alias("segment"))
    s = s.withColumn("volume", sp.volume_per_day(F.col("segment"))).filter("volume is not null")
    s = s.withColumn("in_scope", tx.has_any_term(tx.fold(F.col("segment")), scope_terms) if scope_terms else F.lit(True))
    v = s.groupBy(*keys).agg(F.max(F.when(F.col("in_scope"), F.col("volume"))).alias("volume"), F.max(F.when(~F.col("in_scope"), F.col("volume"))).alias("elsewhere"))
    return v.withColumn("level_ord", F.coalesce(sp.volume_level(F.col("volume")), F.lit(1)))
