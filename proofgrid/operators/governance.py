"""Duplicates, versions, audit chain, retention, redaction, access, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.functions import levels as lv
from proofgrid.functions import text as tx
from proofgrid.functions.hashing import hmac_sha256
from proofgrid.functions.privacy import scrub
from proofgrid.operators.claims import quotes_in_corpus
from proofgrid.operators.scale import broadcast_if_small, previous_by_bucket, row_number_by_bucket, running_sum, top_rows
from proofgrid.session import durable

# Keys never logged as text, longest logged string, text left in place of erased content, wording of negative feedback, bounds of the history search.
SENSITIVE_KEYS = ["text", "excerpt", "statement", "blob", "password", "secret", "token", "email_body"]
LOGGED_CHARS = 300
ERASED = "[effacé : candidat supprimé]"
NEGATIVE_FEEDBACK = ["insuffisant", "pas assez", "manque", "trop faible", "refuse", "refusé", "ne correspond pas", "un peu juste", "pas suffisamment"]
MAX_MISSIONS, MAX_HITS = 25, 8
SCOPE_ORDER = {"strategie": 1, "lecture": 2, "edition": 3, "owner": 4}


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key as an aggregate: partial on the map side, no sort of a key."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def first_seen(docs: DataFrame, scope: Sequence[str], key: str, order: str, counted: Column) -> DataFrame:
    """Marks copies: ``duplicate_of`` is the first counted row with the same key in the scope."""
    first = docs.filter(counted).groupBy(*scope, key).agg(F.min(order).alias("_first"))
    j = docs.join(first, [*scope, key], "left")
    return j.withColumn("duplicate_of", F.when(F.col("_first") < F.col(order), F.col("_first"))).drop("_first")


def reference_numbers(df: DataFrame, keys: Sequence[str], order: str, prefix: str = "C", width: int = 4096) -> DataFrame:
    numbered = row_number_by_bucket(df, keys, F.floor(F.col(order) / width), [F.col(order)], "number")
    return numbered.withColumn("ref", F.format_string(prefix + "-%04d", "number"))


def next_versions(new: DataFrame, stored: DataFrame, lineage: str, order: Sequence[Column], bucket: Column) -> DataFrame:
    """Version numbers of appended rows: they continue after the highest stored version of their lineage."""
    top = stored.groupBy(lineage).agg(F.max("version").alias("_top"))
    numbered = row_number_by_bucket(new, [lineage], bucket, order, "_n")
    return numbered.join(top, lineage, "left").withColumn("version", F.col("_n") + F.coalesce("_top", F.lit(0))).drop("_n", "_top")


def digest(key_hex: str, previous: Column, payload: Column) -> Column:
    return hmac_sha256(key_hex, F.concat(F.lit('{"p":"'), previous, F.lit('","d":'), payload, F.lit("}")))


def broken_links(log: DataFrame, keys: Sequence[str], key_hex: str, width: int = 4096) -> DataFrame:
    """Log rows whose previous hash is not the hash of the row before, or whose digest does not match."""
    prev = previous_by_bucket(log, keys, F.floor(F.col("seq") / width), [F.col("seq")], "hash", F.col("seq"), "_prev")
    bad = (F.coalesce("_prev", F.lit("")) != F.col("prev_hash")) | (digest(key_hex, F.col("prev_hash"), F.col("payload")) != F.col("hash"))
    return prev.filter(bad).drop("_prev")


def verify_chain(log: DataFrame, keys: Sequence[str], key_hex: str) -> DataFrame:
    """First broken row per chain, or none."""
    bad = broken_links(log, keys, key_hex).groupBy(*keys).agg(F.min("seq").alias("broken_at"))
    return log.groupBy(*keys).agg(F.count("*").alias("rows")).join(bad, list(keys), "left")


def chain_head(log: DataFrame, keys: Sequence[str], key_hex: str) -> DataFrame:
    """Head to publish: last number, its hash, and whether the chain holds."""
    head = log.groupBy(*keys).agg(F.max("seq").alias("head_seq"), F.max_by("hash", "seq").alias("head_hash"))
    return head.join(verify_chain(log, keys, key_hex), list(keys)).withColumn("ok", F.col("broken_at").isNull())


def request_counts(events: DataFrame, identity: str, ts: str, seconds: int, limit: int, key: str) -> DataFrame:
    """Requests of an identity in the window that ends at each request, and the seconds to wait when the limit is reached.

    The requests of an identity are counted along time once, together with two marks for each of them, where its window
    starts and where it ends: the difference of the counts at the marks is the number of requests inside. The counts are
    running sums over a range partition, so neither a busy identity nor a busy window is one task. ``key`` is unique.
    """
    span = seconds * 1_000_000
    e = events.select(F.col(key).alias("_key"), F.col(identity).alias("_who"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    mark = lambda at, kind: F.struct(at.alias("at"), F.lit(kind).alias("kind"))
    marks = e.select("_key", "_who", F.inline(F.array(mark(F.col("_t") - span, 0), mark(F.col("_t"), 1), mark(F.col("_t"), 2)))).withColumn("_one", (F.col("kind") == 1).cast("bigint"))
    counted = durable(running_sum(marks, ["_who"], ["at", "kind", "_key"], "_one", "_n"))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    c = counted.groupBy("_key", "_who").agg((of(2, "_n") - of(0, "_n")).alias("requests"), of(0, "_n").alias("_before"), of(1, "at").alias("_t"))
    oldest = counted.filter("kind = 1").select(F.col("_who").alias("_w"), F.col("_n").alias("_m"), F.col("at").alias("_oldest"))
    over = F.col("requests") > limit
    c = c.join(oldest, F.col("_who").eqNullSafe(F.col("_w")) & (F.col("_m") == F.when(over, F.col("_before") + 1)), "left")
    wait = F.greatest(F.lit(1), F.floor((F.lit(span) - (F.col("_t") - F.col("_oldest"))) / 1_000_000) + 1)
    return c.select(F.col("_key").alias(key), F.col("_who").alias(identity), "requests", over.alias("limited"), F.when(over, wait).cast("bigint").alias("retry_after"))


def scrub_detail(detail: Column) -> Column:
    """Audit detail without content: text-like keys become their length, long strings are cut."""
    return F.transform_values(
        detail,
        lambda k, v: F.when(k.isin(*SENSITIVE_KEYS), F.concat(F.lit("["), F.length(v).cast("string"), F.lit(" caractères non journalisés]")))
        .when(F.length(v) > LOGGED_CHARS, F.concat(F.substring(v, F.lit(1), F.lit(LOGGED_CHARS)), F.lit("…"))).otherwise(v),
    )


def visible(missions: DataFrame, shares: DataFrame, user: Column, mission: str = "mission_id") -> DataFrame:
    """Missions a user owns or was given, with the access level."""
    owned = missions.filter(F.col("owner") == user).select(mission, F.lit("owner").alias("scope"))
    given = shares.filter(F.col("user_id") == user).select(mission, "scope").join(owned.select(mission), mission, "left_anti")
    return missions.join(owned.unionByName(given), mission)


def by_access(df: DataFrame, scope: Column, needs: dict[str, str]) -> DataFrame:
    """Columns blanked below the access level they need."""
    rank = lv.lookup(SCOPE_ORDER, scope)
    return df.select(*[F.when(rank >= SCOPE_ORDER[needs[c]], F.col(c)).alias(c) if c in needs else F.col(c) for c in df.columns])


def expired(docs: DataFrame, today: str) -> DataFrame:
    return docs.filter(F.col("expires_at") < F.lit(today).cast("date"))


def purge_preview(docs: DataFrame, today: str) -> DataFrame:
    return expired(docs, today).agg(F.count("*").alias("documents"), F.count_distinct("candidate_id").alias("candidates"))


def purge(rows: DataFrame, doomed: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Rows that stay when the given candidates are erased."""
    return rows.join(doomed.select(key).distinct(), key, "left_anti")


def redact(rows: DataFrame, doomed: DataFrame, columns: Sequence[str], key: str = "candidate_id") -> DataFrame:
    """Rows of erased candidates keep their facts and lose their excerpts."""
    gone = doomed.select(key).distinct().withColumn("redacted", F.lit(True))
    j = rows.join(gone, key, "left").withColumn("redacted", F.coalesce("redacted", F.lit(False)))
    return j.select(*[F.when(F.col("redacted"), F.lit(ERASED)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in j.columns])


def correction_kind(old: Column, new: Column) -> Column:
    """Kind of the evidence a human correction creates."""
    return F.when(new == 0, "contredit").when(new < old, "plafonne").otherwise("supporte")


def regression_case(old: Column, new: Column, excerpt: Column) -> Column:
    return F.struct(correction_kind(old, new).alias("kind"), lv.level_name(old).alias("observed"), lv.level_name(new).alias("expected"), scrub(F.substring(excerpt, 1, 200)).alias("excerpt"))


def negative_feedback(text: Column) -> Column:
    f = tx.fold(text)
    words = F.array(*[F.lit(tx.fold_text(w)) for w in NEGATIVE_FEEDBACK])
    return F.exists(words, lambda w: F.contains(f, w))


def traced_quotes(requirements: DataFrame, sources: DataFrame, mission: str = "mission_id", source: str = "source_id") -> DataFrame:
    """Requirements whose quote stands in a recorded source of their mission."""
    r = requirements.withColumn("_rid", F.struct(*requirements.columns))
    held = quotes_in_corpus(r, sources, "_rid", "quote", (source,), "text", (mission,))
    return held.select("_rid").distinct().select("_rid.*")


def library(entries: DataFrame, user: Column, status: str | None = None, family: str | None = None, query: str | None = None) -> DataFrame:
    """Published entries and the user's own ones, newest first."""
    e = entries.filter((F.col("status") == "published") | (F.col("author_id") == user))
    if status:
        e = e.filter(F.col("status") == status)
    if family:
        e = e.filter(F.col("role_family") == family)
    if query:
        e = e.filter(F.contains(F.lower(F.concat_ws(" ", "title", "body")), F.lit(query.lower())))
    return e.orderBy(F.col("updated_at").desc(), F.col("entry_id").desc())


def _heads(entries: DataFrame, parts: Column, k: int) -> DataFrame:
    """(part, family, entry_id, origin): the first entries that hold a part, per family and over all families (family null, ``any``).

    Of one origin only its first k can count for a mission, and of these the first 2k hold k that are not the mission's own:
    whatever is left out is behind k entries that score as much and come first.
    """
    held = entries.select("entry_id", "origin", "family", F.explode(parts).alias("part"))
    views = F.explode(F.array(F.struct(F.lit(False).alias("any"), F.col("family").alias("family")), F.struct(F.lit(True).alias("any"), F.lit(None).cast("string").alias("family"))))
    held = held.select("entry_id", "origin", "part", views.alias("v")).select("entry_id", "origin", "part", "v.any", "v.family").filter(F.col("any") | F.col("family").isNotNull())
    per_origin = top_rows(held, ["part", "any", "family", "origin"], [F.col("entry_id")], k).drop("rn")
    return top_rows(per_origin, ["part", "any", "family"], [F.col("entry_id")], 2 * k).drop("rn")


def _parts(tags: Column) -> Column:
    """The empty set, every tag and every pair of a tag set, as sorted arrays."""
    def pairs(t: Column) -> Column:
        return F.flatten(F.transform(t, lambda a: F.transform(F.filter(t, lambda b: b > a), lambda b: F.array(a, b))))

    return tx.let(F.array_sort(tags), lambda t: F.concat(F.array(F.array().cast("array<string>")), F.transform(t, lambda a: F.array(a)), pairs(t)))


def suggestions(missions: DataFrame, skills: DataFrame, entries: DataFrame, k: int = 8) -> DataFrame:
    """Top entries per mission: 2 for the same family, 1 per shared tag, never its own ones; ties by entry_id.

    Nothing is scored against every entry of a popular tag. Entries that share at most two tags are found in bounded lists
    (the first ones of a tag, of a pair of tags, and of the same inside a family). They give each mission its k-th score; an
    entry that is in no list shares at least three tags and reaches that score, so it holds one of the rarest tags of the
    mission, all but the (m - 1) most frequent ones where m tags must be shared: only these are read in full, and not at all
    for missions with too few tags. An entry without an origin is nobody's own; null families and tags match nothing.
    missions(mission_id, family), skills(mission_id, skill), entries(entry_id, family, tags, origin); ids are unique.
    """
    e = entries.select("entry_id", "origin", "family", F.array_distinct(F.array_compact(F.coalesce("tags", F.array().cast("array<string>")))).alias("tags"))
    frequency = e.select(F.explode("tags").alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))
    # the tags of a mission that any entry has, rarest first
    known = skills.filter("skill is not null").distinct().join(broadcast_if_small(frequency), "skill")
    by_rarity = F.transform(F.array_sort(F.collect_list(F.struct("n", "skill"))), lambda x: x["skill"])
    m = missions.join(known.groupBy("mission_id").agg(by_rarity.alias("wanted")), "mission_id", "left")
    m = m.select("mission_id", F.col("family").alias("of"), F.coalesce("wanted", F.array().cast("array<string>")).alias("wanted"))

    heads = _heads(e, _parts(F.col("tags")), k).filter((F.size("part") > 0) | ~F.col("any"))
    asked = m.select("mission_id", "of", F.explode(_parts(F.col("wanted"))).alias("part"))
    asked = asked.select("mission_id", "part", F.explode(F.array(F.struct(F.lit(False).alias("any"), F.col("of").alias("family")), F.struct(F.lit(True).alias("any"), F.lit(None).cast("string").alias("family")))).alias("v"))
    asked = asked.select("mission_id", "part", F.col("v.any").alias("_any"), F.col("v.family").alias("_family"))
    same = (F.col("_any") == F.col("any")) & F.col("_family").eqNullSafe(F.col("family"))
    listed = asked.join(broadcast_if_small(heads), "part").filter(same)
    tags_of = e.select("entry_id", "tags", F.col("family").alias("entry_family"), "origin")
    pairs = listed.select("mission_id", "entry_id").distinct()

    def scored(rows: DataFrame) -> DataFrame:
        shared = F.size(F.array_intersect("wanted", "tags"))
        own = F.col("origin").eqNullSafe(F.col("mission_id"))
        points = (F.when(F.col("of") == F.col("entry_family"), 2).otherwise(0) + shared).cast("bigint")
        return rows.filter(~own).withColumn("relevance", points).filter("relevance > 0")

    first = scored(pairs.join(broadcast_if_small(tags_of), "entry_id").join(m, "mission_id"))
    best = durable(top_rows(first.select("mission_id", "entry_id", "relevance"), ["mission_id"], [F.col("relevance").desc(), F.col("entry_id")], k))
    kth = best.filter(F.col("rn") == k).select("mission_id", F.col("relevance").alias("floor"))
    open_ = m.join(kth, "mission_id", "left").withColumn("least", F.greatest(F.lit(3), F.coalesce(F.col("floor") - 2, F.lit(3))).cast("int"))
    open_ = open_.filter(F.size("wanted") >= F.col("least"))
    prefix = open_.select("mission_id", "of", "wanted", "least", F.explode(F.slice("wanted", F.lit(1), F.size("wanted") - F.col("least") + 1)).alias("skill"))
    deep = prefix.join(tags_of.withColumn("skill", F.explode("tags")), "skill")
    # a pair is kept at the rarest tag it shares, and only there
    deep = deep.filter(F.size(F.array_intersect("wanted", "tags")) >= F.col("least")).filter(F.get(F.array_intersect("wanted", "tags"), F.lit(0)) == F.col("skill"))
    more = scored(deep).select("mission_id", "entry_id", "relevance").join(best.select("mission_id", "entry_id"), ["mission_id", "entry_id"], "left_anti")
    every = best.drop("rn").unionByName(more)
    return top_rows(every, ["mission_id"], [F.col("relevance").desc(), F.col("entry_id")], k).select("mission_id", "entry_id", "relevance", "rn")


def history_search(missions: DataFrame, fields: DataFrame, query: str, mission: str = "mission_id") -> tuple[DataFrame, DataFrame]:
    """Newest missions with hits (bounded), the first hits of each (bounded), and whether more missions had hits.

    fields(mission_id, ord, kind, text) are the searchable texts of the visible missions.
    """
    hits = fields.join(missions.select(mission), mission, "left_semi").filter(tx.all_words_in(F.col("text"), query))
    counts = hits.groupBy(mission).agg(F.count("*").alias("hit_count"))
    found = missions.join(counts, mission)
    shown = top_rows(found, [], [F.col("updated_at").desc(), F.col(mission)], MAX_MISSIONS + 1, "position")
    truncated = F.max("position").over(Window.partitionBy()) > MAX_MISSIONS
    page = shown.withColumn("truncated", truncated).filter(F.col("position") <= MAX_MISSIONS)
    first = top_rows(hits.join(F.broadcast(page.select(mission)), mission, "left_semi"), [mission], [F.col("ord")], MAX_HITS)
    return page, first.withColumn("snippet", tx.snippet(F.col("text")))
