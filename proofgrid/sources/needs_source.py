"""External needs: JSON snapshots with a closed set of fields, warehouse reads, listing and idempotent import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.functions import markup
from proofgrid.functions import text as tx
from proofgrid.operators.scale import broadcast_if_small

# The fields of a need, the shortest usable text, the longest page of a listing.
FIELDS = ["external_id", "reference", "title", "company", "state", "updated_at", "created_at", "description", "criteria", "place", "start", "end"]
SNAPSHOT_SCHEMA = "needs/1"
MIN_TEXT = 40
MAX_PAGE = 50
NEED_SCHEMA = ", ".join(f"`{f}` string" for f in FIELDS)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Needs of a JSON-lines snapshot. One bad row refuses the whole snapshot: the read fails and names its problem."""
    checked = snapshot_rows(spark, path)
    refused = F.raise_error(F.concat(F.lit("snapshot refused: "), "problem", F.lit(" in "), F.substring("json", 1, 200)))
    return checked.select(F.when(F.col("problem").isNull(), F.col("need")).otherwise(refused).alias("need")).select("need.*")


def snapshot_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every row of a snapshot with its need and its problem, to show what is wrong with a refused one."""
    return validate_json(spark.read.text(path).select(F.col("value").alias("json")))


def validate_json(rows: DataFrame, json: str = "json") -> DataFrame:
    """Parsed need and the first problem of each JSON row: unreadable, unknown field, missing or repeated identifier."""
    r = rows.withColumn("_keys", F.map_keys(F.from_json(json, "map<string,string>"))).withColumn("need", F.from_json(json, NEED_SCHEMA))
    r = r.withColumn("_id", F.trim(F.coalesce("need.external_id", F.lit(""))))
    # rows without identifier are not counted: they would all meet on one key
    again = r.filter("_id <> ''").groupBy("_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    r = r.join(again, "_id", "left")
    unknown = F.size(F.array_except("_keys", F.array(*[F.lit(f) for f in FIELDS]))) > 0
    problem = F.when(F.col("_keys").isNull(), "unreadable").when(unknown, "unknown_field").when(F.col("_id") == "", "missing_id").when(F.col("_n") > 1, "repeated_id")
    return r.withColumn("problem", problem).drop("_keys", "_id", "_n")


def tagged_snapshots(rows: DataFrame, json: str = "json") -> DataFrame:
    """Whole snapshots, one text each, with their problem (unreadable, wrong schema) and their needs as JSON rows; a refused one has none."""
    parsed = F.from_json(json, "struct<schema:string,needs:array<map<string,string>>>", {"mode": "PERMISSIVE"})
    r = rows.withColumn("_s", parsed)
    readable = F.col("_s.needs").isNotNull() & F.col("_s.schema").isNotNull()
    problem = F.when(F.col("_s").isNull() | (F.col("_s.schema").isNull() & F.col("_s.needs").isNull()), "unreadable").when(~readable | (F.col("_s.schema") != SNAPSHOT_SCHEMA), "wrong_schema")
    needs = F.when(problem.isNull(), F.transform("_s.needs", lambda m: F.to_json(m))).otherwise(F.array().cast("array<string>"))
    return r.select(*rows.columns, problem.alias("problem"), needs.alias("needs")).drop("_s")


def read_tagged_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Needs of snapshots that carry the schema tag and the list of needs in one JSON document; anything else is refused by name."""
    s = tagged_snapshots(spark.read.text(path, wholetext=True).select(F.col("value").alias("json")))
    refused = F.raise_error(F.concat(F.lit("snapshot refused: "), "problem")).cast("array<string>")
    rows = s.select(F.explode(F.when(F.col("problem").isNull(), F.col("needs")).otherwise(refused)).alias("json"))
    bad = F.raise_error(F.concat(F.lit("snapshot refused: "), "problem", F.lit(" in "), F.substring("json", 1, 200)))
    return validate_json(rows).select(F.when(F.col("problem").isNull(), F.col("need")).otherwise(bad).alias("need")).select("need.*")


def compose_brief(title: Column, place: Column, start: Column, end: Column, description: Column, criteria: Column) -> Column:
    """Readable text of a need under neutral titles; empty fields are skipped."""
    given = lambda label, c, glue: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label + glue), c))
    meta = F.concat_ws("\n", given("Lieu", place, " : "), given("Démarrage", start, " : "), given("Fin", end, " : "))
    return F.trim(
        F.concat_ws(
            "\n\n", F.when(F.trim(title) != "", F.trim(title)), F.when(meta != "", meta), given("Description du besoin", description, "\n"), given("Profil recherché", criteria, "\n")
        )
    )


def usable_text(description: Column, criteria: Column) -> Column:
    return F.length(F.trim(F.concat(F.coalesce(description, F.lit("")), F.lit(" "), F.coalesce(criteria, F.lit(""))))) >= MIN_TEXT


def cleaned(needs: DataFrame) -> DataFrame:
    return needs.withColumn("description", markup.html_to_text(F.col("description"))).withColumn("criteria", markup.html_to_text(F.col("criteria")))


def listing(needs: DataFrame, states: DataFrame, companies: DataFrame) -> DataFrame:
    """Needs with the labels of their state and company; a missing one gives an empty label."""
    joined = needs.join(broadcast_if_small(states), "state_id", "left").join(broadcast_if_small(companies), "company_id", "left")
    return joined.withColumn("state", F.coalesce("state", F.lit(""))).withColumn("company", F.coalesce("company", F.lit("")))


def page(needs: DataFrame, query: str, limit: int, offset: int, *, fields: list[str], newest: str, key: str) -> DataFrame:
    """Newest-first page of the needs whose fields contain all words of the query."""
    text = F.concat_ws(" ", *fields)
    rows = needs.filter(tx.all_words_in(text, query)) if query.strip() else needs
    return rows.orderBy(F.col(newest).desc(), F.col(key).desc()).offset(max(0, offset)).limit(max(1, min(limit, MAX_PAGE)))


def mark_imported(needs: DataFrame, imported: DataFrame, keys: list[str]) -> DataFrame:
    return needs.join(imported.select(*keys, "mission_id"), keys, "left")


def import_status(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """created, updated or unchanged, by key and content hash; only the first two need a write."""
    s = stored.select(*keys, F.col("content_hash").alias("_stored"))
    status = F.when(F.col("_stored").isNull(), "created").when(F.col("_stored") == F.col("content_hash"), "unchanged").otherwise("updated")
    return incoming.join(s, keys, "left").withColumn("status", status).drop("_stored")
