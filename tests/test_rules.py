"""Business rules on small frames: levels of phrases, dates, contact details, sources, sinks and streams."""

import datetime as dtm

import pytest
from pyspark.sql import functions as F

from proofgrid.functions import dates as dt
from proofgrid.functions import privacy, scope
from proofgrid.functions import text as tx
from proofgrid.operators import evidence as ev
from proofgrid.operators import governance as gv
from proofgrid.operators import mentions as mn
from proofgrid.operators import notes as nt
from proofgrid.operators import structure as st
from proofgrid.operators.scale import parameter_table
from proofgrid.plans.evidence_queries import KAFKA
from proofgrid.plans.lexicon import _skill
from proofgrid.sources import documents as src
from proofgrid.sources import needs_source as ns
from proofgrid.sources import sinks
from proofgrid.streaming import jobs
from proofgrid.streaming.runtime import file_stream

TODAY = "2026-10-08"
# phrase, lowest level, highest level
BANK = [
    ("- Sans expérience de Kafka, volonté d'apprendre.", 1, 1),
    ("- Kafka non utilisé directement sur ce périmètre.", 1, 1),
    ("- No prior experience with Kafka on topics and brokers.", 1, 1),
    ("- Projet personnel : mise en place de Kafka avec 3 topics et 2 brokers.", 2, 2),
    ("- Kafka administré par une autre équipe, suivi des topics.", 2, 2),
    ("- Audit des contrats Kafka et des coûts de licences.", 2, 2),
    ("- Support aux utilisateurs de Kafka.", 2, 2),
    ("- Assistance à la mise en place de Kafka : 3 topics, 4 partitions, 2 brokers.", 3, 3),
    ("- Développement Kafka avec topic et topics.", 2, 3),
    ("- Designed Kafka producers and consumers on 12 topics.", 4, 4),
    ("- Jamais de panne en production : exploitation de Kafka sur 6 brokers et 12 topics.", 3, 4),
]


def test_phrase_bank_stays_in_bounds(spark):
    rows = spark.createDataFrame([(i, p, p.index("Kafka"), "skill", "kafka") for i, (p, _, _) in enumerate(BANK)], "id int, item string, at int, kind string, skill_key string")
    rows = rows.join(ev.depth_patterns(parameter_table(spark, [KAFKA], mn.LEXICON_SCHEMA)), "skill_key")
    got = {r["id"]: r["level_ord"] for r in ev.analyse_mentions(rows, TODAY).collect()}
    wrong = [(BANK[i][0], got[i]) for i in got if not BANK[i][1] <= got[i] <= BANK[i][2]]
    assert not wrong


def test_fold_keeps_length_and_offsets(spark):
    t = "Été : e‑commerce, Œuvre ß ĲĞ fin İ"
    r = spark.createDataFrame([(t,)], "t string").select(tx.fold(F.col("t")).alias("f"), tx.matches(tx.fold(F.col("t")), "commerce").alias("m")).first()
    assert len(r.f) == len(t) and r.f.startswith("ete : e-commerce") and r.m[0].start == t.index("commerce")


def test_prefix_sums_over_many_pieces(spark):
    t = "\n".join("x" * (i % 7) for i in range(1500))
    got = spark.createDataFrame([(t,)], "t string").select(tx.pieces(F.col("t"), "\n").alias("p")).first().p
    assert len(got) == 1500 and all(t[p.start : p.end] == p.text for p in got)


def test_homonym_guards_and_case(spark):
    lex = parameter_table(spark, [_skill("unity", ["Unity"], needed=["baie"], forbidden=["jeu"]), _skill("san", ["SAN"], cs=["SAN"], after=["francisco"])], mn.LEXICON_SCHEMA)
    docs = spark.createDataFrame([(1, "Baie Unity en production"), (2, "Jeu en Unity, une baie"), (3, "Unity seul"), (4, "zoning SAN"), (5, "san marin, SAN  Francisco")], "doc_id int, text string")
    assert {(r.doc_id, r.skill_key) for r in mn.mentions(docs, lex).collect()} == {(1, "unity"), (4, "san")}


def test_a_lexicon_of_several_blocks_has_the_same_hits(spark, monkeypatch):
    lex = parameter_table(spark, [_skill("sb", ["Spring Boot"]), _skill("topic", ["topic"])], mn.LEXICON_SCHEMA)
    docs = spark.createDataFrame([(1, "spring-boot et SpringBoot, topics"), (2, "sp ring boot topic")], "doc_id int, text string")
    small = sorted(map(tuple, mn.mentions(docs, lex).collect()))
    monkeypatch.setattr(mn, "BLOCK_ROWS", 2)
    assert sorted(map(tuple, mn.mentions(docs, lex).collect())) == small and len(small) == 4


def test_a_hundred_thousand_aliases_without_moving_texts(spark):
    n = 100_000
    none = F.array().cast("array<string>")
    lex = spark.range(n).select(
        F.concat(F.lit("s"), F.col("id") % 5000).alias("skill_key"), F.concat(F.lit("terme "), F.col("id").cast("string")).alias("a"),
    ).groupBy("skill_key").agg(F.collect_list("a").alias("aliases"))
    for c in ("case_sensitive", "context_needed", "context_forbidden", "exclude_after"):
        lex = lex.withColumn(c, none)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("un terme-"), F.col("id") * 250, F.lit(" puis terme 7x et Terme "), F.col("id") * 250 + 1, F.lit(".")).alias("text"))
    hits = mn.raw_mentions(docs, lex)
    got = {(r.doc_id, r.skill_key, r.start) for r in hits.collect()}
    assert got == {(i, f"s{(i * 250 + d) % 5000}", at) for i in range(400) for d, at in ((0, 3), (1, len(f"un terme-{i * 250} puis terme 7x et ")))}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(doc_id" not in plan and plan.count("BroadcastHashJoin") >= 2


@pytest.mark.parametrize("line,start,end", [("Soc (03.2019 – 05.2021)", "2019-03", "2021-05"), ("Soc (2019/03 – 2021/05)", "2019-03", "2021-05"), ("Soc (mars 2019 – maintenant)", "2019-03", None), ("depuis sept. 2020", "2020-09", None)])
def test_date_ranges(spark, line, start, end):
    d = spark.createDataFrame([(1, "Expériences\n" + line + "\n- travail")], "doc_id int, text string")
    e = st.experiences(d, TODAY).first()
    assert (e.start, e.end, e.is_current) == (start, end, end is None)


@pytest.mark.parametrize("line", ["Débit de 2000 - 2010 messages", "Budget 1500 - 2000 euros", "Janvier 2030 – Décembre 2038"])
def test_quantities_and_implausible_years_open_nothing(spark, line):
    assert spark.createDataFrame([(line,)], "t string").select(dt.first_range(tx.fold(F.col("t")), TODAY).isNull()).first()[0]


def test_contact_details(spark):
    bad = ["a.b@exemple.invalid", "x [at] exemple [dot] invalid", "Tel +33 6 12 34 56 78", "06.12.34.56.78", "(+33)6 12 34 56 78", "github.com/xyz"]
    good = ["Débit de 40 000 messages par seconde", "Entre 2019 et 2023, puis 2024-2026", "Kafka 3.4.1 et Java 17.0.2", "Du 2019-03-12 au 2020-03-12"]
    d = spark.createDataFrame([(t, t in bad) for t in bad + good], "t string, bad boolean")
    assert all(r.hit == r.bad for r in d.select("bad", privacy.has_contact_details(F.col("t")).alias("hit")).collect())


def test_hostile_texts_are_quick(spark):
    texts = ["a@b" + ".c" * 20_000, "1 000" + " 000" * 5_000 + " messages par jour", "mot, " * 20_000, "1" * 16_000 + " messages par jour", " " * 40_000 + "Kafka", "Kafka " * 20_000, " " * 100_000]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    begin = dtm.datetime.now()
    d.select(scope.volume_per_day(F.col("t")), tx.normalize_text(F.col("t")), privacy.keyword_stuffing(F.col("t")), privacy.scrub(F.col("t")), tx.garbled(F.col("t")), tx.sentences(F.col("t")), scope.negated_regions(tx.fold(F.col("t")), scope.clauses(tx.fold(F.col("t"))))).collect()
    assert (dtm.datetime.now() - begin).total_seconds() < 30


def test_same_result_for_any_partitioning(spark, sf):
    from proofgrid.plans.lexicon import corpus_lexicon

    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    a = sorted(map(tuple, mn.mentions(d, corpus_lexicon(spark)).collect()))
    assert a == sorted(map(tuple, mn.mentions(d.repartition(7), corpus_lexicon(spark)).collect()))


def test_files_json_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("Texte accentué é ".encode("latin-1") * 30)
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "in" / "c.bin").write_bytes(b"\x00\x01")
    got = {r["name"]: (r["kind"], r["status"]) for r in src.admit(src.read_files(spark, str(tmp_path / "in"))).collect()}
    assert got == {"a.txt": ("txt", "queued"), "b.pdf": ("pdf", "queued"), "c.bin": ("unsupported", "failed")}
    (tmp_path / "needs.json").write_text('{"external_id":"1","title":"A"}\n{"external_id":"2","phone":"x"}\n')
    with pytest.raises(Exception, match="snapshot refused: unknown_field"):
        ns.read_snapshot(spark, str(tmp_path / "needs.json")).collect()
    assert [r["problem"] for r in ns.snapshot_rows(spark, str(tmp_path / "needs.json")).collect()] == [None, "unknown_field"]
    (tmp_path / "good.json").write_text('{"external_id":"1","title":"A"}\n{"external_id":"2"}\n')
    assert sorted(r["external_id"] for r in ns.read_snapshot(spark, str(tmp_path / "good.json")).collect()) == ["1", "2"]
    v = spark.createDataFrame([(1, 1, "x")], "mission_id int, version int, document string")
    sinks.append_versions(v, str(tmp_path / "v"), "mission_id")
    sinks.append_versions(v.withColumn("version", F.lit(2)), str(tmp_path / "v"), "mission_id")
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2
    sinks.write_text(v, str(tmp_path / "t"))
    sinks.write_json(v, str(tmp_path / "j"))
    sinks.publish_head(v, str(tmp_path / "h"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "x" and spark.read.json(str(tmp_path / "h")).count() == 1


KEY = "ab" * 32


def chain(spark, n, broken=()):
    import hashlib
    import hmac

    rows, prev = [], ""
    for i in range(n):
        payload = f'{{"i":{i}}}'
        h = hmac.new(bytes.fromhex(KEY), ('{"p":"' + prev + '","d":' + payload + "}").encode(), hashlib.sha256).hexdigest()
        rows.append(("main", i, payload + (" " if i in broken else ""), prev, h))
        prev = h
    return spark.createDataFrame(rows, "seg string, seq bigint, payload string, prev_hash string, hash string")


def test_hash_chain_matches_hmac_and_finds_tampering(spark):
    assert gv.verify_chain(chain(spark, 50), ["seg"], KEY).first()["broken_at"] is None
    assert gv.verify_chain(chain(spark, 50, {31, 40}), ["seg"], KEY).first()["broken_at"] == 31
    assert gv.broken_links(chain(spark, 50), ["seg"], KEY, width=8).count() == 0


def deliveries(df, folder, cuts, column):
    for lo, hi in zip(cuts, cuts[1:]):
        df.filter((F.col(column) >= lo) & (F.col(column) < hi)).coalesce(1).write.mode("append").parquet(folder)


def test_audit_stream_carries_its_head_over_batches(spark, tmp_path):
    for name, broken, want in (("ok", set(), None), ("bad", {20}, 20)):
        log = chain(spark, 60, broken)
        deliveries(log, str(tmp_path / name), [0, 20, 40, 60], "seq")
        r = jobs.audit_heads(file_stream(spark, str(tmp_path / name), log, files_per_batch=1), ["seg"], KEY, lambda b: b).first()
        assert (r["head_seq"], r["broken_at"]) == (59, want)


def test_evidence_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, (i * 37) % 50, nt.SUPPORTS if i % 4 else nt.LIMITS, 2 + i % 3, "explique_en_appel", "transcription", False, False, False, i) for i in range(60)]
    e = spark.createDataFrame(rows, "subject int, at int, kind string, level_ord int, reliability string, source string, auto_generated boolean, validated boolean, superseded boolean, n int")
    deliveries(e, str(tmp_path / "e"), [0, 25, 40, 60], "n")
    bucket = F.floor(F.col("at") / 10)
    batch = sorted(map(tuple, nt.evidence_effects(e, ["subject"], ["at", "n"]).collect()))
    stream = jobs.reevaluation(file_stream(spark, str(tmp_path / "e"), e, files_per_batch=1), ["subject"], ["at", "n"], bucket)
    assert sorted(map(tuple, stream.select("subject", "effect").collect())) == batch


def test_quotes_are_found_whatever_their_length_and_cut(spark):
    from proofgrid.operators.claims import quotes_in_corpus

    texts = ["Alpha beta gamma delta epsilon zeta eta theta iota kappa", "xalpha  beta gamma deltax", "interminablement\nlong mot", "rien ici du tout"]
    quotes = ["pha beta gamma del", "ALPHA beta gamma delta epsilon zeta eta theta", "interminable", "erminablement long", "epsilon zeta et", "gamma delta absent"]
    fold = lambda t: " ".join(t.lower().split())
    want = {(i, j) for i, t in enumerate(texts) for j, q in enumerate(quotes) if fold(q) in fold(t)}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    q = spark.createDataFrame(list(enumerate(quotes)), "qid int, quote string")
    assert {(r.doc_id, r.qid) for r in quotes_in_corpus(q, d, "qid", "quote").collect()} == want


def test_no_cut_beyond_the_old_limits(spark):
    from proofgrid.functions import levels as lv
    from proofgrid.operators import filters

    reqs = spark.createDataFrame([(1, f"r{i:03}", f"label {i}", lv.IMPERATIVE, 1, None) for i in range(60)], "mission_id int, req_id string, label string, category string, rarity int, reason string")
    ranked = filters.ranked_requirements(reqs)
    assert ranked.count() == 60 and ranked.agg(F.max("pos")).first()[0] == 60
    assert filters.strict_groups(ranked).filter("searched").count() == filters.MAX_STRICT_GROUPS
