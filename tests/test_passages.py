"""Places of passages in texts, verified claims, and entries suggested without all pairs of a popular tag."""

import random

from proofgrid.operators import claims as cl
from proofgrid.operators import governance as gv
from proofgrid.operators import mentions as mn
from proofgrid.operators import passages as ps
from proofgrid.operators.scale import parameter_table
from proofgrid.plans.evidence_queries import KAFKA

TODAY = "2026-10-08"


def places(text, passage):
    return [i + 1 for i in range(len(text) - len(passage) + 1) if text.startswith(passage, i)]


def test_every_place_of_every_passage(spark):
    """Random texts of few letters, so that passages repeat and overlap; lengths from too short to several pieces."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é") for _ in range(rng.choice([0, 5, 12, 300, 1500]))) for _ in range(30)]
    texts += [None, "a" * 700, texts[-1], "𝄞" * 40 + "fin du texte"]
    passages = [t[a : a + n] for t in texts if t for n in (11, 12, 13, 40, 201, 450) for a in [rng.randrange(len(t))]] + ["a" * 12, "a" * 401, None, "", "nulle part ici", "𝄞" * 12 + "f"[:0]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    p = spark.createDataFrame(list(enumerate(passages)), "pid int, passage string")
    got = {(r.doc_id, r.pid, r["at"]) for r in ps.occurrences(p, d, "pid", "passage", ["doc_id"], "text").collect()}
    want = {(i, j, at) for i, t in enumerate(texts) if t for j, q in enumerate(passages) if q and len(q) >= ps.SHORTEST for at in places(t, q)}
    assert got == want and len(want) > 1000


def test_scopes_ids_and_clashing_names(spark):
    d = spark.createDataFrame([(1, None, "un passage de test ici"), (2, "m", "un passage de test ici"), (None, "m", "un passage de test ici")], "_pid bigint, key string, piece string")
    p = spark.createDataFrame([("x", "m", "passage de test"), ("x", "n", "passage de test"), ("y", None, "passage de test")], "place string, key string, slice string")
    got = {tuple(r) for r in ps.occurrences(p, d, "place", "slice", ["_pid"], "piece", ["key"]).collect()}
    assert got == {(2, "x", 4), (None, "x", 4)}
    assert ps.occurrences(p.limit(0), d, "place", "slice", ["_pid"], "piece").count() == 0 and ps.occurrences(p, d.limit(0), "place", "slice", ["_pid"], "piece").count() == 0


def test_quotes_beyond_any_literal_list(spark):
    """6,000 short quotes: one plan, and the texts are in no exchange."""
    d = spark.range(300).selectExpr("id AS doc_id", "concat('debut ', sha2(cast(id AS string), 256), ' fin\n', sha2(cast(id + 1000 AS string), 256)) AS text")
    q = spark.range(6000).selectExpr("id AS qid", "substring(sha2(cast(id AS string), 256), 3, 13) AS quote")
    found = cl.quotes_in_corpus(q, d, "qid", "quote")
    got = {tuple(r) for r in found.collect()}
    assert got == {(i, i) for i in range(300)} | {(i, i + 1000) for i in range(300)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "_t" not in [c for line in plan.splitlines() if "Exchange" in line for c in line.replace("#", " ").split()]


def test_claims_get_the_level_of_their_lines(spark):
    text = "Profil\n- Mise en place d'un cluster Kafka avec 3 topics,\t2 partitions et 4 brokers.\n- Utilisation de Kafka.\nLecture et voyages au long cours"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    claims = [
        (1, 1, "kafka", "mise en  place d'un CLUSTER kafka avec 3 topics, 2 partitions", 4), (2, 1, "kafka", "avec 3 topics, 2 partitions et 4", 3),
        (3, 1, "kafka", "Utilisation de Kafka", 4), (4, 1, "kafka", "Lecture et voyages", 4), (5, 1, "kafka", "Utilisation de Redis", 4), (6, 1, "kafka", None, 4),
        (7, 1, "kafka", "de Kafka", 4), (8, 2, "kafka", "Utilisation de Kafka", 4), (9, 9, "kafka", "Utilisation de Kafka", 4), (10, 1, "redis", "Utilisation de Kafka", 4),
        (11, 3, "kafka", "Utilisation de Kafka", 4),
    ]
    c = spark.createDataFrame(claims, "claim_id int, doc_id int, skill_key string, quote string, asserted_ord int")
    out = {r.claim_id: (r.status, r.level_ord, r.start) for r in cl.verify(c, docs, parameter_table(spark, [KAFKA], mn.LEXICON_SCHEMA), TODAY).collect()}
    assert out[1] == ("verified", 4, text.index("Mise")) and out[2][:2] == ("verified", 3) and out[3][:2] == ("verified", 2)
    assert len(out) == 11 and all(out[i][0] == "downgraded" and out[i][1] is None for i in range(4, 12))


def suggested(spark, missions, skills, entries, k):
    got = gv.suggestions(
        spark.createDataFrame(missions, "mission_id int, family string"), spark.createDataFrame(skills, "mission_id int, skill string"),
        spark.createDataFrame(entries, "entry_id int, family string, tags array<string>, origin int"), k,
    )
    return {(r.mission_id, r.rn): (r.entry_id, r.relevance) for r in got.collect()}


def best_entries(missions, skills, entries, k):
    want = {}
    for m, f in missions:
        mine = {s for mm, s in skills if mm == m and s is not None}
        scored = sorted((-(2 * (f is not None and f == ef) + len(mine & set(tags or []))), e) for e, ef, tags, o in entries if o != m)
        want |= {(m, i + 1): (e, -s) for i, (s, e) in enumerate([x for x in scored if x[0] < 0][:k])}
    return want


def test_suggestions_with_many_shared_tags(spark):
    """Long tag lists with popular tags: entries that share three and more decide, and are read by their rarest tags."""
    rng = random.Random(8)
    tag = lambda: "t" + str(min(int(rng.expovariate(0.25)), 30))
    entries = [(i, rng.choice(["a", "b", None]), [tag() for _ in range(rng.randrange(7))] if rng.random() > 0.05 else None, rng.choice([None, *range(12)])) for i in range(400)]
    missions = [(m, rng.choice(["a", "b", "z", None])) for m in range(40)]
    skills = [(m, tag()) for m in range(39) for _ in range(rng.randrange(8))] + [(3, None), (99, "t1")]
    for k in (1, 8):
        assert suggested(spark, missions, skills, entries, k) == best_entries(missions, skills, entries, k)


def test_suggestions_of_one_owner_and_of_nothing(spark):
    entries = [(i, "a", ["x"], 1) for i in range(30)] + [(100, "b", ["x"], 2), (101, "a", [], None)]
    missions, skills = [(1, "a"), (2, "a"), (3, None)], [(1, "x"), (2, "x"), (3, "x")]
    assert suggested(spark, missions, skills, entries, 3) == best_entries(missions, skills, entries, 3)
    assert suggested(spark, [], [], entries, 3) == {} and suggested(spark, missions, skills, [], 3) == {}


def test_a_gram_that_only_other_scopes_search_stays_with_its_text(spark, monkeypatch):
    """All texts are alike, each scope searches another part of them: without the scope every gram of every text would leave."""
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(4000))
    d = spark.createDataFrame([(i, f"m{i}", text) for i in range(100)], "doc_id int, scope string, text string")
    p = spark.createDataFrame([(i, f"m{i}", text[40 * i : 40 * i + 40]) for i in range(100)], "pid int, scope string, passage string")
    left, grams = [], ps.text_grams
    monkeypatch.setattr(ps, "text_grams", lambda *a, **k: left.append(grams(*a, **k)) or left[-1])
    got = {tuple(r) for r in ps.occurrences(p, d, "pid", "passage", ["doc_id"], "text", ["scope"]).collect()}
    assert got == {(i, i, 40 * i + 1) for i in range(100)}
    assert left[0].count() < 200
