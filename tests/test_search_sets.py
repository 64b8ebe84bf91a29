"""Groups of the three filters of a mission, and the reasons of changed criteria, on small tables."""

from proofgrid.functions import levels as lv
from proofgrid.operators import filters as fl
from proofgrid.operators import scoring as sc

REQ = "mission_id int, req_id string, label string, category string, rarity int, reason string, terms array<string>, advanced boolean, narrowers array<string>"
COMBO = "mission_id int, combo_id string, members array<string>, at_least int"


def sets(spark, reqs, titles, combos):
    ranked = fl.ranked_requirements(spark.createDataFrame(reqs, REQ))
    g = fl.search_sets(ranked, spark.createDataFrame(titles, "mission_id int, core array<string>, wide array<string>"), spark.createDataFrame(combos, COMBO))
    return {(r.mission_id, r.strategy, r.group_id): r for r in g.collect()}


def req(m, i, category, rarity=3, advanced=False, narrowers=None):
    return (m, i, i, category, rarity, None, [i, i + "2", i + "3"], advanced, narrowers)


def test_members_of_a_combination_are_not_imposed_one_by_one(spark):
    reqs = [req(1, "a", lv.ELIMINATORY, 5), req(1, "b", lv.IMPERATIVE), req(1, "c", lv.IMPERATIVE), req(1, "d", lv.DIFFERENTIATING)]
    g = sets(spark, reqs, [(1, ["chef", "chef", "lead"], ["x"])], [(1, "k", ["b", "c", "zz", None], 2)])
    assert g[1, "exploratory", "union"].terms == ["a", "d", "b", "b2", "c"]
    assert g[1, "balanced", "union:k"].terms == ["b", "b2", "c", "c2"] and (1, "balanced", "b") not in g
    assert g[1, "balanced", "a"].terms == ["a", "a2", "a3"] and g[1, "balanced", "d"].terms == ["d", "d2"]
    assert (1, "strict", "b") not in g and g[1, "strict", "k"].members == [["b", "b2"], ["c", "c2"]] and g[1, "strict", "k"].at_least == 2
    assert g[1, "strict", "title"].terms == ["chef", "lead"] and g[1, "exploratory", "title"].terms == ["chef", "lead", "x"]


def test_narrower_groups_take_places_of_the_strict_filter(spark):
    reqs = [req(1, f"i{n}", lv.IMPERATIVE, 1 + n % 5, n == 4, ["deep", "deeper", "deepest", "more"]) for n in range(7)] + [req(1, "e", lv.ELIMINATORY, 1, None, ["no"])]
    g = {k[2]: r for k, r in sets(spark, reqs, [(1, None, None)], []).items() if k[1] == "strict"}
    assert set(g) == {"e", "i4", "narrow:i4", "i3", "i2"} and g["narrow:i4"].terms == ["deep", "deeper", "deepest"]
    assert [k for k, r in sorted(g.items(), key=lambda x: x[1].priority)] == ["e", "i4", "narrow:i4", "i3", "i2"]


def test_weak_requirements_fill_up_and_short_combinations_stay_out(spark):
    reqs = [req(1, "a", lv.DESIRED), req(1, "b", lv.DESIRED), req(1, "c", lv.DESIRED), req(2, "m", lv.IMPERATIVE), req(2, "w", lv.DESIRED), req(3, "s", lv.IMPERATIVE), req(3, "w", lv.DESIRED)]
    g = sets(spark, reqs, [(4, ["t"], None)], [(2, "k", ["m", "none"], 2), (5, "k", [], 1), (5, "n", None, 1)])
    assert {k[2] for k in g if k[:2] == (1, "balanced")} == {"a", "b", "c"} and not {k for k in g if k[:2] == (1, "strict")}
    assert (2, "strict", "k") not in g and {k[2] for k in g if k[:2] == (2, "balanced")} == {"union:k", "w"}
    assert {k[2] for k in g if k[:2] == (3, "balanced")} == {"s", "w"} and {k[1:] for k in g if k[0] == 4} == {(s, "title") for s in ("exploratory", "balanced", "strict")}
    assert sets(spark, [], [], []) == {}


def test_reasons_are_new_evidence_from_outside_the_document(spark):
    res = lambda rows: spark.createDataFrame(rows, "doc_id int, key string, level_ord int, points int")
    ev = lambda rows: spark.createDataFrame(rows, "doc_id int, key string, ord int, source string, excerpt string")
    old_ev = [(1, "a", 0, "cv", "x"), (1, "c", 0, "cv", "x")]
    new_ev = old_ev + [(1, "a", n, "appel", f"dit {n}") for n in (5, 3, 4, 9)] + [(1, "b", 1, "appel", "y"), (1, "c", 2, "appel", "z" * 201), (1, "c", 3, "appel", None), (1, "d", 1, "cv", "w")]
    d = sc.with_reasons(res([(1, "a", 4, 400), (1, "b", 2, 100), (1, "c", 3, 300), (1, "d", 2, 10), (1, "e", 1, 0)]), res([(1, "a", 2, 100), (1, "c", 3, 300), (1, "d", 2, 10), (1, "e", 1, 0)]), ev(new_ev), ev(old_ev))
    got = {r.key: (r.change, r.points_delta, r.because, r.truncated) for r in d.collect()}
    assert got == {
        "a": ("changed", 300, ["dit 3", "dit 4", "dit 5"], False), "b": ("new", 100, [], False), "c": ("changed", 0, ["z" * 200], True), "d": ("changed", 0, [], False),
    }

def test_a_requirement_listed_twice_counts_twice(spark):
    reqs = [req(1, "a", lv.IMPERATIVE), req(1, "b", lv.IMPERATIVE)]
    g = sets(spark, reqs, [], [(1, "k", ["a", "b", "b"], 2)])
    assert g[1, "strict", "k"].members == [["a", "a2"], ["b", "b2"], ["b", "b2"]]
