from __future__ import annotations

import math

import numpy as np
import pytest

from palate.functions import text as X
from palate.operators import opinions as O
from palate.operators import search as S


@pytest.mark.parametrize(
    "raw, want",
    [("  Ｆｏｏ  BAR ", "foo bar"), ("The #1 hit", None), ("a" * 129, None), ("", None), ("brand#13", "brand#13"), ("pаy", None), ("日本go", "日本go"), ("!no", None)],
)
def test_names(raw, want):
    assert X.normalize_id(raw) == want


def test_folds():
    assert X.search_fold("crème-brûlée (hot) + $5") == "cremebrulee hot + $5"
    assert X.skeleton("рау") == "pay"
    assert X.parse_query("!@Big  #cozy ... x") == [
        {"text": "big", "raw": "!@Big", "low": True, "field": "name"},
        {"text": "cozy", "raw": "#cozy", "low": False, "field": "attribute"},
        {"text": "x", "raw": "x", "low": False, "field": None},
    ]
    assert X.initials("ada lovelace") == "AL"


def test_distance_and_tiers():
    assert X.prefix_distance("cozt", "cozy place", 1) == 1 and X.prefix_distance("ab", "ba", 1) == 1 and X.prefix_distance("abc", "xyz", 1) == 2
    assert X.match_term("cozy", "a cozy place") == ("exact", 1.0)
    assert X.match_term("co", "a cozy place") == ("prefix", 0.5)
    assert X.match_term("cozy", "cozy place", whole=True) == ("exact", 0.4)
    assert X.match_term("cpzy", "cozy") == ("typo", 0.75)
    assert X.match_term("abcd", "axbxcxd") == ("subsequence", 4 / 7)
    assert X.match_term("zzz", "abc") is None


ROW = {"folded": "blue anvil", "score": 0.2, "own": None, "tags": {"cozy": {"score": 0.6, "applies": 0.8}}}


def test_one_attribute_has_a_closed_form():
    found = S.score_row(X.parse_query("cozy"), ROW, {})
    assert found["strength"] == pytest.approx(math.sqrt(0.8 * 0.8)) and not found["named"]
    low = S.score_row(X.parse_query("!cozy"), ROW, {})
    assert low["strength"] == pytest.approx(math.sqrt((1 - 0.8) * 0.8))


def test_names_splits_and_nearness():
    found = S.score_row(X.parse_query("blue anvil"), ROW, {})
    assert found["named"] and found["strength"] == pytest.approx(0.6)
    part = S.score_row(X.parse_query("cozy zebra"), ROW, {})
    assert part["unmatched"] == ["zebra"]
    assert S.score_row(X.parse_query("zebra"), ROW, {}) is None
    near = S.score_row(X.parse_query("snug"), ROW, {"snug": [("cozy", 0.5)]})
    assert near and near["strength"] == pytest.approx(math.sqrt((0.5 + 0.5 * 0.3) * 0.6))


def test_search_frame(spark):
    rows = [("v", "blue anvil", 0.2, 3.0, None, {"cozy": (0.6, 0.8)}), ("v", "cozy inn", 0.9, 1.0, 1, {}), ("v", "rod", 0.1, 1.0, None, {})]
    df = spark.createDataFrame(rows, "viewer string, item_id string, score double, conf double, own int, tags map<string, struct<score: double, applies: double>>")
    got = S.search(df, "cozy").orderBy("place").collect()
    assert [r.item_id for r in got] == ["cozy inn", "blue anvil"]


def test_related_attributes_start_anywhere(spark):
    related = [("film noir", "dark", 0.5), ("éclair", "sweet", 0.6), ("cosy", "warm", 0.7), ("zebra", "dark", 0.9), ("noir", "loud", -0.8)]
    rows = [(v, f"{t} thing", 0.2, 1.0, None, {t: (0.6, 0.8)}) for v in ("v", "w") for t in ("dark", "sweet", "warm", "loud")]
    df = spark.createDataFrame(rows, "viewer string, item_id string, score double, conf double, own int, tags map<string, struct<score: double, applies: double>>")
    rel = spark.createDataFrame(related, "tag string, other string, rho double")
    near = {}
    for tag, other, rho in related:
        near.setdefault(tag, []).append((other, rho))
    for query in ("noir", "eclair", "dosy", "!noir", "@noir", "big film noir", "cosy eclair"):
        words = X.parse_query(query)
        want = {}
        for v, item, score, _, own, tags in rows:
            row = {"folded": item, "score": score, "own": own, "tags": {t: {"score": a, "applies": b} for t, (a, b) in tags.items()}}
            if found := S.score_row(words, row, near):
                want[v, item] = (found["strength"], found["unmatched"])
        got = {(r.viewer, r.item_id): (r.strength, r.unmatched) for r in S.search(df, query, rel).collect()}
        assert got == want, query
    assert {r.item_id for r in S.search(df, "eclair", rel).collect()} == {"sweet thing"}
    assert {r.item_id for r in S.search(df, "noir", rel).collect()} == {"dark thing"}


def test_registered_search_equals_brute_force(spark, small):
    from palate.plans import kernels, registry
    from palate.plans.relational import SQL
    from palate.sources.derived import run_sql, table

    assert not {"n08_one_word_search", "o02_search_list"} & set(registry.queries())
    rows: dict = {}
    for r in table(spark, small, "scores").collect():
        own = rows.setdefault((r.viewer, r.item_id), {"score": None, "own": None, "tags": {}, "conf": None})
        if r.tag == "":
            own.update(score=r.score, conf=r.conf)
        else:
            own["tags"][r.tag] = {"score": r.score, "applies": r.applies, "own": None}
    viewers = {v for v, _ in rows}
    for r in table(spark, small, "thumbs").collect():
        if r.user_id in viewers:
            own = rows.setdefault((r.user_id, r.item_id), {"score": None, "own": None, "tags": {}, "conf": None})
            if r.tag == "":
                own["own"] = r.value
            else:
                own["tags"][r.tag] = {"score": own["tags"].get(r.tag, {"score": None})["score"], "applies": 1.0, "own": r.value}
    near: dict = {}
    for r in sorted(run_sql(spark, small, SQL["w06_related_attributes"]).collect(), key=lambda r: (r.tag, -abs(r.rho), r.other)):
        near.setdefault(r.tag, []).append((r.other, r.rho))
    want = {}
    for query in kernels.ASKED:
        words, lists = X.parse_query(query), {}
        for (viewer, item), row in rows.items():
            if found := S.score_row(words, row | {"folded": X.fold_query(item)}, near):
                lists.setdefault(viewer, []).append((-found["strength"], row["conf"] is None, -(row["conf"] or 0), item, found))
        for viewer, found in lists.items():
            for place, (low, _, _, item, f) in enumerate(sorted(found, key=lambda x: x[:4]), 1):
                want[query, viewer, item] = (-low, f["named"], f["unmatched"], place)
    got = registry.queries()["n08_search_feed"](spark, small).collect()
    assert {(r.query, r.viewer, r.item_id): (r.strength, r.named, r.unmatched, r.place) for r in got} == want and len(got) == len(want)
    assert {q for q, *_ in want} == set(kernels.ASKED)


def test_own_thumbs_count():
    tags = {"cozy": {"score": None, "applies": 1.0, "own": -1}}
    assert S.score_row(X.parse_query("cozy"), ROW | {"tags": tags}, {})["strength"] < 1e-150
    tags["cozy"]["own"] = 1
    assert S.score_row(X.parse_query("cozy"), ROW | {"tags": tags}, {})["strength"] == pytest.approx(1.0)


def test_suggestions(spark):
    history = {"a": {"x", "y"}, "b": {"x"}, "c": {"z"}, "d": {"x", "z"}}
    assert S.suggest(history, set()) == ["x", "z", "y"]
    assert S.suggest(history, {"x"}) == ["z", "y"] or S.suggest(history, {"x"}) == ["y", "z"]
    assert S.suggest({}, set()) == []
    thumbs = [("u", i, t, 1) for i, tags in history.items() for t in ("", *tags)]
    got = S.suggestions(spark.createDataFrame(thumbs, "user_id string, item_id string, tag string, value int")).collect()
    assert {(r.item_id, r.tag) for r in got if r.place == 1} >= {("c", "x")}


def test_all_suggestions_equal_single_ones():
    rng = np.random.default_rng(5)
    for _ in range(60):
        carried = rng.random((rng.integers(0, 9), rng.integers(0, 7))) < rng.random()
        names = [f"t{k}" for k in range(carried.shape[1])]
        history = {f"i{i}": {n for n, c in zip(names, row, strict=True) if c} for i, row in enumerate(carried)}
        want = [S.suggest({j: h for j, h in history.items() if j != i}, mine) for i, mine in history.items()]
        assert [[names[k] for k in x] for x in S.suggest_all(carried, at_once=4)] == want


def test_registered_suggestions_equal_brute_force(spark, small):
    from palate.plans import registry
    from palate.sources.derived import table

    every: dict = {}
    for r in table(spark, small, "thumbs").collect():
        every.setdefault(r.user_id, {}).setdefault(r.item_id, set()).update({r.tag} - {""})
    want = set()
    for user, history in every.items():
        for item, mine in history.items():
            offered = S.suggest({j: h for j, h in history.items() if j != item}, mine)
            want |= {(user, item, k, t) for k, t in enumerate(offered, 1)}
    got = [tuple(r) for r in registry.queries()["n09_suggestions"](spark, small).collect()]
    assert set(got) == want and len(got) == len(want)


def test_lists_of_what_is_heard_are_those_of_the_joined_tables(spark):
    thumbs = [("a", "blue anvil", "", 1), ("a", "blue anvil", "cozy", 1), ("b", "blue anvil", "cozy", -1), ("b", "cozy room", "dark", 1), ("v", "blue anvil", "dark", 1), ("v", "own thing", "", -1), ("w", "cozy room", "", 1), ("x", "x thing", "", 1)]
    follows = [("v", "a"), ("v", "b"), ("w", "b"), ("x", "mute"), ("v", None)]
    df = spark.createDataFrame(thumbs, "user_id string, item_id string, tag string, value int")
    edges = spark.createDataFrame(follows, "follower_id string, followed_id string")
    related = spark.createDataFrame([("cozy", "dark", 0.6), ("warm", "cozy", 0.5), ("dark", "cozy", 0.4)], "tag string, other string, rho double")
    said = O.scored(O.opinions(df, edges, near=True)).selectExpr("viewer", "item_id", "tag", "conf", "score", "applies")
    asked = ["cozy", "warm", "#drak", "blue cozy anvil", "own"]
    rows = lambda found: sorted(map(repr, found.collect()))
    want = rows(S.search_each(S.entries(said, df), asked, related))
    heard = S.heard_entries(df, edges, asked, related)
    assert rows(S.search_each(heard, asked)) == want and want
    plan = heard._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(viewer" not in plan and "hashpartitioning(item_id" not in plan


def test_rows_with_the_same_related_attributes_share_them():
    import pyarrow as pa

    kind = pa.list_(pa.struct([("tag", pa.string()), ("other", pa.string()), ("rho", pa.float64())]))
    pair = lambda *x: dict(zip(("tag", "other", "rho"), x, strict=True))
    one, two = pair("a", "b", 0.2), pair("a", "c", -0.6)
    first, none, empty, last = S.near_pairs(pa.array([[one, two], None, [], [one, two]], kind))
    assert first == ((("a", "c", -0.6), ("a", "b", 0.2)), {"b", "c"}) and last is first and none == empty == ((), set())
