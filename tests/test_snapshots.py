from __future__ import annotations

import json

from palate.operators import taste
from palate.sources import snapshots as Z


def test_round_trip_and_what_is_dropped(spark):
    thumbs = [("me", "a", "", 1), ("x", "a", "", -1), ("x", "b", "cozy", 1), ("far", "a", "", 1)]
    follows = [("me", "x"), ("me", "quiet")]
    texts = Z.write_snapshots(spark.createDataFrame(thumbs, "user_id string, item_id string, tag string, value int"), spark.createDataFrame(follows, "follower_id string, followed_id string"))
    whole = json.loads(texts.first().text)
    assert whole == {"users": ["me", "quiet", "x"], "follows": {"me": ["quiet", "x"]}, "ratings": {"me": {"a": 1}, "quiet": {}, "x": {"a": -1, "b\0cozy": 1}}}
    edges, back = Z.read_snapshots(texts)
    assert sorted((r.follower_id, r.followed_id) for r in edges.collect()) == [("me", "quiet"), ("me", "x")]
    assert sorted((r.user_id, r.item_id, r.tag, r.value) for r in back.collect()) == sorted(t for t in thumbs if t[0] != "far")
    kinds = {"one": 1, "less": -1, "one.": 1.0, "two": 2, "half": 1.5, "many": 300, "none": 0, "true": True, "word": "1", "minus": "-1", "yes": "yes", "null": None, "list": [1], "map": {"r": 1}}
    told = Z.read_snapshots(spark.createDataFrame([("v", json.dumps({"ratings": {"u": kinds}}))], "viewer string, text string"))[1]
    assert sorted((r.item_id, r.value) for r in told.collect()) == [("less", -1), ("one", 1), ("one.", 1)]
    odd = {"ratings": {"u": {"a": 1.0, "b": 2, "c": "x", "Not Folded": 1, "d\0": 1, "e\0t\0s": 1, "": 1, "f\0t": -1}}}
    found = Z.read_snapshots(spark.createDataFrame([("v", json.dumps(odd)), ("w", "{}"), ("n", "no json")], "viewer string, text string"))[1]
    assert sorted((r.item_id, r.tag, r.value) for r in found.collect()) == [("a", "", 1), ("f", "t", -1)]


def test_results(spark):
    thumbs = spark.createDataFrame([("me", "a", "", 1), ("x", "a", "", -1), ("x", "b", "cozy", 1)], "user_id string, item_id string, tag string, value int")
    fitted = taste.taste(thumbs, spark.createDataFrame([("me", "x")], "follower_id string, followed_id string"))
    told = json.loads(Z.write_results(fitted).first().text)
    assert told["viewer"] == "me" and set(told["scores"]) == {"a", "b", "b\0cozy"} and set(told["scores"]["a"]) == {"score", "confidence", "applies"}
    assert set(told["plot"]["things"]) == {"a", "b"} and set(told["plot"]["attributes"]) == {"", "cozy"} and len(told["plot"]["things"]["a"]) == 3


def test_ratings_are_put_together_before_they_go_to_readers(spark):
    thumbs = spark.createDataFrame([("x", "a", "", 1)], "user_id string, item_id string, tag string, value int")
    follows = spark.createDataFrame([("me", "x")], "follower_id string, followed_id string")
    plan = Z.write_snapshots(thumbs, follows)._jdf.queryExecution().optimizedPlan().toString()
    # the grouping of ratings lies below the join with their readers
    by_reader = [x for x in plan.splitlines() if "Aggregate [viewer" in x and "user_id" in x.split("]")[0]]
    assert "Aggregate [user_id" in plan and not [x for x in by_reader if "map_from_entries" in x]


def test_ratings_are_spelled_once_and_read_once(spark):
    edges = [(f"v{v:02d}", f"v{(v + k) % 60:02d}") for v in range(60) for k in range(1, 11)] + [("he \"said\" \\ x", "v01")]
    thumbs = [(f"v{v:02d}", f"thing {t}", tag, 1 if t % 2 else -1) for v in range(60) for t in range(3) for tag in ("", "cozy")]
    df = spark.createDataFrame(thumbs, "user_id string, item_id string, tag string, value int")
    texts = Z.write_snapshots(df, spark.createDataFrame(edges, "follower_id string, followed_id string"))
    for r in texts.collect():
        followed = sorted(b for a, b in edges if a == r.viewer)
        of = lambda u: {i + ("\0" + g if g else ""): v for w, i, g, v in thumbs if w == u}
        assert json.loads(r.text) == {"users": sorted([r.viewer, *followed]), "follows": {r.viewer: followed}, "ratings": {u: of(u) for u in [r.viewer, *followed]}}
    good = Z.read_snapshots(texts)[1]
    plan = good._jdf.queryExecution().executedPlan().toString()
    # texts are made once, and names do not travel to be looked at
    assert good.count() == 60 * 11 * 6 + 6 and "hashpartitioning(name" not in plan
