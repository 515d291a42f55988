from __future__ import annotations

from collections import Counter

from palate.operators import opinions as O

THUMBS = [
    ("a", "x", "", 1), ("a", "x", "", -1), ("a", "x", "red", 1), ("b", "x", "red", -1), ("b", "y", "red", 1), ("c", "y", "", 1),
    ("v", "x", "", 1), ("v", "z", "", -1), ("v", "x", "red", 1), ("a", None, "", 1), ("v", None, "", 1), ("b", "y", None, 1),
]
FOLLOWS = [("v", "a"), ("v", "b"), ("v", "b"), ("w", "b"), ("w", "w"), ("c", "nobody"), ("w", None)]


def frames(spark):
    return (
        spark.createDataFrame(THUMBS, "user_id string, item_id string, tag string, value int"),
        spark.createDataFrame(FOLLOWS, "follower_id string, followed_id string"),
    )


def by_hand():
    heard = [(f, *t[1:]) for f, g in FOLLOWS for t in THUMBS if t[0] == g]
    found = {(f, i, ""): [0, 0] for f, i, _, _ in heard}
    for f, i, g, v in heard:
        n = found.setdefault((f, i, g), [0, 0])
        n[0], n[1] = n[0] + 1, n[1] + v
    return found


def test_what_is_said_by_hand_with_nulls_repeated_edges_and_bare_attributes(spark):
    got = O.said(*frames(spark)).collect()
    assert {(r.viewer, r.item_id, r.tag): [r.n, r.s] for r in got} == by_hand() and len(got) == len(by_hand())
    assert all(r.m == r.s / (r.n + 2) for r in got)


def test_what_is_heard_is_never_shuffled_by_viewer(spark, monkeypatch):
    monkeypatch.setattr(O, "tasks", lambda rows: 4)
    thumbs, follows = frames(spark)
    plan = O.said(thumbs, follows)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(item_id" in plan and "hashpartitioning(viewer" not in plan


def test_viewers_who_follow_alike_share_what_they_hear(spark, monkeypatch):
    edges = [(f"v{v:03d}", f"v{(v + k) % 200:03d}") for v in range(200) for k in range(1, 21)]
    follows = spark.createDataFrame(edges, "follower_id string, followed_id string")
    thumbs = spark.createDataFrame([(f"v{v:03d}", f"t{v % 7}", "", 1) for v in range(200)], "user_id string, item_id string, tag string, value int")
    dealt = O.shares(follows)
    assert dealt.count() == 200 and dealt.select("share").distinct().count() < 40
    # a statement has twenty hearers and travels for a few shares
    assert O._packed(thumbs, follows, None, 4).count() < 200 * 5
    monkeypatch.setattr(O, "VIEWERS_A_SHARE", 2)
    assert O.shares(follows).groupBy("share").count().agg({"count": "max"}).first()[0] <= 8


def test_shares_dealt_by_viewer_or_thing_or_over_pieces_say_the_same(spark, monkeypatch):
    thumbs, follows = frames(spark)
    cells = lambda near: Counter((r.viewer, r.item_id, r.tag, r.n, r.s, r.m, r.heard, r.up, r.down) for r in O.opinions(thumbs, follows, thumbs, near).collect())
    want, shared = cells(False), [tuple(r) for r in O.agreement(thumbs, follows).collect()]
    assert cells(True) == want and shared == [("v", "a", 2, 0.5)]
    sizes = lambda: {tuple(r) for r in O.squared_size(thumbs, follows).collect()} | {tuple(r) for r in O.departures(thumbs, follows).collect()}
    whole = sizes()
    monkeypatch.setattr(O, "STATEMENTS_A_PIECE", 1)
    assert O.opinions(thumbs, follows, thumbs, near=True).agg({"pieces": "max"}).first()[0] > 1
    assert cells(True) == want and sizes() == whole and [tuple(r) for r in O.agreement(thumbs, follows).collect()] == shared


def test_what_a_viewer_hears_meets_without_a_shuffle_of_it(spark, monkeypatch):
    from palate.plans.relational import _strength_places

    thumbs, follows = frames(spark)
    places = lambda: Counter(tuple(r) for r in _strength_places(thumbs, follows).collect())
    whole = places()
    monkeypatch.setattr(O, "tasks", lambda rows: 4)
    plan = _strength_places(thumbs, follows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(tag") == 1 and "hashpartitioning(share" in plan  # the one is for shares of several pieces
    monkeypatch.setattr(O, "STATEMENTS_A_PIECE", 1)
    assert places() == whole


def test_own_statements_beside_what_is_heard(spark):
    thumbs, follows = frames(spark)
    got = O.opinions(thumbs, follows, thumbs).collect()
    said = by_hand()
    assert Counter((r.viewer, r.item_id, r.tag) for r in got if r.heard) == Counter(said.keys())
    own = Counter((u, i, g, v) for u, i, g, v in THUMBS)
    assert Counter({(r.viewer, r.item_id, r.tag, v): k for r in got for v, k in ((1, r.up), (-1, r.down)) if k}) == own
    meet = {(r.viewer, r.item_id, r.tag) for r in got if r.heard and r.up + r.down}
    assert meet == {k for k in said if None not in k and any(t[:3] == k for t in THUMBS)}


def test_departures_and_sizes_by_hand(spark):
    thumbs, follows = frames(spark)
    said = by_hand()
    m = lambda *k: said[k][1] / (said[k][0] + 2) if k in said and None not in k else 0
    cells = [(f, *t) for f, g in FOLLOWS for t in THUMBS if t[0] == g] + [(t[0], *t) for t in THUMBS if t[0] in {f for f, _ in FOLLOWS}]
    sums, sizes = {}, {}
    for f, u, i, g, v in cells:
        d = v - m(f, i, g)
        n = sums.setdefault((f, u), [0, 0.0])
        n[0], n[1] = n[0] + 1, n[1] + d
        n = sizes.setdefault(f, [0, 0.0])
        n[0], n[1] = n[0] + 1, n[1] + d * d
    assert {(r.viewer, r.who): (r.cells, r.departure) for r in O.departures(thumbs, follows).collect()} == {k: (n, round(d, 6)) for k, (n, d) in sums.items()}
    assert {r.viewer: (r.cells, r.size) for r in O.squared_size(thumbs, follows).collect()} == {k: (n, round(d, 6)) for k, (n, d) in sizes.items()}


def test_visible_thumbs_count_once_and_only_counts_travel(spark):
    thumbs, follows = frames(spark)
    edges = {(f, g) for f, g in FOLLOWS} | {(t[0], t[0]) for t in THUMBS}
    seen = {(f, *t[:3]) for f, g in edges for t in THUMBS if t[0] == g}
    assert {r.viewer: r.thumbs for r in O.visible(thumbs, follows).collect()} == Counter(s[0] for s in seen)


def test_purchases_are_dealt_into_parts_that_follow_their_number(spark, small, monkeypatch):
    line, orders, part = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("lineitem", "orders", "part"))
    want = Counter(tuple(r) for r in O.thumbs(line, orders, part).collect())
    monkeypatch.setattr(O, "LINES_A_TASK", line.count() // 40)
    found = O.thumbs(line, orders, part)
    assert found.rdd.getNumPartitions() >= 40 and Counter(tuple(r) for r in found.collect()) == want


def test_named_statements_are_counted_where_they_lie(spark):
    thumbs, follows = frames(spark)
    plan = O.visible(thumbs, follows)._jdf.queryExecution().executedPlan().toString()
    sent = [x for x in plan.split("\n") if "hashpartitioning(user_id" in x and "item_id" in x]
    assert sent and plan.count("hashpartitioning(user_id") > len(sent) and "NOT (coalesce(tag" in plan


def test_what_an_account_says_travels_in_few_rows_to_those_who_hear_it(spark, monkeypatch):
    thumbs = spark.createDataFrame([(f"v{v}", f"t{t}", tag, 1) for v in range(3) for t in range(40) for tag in ("", "red", None)], "user_id string, item_id string, tag string, value int")
    packed = thumbs.groupBy("user_id", "item_id").agg(O.F.array_agg(O.F.struct("tag", "value")).alias("says"))
    rows = lambda: Counter((r.user_id, t["item_id"], g, v) for r in O._told(packed).collect() for t in r.told for g, v in zip(t["tags"], t["values"], strict=True))
    want = Counter(tuple(r) for r in thumbs.collect())
    assert O._told(packed).count() == 3 and rows() == want
    monkeypatch.setattr(O, "THINGS_A_ROW", 8)
    assert O._told(packed).count() > 6 and rows() == want


def test_own_statements_are_not_sent_twice_and_say_the_same(spark, monkeypatch):
    thumbs, follows = frames(spark)
    thumbs = thumbs.union(spark.createDataFrame([(None, "x", "", 1), (None, "x", "red", -1)], thumbs.schema))
    cells = lambda own: Counter(tuple(r) for r in O.opinions(thumbs, follows, own, near=True).select("viewer", "item_id", "tag", "n", "s", "m", "heard", "up", "down").collect())
    followers = thumbs.join(follows.select(O.F.col("follower_id").alias("user_id")).distinct(), "user_id", "left_semi")
    pairs = [(O.Own(), followers), (O.Own(lambda t: t == "", True), thumbs.where("tag = ''")), (O.Own(lambda t: t != "", True), thumbs.where("tag <> ''")), (O.Own(None, True), thumbs)]
    for some, each in pairs:
        assert cells(some) == cells(each)
    monkeypatch.setattr(O, "STATEMENTS_A_PIECE", 1)
    for some, each in pairs[:2]:
        assert cells(some) == cells(each)
    plan = O.squared_size(thumbs, follows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_agg") + plan.count("collect_list(struct(tag") > 0 and "LeftSemi" not in plan
