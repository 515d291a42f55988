from __future__ import annotations

import json
import re
from collections import Counter

import pytest

from palate.operators import opinions as O
from palate.plans import registry, relational
from palate.sources import snapshots as Z

THUMBS = [
    ("a", "x", "", 1), ("a", "x", "red", 1), ("b", "x", "red", -1), ("b", "y", "red", 1), ("c", "y", "", 1), ("v", "x", "", 1), ("v", "z", "", -1),
    ("v", "x", "red", 1), ("a", None, "", 1), ("v", None, "", 1), ("b", "y", None, 1), (None, "x", "", 1), (None, "x", "red", 1), (None, "q", "blue", 1), ("b", None, "red", 1),
]
FOLLOWS = [("v", "a"), ("v", "b"), ("v", "b"), ("w", "b"), ("w", "w"), ("c", "nobody"), ("w", None), (None, "a"), (None, "b"), ("u", "v"), ("u", "c")]


@pytest.fixture(params=[1 << 20, 1])
def frames(spark, monkeypatch, request):
    monkeypatch.setattr(O, "STATEMENTS_A_PIECE", request.param)
    return (
        spark.createDataFrame(THUMBS, "user_id string, item_id string, tag string, value int"),
        spark.createDataFrame(FOLLOWS, "follower_id string, followed_id string"),
    )


HEARD = [(f, *t) for f, g in FOLLOWS for t in THUMBS if g is not None and t[0] == g]
SAID = {(f, i, g) for f, _, i, g, _ in HEARD} | {(f, i, "") for f, _, i, _, _ in HEARD}


def test_attributes_heard_or_given(frames):
    named = {x for x in SAID | {t[:3] for t in THUMBS} if x[2]}
    assert Counter(tuple(r) for r in relational._attributes(*frames).collect()) == Counter(Counter(v for v, _, _ in named).items())


def test_candidates_of_everybody(frames):
    pairs = {x[:2] for x in SAID} | {t[:2] for t in THUMBS}
    assert Counter(tuple(r) for r in relational._candidates(*frames).collect()) == Counter(Counter(i for _, i in pairs).items())


def test_hidden_by_eye(frames):
    rated = {t[:2] for t in THUMBS if t[2] == "" and None not in t[:2]}
    listed = {x[:2] for x in SAID if x[2] == ""}
    want = {v: (sum(x[0] == v for x in listed), all(x in rated for x in listed if x[0] == v)) for v, _ in listed}
    got = [tuple(r) for r in relational._hidden_by_eye(*frames).collect()]
    assert {v: x for v, *x in got} == {v: list(x) for v, x in want.items()} and len(got) == len(want)


def test_strengths(frames):
    found = relational._strength(*frames).collect()
    assert {(r.viewer, r.item_id, r.tag) for r in found} == {x for x in SAID if x[2]} and all(0 < r.strength < 1 for r in found)


def test_result_texts_are_written_where_rows_lie(frames):
    scores = O.scored(O.opinions(*frames, near=True)).where("item_id IS NOT NULL AND tag IS NOT NULL").selectExpr("*", "'score' AS kind", "cast(null AS array<double>) AS point")
    whole = scores.where("pieces = 1")
    texts = Z.write_results(whole, "share", "piece").unionByName(Z.write_results(scores.where("pieces > 1")))
    got = {r.viewer: set(json.loads(r.text)["scores"]) for r in texts.collect()}
    said = {x for x in SAID if None not in x[1:]}
    assert got == {v: {i + ("\0" + g if g else "") for u, i, g in said if u == v} for v, _, _ in said}


@pytest.mark.parametrize("name", ["u01_candidates", "u02_attributes", "p24_hidden_by_eye", "attribute_strength", "s19_results"])
def test_what_is_heard_stays_with_its_share(spark, small, name):
    plan = registry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    sent = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert [x for x in sent if x.startswith("share")]
    assert not [x for x in sent if x.startswith("viewer") and "item_id" in x or x.startswith("item_id") and "share" in x]
