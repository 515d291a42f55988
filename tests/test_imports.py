from __future__ import annotations

import random
import re

import pytest

from palate.operators import imports as I

NOW = "2024-05-01 12:00:00"
PATTERNS = {"film": "^tt[0-9]+$", "page": "^Q[1-9][0-9]*$"}


def one_by_one(things, held):
    """Every call in turn, every row in turn."""
    items, links, thumbs, used = set(held["items"]), dict(held["links"]), dict(held["thumbs"]), dict(held["used"])
    by_link = {v: k for k, v in links.items()}
    counts, new_names, new_links, new_thumbs = {}, {}, {}, {}
    for call in sorted({t[0] for t in things}):
        rows = sorted((t for t in things if t[0] == call), key=lambda t: t[3])
        user, service = rows[0][1:3]
        if user in held["locked"] or service == "nowhere" or len(rows) > held["chunk"] or (user, service) in held["closed"]:
            counts[call] = None
            continue
        seen, valid = set(), []
        for _, _, _, _, name, folded, source, ref, value in rows:
            fine = source in PATTERNS and re.match(PATTERNS[source], ref) and value in ("1", "-1") and name == name.strip().lower() and name
            if fine and len(folded) <= 128 and name not in held["removed"] and (source, ref) not in held["gone"] and (source, ref) not in seen:
                seen.add((source, ref))
                valid.append((name, folded, (source, ref), int(value)))
        before = used.get((user, service), 0)
        taken = valid[: max(0, held["limit"] - before)]
        for name, folded, link, _ in taken:
            if link not in by_link:
                if name not in items:
                    items.add(name)
                    new_names[name] = (folded, user)
                if name not in links:
                    links[name], by_link[link] = link, name
                    new_links[name] = (link, user)
        found = [(by_link[link], value) for _, _, link, value in taken if link in by_link]
        saved = 0
        for item, value in found:
            if (user, item) not in thumbs:
                thumbs[user, item] = new_thumbs[user, item] = value
                saved += 1
        used[user, service] = before + saved
        over = len(valid) - len(taken)
        counts[call] = (saved, len(found) - saved, len(rows) - len(found) - over, over, held["limit"] - before - saved)
    return counts, new_names, new_links, new_thumbs


def run(spark, things, held):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    users = sorted({t[1] for t in things})
    imports = [(u, s, "2024-05-01 06:00:00", n) for (u, s), n in held["used"].items()] + [(u, s, "2024-04-28 06:00:00", 3) for u, s in held["closed"]]
    known = I.Store(
        items=frame([(x,) for x in held["items"]], "id string"), links=frame([(k, *v) for k, v in held["links"].items()], "item_id string, source string, ref string"),
        thumbs=frame([(u, i, "", v) for (u, i), v in held["thumbs"].items()], "user_id string, item_id string, tag string, value int"),
        imports=frame(imports, "user_id string, service string, started_at string, thumbs int").selectExpr("user_id", "service", "cast(started_at AS timestamp) AS started_at", "thumbs"),
        removed=frame([(x,) for x in held["removed"]], "id string"), removed_refs=frame(list(held["gone"]), "source string, ref string"),
        patterns=frame(list(PATTERNS.items()), "source string, pattern string"), services=frame([("a",), ("b",)], "service string"),
        unlocked=frame([(u,) for u in users if u not in held["locked"]], "user_id string"),
    )
    schema = "call long, user_id string, service string, ord long, id string, search_id string, source string, ref string, value string"
    out = I.import_thumbs(frame(things, schema), known, NOW, held["limit"], held["chunk"])
    counts = {r.call: (r.saved, r.kept, r.refused, r.over, r.left) if r.status == "done" else None for r in out.counts.collect()}
    names = {r.id: (r.search_id, r.created_by) for r in out.names.collect()}
    links = {r.item_id: ((r.source, r.ref), r.created_by) for r in out.links.collect()}
    return counts, names, links, {(r.user_id, r.item_id): r.value for r in out.thumbs.collect()}


def nothing(**more):
    return {"items": [], "links": {}, "thumbs": {}, "used": {}, "closed": [], "locked": [], "removed": [], "gone": set(), "limit": 100, "chunk": 50} | more


def test_one_free_name_for_two_rows(spark):
    things = [(1, "u", "a", k, "dune", "dune", "film", ref, "1") for k, ref in ((1, "tt1"), (2, "tt2"))]
    counts, names, links, thumbs = run(spark, things, nothing())
    assert counts == {1: (1, 0, 1, 0, 99)} and names == {"dune": ("dune", "u")} and links == {"dune": (("film", "tt1"), "u")} and thumbs == {("u", "dune"): 1}


def test_what_a_refused_pair_leaves_is_free(spark):
    """A chain: the second pair loses its name to the first, so the third gets the link, and the fourth loses it."""
    things = [(1, "u", "a", 1, "n1", "n1", "film", "tt1", "1"), (2, "v", "a", 1, "n1", "n1", "film", "tt2", "1")]
    things += [(3, "w", "a", 1, "n2", "n2", "film", "tt2", "-1"), (4, "x", "a", 1, "n3", "n3", "film", "tt2", "1")]
    counts, _, links, thumbs = run(spark, things, nothing())
    assert links == {"n1": (("film", "tt1"), "u"), "n2": (("film", "tt2"), "w")}
    assert counts == {1: (1, 0, 0, 0, 99), 2: (0, 0, 1, 0, 100), 3: (1, 0, 0, 0, 99), 4: (1, 0, 0, 0, 99)}
    assert thumbs == {("u", "n1"): 1, ("w", "n2"): -1, ("x", "n2"): 1}  # the fourth's goes on what holds the link by then


@pytest.mark.parametrize("seed", range(3))
def test_against_one_call_after_the_other(spark, seed):
    rng = random.Random(seed)
    name = lambda: rng.choice(["n", "m", "o"]) + str(rng.randrange(7)) + rng.choice(["", "", "", " "])
    things = []
    for call in range(14):
        user, service = f"u{call // 2}", rng.choice("ab") if call % 2 == 0 else None
        service = service or ("b" if things[-1][2] == "a" else "a")
        if call == 9:
            service = "nowhere"
        for k in range(rng.randrange(1, 13)):
            source = rng.choice(["film", "page", "film", "other"])
            ref = rng.choice([f"tt{rng.randrange(8)}", f"Q{rng.randrange(1, 6)}", "tt3"])
            things.append((call, user, service, k, name(), "f" * rng.choice([3, 3, 3, 200]), source, ref, rng.choice(["1", "-1", "1", "2"])))
    held = nothing(
        items=["n1", "n2", "m3"], links={"n1": ("film", "tt1"), "n2": ("page", "Q2")}, thumbs={("u0", "n1"): -1, ("u3", "n2"): 1}, removed=["o4"], gone={("film", "tt5")},
        used={("u1", "a"): 8, ("u1", "b"): 10, ("u2", "a"): 9}, closed=[("u4", "a")], locked=["u5"], limit=10, chunk=11,
    )
    assert run(spark, things, held) == one_by_one(things, held)


def test_nothing_at_all(spark):
    assert run(spark, [], nothing()) == ({}, {}, {}, {})


def test_things_are_dealt_by_call_once_and_not_by_name(spark):
    things = spark.createDataFrame([(1, "u", "s", 1, "a", "a", "x", "1", "1")], "call long, user_id string, service string, ord long, id string, search_id string, source string, ref string, value string")
    empty = lambda schema: spark.createDataFrame([], schema)
    known = I.Store(*[None] * 4, removed=empty("id string"), removed_refs=empty("source string, ref string"), patterns=spark.createDataFrame([("x", "^1$")], "source string, pattern string"), services=None, unlocked=None)
    found = I._valid(things, known, spark.createDataFrame([(1, 0)], "call long, used long"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and [r.id for r in found.collect()] == ["a"]
