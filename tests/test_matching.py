from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from palate.operators import matching as M


def test_spellings_and_guesses(spark):
    rows = [("THE LORD OF THE RINGS",), ("Once Upon  A Time In The West",), ("Up",), ("Of Mice",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(M.spellings(F.col("t"))).collect()]
    assert got == [
        ["THE LORD OF THE RINGS", "The Lord Of The Rings", "The Lord of the Rings"],
        ["Once Upon A Time In The West", "Once Upon a Time in the West"], ["Up"], ["Of Mice"],
    ]
    one = spark.createDataFrame([("Up", 2009), ("Up", None)], "t string, y int").coalesce(1)
    got = [[g.title for g in r[0]] for r in one.select(M.film_guesses(F.col("t"), F.col("y"))).collect()]
    assert got == [["Up (2009 film)", "Up (film)", "Up (miniseries)", "Up (TV series)", "Up"], ["Up (film)", "Up (miniseries)", "Up (TV series)", "Up"]]
    book = spark.createDataFrame([("Moby-Dick; or, The Whale: a tale", "H.  Melville")], "t string, a string")
    got = book.select(M.book_guesses(F.col("t"), F.col("a"))).first()[0]
    assert got[0] == "Moby-Dick; or, The Whale: a tale (Melville novel)" and "Moby-Dick; or, The Whale (book)" in got and "Moby-Dick; (novel)" in got and len(got) == 12


def films(spark, rows, pages, facts):
    return {
        r.row: r.ref
        for r in M.pick_films(
            spark.createDataFrame(rows, "row int, title string, year int"), spark.createDataFrame(pages, "title string, ref string"),
            spark.createDataFrame(facts, "ref string, role string, first_year int"),
        ).collect()
    }


def test_films(spark):
    pages = [("A (2000 film)", "q1"), ("A (film)", "q2"), ("B", "q3"), ("B (film)", "q4"), ("C (TV series)", "q5"), ("D", "q6"), ("E (film)", "q7")]
    facts = [("q1", "film", 2000), ("q2", "film", 2000), ("q3", "film", 1990), ("q4", "film", 1991), ("q5", "series", 1999), ("q6", "album", 1980), ("q7", "film", None)]
    rows = [(1, "A", 2000), (2, "A", None), (3, "B", 1991), (4, "B", None), (5, "C", 2000), (6, "C", None), (7, "D", 1980), (8, "E", 1950), (9, "B", 1993)]
    # 1: the year in the title decides; 2: only q2 is guessed; 3: the nearest year; 4: two pages; 5, 6: a series needs years
    assert films(spark, rows, pages, facts) == {1: "q1", 2: "q2", 3: "q4", 5: "q5", 8: "q7"}
    assert films(spark, rows, [], []) == {} == films(spark, [], pages, facts)


def test_authors():
    assert set(M.author_keys("Gabriel García Márquez")) == set(M.author_keys("GABRIEL GARCIA-MARQUEZ"))
    assert set(M.author_keys("Kurt Vonnegut")) & set(M.author_keys("Kurt B. Vonnegut, Jr."))
    assert not set(M.author_keys("Ann Lee")) & set(M.author_keys("Bob Lee")) and M.author_keys(" . ") == []


def test_books_and_bare_titles(spark):
    rows = spark.createDataFrame([(1, "T", "Ann Lee"), (2, "U", "Ann Lee"), (3, "V", "Bob")], "row int, title string, author string")
    pages = spark.createDataFrame([("T (novel)", "a"), ("T", "b"), ("U (Lee novel)", "c"), ("U (book)", "d"), ("V", "e")], "title string, ref string")
    facts = [("a", "book", ["Ann B Lee"]), ("b", "essay", ["Ann Lee"]), ("c", "book", ["ann lee"]), ("d", "book", ["Ann Lee"]), ("e", "film", ["Bob"])]
    got = M.pick_books(rows, pages, spark.createDataFrame(facts, "ref string, role string, authors array<string>"))
    assert {r.row: r.ref for r in got.collect()} == {1: "a"}
    labels = [("X", "a", False, True), ("Y", "b", False, True), ("Y", "c", True, True), ("Z", "d", True, False), ("W", "e", True, True), ("W", "f", True, True)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate("XYZW")], "row int, title string")
    got = M.pick_titles(rows, spark.createDataFrame(labels, "title string, ref string, listed boolean, rateable boolean"))
    assert {r.row: r.ref for r in got.collect()} == {0: "a", 1: "c"}


@pytest.mark.parametrize("centre", [(10.0, 20.0), (89.9995, 0.0), (-60.0, 179.999), (-89.9996, -179.999)])
def test_places_equal_brute_force(spark, centre):
    rng = random.Random(str(centre))
    wide = 0.004 / max(math.cos(math.radians(centre[0])), 1e-3)
    at = lambda: (max(-90.0, min(90.0, centre[0] + rng.uniform(-0.004, 0.004))), (centre[1] + rng.uniform(-wide, wide) + 540) % 360 - 180)
    names = ["The Red Inn", "Red Inn", "Inn, Red!", "Red", "Blue Inn", "Red Inn Bar"]
    places = [(k, rng.choice(names), *at()) for k in range(60)]
    rows = [(k, rng.choice(names), *at()) for k in range(60)]

    def apart(a, b):
        lat, lon, lat2, lon2 = map(math.radians, (*a, *b))
        return 2 * M.EARTH * math.asin(math.sqrt(math.sin((lat2 - lat) / 2) ** 2 + math.cos(lat) * math.cos(lat2) * math.sin((lon2 - lon) / 2) ** 2))

    def words(name):
        found = [w for w in "".join(" " if c in ",!" else c for c in name.lower()).split()]
        return found[1:] if found[0] == "the" else found

    want = {}
    for k, name, *here in rows:
        near = [(apart(here, p[2:]), p[0], p[1]) for p in places if apart(here, p[2:]) <= M.REACH_METRES]
        plain = lambda n: set(words(n)) | ({w for w in n.lower().split()} - {"the"} if any(c in n for c in ",!") else set())
        same = sorted((a, ref) for a, ref, n in near if plain(n) == plain(name))
        leads = [ref for _, ref, n in near if len(words(n)) < len(words(name)) and words(name)[: len(words(n))] == words(n)]
        if same or len(leads) == 1:
            want[k] = same[0][1] if same else leads[0]
    schema = "string, lat double, lon double"
    got = M.pick_places(spark.createDataFrame(rows, f"row int, name {schema}"), spark.createDataFrame(places, f"ref int, name {schema}"))
    assert {r.row: r.ref for r in got.collect()} == want and want


def test_dense_places_answer_from_finer_cells_and_no_row_meets_them_all(spark, monkeypatch):
    rng = random.Random(5)
    at = lambda: (60 + rng.uniform(-0.001, 0.001), 179.9995 + rng.uniform(-0.001, 0.001))
    spot = lambda lat, lon: (lat, (lon + 180) % 360 - 180)
    names = ["The Red Inn", "Red Inn", "Red", "Blue Inn", "Red Inn Bar"]
    places = [(k, rng.choice(names), *spot(*at())) for k in range(800)] + [(k, "Green", 60.0, 179.9995) for k in (901, 900)] + [(902, "Old", 60.0, 179.9995)]
    rows = [(k, rng.choice(names), *spot(*at())) for k in range(400)] + [(500, "Green Inn", 60.0, 179.9995), (501, "Old Inn", 60.0, 179.9995), (502, "Red Inn", 60.002, 179.9995), (None, "Red", 60.0, 179.9995)]
    schema = "string, lat double, lon double"
    frames = spark.createDataFrame(rows, f"row int, name {schema}"), spark.createDataFrame(places, f"ref int, name {schema}")
    met, within = [], M._within
    monkeypatch.setattr(M, "_within", lambda *a: met.append(x := within(*a)) or x)
    monkeypatch.setattr(M, "FINEST", 0)
    want = {r.row: r.ref for r in M.pick_places(*frames).collect()}
    once = met.pop().count()
    monkeypatch.setattr(M, "FINEST", 8)
    assert {r.row: r.ref for r in M.pick_places(*frames).collect()} == want and {501, 502, None} < set(want) and 500 not in want
    assert len(met) > 2 and sum(x.count() for x in met) < once / 4


def test_catalog(spark):
    candidates = [(1, 1, "w", "q1", ["a"]), (1, 2, "w", "q2", ["b", "c"]), (1, 3, "w", "q3", ["d"]), (1, 4, "w", "q4", ["b"]), (1, 5, "w", "q5", ["d"]), (2, 1, "w", "q5", [])]
    found = M.classify(
        spark.createDataFrame(candidates, "search int, pos int, source string, ref string, names array<string>"),
        spark.createDataFrame([("b",), ("d",), ("z",)], "id string"), spark.createDataFrame([("z", "w", "q1"), ("b", "w", "q9")], "item_id string, source string, ref string"),
    )
    assert sorted((r.search, r.pos, r.item_id, r.kind) for r in found.collect()) == [(1, 1, "z", "existing"), (1, 2, "c", "free"), (1, 3, "d", "plain")]
    moves = spark.createDataFrame([(1, "a b", "A b"), (2, "A b", "Ab"), (2, "c", "Ab")], "step int, title string, target string")
    asked, pages = spark.createDataFrame([("a b",), ("c",), ("d",)], "title string"), spark.createDataFrame([("Ab", 1), ("d", 2)], "title string, ref int")
    assert {r.title: r.ref for r in M.resolved(asked, moves, pages).collect()} == {"a b": 1, "c": 1, "d": 2}


def test_what_stands_beside_candidates_comes_along(spark):
    candidates = spark.createDataFrame(
        [("s", 1, "w", "q1", ["a"], 5), ("s", 2, "w", "q2", ["b", "c"], 6), ("s", 3, "w", "q3", ["c"], 7), ("s", 4, "w", "q4", [], 8)],
        "search string, pos int, source string, ref string, names array<string>, stars int",
    )
    items, links = spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), spark.createDataFrame([("z", "w", "q1"), ("b", "w", "q9")], "item_id string, source string, ref string")
    found = M.classify(candidates, items, links, ("stars",))
    assert {tuple(r) for r in found.collect()} == {("s", 1, "z", "existing", 5), ("s", 2, "c", "plain", 6)}
    assert "posexplode" not in found._jdf.queryExecution().executedPlan().toString()  # names are looked at before, once each
