from __future__ import annotations

import gzip
import io
import json
import random
import zipfile

import pytest

from palate.sources import exports as X


def read_by_hand(text: str) -> list[list[str]]:
    """CSV one character at a time, by its rules."""
    rows, row, cell, inside, i = [], [], "", False, 1 if text[:1] == "﻿" else 0

    def end():
        nonlocal row, cell
        row.append(cell)
        if row != [""]:
            rows.append(row)
        row, cell = [], ""

    while i < len(text):
        c = text[i]
        if inside:
            if c == '"' and text[i + 1 : i + 2] == '"':
                cell, i = cell + '"', i + 1
            elif c == '"':
                inside = False
            else:
                cell += c
        elif c == '"' and not cell:
            inside = True
        elif c == ",":
            row.append(cell)
            cell = ""
        elif c in "\r\n":
            if c == "\n" or text[i + 1 : i + 2] != "\n":
                end()
        else:
            cell += c
        i += 1
    if cell or row:
        end()
    return rows


@pytest.mark.parametrize("seed", range(5))
def test_csv_equals_reading_by_hand(seed):
    rng = random.Random(seed)
    for _ in range(200):
        text = "".join(rng.choice('ab",,\r\n" é') for _ in range(rng.randrange(25)))
        if '""' in text:  # an empty quoted cell that goes on is read in two ways by readers at large
            continue
        assert X.csv_rows(text) == read_by_hand(text), text
    assert X.csv_rows('﻿a,"b ""c"", d"\r\n\r\n"x\ny",z') == [["a", 'b "c", d'], ["x\ny", "z"]]


def texts(spark, rows):
    return spark.createDataFrame([("e", *r) for r in rows], "export string, path string, text string")


def ratings(spark, reader, kind, *rows):
    """What ``reader`` finds in files of one kind."""
    known = X.recognised(texts(spark, rows).coalesce(1))
    assert {r["is"] for r in known.select("is").collect()} == {kind}
    found = reader(known if kind in ("google-maps", "spotify", "trakt") else X.cells(known).where("line > 0"))
    return sorted((r.ord, r.kind, r.title, r.author, r.ref, r.year, r.value) for r in found.collect())


def test_imdb_old_and_new(spark):
    text = "const,You rated,Title,Title Type,Year\ntt1,9,One,movie,1999\nnm2,9,x,movie,\ntt3,6,Mid,movie,\ntt4,8,Ep,TV Episode,2001\ntt5,0,No,movie,\ntt6,4, Low ,movie,19x"
    found = ratings(spark, X.read_imdb, "imdb", ("r.csv", text))
    want = [(1, "One", "tt1", 1999, 1), (3, "Mid", "tt3", None, 0), (4, "Ep", "tt4", 2001, 0), (6, "Low", "tt6", None, -1)]
    assert found == [(k, "imdb", title, None, ref, year, value) for k, title, ref, year, value in want]


def test_films_rated_and_liked(spark):
    head = "Date,Name,Year,Letterboxd URI"
    rated = f"{head},Rating\nd,A,2000,u1,3\nd,B,2001,u2,2\nd,C,,u3,3.5\nd,D,,u4,9\nd,,,u5,4"
    liked = f"{head}\nd,A,2000,u1\nd,B,2001,u2\nd,E,2002,u6"
    rows = [X.cells(texts(spark, [(p, t)]).coalesce(1)).where("line > 0") for p, t in (("ratings.csv", rated), ("likes/films.csv", liked))]
    assert [(r.title, r.value) for r in X.read_letterboxd(*rows).orderBy("ord").collect()] == [("A", 1), ("B", -1), ("C", 0), ("E", 1)]


def test_books(spark):
    text = "Book Id,Title,Author,My Rating,Exclusive Shelf\n1,\"The Problem (Past, #1)\",A.   B,5,read\n2,Own (2nd) ,C,3,read\n3,X,Y,0,read"
    assert [(r[2], r[3], r[6]) for r in ratings(spark, X.read_goodreads, "goodreads", ("g.csv", text))] == [("The Problem", "A. B", 1), ("Own (2nd)", "C", 0)]
    text = "Title,Authors,ISBN/UID,Star Rating\nT,\"A  B, C\",1,4.25\nU,D,2,\nV,E,3,5.5"
    assert [(r[2], r[3], r[6]) for r in ratings(spark, X.read_storygraph, "storygraph", ("s.csv", text))] == [("T", "A B", 1)]


def test_places_newest_first(spark):
    new = lambda name, lon, lat, stars, date: {"geometry": {"coordinates": [lon, lat]}, "properties": {"date": date, "five_star_rating_published": stars, "location": {"name": name}}}
    old = {"properties": {"Published": "2023", "Star Rating": "2", "Location": {"Business Name": "Old", "Geo Coordinates": {"Latitude": 1, "Longitude": "2"}}}}
    every = [new("A", 1, 2, 5, "2022"), old, new("B", 0, 0, 5, "2024"), new(" ", 1, 1, 5, "2024"), new("C", 1, 1, 9, "2024"), new(7, 1, 1, 5, "2024"), new("D", 3, 4, 3, "2024")]
    found = ratings(spark, X.read_maps, "google-maps", ("Maps/Reviews.json", json.dumps({"type": "FeatureCollection", "features": every})))
    assert [(r[2], r[6]) for r in found] == [("D", 0), ("Old", -1), ("A", 1)]


def test_music_and_pages(spark):
    uri = lambda kind: {"uri": f"spotify:{kind}:{'a1' * 11}"}
    library = {"tracks": [uri("track"), uri("album"), {}], "albums": [], "artists": [uri("artist")], "bannedTracks": [uri("track")], "shows": [uri("track")]}
    found = ratings(spark, X.read_spotify, "spotify", ("YourLibrary.json", json.dumps(library)))
    assert [(r[1], r[4], r[6]) for r in found] == [("track", "a1" * 11, 1), ("artist", "a1" * 11, 1), ("track", "a1" * 11, -1)]
    page = [
        {"rating": 8, "type": "movie", "movie": {"title": "M", "year": 2000, "ids": {"imdb": "tt7"}}},
        {"rating": 3, "type": "show", "show": {"title": " S ", "year": "x", "ids": {"imdb": "7"}}},
        {"rating": 9, "type": "episode", "episode": {}, "show": {"title": "S"}},
        {"rating": 7.5, "type": "movie", "movie": {"title": "N"}},
        {"rating": "7", "type": "movie", "movie": {"title": "N"}},
    ]
    found = ratings(spark, X.read_trakt, "trakt", ("ratings-movies.json", json.dumps(page)))
    assert [(r[1], r[2], r[4], r[5], r[6]) for r in found if r[6]] == [("imdb", "M", "tt7", 2000, 1), ("film", "S", None, None, -1)]


def test_what_an_export_is_read_as(spark):
    films = "Date,Name,Year,Letterboxd URI\nd,A,2000,u1"
    imdb = "Const,Your Rating,Title\ntt1,9,A"
    rows = [
        ("list", "w.csv", "Position,Const,Your Rating,Title\n1,tt1,,A"), ("broken", "x.json", "{not json"), ("names", "a/CONTENT_INTERACTION/x.csv", None),
        ("empty", "e.csv", ""), ("films", "watched.csv", films), ("likes", "likes/films.csv", films), ("likes", "r.csv", imdb), ("imdb", "r.csv", imdb),
    ]
    found, rated = X.read_exports(spark.createDataFrame(rows, "export string, path string, text string").coalesce(1))
    assert {r.export: r.source or r.refusal for r in found.collect()} == {
        "list": "imdb-list", "broken": "unreadable", "names": "netflix-without-ratings", "empty": "unreadable", "films": "letterboxd-list",
        "likes": "letterboxd", "imdb": "imdb",
    }
    assert sorted((r.export, r.source, r.value) for r in rated.collect()) == [("imdb", "imdb", 1), ("likes", "letterboxd", 1)]


def test_containers(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ratings.csv", "Const,Your Rating\n")
        z.writestr("other.txt", "x")
    rows = [("/a/x.zip", bytearray(raw.getvalue())), ("/a/y.gz", bytearray(gzip.compress(b"x"))), ("/a/z.csv", bytearray(b"a,b")), ("/a/bad.zip", bytearray(b"PKxx")), ("/a/e", None)]
    found = {(r.export, r.path): (r.text, r.refusal) for r in X.unpacked(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert found == {
        ("/a/x.zip", "ratings.csv"): ("Const,Your Rating\n", None), ("/a/x.zip", "other.txt"): (None, None), ("/a/y.gz", "y.gz"): (None, "unreadable"),
        ("/a/z.csv", "z.csv"): ("a,b", None), ("/a/bad.zip", "bad.zip"): (None, "unreadable"), ("/a/e", "e"): ("", None),
    }


def test_prefilled_files_and_their_first_fault(spark):
    accounts = texts(spark, [("accounts.csv", "handle,name\nanna,Anna\nbob,Bob\n9x,Nine\n")])
    files = texts(spark, [("p/anna.csv", "name,attribute,rating\n'=One,,YES\nTwo,Tag,no\n,,\n"), ("p/bob.csv", "name,attribute,rating\nA,,yes\nB,,maybe\na,,no\n")])
    rows, faults = X.prefilled(accounts, files)
    assert [(r.handle, r.item_id, r.tag, r.value, r.line) for r in rows.where("handle = 'anna'").orderBy("line").collect()] == [("anna", "=one", "", 1, 2), ("anna", "two", "tag", -1, 3)]
    assert sorted((r.path, r.line, r.fault) for r in faults.collect()) == [("accounts.csv", 4, "handle"), ("p/bob.csv", 3, "rating")]


def test_export_guards_formulas(spark):
    rows = [("u", '=1+"2"', "", 1, None, None, None), ("u", "a,b", "\tt", -1, "s", "i", "l")]
    df = spark.createDataFrame(rows, "user_id string, name string, attribute string, value int, source string, id string, link string")
    text = X.export_files(df, ["user_id"]).first().text
    assert text == '﻿name,attribute,rating,source,id,link\r\n"\'=1+""2""",,yes,,,\r\n"a,b",\'\tt,no,s,i,l\r\n'


def test_cells_are_looked_up_and_trimmed_where_a_file_is_parsed(spark):
    text = "﻿Title, YEAR ,Title,odd\r\n -1 , x\t,second,y\r\nshort\r\n"
    rows = X.cells(spark.createDataFrame([("e", "p", text)], "export string, path string, text string")).where("line > 0")
    got = [tuple(r) for r in rows.orderBy("line").select(X.cell("title"), X.cell("year"), X.cell("const"), "cells").collect()]
    assert got == [("-1", "x", "", [" -1 ", " x\t", "second", "y"]), ("short", "", "", ["short"])]
    # a reader's conditions do not each search the header again
    plan = X.read_imdb(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" not in plan
