from __future__ import annotations

import random
import re
import textwrap
from collections import Counter

import pytest

from palate.llm import licences as L


def brute(rows):
    def grams(s):
        w = re.sub("[^A-Za-z0-9]+", " ", s).lower().split()
        return Counter(zip(w, w[1:], strict=False)), max(0, len(w) - 1)

    out = []
    shapes = [(n, *grams(t)) for n, t in L.TEMPLATES]
    for doc, text in rows:
        found = {}
        for line, s in [(0, text or ""), *((1, x) for x in (text or "").split("\n"))]:
            own, size = grams(s)
            names = {}
            for name, t, n in shapes:
                score = 2 * sum((own & t).values()) / (size + n)
                if score >= L.LEAST:
                    names[name] = max(score, names.get(name, 0))
            for name, score in names.items():
                best, lines, whole = found.get(name, (0.0, 0, False))
                found[name] = (max(best, score), lines + line, whole or not line)
        out += [(doc, n, *x) for n, x in found.items()]
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted((tuple(r) for r in L.op9_licences(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()]) and got


def test_variants_and_odd_rows(spark):
    mit = next(t for n, t in L.TEMPLATES if n == "MIT" and len(t) > 200)
    rows = [
        (1, mit.upper(), 1), (2, mit.replace("Software", "Program"), 1), (3, "x\n" + mit + "\ny", 1), (4, mit[: len(mit) // 2], 1),
        (5, "licensed under the apache licence version 2.0", 1), (None, None, 1), (6, "", 1), (7, "\n\n", 1), (8, "a", 1),
        (9, "Released under the MIT License.\nReleased under the MIT License.", 1), (9, "Released under the MIT License", 2),
        (10, "word " * 50_000, 1), (11, "under", 1), (11, "the Mit license.", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, licence int")
    got = sorted((tuple(r) for r in L.scan(df).collect()), key=str)
    assert got == brute([(d, t) for d, t, _ in rows])
    assert {1, 2, 3} <= {r[0] for r in got}


@pytest.mark.parametrize("n", [0])
def test_empty(spark, n):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == n


def brute_passages(rows, templates):
    """Every run of words of every text, by counting; rows of whole texts and lines not among them."""
    out = set()
    for doc, text in rows:
        words = re.sub("[^A-Za-z0-9]+", " ", text).lower().split()
        for name, body in templates:
            own = re.sub("[^A-Za-z0-9]+", " ", body).lower().split()
            own, n = Counter(zip(own, own[1:], strict=False)), len(own) - 1
            for i in range(len(words)):
                for j in range(i + 2, len(words) + 1):
                    grams = Counter(zip(words[i:j], words[i + 1 : j], strict=False))
                    score = 2 * sum((grams & own).values()) / (j - i - 1 + n)
                    if score >= L.LEAST:
                        out.add((doc, name, score))
    best = {}
    for doc, name, score in out:
        best[doc, name] = max(score, best.get((doc, name), 0))
    return best


def test_passages_equal_brute_force(spark):
    templates = [("A", "a b a b c d"), ("A", "c c c c"), ("B", "the end of the end of it all"), ("C", "x y")]
    chance = random.Random(5)
    rows = [(k, "".join(chance.choice("abcdxy") + chance.choice(["  ", "\n", "-"]) for _ in range(chance.randrange(30)))) for k in range(60)]
    rows += [(100 + k, " ".join(chance.choice(["the", "end", "of", "it", "all", "c"]) for _ in range(25))) for k in range(40)]
    want = brute_passages(rows, templates)
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()
    assert {(r.doc_id, r.licence) for r in got} == set(want) and len(got) == len(want)
    alone = {(r.doc_id, r.licence): r.score for r in got if not r.lines and not r.whole}
    assert alone and alone == {k: want[k] for k in alone}
    assert all(r.score <= want[r.doc_id, r.licence] for r in got)


def test_wrapped_blocks_and_notices_in_prose(spark):
    def longest(name):
        return max((t for n, t in L.TEMPLATES if n == name), key=len)

    prose = "It rained all day and nobody came to see the show, so we went home early. " * 40
    apache = next(t for n, t in L.TEMPLATES if n == "Apache-2.0" and 200 < len(t) < 1000)
    rows = [
        (1, textwrap.fill(longest("MIT"), 70, initial_indent="# ", subsequent_indent="# ") + "\n\n" + prose),
        (2, prose + "\n" + textwrap.fill(apache, 60) + "\n" + prose),
        (3, prose + "which is why this was released under the MIT License. " + prose),
        (4, prose),
        *((10 + k, longest(n)) for k, n in enumerate(["ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", "Apache-2.0", "CC0-1.0"])),
        (20, prose * 4 + textwrap.fill(longest("GPL-2.0"), 50) + prose * 4),
    ]
    got = {(r.doc_id, r.licence): (r.score, r.lines, r.whole) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, "MIT"] == got[3, "MIT"] == got[20, "GPL-2.0"] == (1.0, 0, False)
    assert got[2, "Apache-2.0"] == (pytest.approx(14 / 15), 1, False)  # its first line is like the short notice
    assert all(got[10 + k, n][0] == 1.0 and got[10 + k, n][2] for k, n in enumerate(["ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", "Apache-2.0", "CC0-1.0"]))
    assert not any(d == 4 for d, _ in got)
