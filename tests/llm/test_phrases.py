from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from palate.llm import phrases as P


def brute(rows, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, told in f.items():
        some = {p: a for p, a in told.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in some.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        found = []
        for p, a in some.items():
            s, k = min((1000 * a * n[lang] // (told[p[:k]] * told[p[k:]]), k) for k in range(1, len(p)))
            if inside[p] < a:
                found.append((-s, -a, " ".join(p).encode(), told[p[:k]], told[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def rows_of(seed, n=300):
    pick = random.Random(seed)
    vocabulary = ["a", "b", "É", "the", "of", "Zebra", "x-y", "ß", " ", "word" * 40]
    odd = [(None, "en"), ("", "en"), ("...", None), ("One  two\tthree. one two three", None), ("one two three", "und"), ("b " * 20_000, "xx"), ("q" * 300_000 + " the of", "en")]
    return [
        ("".join(pick.choice(vocabulary) + pick.choice([" ", " ", "  ", "\t", ". ", "\n", "\r\n", ", "]) for _ in range(pick.randint(0, 60))), pick.choice(["en", "de", None]))
        for _ in range(n)
    ] + odd * 2


@pytest.mark.parametrize(("least", "top", "width"), [(5, 2000, None), (3, 7, 8), (40, 2000, 1 << 16)])
def test_against_brute_force(spark, tmp_path, monkeypatch, least, top, width):
    """Also with a sketch too narrow to tell anything, and tiles shorter than most rows."""
    monkeypatch.setattr(P, "TILE", 1 << 12)  # workers fork the patched module in local mode or not: both must agree
    rows = rows_of(least)
    docs = spark.createDataFrame([(i, t, x, 1, "y") for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, f int, phrase string")
    docs.repartition(5).write.parquet(str(tmp_path / "d"))
    found = P.phrases(spark.read.parquet(str(tmp_path / "d")), least, top, width).collect()
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found)
    assert got == brute(rows, least, top)


def test_tiles_are_worked_off_alike(monkeypatch):
    text = ("some words here, and. more of them\n" * 400 + "x" * 9000 + " end of it" + "!" * 50).encode()
    rows = np.array([0, 10, 10, 5000, len(text)])
    told = []
    for size in (64, 1000, 1 << 20):
        monkeypatch.setattr(P, "TILE", size)
        d, found = np.frombuffer(text, np.uint8), Counter()
        for x, y in P._cuts(d, rows):
            a, b = int(np.searchsorted(rows, x, side="right")) - 1, int(np.searchsorted(rows, y, side="left"))
            tile = P.Tile(P._FOLD[d[x:y]], np.clip(rows[a : b + 1], x, y) - x, np.zeros(b - a, np.int64))
            for n, _, keys in tile.keys(np.ones(1, np.uint64)):
                found.update((n, k) for k in keys.tolist())
        told.append(found)
    assert told[0] == told[1] == told[2]


def test_no_frequent_run_is_lost_and_few_rare_ones_pass(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    width = P.width_for(docs)
    bits = P.frequent_bits(P.sketch(docs, width), width, 20)
    counted = P.survivors(docs, bits, width).groupBy("lang", "words", "phrase").sum("f").where("words > 0").collect()
    every = P.survivors(docs, np.full_like(bits, 255), width).groupBy("lang", "words", "phrase").sum("f").where("words > 0").collect()
    true = {(r[0], r[2]): r[3] for r in every}
    passed = {(r[0], r[2]): r[3] for r in counted}
    assert {k: v for k, v in true.items() if v >= 20} == {k: v for k, v in passed.items() if v >= 20}
    assert all(true[k] == v for k, v in passed.items())
    rare = sum(v < 20 for v in true.values())
    assert sum(v < 20 for v in passed.values()) < 0.02 * rare


def test_counts_past_64_bits(spark):
    big = 10**14
    rows = [("en", 0, "", 9 * big), ("en", 1, "a", 3 * big), ("en", 1, "b", 2 * big), ("en", 2, "a b", big)]
    (r,) = P.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, f long")).collect()
    assert r.score == 1000 * big * 9 * big // (3 * big * 2 * big) == 1500


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert P.phrases(docs).count() == 0
