from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from palate.llm import substring_dedup as S


def brute(rows, window):
    seen = Counter()
    split = [(t or "").encode().split() for _, t in rows]
    for w in split:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in S.op6_substring_dedup(spark, f"/root/testdata/{sf}").collect()), key=str)
    assert got == brute(rows, S.WINDOW)


@pytest.mark.parametrize("seed", range(3))
def test_few_words_many_repeats(spark, seed):
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(30)))) for k in range(60)]
    rows += [(100, "a " * 50), (101, "x " * 8), (101, "x " * 8), (None, "p q r s t u v"), (None, "p q r s t u v w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in S.removal_report(df, window=7, anchor=3).collect()), key=str)
    assert got == brute(rows, 7)


def test_texts_keep_their_spaces(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(1, f"one\n two  {passage}\n\nthree four", "x"), (2, f"{passage}", "y"), (3, "left  as\tis ", "z"), (4, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, dk string")
    got = {r.doc_id: (r.text, r.dk) for r in S.without_repeats(df).collect()}
    assert got == {1: ("one\n two  three four", "x"), 2: ("", "y"), 3: ("left  as\tis ", "z"), 4: (None, "n")}


@pytest.mark.parametrize("rows", [[], [(None, None, 1), (1, "", 2), (1, "a b", 3), (2, "long " * 40_000, 4)]])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, size int")
    got = sorted((tuple(r) for r in S.removal_report(df).collect()), key=str)
    assert got == brute([(d, t) for d, t, _ in rows], S.WINDOW)
