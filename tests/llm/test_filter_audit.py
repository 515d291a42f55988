from __future__ import annotations

import re
from itertools import permutations

import numpy as np

from palate.llm import filter_audit as A

LONG = " ".join(f"w{i}" for i in range(250))
DOCS = [
    (1, LONG, "en"),
    (2, LONG, "de"),
    (2, LONG, "de"),
    (1, LONG, None),
    (None, LONG, "en"),
    (3, None, "en"),
    (4, "", ""),
    (5, "HELLO World # again", "en"),
    (6, "a " * 300, "en"),
    (7, "x" * 200_000 + " | $", "fr"),
    (8, "ÀÉ éa A", "fr"),
    (None, None, None),
]
LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, None), (3, None, 1), (5, 0, 1), (None, 1, 1), (99, 1, 1)]


def failed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
    return out + ("D" if re.search("[#$%&*|]", text) else "")


def brute(docs, labels):
    out = {}
    rows = [(i, t or "", p or "") for i, t, p in docs]
    for part in {p for _, _, p in rows}:
        told = []
        for i, t, p in rows:
            if p == part:
                bad = failed(t)
                if i is not None and any(j is not None and j < i and u == t for j, u, _ in rows):
                    bad += "E"
                own = [x for x in labels if i is not None and x[0] == i]
                told.append((bad, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = told
            for step, c in enumerate(order, 1):
                here = [x for x in left if c in x[0]]
                left = [x for x in left if c not in x[0]]
                shapley[c] += len(here)
                fails = sum(c in x[0] for x in told)
                alone = sum(x[0] == c for x in told)
                out[part, order, step] = [len(left), len(here), fails - len(here), alone, sum(x[1] for x in here), sum(x[2] for x in here)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return out


def told(found):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in A._COUNTS] for r in found.collect()}


def test_against_brute_force(spark, tmp_path):
    docs = spark.createDataFrame([(*r, "x", 1) for r in DOCS], "doc_id long, text string, lang string, part string, mask int")
    docs.write.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = A.audit(spark.read.parquet(str(tmp_path / "d")), labels)
    got, want = told(found), brute(DOCS, LABELS)
    assert found.count() == len(want) == 600 * 4
    assert got == want


def test_a_hot_text_and_a_hot_id(spark, tmp_path):
    rows = [(i, "same", "en") for i in range(1500)] + [(7, f"text {i}", "de") for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    got = told(A.audit(spark.read.parquet(str(tmp_path / "d")), labels))
    assert got["en", "EABCD", 1][:2] == [1, 1499] and got["en", "EABCD", 1][4] == 1
    assert got["de", "ABCDE", 1][1] == got["de", "ABCDE", 1][4] == 1500


def test_matrices():
    m = A.incidence()
    assert all(m[k].shape == (32, 600) for k in ("kept", "removed", "redundant", "unique"))
    fails = sum(m["letter"][k] * ((np.arange(32)[:, None] >> k) & 1) for k in range(5))
    assert (m["removed"] + m["redundant"] == fails).all()  # each failure is a removal or comes too late
    last = m["kept"][:, 4::5] + m["removed"].reshape(32, 120, 5).sum(axis=2)
    assert (last == 1).all()  # and every document is kept or removed once, whatever the order


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(docs, labels).count() == 0
