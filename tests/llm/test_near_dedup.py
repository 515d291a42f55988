from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from palate.llm import near_dedup as N


def runs_of(text: str | None) -> Counter:
    words = (text or "").encode().split()
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + N.RUN]) for i in range(max(1, len(words) - N.RUN + 1)))


def similarity(a: Counter, b: Counter) -> float:
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    sets = [(d, runs_of(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders: dict = {}
    for k, (d, s) in enumerate(sets):
        for other in {o for g in s for o in holders.get(g, ())}:
            if similarity(s, sets[other][1]) >= 0.8:
                a, b = sorted((root(d), root(sets[other][0])))
                parent[b] = a
        for g in s:
            holders.setdefault(g, []).append(k)
    return {d: root(d) for d, _ in sets}


def test_signature_is_unbiased():
    rng = np.random.default_rng(1)
    gram = rng.integers(0, 2**63, 90, dtype=np.uint64)
    a, b = rng.integers(1, 7, 90), rng.integers(1, 7, 90)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    row = np.repeat([0, 1], 90)
    got = []
    for salt in range(40):
        s = N.signatures(row, N.mix(np.tile(gram, 2) + np.uint64(salt * 7919)), np.concatenate([a, b]), 2)
        assert np.isfinite(s).all()
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - true) < 4 * np.sqrt(true * (1 - true) / (40 * N.SLOTS))


def test_signature_ignores_order_and_company():
    gram, weight = np.arange(5, dtype=np.uint64), np.array([1, 300, 2, 5, 1])
    alone = N.signatures(np.zeros(5, int), gram, weight, 1)
    other = N.signatures(
        np.array([1] * 5 + [0] * 900), np.concatenate([gram[::-1], np.arange(900, dtype=np.uint64)]),
        np.concatenate([weight[::-1], np.ones(900, int)]), 2,
    )
    assert np.array_equal(alone[0], other[1])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_classes_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in N.op5_near_dedup(spark, f"/root/testdata/{sf}").collect()}
    want = brute_classes(rows)
    assert {d: r.class_id for d, r in got.items()} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.class_id == d) for d, r in got.items())


def test_large_group_and_chains(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(150):  # one large group of near copies
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    words = [f"c{k}" for k in range(100)]
    for k in range(20):  # a chain: neighbours are near, the ends are not
        words[5 * k] = f"y{k}"
        rows.append((1000 + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()} == brute_classes(rows)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(None, None, 1), (None, "a b", 1), (1, "", 1), (2, " \n", 2), (3, "a  b", 3), (3, "a b", 4), (5, "z " * 30_000, 5)],
    ],
)
def test_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = N.near_duplicates(df).collect()
    assert len(got) == len(rows)
    if rows:
        together = [r for r in got if r.class_size == 3]
        assert len(together) == 3 and {r.class_id for r in together} == {3}
        assert sum(r.kept for r in together) == 1
        assert all(r.kept and r.class_id == r.doc_id for r in got if r.class_size == 1)


def test_many_rows_equal_in_null_id_and_text(spark, tmp_path):
    near = [(k, "the same ten words over and over again until " + f"w{k} " * 2 + "the end of this long enough text that all of them share " * 3) for k in range(20)]
    rows = [(None, near[0][1])] * 10_000 + near
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(str(tmp_path / "d"))
    got = N.near_duplicates(spark.read.parquet(str(tmp_path / "d"))).collect()
    classes = brute_classes(near)
    assert len(got) == len(rows) and {r.doc_id: r.class_id for r in got if r.doc_id is not None} == classes
    assert {r.class_id for r in got if r.doc_id is None} == {classes[0]} and sum(r.kept for r in got) == len(set(classes.values()))
