from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from palate.llm import language_model as L

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text: str | None) -> list[bytes]:
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return [*WORD.findall(low.encode()), b"\n"]


def fold(doc) -> int:
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10


def brute(rows, weights):
    """All scores by definition, given the mixture weights."""
    words, pairs, n = Counter(), Counter(), 0
    for doc, text in rows:
        if fold(doc):
            t = tokens(text)
            words.update(t)
            pairs.update(zip([b"\t", *t[:-1]], t, strict=True))
            n += len(t)
    context = words | Counter({b"\t": words[b"\n"]})
    out = []
    for doc, text in rows:
        t, base, score = tokens(text), 0.0, 0.0
        for h, w in zip([b"\t", *t[:-1]], t, strict=True):
            p0 = (words[w] + 0.1) / (n + 0.1 * (len(words) + 1))
            p1 = words[w] / max(n, 1)
            p2 = pairs[h, w] / context[h] if context[h] else 0.0
            base += math.log10(p0)
            score += math.log10(weights[L.bucket(np.array([context[h]]))[0]] @ np.array([p2, p1, p0]))
        out.append((doc, len(t), sum(words[w] > 0 for w in t), base, score))
    return out, n


@pytest.mark.parametrize("table, block", [(1 << 20, 4 << 20), (50, 20_000), (1 << 20, 700)])
def test_scores_equal_brute_force(spark, monkeypatch, table, block):
    monkeypatch.setattr(L, "TABLE", table)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found, model = L.scored(docs, block)
    got = {r.doc_id: r for r in found.collect()}
    want, n = brute([tuple(r) for r in docs.collect()], model.weights)
    assert model.n == n and len(got) == len(want)
    for doc, size, known, base, score in want:
        r = got[doc]
        assert (r.n_tokens, r.n_known) == (size, known)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_weights_learn_from_held_out_counts():
    held = {(3, 20, 0): 90.0, (3, -999, 0): 10.0, (5, -999, 0): 100.0}
    w = L.mixture_weights(held)
    assert w[3][0] > 0.8 and w[5][0] < 1e-3 and np.allclose(w.sum(1), 1) and (w[4] == w[3]).all()


def test_weights_equal_em_on_raw_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model, _ = L.learn(docs)
    words, pairs, held = Counter(), Counter(), Counter()
    for r in docs.collect():
        t = tokens(r.text)
        both = list(zip([b"\t", *t[:-1]], t, strict=True))
        if fold(r.doc_id) == L.EM_FOLD:
            held.update(both)
        elif fold(r.doc_id):
            words.update(t)
            pairs.update(both)
    n, v, context = sum(words.values()), len(words), words | Counter({b"\t": words[b"\n"]})
    by_bucket = {}
    for (h, w), c in held.items():
        p = [pairs[h, w] / context[h] if context[h] else 0.0, words[w] / n, (words[w] + 0.1) / (n + 0.1 * (v + 1))]
        by_bucket.setdefault(int(L.bucket(np.array([context[h]]))[0]), []).append((c, *p))
    for b, rows in by_bucket.items():
        c, p = np.array(rows)[:, 0], np.array(rows)[:, 1:]
        own = np.full(3, 1 / 3) if b else np.array([0, 0.5, 0.5])
        for _ in range(L.EM_ROUNDS):
            part = p * own
            own = (c[:, None] * part / part.sum(1, keepdims=True)).sum(0) / c.sum()
        assert np.abs(model.weights[b] - own).max() < 0.03, (b, model.weights[b], own)


def test_better_than_the_base_on_held_out(spark):
    rows = [r for r in L.op7_language_model(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


@pytest.mark.parametrize("rows", [[], [(None, None, 1), (1, "", 2), (3, "A b a B", 2), (3, "A b a B", 2), (7, "x " * 60_000, 3)]])
@pytest.mark.parametrize("block", [4 << 20, 1000])
def test_odd_rows(spark, rows, block, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, fold int").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    found, model = L.scored(docs, block)
    got = sorted(((r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in found.collect()))
    want, _ = brute([(d, t) for d, t, _ in rows], model.weights)
    assert got == sorted((d or 0, a, b, round(x, 6), round(y, 6)) for d, a, b, x, y in want)
