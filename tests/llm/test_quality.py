from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from palate.llm import quality as Q


def brute_chunk_maxima(model, text: bytes):
    syms = []
    for i, b in enumerate(text):
        gram = text[i : i + Q.GRAM]
        seen = len(gram) == Q.GRAM and any(
            text[i - lag : i - lag + Q.GRAM] == gram for lag in range(1, Q.LAGS + 1) if i - lag >= 0
        )
        syms.append(b + 256 * seen)
    syms += [Q.PAD] * Q.WIDTH
    acts = [sum(model["filters"][k][syms[t + k]] for k in range(Q.WIDTH)) for t in range(max(1, len(text)))]
    maxima = [np.max(acts[a : a + Q.CHUNK], axis=0) for a in range(0, len(acts), Q.CHUNK)]
    if len(text) % Q.CHUNK or not text:  # the last chunk ends in pads, whose windows weigh nothing
        maxima[-1] = np.maximum(maxima[-1], 0)
    return maxima


@pytest.fixture(scope="module")
def model():
    texts = [b"plain words in a row " * k for k in (1, 5)] + [b"### %%% *** " * k for k in (1, 40)]
    return Q.fit(texts, np.array([1.0, 1, 0, 0]), steps=10)


def test_forward_equals_brute_force(model):
    rng = np.random.default_rng(3)
    texts = [b"", b"a", b"abcabcabcabcabcabc", bytes(rng.integers(97, 103, 700)), b"x" * 256, b"xyz" * 300]
    got = Q.scores(model, pa.array([t.decode() for t in texts]))
    for text, score in zip(texts, got, strict=True):
        maxima = np.array(brute_chunk_maxima(model, text), np.float32)
        want = Q.combine(model, maxima, np.array([0, len(maxima)]))[0]
        assert score == pytest.approx(want, abs=1e-5)
    alone = [Q.scores(model, pa.array([t.decode()]))[0] for t in texts]
    assert np.allclose(alone, got, atol=1e-6)


@pytest.mark.parametrize("size", [1023, 1024, 1025, 5000])
def test_long_text_in_tiles(model, monkeypatch, size):
    text = bytes(np.random.default_rng(size).integers(97, 101, size)).decode()
    want = Q.scores(model, pa.array([text]))
    monkeypatch.setattr(Q, "SLICE_BYTES", 1024)
    assert np.array_equal(Q.scores(model, pa.array([text])), want)


def test_gradient_by_finite_differences(model):
    texts, labels = [b"plain words in a row " * 30, b"### %%% " * 9, b"a"], np.array([1.0, 0.0, 1.0])
    m = {k: v.astype(np.float64) for k, v in model.items()}
    column = pa.array([t.decode() for t in texts])

    def loss():
        p = Q.scores(m, column)
        return -np.mean(np.log(np.where(labels == 1, p, 1 - p)))

    for name, g in Q._gradient(m, [Q._chunks(t) for t in texts], labels).items():
        for at in np.argsort(-np.abs(g).ravel())[:6]:
            flat, step = m[name].reshape(-1), 1e-5
            kept = flat[at]
            flat[at] = kept + step
            up = loss()
            flat[at] = kept - step
            assert (up - loss()) / (2 * step) == pytest.approx(g.ravel()[at], rel=2e-2, abs=1e-6), name
            flat[at] = kept


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.op1_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in judged]) >= 0.95


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame(
        [(None, None, 1), (1, "", 2), (1, "good words", 2), (2, "###" * 20_000, 3)], "doc_id long, text string, score int"
    )
    from palate.llm._store import with_text

    found = Q.scored(with_text(docs), Q.learn(docs, labels, steps=3)).collect()
    assert len(found) == 4 and all(0 <= r.score <= 1 for r in found)
    empty = docs.limit(0)
    assert Q.learn(empty, labels, steps=3)["rest"][0] == 0.5
    assert Q.scored(with_text(empty), Q.learn(empty, labels.limit(0))).count() == 0
