from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palate.llm import _skew, _words, substring_dedup


@pytest.mark.parametrize("tile", [7, 16, 64])
def test_words_in_tiles_equal_splitting(monkeypatch, tile):
    rng = random.Random(tile)
    known: dict[bytes, int] = {}
    plain: dict[bytes, int] = {}
    for _ in range(150):
        texts = [
            bytes(rng.choice(b"ab \tAB") for _ in range(rng.choice([0, 1, 5, 40, 200]))) if rng.random() < 0.7 else b"x" * rng.choice([0, 6, 8, 50, 130]) + b" " * rng.choice([0, 1])
            for _ in range(rng.randint(0, 6))
        ]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        for lower in (False, True):
            flat = [w for t in texts for w in (t.lower() if lower else t).split()]
            with monkeypatch.context() as m:
                m.setattr(_words, "SLICE_BYTES", tile)
                m.setattr(_words, "_powers", {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)})
                found = _words.words(data, offsets, lower)
            whole = _words.words(data, offsets, lower)
            assert found.counts.tolist() == [len(t.split()) for t in texts] and len(flat) == len(found.hashes)
            for h, g, a, z, w in zip(found.hashes.tolist(), whole.hashes.tolist(), found.begin, found.end, flat, strict=True):
                raw = data[a:z].tobytes()
                assert (raw.lower() if lower else raw) == w
                assert known.setdefault(w, h) == h and plain.setdefault(w, g) == g == h
    assert len(set(known.values())) == len(known)


def test_long_text_is_joined_as_short_ones_are(monkeypatch):
    rng = random.Random(1)
    for _ in range(200):
        text = bytes(rng.choice(b"ab \n") for _ in range(rng.randrange(60)))
        n = len(text.split())
        gone = np.array([rng.random() < 0.4 for _ in range(n)], bool)
        want = substring_dedup.joined(text), substring_dedup.joined(text, gone)
        monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 0)
        assert (substring_dedup.joined(text), substring_dedup.joined(text, gone)) == want
        monkeypatch.undo()


def test_tiles_of_windows_lose_no_repeat():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 3, 300).astype(np.uint64)
    w = _words.Words(hashes, np.arange(300), np.arange(300) + 1, np.array([0, 300]))
    whole = list(substring_dedup.tiled_stretches(w, 7, 3))
    parts = list(substring_dedup.tiled_stretches(w, 7, 3, tile=40))
    cover = lambda found: sorted(k for _, start, size, *_ in found for a, n in zip(start, size, strict=True) for k in range(a, a + n))
    assert cover(whole) == cover(parts) == list(range(294)) and len(parts) == 8


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_dealt_over_salts(spark, how):
    members = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("key"))
    facts = members.groupBy("key").agg(F.count("*").alias("n")).where("key <> 11").withColumn("said", F.col("key") * 2)
    hot = _skew.hot_keys(facts, ["key"], "n", few=100)
    assert [(r.key, r.salts) for r in hot.collect()] == [(7, 11)]
    found = _skew.join_back(members, facts, ["key"], hot, ["id"], how)
    want = members.join(facts, ["key"], how)
    assert found.columns == want.columns and sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert not _skew.hot_keys(facts.limit(0), ["key"], "n").collect()
