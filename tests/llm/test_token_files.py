from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palate.llm import token_files as T
from palate.llm._tokens import vocabulary_path

IDS = st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**63))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(IDS, st.sampled_from([1, 2, 9, 130, 250])), max_size=30))
def test_round_trip(runs):
    ids = np.array([v for v, n in runs for _ in range(n)], np.uint64)
    words, escapes, offsets = T.encode(ids)
    assert np.array_equal(T.decode(words, escapes), ids)
    if len(ids):
        a = len(ids) // 3
        assert np.array_equal(T.decode_from(words, escapes, offsets, a, 50), ids[a : a + 50])


def test_small_ids_pack_tight():
    words, escapes, _ = T.encode(np.full(600, 1))
    assert len(words) == 10 and not len(escapes)
    words, _, _ = T.encode(np.full(300, 49000))
    assert len(words) == 100


def test_query_equals_the_library(spark, small):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    got = {r.doc_id: r for r in T.op8_token_files(spark, small).collect()}
    at = 0
    for doc, text in rows:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, T.END_ID], "<u4")
        r = got.pop(doc)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not got


@pytest.mark.parametrize("rows", [[], [(None, None, "x"), (1, "", "x"), (1, "a b", "x"), (0, "word " * 90000, None)]])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, part string")
    found = sorted(((r.start, r.doc_id, len(r.ids) // 4) for r in T.read(T.write(df)).collect()))
    assert [d for _, d, _ in found] == sorted((d for d, _, _ in rows), key=lambda d: (d is not None, d))
    assert [s for s, _, _ in found] == [sum(n for _, _, n in found[:k]) for k in range(len(found))]
    assert sum(n for *_, n in found) == sum(len((t or "").split()) + 1 for _, t, _ in rows)


def test_the_widest_of_many_ids_is_found_by_doubling():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 119, 120, 240, 241, 700):
        for most in (1, 2, 300, 60_000, 1 << 32):
            ids = rng.integers(0, most, n).astype(np.uint64)
            ids[n // 3 : n // 3 + 130] = 0
            fits = lambda i, s, n=n, ids=ids: i + T.COUNTS[s] <= n and all(int(x).bit_length() <= T.WIDTHS[s] for x in ids[i : i + T.COUNTS[s]])
            assert T._choices(ids).tolist() == [next((s for s in range(15) if fits(i, s)), T.ESCAPE) for i in range(n)]
