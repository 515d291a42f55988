from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palate.llm import packing
from palate.llm._tokens import vocabulary_path


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=4), st.integers(0, 60))
def test_closest_fill_is_best(counts, room):
    taken = packing.closest_fill(counts, room)
    assert all(0 < k <= counts[n] for n, k in taken.items())
    best = max(
        s
        for ks in product(*(range(c + 1) for c in counts.values()))
        if (s := sum(n * k for n, k in zip(counts, ks, strict=True))) <= room
    )
    assert sum(n * k for n, k in taken.items()) == best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40))
def test_pack_places_every_id_once(lengths):
    docs = [(k, np.arange(n, dtype="<u4").tobytes()) for k, n in enumerate(lengths)]
    made = list(packing.pack(docs, window=16, unit_tokens=100))
    found = defaultdict(list)
    for pieces in made:
        total = sum(len(p[2]) // 4 for p in pieces)
        assert total == 16 or total & (total - 1) == 0
        for doc, start, ids, n in pieces:
            assert n == lengths[doc]
            found[doc].append((start, ids))
    for doc, ids in docs:
        assert b"".join(x for _, x in sorted(found[doc])) == ids


def test_pieces_that_fit_nowhere_do_not_pile_up():
    drawn = 0

    def docs():
        nonlocal drawn
        for k in range(3000):
            drawn += 3000
            yield k, np.zeros(3000, "<u4").tobytes()

    placed = 0
    for made in packing.pack(docs(), window=4096, unit_tokens=100_000):
        placed += sum(len(p[2]) // 4 for p in made)
        assert drawn - placed <= 2 * 100_000 + 3000
    assert placed == drawn == 9_000_000


def test_packed_covers_the_table(spark, small):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = defaultdict(list)
    sequences = defaultdict(list)
    for r in packing.op10_packing(spark, small).collect():
        got[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, packing.END_ID]
        pieces = sorted(got.pop(doc), key=lambda r: r.start)
        assert [r.start for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces[:-1])]))
        assert sum(r.length for r in pieces) == len(ids) == pieces[0].doc_tokens
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert not got
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == list(np.cumsum([0, *(r.length for r in s[:-1])]))
        total = sum(r.length for r in s)
        assert total == 4096 or total & (total - 1) == 0


@pytest.mark.parametrize("rows", [[], [(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "word " * 9000, None)]])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    found = packing.packed(df).collect()
    sizes = sorted((d or 0, len((t or "").split()) + 1) for d, t, _ in rows)
    whole = defaultdict(int)
    for r in found:
        whole[r.doc_id or 0] += r.length
        assert len(r.ids) == 4 * r.length and r.start + r.length <= r.doc_tokens
        assert (r.doc_id or 0, r.doc_tokens) in sizes
    assert dict(whole) == {d: sum(n for k, n in sizes if k == d) for d, _ in sizes}
