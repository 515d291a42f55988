from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palate.llm import bpe
from palate.llm._tokens import encoded_rows, vocabulary_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(vocabulary_path())


TEXTS = st.text(st.sampled_from("abeinorst thXÉéßñ .,'sdm12!*|\n\t  ̧́ΣİK漢字😀<|endoftext|>"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_equal_the_library(codec, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert codec.ids(text) == want
    assert "".join(bpe.decoded(codec, want)) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_columns_equal_the_library(codec, library, texts):
    import pyarrow as pa

    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(encoded_rows(vocabulary_path(), pa.array(texts, pa.string()))) == want


def test_memory_is_constant_and_tokens_come_early(codec):
    machine = bpe.Transducer(codec.merges)
    rng, early = random.Random(5), 0
    symbols = [codec.inner[ord(rng.choice("abcdefghinorst"))] for _ in range(20_000)]
    out = []
    machine.emitted = None
    for k, s in enumerate(symbols):
        out += machine.push(s)
        early = max(early, k - sum(len(codec.merges.symbols[t]) for t in out[-1:]) if out else 0)
    out += machine.finish()
    assert machine.most_held <= codec.merges.longest + codec.merges.lookahead + 1
    assert [s for t in out for s in codec.merges.symbols[t]] == symbols
    assert out[:50] == codec.merges.merge(symbols[:400])[:50]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30), st.integers(1, 5))
def test_bytes_to_text(data, step):
    machine = bpe.ByteToText()
    got = "".join(machine.feed(data[a : a + step]) for a in range(0, len(data), step)) + machine.finish()
    assert got == data.decode("utf-8", "replace")
    assert len(machine.waiting) <= 3


def test_query(spark, small, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in bpe.op3_bpe(spark, small).collect():
        ids = library.encode(texts.pop(r.doc_id), add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert not texts


@pytest.mark.parametrize("rows", [[], [(None, None, 1), (1, "", 2), (1, "  ", 3), (2, "word " * 50_000, 4)]])
def test_odd_rows(spark, library, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_tokens) for r in bpe.round_trip(df).collect()}
    assert got == {(d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in rows}
