from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palate.llm import exact_dedup as E


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(-1 if d is None else d)
    return sorted((d, max(groups[t or ""]), len(groups[t or ""])) for d, t in [((-1 if d is None else d), t) for d, t in rows])


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "b"), (6, "x" * 100_000), (7, "a "), (None, "n")]


@pytest.mark.parametrize("digest", [E.sha256, lambda t: F.substring(E.sha256(t), 1, 0), lambda t: F.length(t).cast("string").cast("binary")])
def test_content_decides_whatever_the_digest(spark, digest, tmp_path):
    spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, n int").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = E.exact_duplicates(docs, digest).collect()
    none = lambda v: -1 if v is None else v
    assert sorted((none(r.doc_id), none(r.keep_id), r.group_size) for r in got) == brute(ROWS)
    assert sum(r.kept for r in got) == len({t or "" for _, t in ROWS})
    kept = E.keep_one(docs)
    assert kept.columns == docs.columns and sorted(none(r.doc_id) for r in kept.collect()) == [-1, 2, 4, 5, 6, 7]


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = E.op2_exact_dedup(spark, small).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == brute(rows)
    texts = dict(rows)
    assert all(r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.kept == (r.doc_id == r.keep_id) for r in got)


def test_empty(spark):
    assert E.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
