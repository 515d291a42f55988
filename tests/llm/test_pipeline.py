from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palate.llm import packing, quality, substring_dedup
from palate.llm._tokens import vocabulary_path
from tests.llm.test_near_dedup import brute_classes


def brute_cut(rows, window):
    seen = defaultdict(int)
    for _, t in rows:
        w = t.split()
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] += 1
    for doc, t in rows:
        w = t.split()
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        yield doc, " ".join(x for k, x in enumerate(w) if k not in gone)


def test_pipeline_equals_brute_force(spark, small):
    import corpus_pipeline as C
    from tokenizers import Tokenizer

    assert [n for n, _ in C.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "substring dedup", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = quality.learn(docs, spark.read.parquet(f"{small}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in quality.scored(docs, model).collect() if r.score >= quality.THRESHOLD]
    keep = {}
    for doc, text in rows:
        keep[text] = max(doc, keep.get(text, doc))
    rows = [(doc, text) for text, doc in keep.items()]
    classes = brute_classes(rows)
    rows = list(brute_cut([(d, t) for d, t in rows if classes[d] == d], substring_dedup.WINDOW))
    library = Tokenizer.from_file(vocabulary_path())
    want = {d: [*library.encode(t, add_special_tokens=False).ids, packing.END_ID] for d, t in rows}
    got = defaultdict(dict)
    for r in C.run(spark, small).collect():
        got[r.doc_id][r.start] = np.frombuffer(bytes(r.ids), "<u4").tolist()
    assert {d: [i for a in sorted(p) for i in p[a]] for d, p in got.items()} == want


def test_stages_keep_the_columns(spark, small):
    import corpus_pipeline as C

    docs = spark.createDataFrame([], spark.read.parquet(f"{small}/documents.parquet").schema)
    for _, stage in C.STAGES[:-1]:
        found = stage(spark, docs, small)
        assert found.columns == docs.columns and found.count() == 0
    assert C.STAGES[-1][1](spark, docs, small).count() == 0


ODD = [
    (None, None, 1.0), (1, "", 2.0), (1, "", 2.0), (2, "plain words in a row " * 3, 42.0), (3, "plain words in a row " * 3, 42.0),
    (4, "long " * 90_000, 7.0), (5, "  \t ", 8.0), (None, "one more", 9.0), (6, "###$$" * 30, 10.0),
]


@pytest.mark.parametrize("stage", range(4))
def test_stages_on_odd_rows(spark, small, tmp_path, stage):
    """Clashing names, nulls, ties, repeated rows, a long text: what stays, stays as it was."""
    import corpus_pipeline as C

    spark.createDataFrame(ODD, "doc_id long, text string, score double").withColumns(
        {"row": F.lit("r"), "__row": F.col("score"), "t1": F.lit(None).cast("string"), "doc": F.col("doc_id"), "kept": F.lit(3), "salts": F.lit("s"), "digest": F.lit(1)}
    ).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    found = C.STAGES[stage][1](spark, docs, small)
    assert found.columns == docs.columns
    rows = [tuple(r) for r in found.collect()]
    given = Counter((r.doc_id, r.score) for r in docs.collect())
    assert not Counter((r[0], r[2]) for r in rows) - given
    assert all(r[3:] == ("r", r[2], None, r[0], 3, "s", 1) for r in rows)
    texts = Counter(r[1] for r in rows)
    if stage == 1:
        assert sorted(r[2] for r in rows) == [2.0, 7.0, 8.0, 9.0, 10.0, 42.0] and max(texts.values()) == 1
    if stage == 2:
        assert sorted(r[2] for r in rows) == [1.0, 2.0, 2.0, 7.0, 8.0, 9.0, 10.0, 42.0]
    if stage == 3:
        assert len(rows) == len(ODD) and texts[None] == 1 and texts["plain words in a row " * 3] == 2
        assert [r[1].split() for r in rows if r[2] == 7.0] == [[]]
