from __future__ import annotations

import os
import uuid

import pytest

from palate.operators import ledger as L

TITLES = {f"t{k}": [f"Q{k}", f"Q{k}b"] for k in range(0, 40, 2)}
LABELS = {f"l{k}": [f"P{k}"] for k in range(0, 60, 3)}


def asker(known, folder, stage, fail_at=None):
    """Answers a batch and leaves a note of it; ``fail_at``: fails when asked this."""

    def call(asked):
        if fail_at in asked:
            raise RuntimeError("cut off")
        with open(os.path.join(folder, f"{stage}-{uuid.uuid4().hex}"), "w") as f:
            f.write("\n".join(asked))
        return {q: known[q][::-1] for q in asked if q in known}

    return L.by_batch(call)


def notes(folder, stage):
    return [open(os.path.join(folder, f)).read().split("\n") for f in sorted(os.listdir(folder)) if f.startswith(stage)]


def rows_of(spark):
    rows = [(k, f"t{k % 30}" if k % 11 else None, f"l{k % 30}") for k in range(90)]
    want = {}
    for k, title, label in rows:
        if title in TITLES:
            want[k] = (TITLES[title], "titles")
        elif label in LABELS:
            want[k] = (LABELS[label], "labels")
    return spark.createDataFrame(rows, "row long, title string, label string"), want


def found(df):
    return {r.row: (r.answers, r.stage) for r in df.collect()}


def test_titles_then_labels_each_asked_once(spark, tmp_path):
    rows, want = rows_of(spark)
    os.mkdir(tmp_path / "n")
    got = L.match_titles(rows, asker(TITLES, tmp_path / "n", "titles"), asker(LABELS, tmp_path / "n", "labels"), L.Ledger(spark, f"file://{tmp_path}/l"), batch=4, wave=3)
    assert found(got) == want
    for stage in ("titles", "labels"):
        asked = notes(tmp_path / "n", stage)
        assert max(map(len, asked)) <= 4 and sorted(sum(asked, [])) == sorted(set(sum(asked, [])))
    assert {q for b in notes(tmp_path / "n", "labels") for q in b} == {r.label for r in rows.collect() if r.title not in TITLES}


def test_a_run_that_was_cut_off_goes_on(spark, tmp_path):
    rows, want = rows_of(spark)
    os.mkdir(tmp_path / "n")
    book, args = L.Ledger(spark, f"file://{tmp_path}/l"), {"batch": 4, "wave": 1}
    with pytest.raises(Exception, match="cut off"):
        L.match_titles(rows, asker(TITLES, tmp_path / "n", "titles", "t20"), asker(LABELS, tmp_path / "n", "labels"), book, **args)
    before = notes(tmp_path / "n", "titles")
    assert before and "t20" not in sum(before, [])
    with pytest.raises(Exception, match="cut off"):
        L.match_titles(rows, asker(TITLES, tmp_path / "n", "titles"), asker(LABELS, tmp_path / "n", "labels", "l5"), book, **args)
    got = L.match_titles(rows, asker(TITLES, tmp_path / "n", "titles"), asker(LABELS, tmp_path / "n", "labels"), book, **args)
    assert found(got) == want
    for stage in ("titles", "labels"):
        asked = sum(notes(tmp_path / "n", stage), [])
        assert len(asked) == len(set(asked))  # nothing twice, over three runs
    again = L.match_titles(rows, asker(TITLES, tmp_path / "n", "late"), asker(LABELS, tmp_path / "n", "late"), book, **args)
    assert found(again) == want and notes(tmp_path / "n", "late") == []


def test_what_was_half_written_does_not_count(spark, tmp_path):
    book = L.Ledger(spark, f"file://{tmp_path}/l")
    book.add("s", spark.createDataFrame([("a", ["x"])], L.ANSWERS))
    book.add("s", spark.createDataFrame([("b", ["y"])], L.ANSWERS))
    os.remove(tmp_path / "l" / "s" / "1" / "_SUCCESS")
    assert [r.question for r in book.answers("s").collect()] == ["a"]
    questions = spark.createDataFrame([("a",), ("b",), (None,), ("b",)], "question string")
    index = spark.createDataFrame([("b", ["z"])], L.ANSWERS)
    got = L.ask_all(questions, lambda asked: asked.join(index, "question"), book, "s")
    assert sorted((r.question, r.answers) for r in got.collect()) == [("a", ["x"]), ("b", ["z"])]
