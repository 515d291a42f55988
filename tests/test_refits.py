from __future__ import annotations

import random

import pytest

from palate.operators import taste
from palate.streaming import refits as R

LOG = "event_id long, user_id string, item_id string, tag string, value int"


def events(seed, n=90):
    rng = random.Random(seed)
    return [(e, f"u{rng.randrange(6)}", f"i{rng.randrange(4)}", rng.choice(["", "", "cosy"]), rng.choice([1, -1, 1, 0])) for e in range(n)]


FOLLOWS = [(f"u{a}", f"u{(a + d) % 6}") for a in range(5) for d in (1, 2)] + [("w", "u0")]


def whole(spark, rows, follows):
    """All scores from what the log leaves, at once."""
    held = {}
    for _, user, item, tag, value in sorted(rows):
        held[user, item, tag] = value
    thumbs = spark.createDataFrame([(*k, v) for k, v in held.items() if v], "user_id string, item_id string, tag string, value int")
    return scores(taste.taste(thumbs, follows).where("kind = 'score'"))


def scores(df):
    return {(r.viewer, r.item_id, r.tag): (pytest.approx(r.score, abs=1e-9), r.conf) for r in df.collect()}


def plain(df):
    return {(r.viewer, r.item_id, r.tag): (r.score, r.conf) for r in df.collect()}


def test_every_prefix_equals_a_full_recomputation(spark, tmp_path):
    log, follows = events(1), spark.createDataFrame(FOLLOWS, "follower_id string, followed_id string")
    tables = R.Versions(spark, f"file://{tmp_path}/t", buckets=4)
    cuts = [0, 40, 41, 90]
    for version, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = spark.createDataFrame(log[a:b], LOG)
        assert R.apply_batch(part, version, follows, tables)
        assert plain(tables.read("scores", R.SCORES)) == whole(spark, log[:b], follows)
    before = tables.commits().count(), plain(tables.read("scores", R.SCORES))
    assert not R.apply_batch(spark.createDataFrame(log[41:90], LOG), 2, follows, tables)  # given again
    assert (tables.commits().count(), plain(tables.read("scores", R.SCORES))) == before
    late = spark.createDataFrame([(2, *log[50][1:4], 1)], LOG)  # older than what the key holds
    assert R.apply_batch(late, 3, follows, tables)
    assert plain(tables.read("scores", R.SCORES)) == before[1]


def test_what_a_failed_batch_left_is_not_read(spark, tmp_path, monkeypatch):
    log, follows = events(2, 40), spark.createDataFrame(FOLLOWS, "follower_id string, followed_id string")
    tables = R.Versions(spark, f"file://{tmp_path}/t", buckets=2)
    R.apply_batch(spark.createDataFrame(log[:20], LOG), 0, follows, tables)
    before = plain(tables.read("scores", R.SCORES))
    with monkeypatch.context() as m:
        m.setattr(R.Versions, "commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            R.apply_batch(spark.createDataFrame(log[20:], LOG), 1, follows, tables)
    assert plain(tables.read("scores", R.SCORES)) == before
    R.apply_batch(spark.createDataFrame(log[20:], LOG), 1, follows, tables)
    assert plain(tables.read("scores", R.SCORES)) == whole(spark, log, follows)


def test_only_those_touched_are_fitted(spark, tmp_path, monkeypatch):
    follows = spark.createDataFrame([("a", "x"), ("b", "y"), ("x", "y")], "follower_id string, followed_id string")
    tables, fitted = R.Versions(spark, f"file://{tmp_path}/t", buckets=3), []
    whole_taste = taste.taste
    monkeypatch.setattr(taste, "taste", lambda thumbs, edges, rank: fitted.append({r.follower_id for r in edges.collect()}) or whole_taste(thumbs, edges, rank))
    for version, rows in enumerate([[(1, "x", "i", "", 1), (2, "y", "i", "", 1)], [(3, "x", "i", "", -1)], [(4, "x", "i", "", -1)], [(5, "y", "j", "", 1)]]):
        R.apply_batch(spark.createDataFrame(rows, LOG), version, follows, tables)
    assert fitted == [{"a", "b", "x"}, {"a", "x"}, set(), {"b", "x"}]


def test_stream(spark, tmp_path):
    log, follows = events(3, 60), spark.createDataFrame(FOLLOWS, "follower_id string, followed_id string")
    for k in range(2):
        spark.createDataFrame(log[30 * k : 30 * k + 30], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = R.keep_scores(stream, follows, f"file://{tmp_path}/t", f"file://{tmp_path}/ck", buckets=4)
    query.awaitTermination(240)
    assert query.exception() is None
    tables = R.Versions(spark, f"file://{tmp_path}/t", buckets=4)
    assert plain(tables.read("scores", R.SCORES)) == whole(spark, log, follows)
    assert tables.commits().select("version").distinct().count() == 2
