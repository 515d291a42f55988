from __future__ import annotations

import datetime as dt
import random

from palate.streaming import follows as L


def log(n=80, seed=5):
    rng = random.Random(seed)
    at = dt.datetime(2024, 1, 1)
    return [(k, rng.choice(["insert", "INSERT", "UPDATE", "DELETE", "delete"]), f"u{rng.randrange(5)}", f"u{rng.randrange(5)}", at + dt.timedelta(minutes=k)) for k in range(n)]


LISTENERS = [("u0", None, None), ("u1", None, "u1"), ("u1", "u2", None), ("u2", "u4", "u3"), ("u9", None, None), ("u3", "u3", None)]


def by_hand(changes):
    out = []
    for k, op, a, b, _ in changes:
        for who, only_a, only_b in LISTENERS:
            mine = who in (a, b)
            if op.upper() != "DELETE" and mine and only_a in (None, a) and only_b in (None, b):
                out.append((who, k, op.upper(), a, b))
    return sorted(out)


def told(rows):
    return sorted((r.subscriber, r.change_id, r.op, r.follower_id, r.followed_id) for r in rows)


def test_batch_and_stream_by_hand(spark, tmp_path):
    changes = log()
    listeners = spark.createDataFrame(LISTENERS, "subscriber string, follower_id string, followed_id string")
    assert told(L.follow_events(spark.createDataFrame(changes, L.CHANGES), listeners).collect()) == by_hand(changes)
    for k in range(2):
        spark.createDataFrame(changes[40 * k : 40 * k + 40], L.CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(L.CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = L.follow_events(stream, listeners)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert told(spark.read.parquet(str(tmp_path / "out")).collect()) == by_hand(changes)


def test_a_crafted_filter_shows_nobody_elses(spark):
    changes = [(1, "INSERT", "a", "b", None), (2, "DELETE", "me", "b", None), (3, "INSERT", "me", "me", None)]
    listeners = spark.createDataFrame([("me", "a", "b"), ("me", None, None)], "subscriber string, follower_id string, followed_id string")
    assert told(L.follow_events(spark.createDataFrame(changes, L.CHANGES), listeners).collect()) == [("me", 3, "INSERT", "me", "me")]
