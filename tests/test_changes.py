from __future__ import annotations

import random

import pandas as pd
import pytest

from palate.sources.derived import table
from palate.streaming import changes, deltas


def model(events):
    """(events with their revision, final thumbs) by definition."""
    held, clock, out = {}, {}, []
    for e, user, item, tag, value in sorted(events):
        key = (user, item, tag)
        if held.get(key, 0) != value:
            clock[user] = clock.get(user, 0) + 1
            held[key] = value
            out.append((user, e, clock[user]))
    return out, {k: v for k, v in held.items() if v}


def test_stream_equals_batch(spark, small, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", changes.ROCKSDB)
    log = table(spark, small, "log")
    for k in range(3):  # three micro-batches, in order
        log.where(f"event_id between {k * 334} and {k * 334 + 333}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        changes.revisions(stream, retention_hours=100_000)
        .writeStream.format("memory").queryName("revisions_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    got = sorted((r.user_id, r.event_id, r.revision) for r in spark.sql("select * from revisions_out").collect())
    want, _ = model([(r.event_id, r.user_id, r.item_id, r.tag, r.value) for r in log.collect()])
    assert got == sorted(want) and got


class Counted(dict):
    """A map state that counts what it is asked."""

    reads = 0

    def containsKey(self, k):  # noqa: N802
        self.reads += 1
        return k in self

    def getValue(self, k):  # noqa: N802
        self.reads += 1
        return self[k]

    def updateValue(self, k, v):  # noqa: N802
        self[k] = v

    def removeKey(self, k):  # noqa: N802
        del self[k]


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, v):
        self.held = v


def clock_of(hours):
    clock = changes.AccountClock(hours)
    clock.clock, clock.keys, clock.queue = Value(), Counted(), Counted()
    return clock


def batch(rows):
    frame = pd.DataFrame(rows, columns=["event_id", "item_id", "tag", "value", "ts"])
    frame["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(frame["ts"], unit="h")
    return frame


def test_expiry_costs_what_expires():
    clock = clock_of(100)
    list(clock.handleInputRows(("u",), iter([batch([(k, f"i{k}", "", 1, 0) for k in range(500)])]), None))
    list(clock.handleInputRows(("u",), iter([batch([(500, "i0", "", 0, 1), (501, "i1", "", 0, 150), (502, "i0", "", 1, 150)])]), None))
    before = clock.keys.reads + clock.queue.reads
    (out,) = clock.handleInputRows(("u",), iter([batch([(503, "i2", "", -1, 240)])]), None)
    assert clock.keys.reads + clock.queue.reads - before <= 4  # the event's key and the queue's head
    assert out.floor.tolist() == [0]  # the first tombstone was taken away again, the second is young
    before = clock.keys.reads + clock.queue.reads
    (out,) = clock.handleInputRows(("u",), iter([batch([(504, "i2", "", 1, 251)])]), None)
    assert out.floor.tolist() == [502] and len(clock.keys) == 499 and clock.keys.reads + clock.queue.reads - before <= 6


@pytest.mark.parametrize("seed", range(4))
def test_floor_by_the_definition(seed):
    """The floor is the last revision among the clears that are older than the retention and still stand."""
    rng = random.Random(seed)
    clock, at, log, floor = clock_of(40), 0, [], 0
    held, revision = {}, 0
    for e in range(200):
        at += rng.randrange(4)
        log.append((e, f"i{rng.randrange(5)}", rng.choice(["", "t"]), rng.choice([1, -1, 0]), at))
    for a in range(0, 200, 23):
        part = log[a : a + 23]
        out = pd.concat(clock.handleInputRows(("u",), iter([batch(part)]), None))
        for _, item, tag, value, ts in part:
            if held.get((item, tag), (0,))[0] != value:
                revision += 1
                held[item, tag] = (value, revision, ts)
        for key, (value, when, ts) in list(held.items()):
            if value == 0 and ts < part[-1][4] - 40:
                floor = max(floor, when)
                del held[key]
        assert set(out.floor) <= {floor} and clock.clock.get()[:2] == (revision, floor)
        assert {k: v for k, v in clock.keys.items()} == {k: v[:2] for k, v in held.items()}


@pytest.mark.parametrize("seed", range(3))
def test_deltas_fold_to_the_full_read(spark, seed):
    rng = random.Random(seed)
    events = [(e, f"u{rng.randrange(2)}", f"i{rng.randrange(4)}", "", rng.choice([1, -1, 0])) for e in range(60)]
    _, want = model(events)

    def state(upto):
        out, _ = model(events[:upto])
        last = {}
        for user, e, revision in out:
            _, _, item, tag, value = events[e]
            last[user, item, tag] = (user, item, tag, value, revision)
        return list(last.values())

    schema = "user_id string, item_id string, tag string, value int, revision long"
    held = spark.createDataFrame([], "user_id string, item_id string, tag string, value int")
    since: dict = {}
    for upto in (20, 35, 60):
        rows = state(upto)
        asked = spark.createDataFrame([(u, since.get(u)) for u in ("u0", "u1")], "user_id string, since long")
        floors = spark.createDataFrame([("u1", 10 if upto == 60 else 0)], "user_id string, floor long")
        answer = deltas.changes_since(spark.createDataFrame(rows, schema), asked, floors)
        held = spark.createDataFrame(deltas.apply_changes(held, answer).collect(), held.schema)
        since = {u: max((r[4] for r in rows if r[0] == u), default=0) for u in ("u0", "u1")}
    assert {(r.user_id, r.item_id, r.tag): r.value for r in held.collect()} == want
