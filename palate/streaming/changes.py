"""The change log as a Structured Streaming job.

Each account has a clock that moves once per effective change (a thumb given, turned or cleared; an equal rewrite
moves nothing). A clear leaves a tombstone, which a later thumb on the same key takes away; tombstones older than
the retention raise the account's floor, below which a reader has to read in full.

Tombstones wait in a queue, in the order of the clock. A batch looks at the queue's head alone and goes on only as long as
what it finds there has expired, so its work grows with its events and with what expires, not with what is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "user_id string, event_id long, item_id string, tag string, value int, revision long, floor long"
RETENTION_HOURS = 720


class AccountClock(StatefulProcessor):
    """State: one value for the clock, the floor and the queue's ends; a map from key to what is held or was cleared; a map from
    place in the queue to a tombstone. Events of a micro-batch are taken in event_id order; earlier ids than the last one
    seen are repeats and are ignored. A tombstone that was taken away, or followed by another of its key, stays in
    the queue until its time and then does nothing."""

    def __init__(self, retention_hours: int = RETENTION_HOURS):
        self.retention = pd.Timedelta(hours=retention_hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "revision long, floor long, last long, head long, tail long, newest timestamp")
        self.keys = handle.getMapState("keys", "item_id string, tag string", "value int, revision long")
        self.queue = handle.getMapState("queue", "place long", "item_id string, tag string, revision long, at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        revision, floor, last, head, tail, newest = self.clock.get() if self.clock.exists() else (0, 0, -1, 0, 0, None)
        events = pd.concat(list(rows)).sort_values("event_id", kind="stable")
        out = []
        for e in events.itertuples(index=False):
            if e.event_id <= last:
                continue
            last, newest = int(e.event_id), e.ts if newest is None else max(pd.Timestamp(newest), e.ts)
            at = (e.item_id, e.tag)
            held = self.keys.getValue(at) if self.keys.containsKey(at) else None
            if int(e.value) == (held[0] if held is not None else 0):
                continue
            revision += 1
            self.keys.updateValue(at, (int(e.value), revision))
            if int(e.value) == 0:
                self.queue.updateValue((tail,), (e.item_id, e.tag, revision, e.ts))
                tail += 1
            out.append((key[0], last, e.item_id, e.tag, int(e.value), revision))
        while head < tail:
            item, tag, when, ts = self.queue.getValue((head,))
            if pd.Timestamp(ts) >= pd.Timestamp(newest) - self.retention:
                break
            self.queue.removeKey((head,))
            head += 1
            if self.keys.containsKey((item, tag)) and tuple(self.keys.getValue((item, tag))) == (0, when):
                floor = max(floor, when)
                self.keys.removeKey((item, tag))
        self.clock.update((revision, floor, last, head, tail, newest))
        found = pd.DataFrame(out, columns=["user_id", "event_id", "item_id", "tag", "value", "revision"])
        found["floor"] = floor
        yield found.astype({"event_id": "int64", "value": "int32", "revision": "int64", "floor": "int64"})

    def close(self) -> None:
        pass


def revisions(log: DataFrame, retention_hours: int = RETENTION_HOURS) -> DataFrame:
    """Effective changes with their account's revision, from a stream (user_id, event_id, item_id, tag, value, ts).

    Needs the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass``.
    """
    return log.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=AccountClock(retention_hours), outputStructType=OUTPUT, outputMode="append", timeMode="None"
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
