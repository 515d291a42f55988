"""Follows as they come: a stream of changes of the follow graph, dealt out to those who may hear of them.

Only inserts and updates go out. What is deleted can no longer be shown to be anybody's own, so it is not sent; who is
unfollowed learns of it on the next full read. A follow reaches its two ends and nobody else, and of those only who
listens. A listener may narrow what they hear by a filter of their own, which never widens it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGES = "change_id long, op string, follower_id string, followed_id string, ts timestamp"


def follow_events(changes: DataFrame, listeners: DataFrame) -> DataFrame:
    """(subscriber, change_id, op, follower_id, followed_id, ts) of a stream or table of ``changes`` (``CHANGES``).

    listeners (subscriber, follower_id, followed_id): a row each, with null for an end they do not filter by. Who listens
    with several rows hears a change once for each that lets it through. Every change meets at most its two ends, so a
    batch makes no more rows than twice its own, times the rows of one listener; listeners are joined by key."""
    sent = changes.where(F.upper("op").isin("INSERT", "UPDATE"))
    ends = F.array_distinct(F.array("follower_id", "followed_id"))
    dealt = sent.withColumn("subscriber", F.explode(ends))
    asked = listeners.select("subscriber", F.col("follower_id").alias("only_follower"), F.col("followed_id").alias("only_followed"))
    heard = dealt.join(asked, "subscriber")
    heard = heard.where("(only_follower IS NULL OR only_follower = follower_id) AND (only_followed IS NULL OR only_followed = followed_id)")
    return heard.select("subscriber", "change_id", F.upper("op").alias("op"), "follower_id", "followed_id", "ts")
