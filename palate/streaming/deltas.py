"""Reading an account's changes since a revision, and applying them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["user_id", "item_id", "tag"]


def changes_since(state: DataFrame, asked: DataFrame, floors: DataFrame) -> DataFrame:
    """What each asker has to apply: (user_id, item_id, tag, value, revision, full).

    state: the last change of every key (user_id, item_id, tag, value, revision), value 0 for a tombstone.
    asked: (user_id, since); floors: (user_id, floor). A full answer holds every thumb and no tombstone.
    """
    latest = state.groupBy("user_id").agg(F.max("revision").alias("latest"))
    known = asked.join(latest, "user_id", "left").join(floors, "user_id", "left")
    full = (
        F.col("since").isNull()
        | (F.col("since") <= 0)
        | (F.col("since") > F.coalesce("latest", F.lit(0)))
        | (F.col("since") < F.coalesce("floor", F.lit(0)))
    )
    told = state.join(known.select("user_id", "since", full.alias("full")), "user_id")
    wanted = F.when(F.col("full"), F.col("value") != 0).otherwise(F.col("revision") > F.col("since"))
    return told.where(wanted).select(*KEYS, "value", "revision", "full")


def apply_changes(held: DataFrame, answer: DataFrame) -> DataFrame:
    """The thumbs held after an answer: replaced by a full one, otherwise without what it touches, plus its thumbs."""
    full = answer.where("full").select("user_id").distinct()
    kept = held.join(full, "user_id", "left_anti").join(answer.select(*KEYS), KEYS, "left_anti")
    return kept.select(*KEYS, "value").unionByName(answer.where("value <> 0").select(*KEYS, "value"))
