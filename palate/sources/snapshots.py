"""Snapshots and results as JSON texts, one for each viewer.

A snapshot is ``{users, follows: {user: [user]}, ratings: {user: {ratable: 1 or -1}}}``; a ratable is a thing, or a
thing and an attribute with a NUL between. A result is ``{viewer, scores: {ratable: {score, confidence, applies}},
plot: {things: {name: point}, attributes: {name: point}}}``. A text holds what one viewer hears and is one cell of a
row; viewers are spread over tasks.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import opinions

JOIN = "\0"
SCHEMA = "struct<users: array<string>, follows: map<string, array<string>>, ratings: map<string, map<string, variant>>>"


def ratable(item: Column, tag: Column) -> Column:
    return F.when(tag == "", item).otherwise(F.concat(item, F.lit(JOIN), tag))


def write_snapshots(thumbs: DataFrame, follows: DataFrame) -> DataFrame:
    """(viewer, text): for each account that follows others its own thumbs and those of the accounts it follows."""
    edges = follows.select(F.col("follower_id").alias("viewer"), F.col("followed_id").alias("user_id")).distinct()
    own = edges.select("viewer", F.col("viewer").alias("user_id")).distinct()
    who = edges.unionByName(own).distinct()
    # an account's ratings are put together and spelled once, not once for each of its readers, and travel once for those
    # who follow alike
    rated = F.map_from_entries(F.collect_list(F.struct(ratable(F.col("item_id"), F.col("tag")), "value")))
    ratings = thumbs.groupBy("user_id").agg(F.to_json(rated).alias("rated"))
    dealt = who.join(opinions.shares(follows), "viewer", "left").withColumn("share", F.coalesce("share", F.xxhash64("viewer")))
    readers = dealt.groupBy("user_id", "share").agg(F.collect_list("viewer").alias("viewers"))
    per_share = readers.join(ratings, "user_id", "left").withColumn("rated", F.coalesce("rated", F.lit("{}"))).repartition(opinions.tasks(thumbs), "share")
    per_user = per_share.select("share", "user_id", "rated", F.explode("viewers").alias("viewer"))
    followed = F.array_sort(F.collect_list(F.when(F.col("user_id") != F.col("viewer"), F.col("user_id"))))
    spelled = F.concat(_spelled(F.col("user_id")), F.lit(":"), F.col("rated"))
    whole = per_user.groupBy("share", "viewer").agg(F.array_sort(F.collect_list("user_id")).alias("users"), followed.alias("followed"), F.collect_list(spelled).alias("ratings"))
    follows_ = F.concat(_spelled(F.col("viewer")), F.lit(":"), F.to_json("followed"))
    parts = [F.lit('{"users":'), F.to_json("users"), F.lit(',"follows":{'), follows_, F.lit('},"ratings":{'), F.array_join("ratings", ","), F.lit("}}")]
    return whole.select("viewer", F.concat(*parts).alias("text"))


def _spelled(name: Column) -> Column:
    """A text as JSON spells it."""
    listed = F.to_json(F.array(name))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _named(rows: DataFrame) -> DataFrame:
    """Those ``rows`` whose item_id and tag can be names, the tag also ''; each name is looked at once a batch, where rows lie."""

    def run(batches):
        known = lru_cache(1 << 18)(text.is_normalized)
        for batch in batches:
            ok = None
            for name, bare in (("item_id", False), ("tag", True)):
                coded = batch.column(name).dictionary_encode()
                fine = pa.array([bare and x == "" or x is not None and known(x) for x in coded.dictionary.to_pylist()] or [False])
                mask = fine.take(coded.indices).fill_null(False)
                ok = mask if ok is None else pc.and_(ok, mask)
            yield batch.filter(ok)

    return rows.mapInArrow(run, rows.schema)


def read_snapshots(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(follows, thumbs) of snapshots (viewer, text), sanitised: (viewer, follower_id, followed_id) and (viewer, user_id,
    item_id, tag, value). Values other than 1 and -1 and names that can be none are dropped."""
    read = texts.select("viewer", F.from_json("text", SCHEMA).alias("s"))
    follows = read.select("viewer", F.explode("s.follows").alias("follower_id", "all")).select("viewer", "follower_id", F.explode("all").alias("followed_id"))
    rated = read.select("viewer", F.explode("s.ratings").alias("user_id", "all")).select("viewer", "user_id", F.explode("all").alias("ratable", "value"))
    # only what is a number in the text: neither "1" nor true
    number = F.when(~F.schema_of_variant("value").isin("STRING", "BOOLEAN"), F.try_variant_get("value", "$", "double"))
    rated = rated.where(number.isin(1.0, -1.0)).withColumn("parts", F.split("ratable", JOIN, 2))
    rated = rated.select(
        "viewer", "user_id", F.col("parts")[0].alias("item_id"), F.coalesce(F.get("parts", F.lit(1)), F.lit("")).alias("tag"), F.size("parts").alias("n"), number.cast("int").alias("value")
    )
    good = _named(rated).where((F.col("n") == 1) | (F.col("tag") != ""))
    return follows.distinct(), good.select("viewer", "user_id", "item_id", "tag", "value")


def write_results(fitted: DataFrame, *keys: str) -> DataFrame:
    """(viewer, text) of fitted rows (kind 'score' or 'plot', see ``operators.taste``). ``keys``: by what rows lie, where all
    of a viewer have the same of it, so that they are put together where they are."""
    score = F.struct("score", F.col("conf").alias("confidence"), "applies")
    of = lambda when, key, value: F.map_from_entries(F.collect_list(F.when(when, F.struct(key.alias("key"), value.alias("value")))))
    thing = (F.col("kind") == "plot") & F.col("item_id").isNotNull()
    attribute = (F.col("kind") == "plot") & F.col("tag").isNotNull()
    maps = fitted.where("kind in ('score', 'plot')").groupBy(*keys, "viewer").agg(
        of(F.col("kind") == "score", ratable(F.col("item_id"), F.col("tag")), score).alias("scores"),
        of(thing, F.col("item_id"), F.col("point")).alias("things"),
        of(attribute, F.col("tag"), F.col("point")).alias("attributes"),
    )
    return maps.select("viewer", F.to_json(F.struct("viewer", "scores", F.struct("things", "attributes").alias("plot"))).alias("text"))
