"""What is said of things, on DataFrames: thumbs from purchases, what followed accounts say, what everyone says.

The statements that viewers hear are many times the thumbs, so they are never shuffled one by one. Viewers who follow
alike make a share, and thumbs travel once for each share that hears them, with the list of its hearers: to their thing
where each key is worked out by itself, or to the share where a viewer's keys are looked at together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THUMBS_A_TASK = 1 << 16
LINES_A_TASK = 1 << 18
VIEWERS_A_SHARE = 64
THINGS_A_ROW = 1 << 12
STATEMENTS_A_PIECE = 1 << 20  # a share that hears more is dealt over several tasks by thing


def thumbs(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """(user_id, item_id, tag, value): one purchase says something of the thing and, for a third of the pairs of
    customer and thing, of its four attributes. Sums decide, and zero sums are no thumbs."""
    parts = tasks(lineitem, LINES_A_TASK)
    lineitem = lineitem.repartition(parts, "l_orderkey")
    # merged, as orders and parts grow with the lines and are too many, in the end, for each task to hold
    bought = lineitem.join(orders.hint("merge"), lineitem.l_orderkey == orders.o_orderkey).join(part.hint("merge"), lineitem.l_partkey == part.p_partkey)
    kind = F.lower("p_type")
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    cut = F.lit(5) - F.round(F.col("l_discount") * 100).cast("int")
    item = F.concat("p_name", F.lit(" "), kind)
    tagged = (F.col("o_custkey") + F.length(item)) % 3 == 0
    rows = bought.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("user_id"), item.alias("item_id"), F.length("p_name").alias("name"),
        F.when(tagged, F.lower("p_brand")).alias("brand"), flag.cast("byte").alias("flag"), F.when(tagged, cut).alias("cut"), F.coalesce(tagged, F.lit(False)).alias("tagged"),
    )
    # what one account says of one thing meets in one task, before it is written out: a thing's name tells its attributes
    rows = rows.repartition(parts, "user_id", "item_id")
    words = F.split(F.substring("item_id", F.lit(1), F.col("name")), " ")
    says = lambda tag, value: F.struct(tag.alias("tag"), value.alias("v"))
    of_it = [F.col("brand"), F.coalesce(F.get(words, 0), F.lit("")), F.coalesce(F.get(words, 1), F.lit("")), F.substring("item_id", F.col("name") + 2, F.length("item_id"))]
    # a thing's own statement and an attribute that happens to be '' stay apart, as they are decided apart
    own = F.struct(F.lit("").alias("tag"), F.col("flag").cast("int").alias("v"), F.lit(True).alias("own"))
    tags = F.transform(F.array(*(says(t, F.col("cut")) for t in of_it)), lambda t: F.struct(t["tag"], t["v"], F.lit(False).alias("own")))
    every = F.when(F.col("tagged"), F.concat(F.array(own), tags)).otherwise(F.array(own))
    rows = rows.select("user_id", "item_id", F.inline(every))
    sums = rows.groupBy("user_id", "item_id", "tag", "own").agg(F.sum("v").alias("s")).where("s <> 0")
    return sums.select("user_id", "item_id", "tag", F.when(F.col("s") > 0, 1).otherwise(-1).alias("value"))


def _means(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, tag, n, s, m) from statements (*keys, tag, value): count, sum and smoothed mean. A thing of which only
    attributes are said gets an entry of its own with nothing in it."""
    counts = rows.groupBy(*keys, "tag").agg(F.count("value").alias("n"), F.sum("value").cast("long").alias("s"))
    every = F.collect_list(F.struct("tag", "n", "s"))
    empty = F.struct(F.lit("").alias("tag"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"))
    things = counts.groupBy(*keys).agg(every.alias("all"))
    whole = F.when(F.exists("all", lambda x: x["tag"] == ""), F.col("all")).otherwise(F.concat("all", F.array(empty)))
    found = things.select(*keys, F.inline(whole))
    return found.withColumn("m", F.col("s").cast("double") / (F.col("n") + 2))


def tasks(rows: DataFrame, each: int = THUMBS_A_TASK) -> int:
    """In how many parts to deal what grows with ``rows``, so that no task does."""
    return rows.count() // each + 1


def shares(follows: DataFrame) -> DataFrame:
    """(viewer, share): viewers whose follows have the same least hash, as the more have the more they follow alike, so many
    that a share stays small."""
    least = follows.where("followed_id IS NOT NULL").groupBy(F.col("follower_id").alias("viewer")).agg(F.min(F.xxhash64("followed_id")).alias("least"))
    sizes = least.groupBy("least").agg(F.count("*").alias("size"))
    salt = F.pmod(F.xxhash64("viewer"), F.floor(F.col("size") / VIEWERS_A_SHARE) + 1)
    return least.join(sizes, "least").select("viewer", F.xxhash64("least", salt).alias("share"))


@dataclass(frozen=True)
class Own:
    """Of the thumbs themselves, those that meet their author too: with a tag that ``of`` holds of, of followers or of everybody."""

    of: Callable[[Column], Column] | None = None
    everybody: bool = False


def _packed(thumbs_: DataFrame, follows: DataFrame, own: DataFrame | Own | None, parts: int, near: bool = False) -> DataFrame:
    """(item_id, share, piece, pieces, who, viewers, says, own): every account's statements about a thing, once for each share
    of those that hear them, dealt by (item_id, share), or with ``near`` by (share, piece), so that all a viewer hears
    meets unless its share hears very much. ``own``: statements that meet their own author too; where they are
    some of the thumbs (``Own``, with ``near`` only), they are not sent a second time to a share that hears them anyway."""
    pack = lambda x: x.repartition(parts, "user_id").groupBy("user_id", "item_id").agg(F.array_agg(F.struct("tag", "value")).alias("says"))
    told = (lambda x: _told(pack(x))) if near else pack
    held = "told" if near else "says"
    dealt = shares(follows)
    edges = follows.where("followed_id IS NOT NULL").join(dealt, F.col("follower_id").eqNullSafe(F.col("viewer"))).select("follower_id", "followed_id", "share")
    if near:
        weights = thumbs_.groupBy("user_id").agg(F.count("*").alias("told"))
        heard = edges.join(weights, F.col("followed_id") == F.col("user_id")).groupBy("share").agg(F.sum("told").alias("told"))
        pieces = (F.floor(F.col("told") / STATEMENTS_A_PIECE) + 1).cast("int").alias("pieces")
        heard = heard.select(F.col("share").alias("of"), pieces)
        dealt = dealt.join(heard, F.col("share") == F.col("of"), "left").select("viewer", "share", F.coalesce("pieces", F.lit(1)).alias("pieces"))
        edges = edges.join(heard, F.col("share") == F.col("of")).drop("of")
    else:
        dealt, edges = dealt.withColumn("pieces", F.lit(1)), edges.withColumn("pieces", F.lit(1))
    edges = edges.select("followed_id", "share", "pieces", "follower_id", F.lit(False).alias("own"))
    itself = isinstance(own, Own)
    if itself:
        alone = F.lit(None).cast("string").alias("follower_id"), F.lit(True).alias("own")
        edges = edges.unionByName(dealt.where("viewer IS NOT NULL").select(F.col("viewer").alias("followed_id"), "share", "pieces", *alone))
        if own.everybody:
            others = thumbs_.where("user_id IS NOT NULL").select("user_id").distinct().join(dealt, F.col("user_id") == F.col("viewer"), "left_anti")
            edges = edges.unionByName(others.select(F.col("user_id").alias("followed_id"), F.xxhash64("user_id").alias("share"), F.lit(1).alias("pieces"), *alone))
    hearers = F.transform(F.filter(F.collect_list(F.struct("follower_id", "own")), lambda x: ~x["own"]), lambda x: x["follower_id"])
    edges = edges.repartition(parts, "followed_id").groupBy("followed_id", "share", "pieces").agg(hearers.alias("viewers"), F.max("own").alias("own"))
    item = [] if near else ["item_id"]
    found = told(thumbs_).join(edges, F.col("user_id") == F.col("followed_id"))
    found = found.select(*item, "share", "pieces", F.col("user_id").alias("who"), "viewers", held, "own")
    if itself and own.everybody:  # nobody hears who has no name
        nameless = told(thumbs_.where("user_id IS NULL"))
        found = found.unionByName(nameless.select(F.xxhash64("user_id").alias("share"), F.lit(1).alias("pieces"), F.col("user_id").alias("who"), F.array().cast("array<string>").alias("viewers"), held, F.lit(True).alias("own")))
    elif own is not None and not itself:
        mine = told(own).join(dealt, F.col("user_id") == F.col("viewer"), "left")
        share, pieces = F.coalesce("share", F.xxhash64("user_id")).alias("share"), F.coalesce("pieces", F.lit(1)).alias("pieces")
        found = found.unionByName(mine.select(*item, share, pieces, F.col("user_id").alias("who"), F.array("user_id").alias("viewers"), held, F.lit(True).alias("own")))
    if not near:
        return found.withColumn("piece", F.lit(0)).repartition(parts, "item_id", "share")
    # what one account says goes to a piece in one row
    piece = lambda t: F.pmod(F.xxhash64(t["item_id"]), F.col("pieces")).cast("int")
    pieces = F.array_distinct(F.transform("told", piece))
    apart = F.transform(pieces, lambda p: F.struct(p.alias("piece"), F.filter("told", lambda t: piece(t) == p).alias("told")))
    whole = F.array(F.struct(F.lit(0).alias("piece"), F.col("told").alias("told")))
    found = found.select("share", "pieces", "who", "viewers", "own", F.inline(F.when(F.col("pieces") == 1, whole).otherwise(apart)))
    found = found.repartition(parts, "share", "piece").select("share", "pieces", "who", "viewers", "own", "piece", F.inline("told"))
    says = F.arrays_zip(F.col("tags").alias("tag"), F.col("values").alias("value")).alias("says")
    found = found.select("item_id", "share", "pieces", "piece", "who", "viewers", says, "own")
    if not itself:
        return found
    kept = F.filter("says", lambda x: own.of(x["tag"])) if own.of else F.col("says")
    heard = F.struct("viewers", "says", F.lit(False).alias("own"))
    ways = F.when(F.col("own"), F.array(heard, F.struct(F.array("who").alias("viewers"), kept.alias("says"), F.lit(True).alias("own")))).otherwise(F.array(heard))
    return found.select("item_id", "share", "pieces", "piece", "who", F.inline(ways))


def _told(packed: DataFrame) -> DataFrame:
    """(user_id, told): what an account says of up to about ``THINGS_A_ROW`` things in one row, names and values apart, so that
    who hears it is not repeated for each thing and rows stay bounded."""
    things = F.count("*").over(Window.partitionBy("user_id"))
    slot = F.pmod(F.xxhash64("item_id"), F.floor(things / THINGS_A_ROW) + 1).alias("slot")
    each = F.struct("item_id", F.transform("says", lambda x: x["tag"]).alias("tags"), F.transform("says", lambda x: x["value"]).alias("values"))
    return packed.select("user_id", each.alias("each"), slot).groupBy("user_id", "slot").agg(F.collect_list("each").alias("told")).drop("slot")


def _listed(name: str) -> Column:
    """All values, nulls too."""
    return F.transform(F.collect_list(F.struct(F.col(name).alias("x"))), lambda s: s["x"])


def opinions(thumbs_: DataFrame, follows: DataFrame, own: DataFrame | Own | None = None, near: bool = False) -> DataFrame:
    """(share, piece, pieces, viewer, item_id, tag, n, s, m, heard, up, down): what the accounts a viewer follows say, and how
    often the viewer does (``up``, ``down``; of ``own``). Where nothing is heard, ``m`` is null.

    What is heard is many times the thumbs, so statements travel once for a share of their hearers, and every key is
    summed where it is written out. The result lies by (item_id, share), with ``near`` by (share, piece): a grouping by these
    and more needs no shuffle, and with ``near`` one by viewer little."""
    found = _packed(thumbs_, follows, own, tasks(thumbs_), near)
    # a thing of which only attributes are heard gets an entry of its own with nothing in it
    nothing = F.array(F.struct(F.lit("").alias("tag"), F.lit(None).cast("int").alias("value")))
    says = F.when(F.col("own") | F.exists("says", lambda x: x["tag"] == ""), F.col("says")).otherwise(F.concat("says", nothing))
    dealt = ["share", "piece", "pieces"]
    rows = found.select("item_id", *dealt, "own", says.alias("says"), F.explode("viewers").alias("viewer"))
    rows = rows.select("item_id", *dealt, "own", "viewer", F.inline("says"))
    keys = [*dealt, "viewer", "item_id", "tag"]
    mine, theirs = F.col("own"), ~F.col("own")
    if own is None:
        sums = rows.groupBy(*keys).agg(F.count("value").alias("n"), F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("s"))
        return sums.withColumn("m", F.col("s").cast("double") / (F.col("n") + 2))
    # null equals nothing, so there own and heard statements do not meet
    apart = mine & (F.col("item_id").isNull() | F.col("viewer").isNull() | F.col("tag").isNull())
    sums = rows.groupBy(*keys, apart.alias("apart")).agg(
        F.count(F.when(theirs, F.col("value"))).alias("n"),
        F.coalesce(F.sum(F.when(theirs, F.col("value"))), F.lit(0)).cast("long").alias("s"),
        F.count(F.when(theirs, 1)).alias("heard"),
        F.count(F.when(mine & (F.col("value") > 0), 1)).alias("up"),
        F.count(F.when(mine & (F.col("value") < 0), 1)).alias("down"),
    )
    m = F.when(F.col("heard") > 0, F.col("s").cast("double") / (F.col("n") + 2))
    return sums.select(*keys, "n", "s", m.alias("m"), "heard", "up", "down")


def said(thumbs_: DataFrame, follows: DataFrame) -> DataFrame:
    """(viewer, item_id, tag, n, s, m): what the accounts a viewer follows say."""
    return opinions(thumbs_, follows).select("viewer", "item_id", "tag", "n", "s", "m")


def scored(found: DataFrame) -> DataFrame:
    """``opinions`` with conf, score and applies, null where nothing is heard."""
    score = F.when(F.col("m").isNotNull(), F.greatest(F.least("m", F.lit(1 - 1e-9)), F.lit(-1 + 1e-9)))
    found = found.withColumn("conf", F.col("n")).withColumn("score", score)
    return found.withColumn("applies", F.when(F.col("tag") == "", F.lit(1.0)).otherwise((1 + F.col("score")) / 2))


def own_values() -> Column:
    """The viewer's own statements of a key, one after the other; empty without one."""
    return F.concat(F.array_repeat(F.lit(1), F.col("up").cast("int")), F.array_repeat(F.lit(-1), F.col("down").cast("int")))


def _heard(packed: DataFrame) -> DataFrame:
    """A row for each statement and hearer."""
    rows = packed.select("item_id", "share", "piece", "who", "own", "says", F.explode("viewers").alias("viewer"))
    return rows.select("item_id", "share", "piece", "who", "own", "viewer", F.inline("says"))


def agreement(thumbs_: DataFrame, follows: DataFrame) -> DataFrame:
    """(a, b, shared, agreement): of how many things both a viewer and an account it follows say something, and how often
    the same."""
    things = thumbs_.where("tag = '' AND item_id IS NOT NULL")
    rows = _heard(_packed(things, follows, Own(), tasks(things), near=True))
    key = Window.partitionBy("share", "piece", "item_id", "viewer")
    mine = lambda sign: F.count(F.when(F.col("own") & (F.col("value") == sign), 1)).over(key)
    rows = rows.withColumn("up", mine(1)).withColumn("down", mine(-1)).where("NOT own AND up + down > 0")
    alike = F.when(F.col("value") > 0, F.col("up")).otherwise(F.col("down"))
    sums = rows.groupBy("viewer", "who").agg(F.sum(F.col("up") + F.col("down")).alias("shared"), F.sum(alike).alias("alike"))
    return sums.select(F.col("viewer").alias("a"), F.col("who").alias("b"), "shared", F.round(F.col("alike") / F.col("shared"), 6).alias("agreement"))


def departures(thumbs_: DataFrame, follows: DataFrame) -> DataFrame:
    """(viewer, who, cells, departure): how far what an account says, or the viewer, departs from the means, summed. The
    mean of a key is worked out beside its statements."""
    rows = _heard(_packed(thumbs_, follows, Own(), tasks(thumbs_), near=True))
    key = Window.partitionBy("share", "piece", "item_id", "viewer", "tag")
    theirs = F.when(~F.col("own"), F.col("value"))
    m = F.coalesce(F.sum(theirs).over(key), F.lit(0)).cast("double") / (F.count(theirs).over(key) + 2)
    known = F.col("item_id").isNotNull() & F.col("tag").isNotNull() & F.col("viewer").isNotNull()
    rows = rows.withColumn("d", F.col("value") - F.when(known, m).otherwise(0.0))
    sums = rows.groupBy("viewer", "who").agg(F.count("*").alias("cells"), F.sum("d").alias("d"))
    return sums.select("viewer", "who", "cells", (F.round("d", 6) + 0.0).alias("departure"))


def visible(thumbs_: DataFrame, follows: DataFrame) -> DataFrame:
    """(viewer, thumbs): how many statements a viewer may read, its own and those of the accounts followed. Each is one
    account's, so accounts are counted first and only counts travel. A named attribute of a thing comes once for each
    account (``thumbs`` sums it up); what has no name may come as the thing itself and as an attribute, and counts once."""
    nameless = F.coalesce("tag", F.lit("")) == ""
    named = thumbs_.where(~nameless).groupBy("user_id").agg(F.count("*").alias("thumbs"))
    others = thumbs_.where(nameless).select("user_id", "item_id", "tag").distinct().groupBy("user_id").agg(F.count("*").alias("thumbs"))
    counts = named.unionByName(others).groupBy("user_id").agg(F.sum("thumbs").alias("thumbs"))
    edges = follows.select(F.col("follower_id").alias("viewer"), F.col("followed_id").alias("user_id"))
    edges = edges.unionByName(counts.select(F.col("user_id").alias("viewer"), "user_id")).distinct()
    # an account without a name is read by itself alone
    edges = edges.where("user_id IS NOT NULL OR viewer IS NULL")
    return edges.join(counts, edges.user_id.eqNullSafe(counts.user_id)).groupBy("viewer").agg(F.sum("thumbs").alias("thumbs"))


def everyone(thumbs_: DataFrame) -> DataFrame:
    """(item_id, tag, n, m): what all accounts say."""
    return _means(thumbs_.select("item_id", "tag", "value"), ["item_id"]).select("item_id", "tag", "n", "m")


def squared_size(thumbs_: DataFrame, follows: DataFrame) -> DataFrame:
    """(viewer, cells, size): how far a viewer's statements and those heard depart from the means, squared and summed.
    Over the n statements of a key, each +1 or -1 and s together, that is n - 2 m s + n m^2: what is heard needs no
    second look."""
    found = opinions(thumbs_, follows, Own(), near=True)
    m = F.when(F.col("item_id").isNotNull() & F.col("tag").isNotNull() & F.col("viewer").isNotNull(), F.coalesce("m", F.lit(0.0))).otherwise(0.0)
    n, s = F.col("n") + F.col("up") + F.col("down"), F.col("s") + F.col("up") - F.col("down")
    found = found.select("viewer", n.alias("cells"), (n - 2 * m * s + n * m**2).alias("size"))
    sums = found.groupBy("viewer").agg(F.sum("cells").alias("cells"), F.round(F.sum("size"), 6).alias("size"))
    return sums.where("cells > 0")


def held(log: DataFrame) -> DataFrame:
    """(user_id, item_id, tag, value, event_id): the last write of each key, where it isn't a clearing."""
    last = F.max(F.struct("event_id", "value")).alias("last")
    found = log.groupBy("user_id", "item_id", "tag").agg(last)
    return found.where("last.value <> 0").select("user_id", "item_id", "tag", "last.value", "last.event_id")
