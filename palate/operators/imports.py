"""The bulk import: many accounts' chunks written at once, as if one after the other.

A chunk (a *call*) is an array of things ``(id, search_id, source, ref, value)``: the name a thing would get, its folded
copy, its link to a public index, and the thumb. The thumb goes on whatever holds the link. Otherwise the name is made, if
it is new, and given the link, if it has none; a name that holds another link is refused. Calls are ordered by number, and
what one of them has made the later ones find.

That order matters in one place only: who gets a free name or a free link. Taking pairs (name, link) in order, each if
neither is taken yet, is a greedy matching. It is worked out in rounds (``matched``): a pair that comes first both among
those of its name and among those of its link is taken, whatever the others do; then all pairs that share a name or a link
with a taken one go, and the rest make up the next round. Every round takes the first pair left of each connected group, so
most batches need few.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources import store

CHUNK, LIMIT, OPEN_HOURS, EVERY_HOURS = 500, 10_000, 24, 720
LINK = ["source", "ref"]


@dataclass
class Store:
    """What is stored before. Names: items (id), links (item_id, source, ref; one a name, one a link), thumbs (user_id,
    item_id, tag, value), imports (user_id, service, started_at, thumbs), removed (id), removed_refs (source, ref), patterns
    (source, pattern), services (service), unlocked (user_id)."""

    items: DataFrame
    links: DataFrame
    thumbs: DataFrame
    imports: DataFrame
    removed: DataFrame
    removed_refs: DataFrame
    patterns: DataFrame
    services: DataFrame
    unlocked: DataFrame


@dataclass
class Imported:
    """What a batch writes: names (id, search_id, created_by), links (item_id, source, ref, created_by), thumbs (user_id,
    item_id, tag, value), imports (user_id, service, started_at, thumbs; those of the batch, gone if nothing was written) and
    counts, a row a call: status 'done', or why nothing of it was looked at, and saved, kept, refused, over, left."""

    names: DataFrame
    links: DataFrame
    thumbs: DataFrame
    imports: DataFrame
    counts: DataFrame


def matched(pairs: DataFrame) -> DataFrame:
    """The greedy matching of ``pairs`` (id, source, ref, at): in the order of ``at``, each whose name and link are both
    free. ``at`` tells the pairs apart."""
    left, taken, old = store.save(pairs.select("id", *LINK, "at"), "pairs"), [], None
    while not left.isEmpty():
        first = F.col("at") == F.min("at").over(Window.partitionBy("id"))
        firsts = left.withColumn("first", first).withColumn("first_link", F.col("at") == F.min("at").over(Window.partitionBy(*LINK)))
        now = store.save(firsts.where("first AND first_link").drop("first", "first_link"), "taken")
        taken.append(now)
        rest = left.join(now.select("id"), "id", "left_anti").join(now.select(*LINK), LINK, "left_anti")
        old, left = left, store.save(rest.select("id", *LINK, "at"), "pairs")
        store.drop(old)
    out = left
    for part in taken:
        out = out.unionByName(part)
    return out


def _standing(calls: DataFrame, known: Store, now: str, limit: int, chunk: int) -> DataFrame:
    """(call, user_id, service, asked, status, started_at, used) of every call."""
    now_ = F.lit(now).cast("timestamp")
    hours = lambda n: F.expr(f"INTERVAL {n} HOURS")
    told = calls.join(known.imports.select("user_id", "service", "started_at", F.col("thumbs").alias("used")), ["user_id", "service"], "left")
    fresh = F.col("started_at").isNull() | (F.col("started_at") + hours(EVERY_HOURS) <= now_)
    told = told.withColumn("used", F.when(fresh, F.lit(0)).otherwise(F.col("used")).cast("long")).withColumn("started_at", F.when(fresh, now_).otherwise(F.col("started_at")))
    told = told.join(F.broadcast(known.services.select("service", F.lit(True).alias("is_service"))), "service", "left")
    told = told.join(known.unlocked.select("user_id", F.lit(True).alias("is_unlocked")).distinct(), "user_id", "left")
    status = (
        F.when(F.col("is_unlocked").isNull(), "locked")
        .when(F.col("is_service").isNull(), "not a service")
        .when(F.col("asked") > chunk, "too many")
        .when(F.col("started_at") + hours(OPEN_HOURS) <= now_, "closed")
        .otherwise("done")
    )
    return told.select("call", "user_id", "service", "asked", status.alias("status"), "started_at", "used")


def _valid(things: DataFrame, known: Store, open_: DataFrame) -> DataFrame:
    """The things of calls in ``open_`` that a single write would be allowed, the first of each call's for a link.

    Names are looked at once each, and those allowed are written: few, mostly, beside the things, which then stay where
    they are. What is left of the things is dealt by call, once, for all that follows within calls."""
    fine = things.join(F.broadcast(known.patterns.select("source", "pattern")), "source")
    fine = fine.where(F.expr("rlike(ref, pattern) AND value IN ('1', '-1') AND char_length(search_id) <= 128")).drop("pattern")
    names = fine.select("id").distinct().where(text.column(lambda n: "y" if text.is_normalized(n) else None)("id").isNotNull())
    names = store.save(names.join(known.removed.select("id"), "id", "left_anti"), "import-names")
    fine = fine.join(names, "id").join(known.removed_refs.select(*LINK), LINK, "left_anti").join(open_, "call")
    order = Window.partitionBy("call", *LINK).orderBy("ord")
    return fine.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def import_thumbs(things: DataFrame, known: Store, now: str, limit: int = LIMIT, chunk: int = CHUNK) -> Imported:
    """Write the calls in ``things`` (call, user_id, service, ord, id, search_id, source, ref, value as text; calls are
    numbered in their order, one for each user and service) at the time ``now``. A call with no thing but a null ``ord`` asks for
    nothing."""
    things, stored = store.save(things, "import-things"), store.save(known.links.select("item_id", *LINK), "import-held")
    calls = things.groupBy("call", "user_id", "service").agg(F.count("ord").alias("asked"))
    standing = store.save(_standing(calls, known, now, limit, chunk), "import-calls")
    open_ = standing.where("status = 'done'").select("call", "used")
    valid = _valid(things.where("ord IS NOT NULL"), known, open_)
    place = F.row_number().over(Window.partitionBy("call").orderBy("ord"))  # a call has at most ``chunk`` things
    valid = store.save(valid.withColumn("over", place > limit - F.col("used")), "import-valid")
    taken = valid.where("NOT over").select("call", "user_id", "ord", "id", "search_id", *LINK, "value")

    # names and links: who gets what is free
    free = taken.join(stored.select(*LINK), LINK, "left_anti").join(stored.select(F.col("item_id").alias("id")), "id", "left_anti")
    first = F.min(F.struct("call", "ord", "user_id", "search_id")).alias("at")  # a pair asked for often is decided where it comes first
    made = store.save(matched(free.groupBy("id", *LINK).agg(first)), "import-links")
    names = made.join(known.items.select("id"), "id", "left_anti").select("id", "at.search_id", F.col("at.user_id").alias("created_by"))

    # thumbs: on what holds the link when the call is over
    holders = stored.select(*LINK, "item_id", F.lit(None).cast(things.schema["call"].dataType).alias("since"))
    holders = holders.unionByName(made.select(*LINK, F.col("id").alias("item_id"), F.col("at.call").alias("since")))
    found = taken.join(holders, LINK).where("since IS NULL OR since <= call")
    own = known.thumbs.where("tag = ''").select("user_id", "item_id", F.lit(True).alias("had"))
    found = found.join(own, ["user_id", "item_id"], "left")
    before = Window.partitionBy("user_id", "item_id").orderBy("call", "ord")
    found = store.save(found.withColumn("saved", F.col("had").isNull() & (F.row_number().over(before) == 1)), "import-found")
    thumbs = found.where("saved").select("user_id", "item_id", F.lit("").alias("tag"), F.col("value").cast("int").alias("value"))

    sums = found.groupBy("call").agg(F.count("*").alias("found"), F.sum(F.col("saved").cast("long")).alias("saved"))
    past = valid.groupBy("call").agg(F.sum(F.col("over").cast("long")).alias("over"))
    counts = standing.join(sums, "call", "left").join(past, "call", "left").na.fill(0, ["found", "saved", "over"])
    done = F.col("status") == "done"
    of = lambda c: F.when(done, c)
    told = counts.select(
        "call", "user_id", "service", "status", of(F.col("saved")).alias("saved"), of(F.col("found") - F.col("saved")).alias("kept"),
        of(F.col("asked") - F.col("found") - F.col("over")).alias("refused"), of(F.col("over")).alias("over"), of(limit - F.col("used") - F.col("saved")).alias("left"),
    )
    imports = counts.where(done & (F.col("used") + F.col("saved") > 0)).select("user_id", "service", "started_at", (F.col("used") + F.col("saved")).alias("thumbs"))
    links = made.select(F.col("id").alias("item_id"), *LINK, F.col("at.user_id").alias("created_by"))
    return Imported(names, links, thumbs, imports, told)


def resolved(told: DataFrame, thumbs: DataFrame) -> DataFrame:
    """(user_id, ord, item_id, source, ref, value, known): what of the matched rows of an export there is to import. ``told``
    (user_id, ord, source, ref, value, item_id, kind) says what each row's find stands for; what the account has rated stays
    as it is, and of rows for one thing the first counts."""
    told = told.join(thumbs.where("tag = ''").select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    first = F.row_number().over(Window.partitionBy("user_id", "item_id").orderBy("ord"))
    told = told.withColumn("k", first).where("k = 1")
    return told.select("user_id", "ord", "item_id", "source", "ref", "value", (F.col("kind") != "free").alias("known"))
