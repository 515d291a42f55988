"""Near duplicates by weighted minwise hashing: BagMinHash signatures, bands, exact multiset overlap.

A text is the multiset of its runs of five words (a text of one to four words is one run). Two texts are near
duplicates when sum(min) / sum(max) of their run counts is at least 0.8.

Signature. Every run carries, for each dyadic interval of weights [0,1), [1,2), [2,4), [4,8), ..., a Poisson
process of points (time, weight, slot), drawn from the run's hash alone. A text that holds the run w times sees
the points below weight w. The first time in each slot is the text's signature there; two texts agree in a slot
with probability exactly their weighted Jaccard similarity. Points are drawn in order of time and only until
every slot of the text has one, so a run seldom costs more than one or two.

Candidates. ``BANDS`` bands of ``ROWS`` slots; texts that agree in a band share a bucket. Buckets are worked
off in rounds, never by all their pairs. First each bucket's members are verified against one pivot and links
grow into components. Then only buckets that hold several components go on. Their texts' runs are counted among
them, and what two texts can have in common splits in two:

- Runs that at most ``RARE`` texts hold. Texts that share such runs are paired through them, a bounded number
  of partners for each run, and pairs whose common rare runs and frequent runs could suffice are verified.
- Runs that more texts hold. All other pairs have only these in common, at most the smaller count of the two,
  so texts with too few leave the buckets. The others take turns as pivots: first the text of each bucket with
  the largest share of frequent runs, then up to ``AT_ONCE`` members outside the bucket's largest component.
  Pivots are verified against the members of other components that the bound allows, and leave the bucket; a
  pair that meets in several bands is looked at in the first.

Every pair of a bucket ends up verified, excluded by that bound, or inside one component, with no cap on
members or partners.

Results: one row per document with its class (the smallest doc_id linked to it, directly or through others).

Defined results: null and empty texts, and texts of white space only, have no runs and are a class each; texts
with equal multisets are one class; null doc_ids lose against any other as class_id; of rows with equal doc_id
in a class exactly one is kept; an empty table gives an empty result; other columns are ignored. A very long text is one
row's work: its runs are counted, and where it has a candidate also compared, whole, in memory proportional to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._arrow import slices, text_bytes
from ._skew import hot_keys, join_back
from ._store import pin_splits, read_table, release, save, without_rows
from ._words import U, mix, padded, runs, sequence_hash, words

RUN, SLOTS, ROWS = 5, 128, 4
BANDS = SLOTS // ROWS
PIVOTS = 4
AT_ONCE, MOST_AT_ONCE = 64, 1024
SALTS = 16
RARE = 8
_STEP = U(0x9E3779B97F4A7C15)
_EXTRA = float(np.log(SLOTS) + 2)


def multisets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of each row: (row, run's hash, how often), rows in no order."""
    w = words(data, offsets)
    counts = w.counts
    hashes, first = padded(w.hashes, counts, RUN - 1, 0)
    many = np.where(counts > 0, np.maximum(1, counts - RUN + 1), 0)
    rows = np.repeat(np.arange(len(counts)), many)
    grams = sequence_hash(hashes, RUN)[runs(first, many)] if len(rows) else np.zeros(0, U)
    keys = mix(grams + mix(rows.astype(U) + U(1)))
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return rows[order[at]], grams[order[at]], np.diff(np.append(at, len(keys)))


def signatures(row: np.ndarray, gram: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The signatures of n multisets: first arrival times, (n, SLOTS) float32; inf where there is no run."""
    total = np.bincount(row, weights=weight, minlength=n)
    levels = np.ceil(np.log2(weight)).astype(np.int64) + 1  # dyadic intervals below the weight
    node = np.repeat(np.arange(len(row)), levels)
    level = np.arange(int(levels.sum())) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0)).astype(float)
    size = np.where(level == 0, 1, low)
    row, top = row[node], weight[node]
    seed = mix(gram[node] + level.astype(U) * U(0xD1B54A32D192ED03))
    rate, time, drawn = SLOTS * size, np.zeros(len(node)), np.zeros(len(node), U)
    first = np.full(n * SLOTS, np.inf)
    with np.errstate(divide="ignore"):
        step = 1 / total  # the time in which a slot sees one point on average
    limit = _EXTRA * step
    waiting = []
    while len(row):
        block = int(np.clip(40_000 // len(row), 1, 64))
        k = drawn[:, None] + np.arange(1, block + 1, dtype=U)
        r = mix(seed[:, None] + k * _STEP)
        gaps = -np.log(((r >> U(11)).astype(float) + 1) * 2.0**-53) / rate[:, None]
        gaps[:, 0] += time
        times = np.cumsum(gaps, axis=1)
        r = mix(r ^ _STEP)
        seen = (times <= limit[row][:, None]) & (
            low[:, None] + (r >> U(11)).astype(float) * 2.0**-53 * size[:, None] < top[:, None]
        )
        slots = row[:, None] * SLOTS + (r % U(SLOTS)).astype(np.int64)
        np.minimum.at(first, slots[seen], times[seen])
        within = times[:, -1] <= limit[row]
        # a node whose block went past the limit draws that block again if the limit grows
        again = np.flatnonzero(~within)
        waiting.append((row[again], top[again], seed[again], rate[again], time[again], drawn[again], low[again], size[again]))
        time, drawn = times[:, -1], drawn + U(block)
        row, top, seed, rate, time, drawn, low, size = (
            x[within] for x in (row, top, seed, rate, time, drawn, low, size)
        )
        if not len(row):
            open_rows = np.isinf(first.reshape(n, SLOTS)).any(axis=1) & (total > 0)
            if open_rows.any():  # some slot has no point yet: look further, in those rows
                limit = np.where(open_rows, limit + 4 * step, limit)
                parts = [np.concatenate(x) for x in zip(*waiting, strict=True)]
                go = open_rows[parts[0]]
                row, top, seed, rate, time, drawn, low, size = (x[go] for x in parts)
                waiting = []
    return first.reshape(n, SLOTS).astype(np.float32)


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    parts = np.ascontiguousarray(signature).view(np.uint32).astype(U).reshape(len(signature), BANDS, ROWS)
    out = np.zeros(parts.shape[:2], U) + np.arange(BANDS, dtype=U)
    for k in range(ROWS):
        out = mix(out * _STEP + parts[:, :, k])
    return out


def fingerprints(row: np.ndarray, gram: np.ndarray, weight: np.ndarray, n: int) -> list[bytes | None]:
    """128 bits of each whole multiset, whatever the order of its runs; None for an empty one."""
    sums = np.zeros((n, 2), U)
    np.add.at(sums[:, 0], row, mix(gram ^ U(0x51ED270B)) * weight.astype(U))
    np.add.at(sums[:, 1], row, mix(gram + U(0x2545F491)) * weight.astype(U))
    some = np.bincount(row, minlength=n) > 0
    raw = sums.astype(">u8").tobytes()
    return [raw[16 * i : 16 * i + 16] if some[i] else None for i in range(n)]


def occurrences(row: np.ndarray, gram: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each occurrence of a run as a key of its own (run, how many before it): multisets become sets."""
    many = np.repeat(np.arange(len(row)), weight)
    nth = np.arange(len(many)) - np.repeat(np.cumsum(weight) - weight, weight)
    return row[many], mix(gram[many] + nth.astype(U) * _STEP).view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, fp, n, bands) of every row: fp is null where there are no runs. The row number hangs on
    the partition and the place in it, which a scan of files repeats exactly."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets, 4 << 20):
                row, gram, weight = multisets(data, offsets[a : b + 1])
                n = b - a
                fps = fingerprints(row, gram, weight, n)
                keys = bands(signatures(row, gram, weight, n)).view(np.int64)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, n),
                        batch.column(2).slice(a, n),
                        pa.array(fps, pa.binary()),
                        pa.array(np.bincount(row, weights=weight, minlength=n).astype(np.int64)),
                        lists,
                    ],
                    names=["doc_id", "row", "fp", "n", "bands"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(
        run, "doc_id long, row long, fp binary, n long, bands array<long>"
    )


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): the smallest node it is connected to.

    Labels fall to the smallest among the neighbours' and then jump to their label's label, so the rounds grow
    with the logarithm of a component's width.
    """
    both = save(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = save(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")),
        "labels",
    )
    while True:
        around = (
            both.join(labels, both.b == labels.node)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = save(
            labels.join(around, "node").select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")),
            "labels",
        )
        if lower.where("moved").isEmpty():
            return lower.select("node", "label")
        jump = lower.select(F.col("node").alias("at"), F.col("label").alias("further"))
        labels = save(
            lower.join(jump, F.col("label") == F.col("at")).select("node", F.least("label", "further").alias("label")),
            "labels",
        )


def run_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, runs) of the texts whose rows ``wanted`` (row, fp) names, one a fp: row numbers are unique, so no rows that
    are equal in id and text meet anywhere."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                row, key = occurrences(*multisets(data, offsets[a : b + 1]))
                order = np.argsort(row, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(key[order]))],
                    names=["fp", "runs"],
                )

    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    return texts.join(wanted, "row").select("fp", "text").mapInArrow(run, "fp binary, runs array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough."""
    left = sets.select(F.col("fp").alias("a"), F.col("runs").alias("runs_a"))
    right = sets.select(F.col("fp").alias("b"), F.col("runs").alias("runs_b"))
    # a pivot stands in very many pairs, each of which gets its runs
    often = lambda c: hot_keys(pairs.groupBy(c).count(), [c], "count")
    both = join_back(pairs, left, ["a"], often("a"), ["b"])
    both = join_back(both, right, ["b"], often("b"), ["a"])
    common = F.size(F.array_intersect("runs_a", "runs_b"))
    either = F.size("runs_a") + F.size("runs_b") - common
    return both.where(common >= F.lit(similarity) * either - 1e-9).select("a", "b")


def linked(docs: DataFrame, rows: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(node, label) over the texts (fp) of ``rows`` that have a near duplicate."""
    texts = rows.where("fp IS NOT NULL").dropDuplicates(["fp"])
    members = texts.select("fp", "n", F.posexplode("bands").alias("band", "key"))
    place = F.xxhash64("fp", F.col("band") % PIVOTS)
    pivot = F.min(F.struct(place.alias("place"), F.col("fp"), F.col("n")))
    buckets = members.groupBy("band", "key").agg(F.count("*").alias("size"), pivot.alias("pivot")).where("size > 1")
    buckets = save(buckets, "buckets")
    hot = hot_keys(buckets, ["band", "key"], "size")
    open_members = save(
        join_back(members, buckets, ["band", "key"], hot, ["fp"]).select(
            "band", "key", "fp", "n", F.col("pivot.fp").alias("pivot"), F.col("pivot.n").alias("pivot_n")
        ),
        "buckets",
    )
    nodes = open_members.select("fp").distinct()
    wanted = nodes.join(texts.select("fp", "row"), "fp")
    sets = save(run_sets(docs, wanted), "run-sets")
    near = F.least("n", "pivot_n") >= F.lit(similarity) * F.greatest("n", "pivot_n") - 1e-9
    to_pivot = open_members.where((F.col("fp") != F.col("pivot")) & near)
    pairs = save(_ordered(to_pivot.select(F.col("fp").alias("x"), F.col("pivot").alias("y"))).distinct(), "pairs")
    labels = merged(nodes.select("fp", F.col("fp").alias("label")), save(verified(pairs, sets, similarity), "links"))
    release(docs.sparkSession)
    done = pairs
    members, _ = _several(open_members.where(F.col("fp") != F.col("pivot")).select("band", "key", "fp", "n"), labels)
    if members.isEmpty():
        return labels
    lists = save(holders(sets, members), "holders")
    share = save(shares(sets, members, lists), "shares")
    pairs = rare_pairs(lists, share, labels, similarity)
    pairs = save(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    labels = merged(labels, save(verified(pairs, sets, similarity), "links"))
    done = done.union(pairs)
    release(docs.sparkSession)
    # from here on only the runs that many texts hold can link
    share = share.where(F.col("f") >= similarity * F.col("n") - 1e-9)
    several, _ = _several(members.select("band", "key", "fp", "n"), labels)
    own = texts.select("fp", "bands").join(share.select("fp", "f"), "fp")
    members = save(several.drop("label", "outside").join(own, "fp"), "buckets")
    at_once = 1  # the middle of each bucket alone, then ever more, so that rounds stay few
    while True:
        members, empty = _several(members, labels, similarity)
        if empty:
            return labels
        order = Window.partitionBy("band", "key").orderBy((F.col("f") / F.col("n")).desc(), "fp")
        turn = members if at_once == 1 else members.where("outside")
        share_of = Window.partitionBy("band", "key", "salt").orderBy((F.col("f") / F.col("n")).desc(), "fp")
        turn = turn.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS))).withColumn("rank", F.row_number().over(share_of)).where(F.col("rank") <= at_once)
        turn = turn.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= at_once)
        at_once = min(max(AT_ONCE, 2 * at_once), MOST_AT_ONCE)
        pivots = turn.select(
            "band", "key", F.col("fp").alias("pivot"), F.col("n").alias("pivot_n"), F.col("f").alias("pivot_f"),
            F.col("label").alias("pivot_label"), F.col("bands").alias("pivot_bands"),
        )
        most = F.least("f", "pivot_f")
        can = near & (most >= similarity * (F.col("n") + F.col("pivot_n") - most) - 1e-9)
        meet = F.expr("array_position(zip_with(bands, pivot_bands, (x, y) -> x = y), true) = band + 1")
        sizes = members.groupBy("band", "key").count()
        to_pivots = join_back(members, pivots, ["band", "key"], hot_keys(sizes, ["band", "key"], "count"), ["fp"]).where((F.col("label") != F.col("pivot_label")) & can & meet)
        pairs = _ordered(to_pivots.select(F.col("fp").alias("x"), F.col("pivot").alias("y"))).distinct()
        pairs = save(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        labels = merged(labels, save(verified(pairs, sets, similarity), "links"))
        done = done.union(pairs)
        used = pivots.select("band", "key", F.col("pivot").alias("fp"))
        release(docs.sparkSession)
        members = members.drop("label", "outside").join(used, ["band", "key", "fp"], "left_anti")


def _several(members: DataFrame, labels: DataFrame, similarity: float | None = None) -> tuple[DataFrame, bool]:
    """``members`` of the buckets that hold several components, with their label and whether it is another than
    the bucket's largest; and whether there is none. Given ``similarity``, texts go whose frequent runs (f) are too
    few for any partner, even one as short as the bucket's shortest text."""
    told = members.join(labels, "fp")
    parts = told.groupBy("band", "key", "label").agg(F.count("*").alias("c"), F.min("n").alias("shortest"))
    several = (
        parts.groupBy("band", "key")
        .agg(F.max(F.struct("c", "label")).alias("most"), F.count("*").alias("labels"), F.min("shortest").alias("shortest"), F.sum("c").alias("size"))
        .where("labels > 1")
    )
    several = save(several, "several")
    if similarity is None:
        enough = F.lit(True)
    else:  # overlap >= similarity / (1 + similarity) of both sizes together
        enough = F.col("f") * (1 + similarity) >= similarity * (F.col("n") + F.col("shortest")) - 1e-9
    outside = (F.col("label") != F.col("most.label")).alias("outside")
    told = join_back(told, several, ["band", "key"], hot_keys(several, ["band", "key"], "size"), ["fp"])
    found = save(told.where(enough).select(*members.columns, "label", outside), "buckets")
    return found, found.isEmpty()


def _runs_of(sets: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fp, run) of the texts in ``members``, and (run, c): how many of them hold each run that several do."""
    own = sets.join(members.select("fp").distinct(), "fp", "left_semi").select("fp", F.explode("runs").alias("run"))
    return own, own.groupBy("run").agg(F.count("*").alias("c")).where("c > 1")


def holders(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(who, m): the sets of 2 to ``RARE`` texts that alone hold some run, and how many such runs there are."""
    own, held = _runs_of(sets, members)
    rare = own.join(held.where(F.col("c") <= RARE), "run")
    return rare.groupBy("run").agg(F.sort_array(F.collect_list("fp")).alias("who")).groupBy("who").agg(F.count("*").alias("m"))


def shares(sets: DataFrame, members: DataFrame, lists: DataFrame) -> DataFrame:
    """(fp, n, f) of the texts that hold runs of others: all their runs, and those that more than ``RARE`` hold."""
    own, held = _runs_of(sets, members)
    often = own.join(held.where(F.col("c") > RARE), "run", "left_semi").groupBy("fp").agg(F.count("*").alias("f"))
    rare = lists.select(F.explode("who").alias("fp")).distinct().withColumn("f", F.lit(0).cast("long"))
    size = members.select("fp", "n").distinct()
    return size.join(often.union(rare).groupBy("fp").agg(F.sum("f").alias("f")), "fp").select("fp", "n", "f")


def rare_pairs(lists: DataFrame, share: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """(a, b): texts of different components that share a rare run and can have enough in common."""
    lone = lists.select("m", "who", F.explode("who").alias("a")).select("a", "m", F.explode("who").alias("b"))
    common = lone.where("a < b").groupBy("a", "b").agg(F.sum("m").alias("rare"))
    own = share.join(labels, "fp")
    side = lambda x: own.select(*(F.col(c).alias(x if c == "fp" else f"{c}_{x}") for c in own.columns))
    most = F.col("rare") + F.least("f_a", "f_b")
    can = most >= similarity * (F.col("n_a") + F.col("n_b") - most) - 1e-9
    both = common.join(side("a"), "a").join(side("b"), "b")
    return both.where((F.col("label_a") != F.col("label_b")) & can).select("a", "b")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (fp, label) after the components that ``links`` (a, b) connect become one."""
    if links.isEmpty():
        return labels
    ends = links.join(labels.select(F.col("fp").alias("a"), F.col("label").alias("la")), "a")
    ends = ends.join(labels.select(F.col("fp").alias("b"), F.col("label").alias("lb")), "b")
    moved = components(ends.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    moved = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    found = labels.join(moved, "label", "left").select("fp", F.coalesce("to", "label").alias("label"))
    return save(found, "labels")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, row, class_id, class_size, kept) for every row of ``docs`` (doc_id, text, ...)."""
    pin_splits(docs.sparkSession)
    rows = save(signed(docs), "signatures")
    labels = linked(docs, rows, similarity)
    own = rows.select("doc_id", "fp", "row")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    texts = own.where("fp IS NOT NULL").groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    texts = texts.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    texts = save(texts, "texts")
    sums = [F.min("first").alias("first"), F.sum("n").alias("class_size"), F.count("*").alias("texts")]
    classes = save(texts.groupBy("label").agg(*sums), "classes")
    told = join_back(texts.select("fp", "label"), classes, ["label"], hot_keys(classes, ["label"], "texts"), ["fp"])
    told = told.select("fp", "first", "class_size")
    found = join_back(own.where("fp IS NOT NULL"), told, ["fp"], hot_keys(texts, ["fp"], "n"), ["row"])
    grouped = found.select(
        "doc_id", "row", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept")
    )
    one, yes = F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept")
    return grouped.union(own.where("fp IS NULL").select("doc_id", "row", F.col("doc_id").alias("class_id"), one, yes))


def keep_first(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class, all its columns unchanged, whatever their names."""
    return without_rows(docs, near_duplicates(docs, similarity).where(~F.col("kept")).select("row"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "kept")


QUERIES = {"op5_near_dedup": op5_near_dedup}
ORACLES: dict[str, str] = {}
