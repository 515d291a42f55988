"""How filters interact: every order of five filters at once, by a product of incidence matrices.

Which filters a document fails is one of 32 masks, and what an order of filters does to a document depends on its
mask alone. So Spark counts documents by (part, mask), and each part gives three rows of 32 counts: all its
documents, those labelled good and those labelled toxic. What each of the 120 orders does at each of its five steps
to a document of a given mask is a constant 32 by 600 matrix of zeros and ones; the products of counts and matrices are the audit.

The filters, by whether a document fails:

- A: fewer than 200 words (maximal runs of ``[^\\x20\\x09-\\x0D]``);
- B: fewer distinct words than half of its words, case-sensitive;
- C: over three in a hundred of its code points are ``[A-Z]``;
- D: it holds one of ``#$%&*|``;
- E: a row with a smaller ``doc_id`` has the same text, whatever its part and whether it would be removed.

Only E crosses documents: texts are told apart by their SHA-256, the smallest id of each is found by partial
aggregation, and the rows of hot texts find theirs again dealt over salts. Labels are met the same way by ``doc_id``.
Texts are read once; what is shuffled is a digest and some numbers a row.

Defined results: null texts count as empty, which fail A and pass B, C and D; null
``lang`` is the part ''; a null ``doc_id`` is no smaller than any other and no other is smaller than it, and it has no
label; rows equal in text and ``doc_id`` do not fail E through each other; of several labels of an id any
that says so counts; repeated rows count each; an empty table gives an empty result; other columns are ignored. A very
long text is one row's work: its words are split in one task, in memory proportional to it.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._skew import hot_keys, join_back
from ._store import read_table, save, with_text

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3

_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)


def incidence() -> dict[str, np.ndarray]:
    """The 32 by 600 matrices of outcomes: column 5 * order + step - 1. ``letter`` (5 by 600) says which filter
    a column is."""
    fails = (np.arange(MASKS)[:, None] >> np.arange(STEPS)) & 1  # mask x filter
    at = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])  # order x step
    failed = fails[:, at]  # mask x order x step
    before = np.cumsum(failed, axis=2) - failed  # how many of the earlier steps it fails
    flat = lambda x: np.ascontiguousarray(x.reshape(MASKS, -1).astype(np.int64))
    return {
        "kept": flat(before + failed == 0),
        "removed": flat((failed == 1) & (before == 0)),
        "redundant": flat((failed == 1) & (before > 0)),
        "unique": flat((failed == 1) & (fails.sum(axis=1)[:, None, None] == 1)),
        "letter": (at.reshape(1, -1) == np.arange(STEPS)[:, None]).astype(np.int64),
    }


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, own): the mask of A to D of every row, read once and saved."""
    told = with_text(docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")))
    told = told.select(
        "doc_id",
        "part",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("words"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("capitals"),
        F.length("text").alias("points"),
        F.col("text").rlike("[#$%&*|]").alias("d"),
    )
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    failed = [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * F.col("capitals") > MOST_CAPITALS * F.col("points"), F.col("d")]
    own = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(failed)), F.lit(0))
    return save(told.select("doc_id", "part", "digest", own.alias("own")), "audit-masks")


def histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail just the filters of a mask."""
    rows = masks(docs)
    flags = labels.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int").alias("good"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int").alias("toxic"),
    )
    flags = flags.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    firsts = save(firsts, "audit-firsts")
    same_id = hot_keys(rows.where("doc_id IS NOT NULL").groupBy("doc_id").count(), ["doc_id"], "count")
    # rows without an id have no label and no smaller id: they join nothing
    known = join_back(rows.where("doc_id IS NOT NULL"), flags, ["doc_id"], same_id, ["digest", "part"], "left")
    known = join_back(known, firsts.drop("copies"), ["digest"], hot_keys(firsts, ["digest"], "copies"), ["doc_id"], "left")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    told = known.select("part", (F.col("own") + F.when(later, 1 << 4).otherwise(0)).alias("mask"), "good", "toxic")
    nameless = rows.where("doc_id IS NULL").select("part", F.col("own").alias("mask"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return (
        told.unionByName(nameless)
        .groupBy("part", "mask")
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    )


def products(counted: DataFrame) -> DataFrame:
    """The audit of parts with their counts by mask (part, masks array<struct<mask, n, good, toxic>>)."""
    m = incidence()
    orders, steps = np.repeat(ORDERS, STEPS), np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))

    def run(batches):
        for batch in batches:
            told = batch.column("masks").to_pylist()
            stack = np.zeros((3, len(told), MASKS), np.int64)  # counts of all, good and toxic documents: a row a part
            for i, row in enumerate(told):
                for x in row:
                    stack[:, i, x["mask"]] = x["n"], x["good"], x["toxic"]
            every, good, toxic = stack
            removed = every @ m["removed"]
            given = {
                "kept": every @ m["kept"],
                "removed": removed,
                "redundant": every @ m["redundant"],
                "unique_fails": every @ m["unique"],
                "good_lost": good @ m["removed"],
                "toxic_lost": toxic @ m["removed"],
                "shapley": removed @ m["letter"].T @ m["letter"],
            }
            for i, part in enumerate(batch.column("part").to_pylist()):
                columns = [pa.array([part] * len(orders), pa.string()), pa.array(orders), pa.array(steps)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *(pa.array(given[c][i]) for c in _COUNTS)], names=["part", "filter_order", "step", *_COUNTS]
                )

    return counted.mapInArrow(run, RESULT)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    by_part = histogram(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    return products(by_part)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {"op12_filter_audit": op12_filter_audit}

ORACLES = {
    "op12_filter_audit": r"""
        WITH w AS (
            SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents)
        ), f AS (
            SELECT part, len(ws) < 200 AS "A", 100 * len(list_distinct(ws)) < 50 * len(ws) AS "B",
                   100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) AS "C",
                   regexp_matches(t, '[#$%&*|]') AS "D",
                   coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS "E",
                   EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND l.quality = 1) AS good,
                   EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND l.toxic = 1) AS toxic
            FROM w
        ), h AS (
            SELECT part, "A", "B", "C", "D", "E", count(*) AS n, sum(good::INT) AS good, sum(toxic::INT) AS toxic
            FROM f GROUP BY ALL
        ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
        orders AS (
            SELECT a.c || b.c || d.c || e.c || g.c AS filter_order
            FROM letters a, letters b, letters d, letters e, letters g
            WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5
        ), steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
        told AS (
            SELECT part, filter_order, step, n, good, toxic, substr(filter_order, step, 1) AS letter,
                   list_filter([CASE WHEN "A" THEN 'A' END, CASE WHEN "B" THEN 'B' END, CASE WHEN "C" THEN 'C' END,
                                CASE WHEN "D" THEN 'D' END, CASE WHEN "E" THEN 'E' END], lambda x: x IS NOT NULL) AS failed
            FROM h, steps
        ), placed AS (
            SELECT *, list_contains(failed, letter) AS here,
                   len(list_filter(failed, lambda x: instr(filter_order, x) < step)) > 0 AS gone FROM told
        ), counted AS (
            SELECT part, filter_order, step, letter,
                   sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END) AS kept,
                   sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS redundant,
                   sum(CASE WHEN here AND len(failed) = 1 THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END) AS good_lost,
                   sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
            FROM placed GROUP BY ALL
        )
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
               CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
               CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
        FROM counted
    """
}
