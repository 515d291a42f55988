"""Exact deduplication by skew-safe combining.

Three stages, each grouping on the digest *and* the whole text, so that two texts that merely share a
digest never merge:

1. local: rows of one input partition combine before anything is shuffled (map-side aggregation);
2. salted: one row per (partition, text) goes to ``salts`` sub-groups of its digest;
3. global: at most ``salts`` rows of a digest meet, whatever number of copies there was.

Members find their group again through the digest, those of the few hot digests dealt over salts. Only digests
that turn out to hold several texts are matched by the text as well.

Defined results: a null text counts as empty; of equal texts the row with the largest ``doc_id`` stays
(nulls lose against any id); of rows equal in text and ``doc_id`` exactly one stays; an empty table gives an
empty result; other columns of the input are ignored. A very long text is hashed and compared whole, in memory proportional
to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._skew import hot_keys, join_back
from ._store import pin_splits, read_table, release, save, with_text, without_rows

SALTS = 8


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _rows(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, text, digest and a row number that tells repeated rows apart.

    The row number hangs on the partition and the place in it, which a scan of files repeats exactly.
    """
    return with_text(docs.select(F.col("doc_id").cast("long"), "text")).select(
        F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("who"),
        "text",
        digest(F.col("text")).alias("digest"),
    )


def groups(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct text of ``rows``: digest, text, keep (struct doc_id, row), n."""
    best = [F.max("who").alias("who"), F.sum("n").alias("n")]
    salted = (
        rows.withColumn("n", F.lit(1).cast("long"))
        .groupBy("digest", "text", (F.spark_partition_id() % salts).alias("salt"))
        .agg(*best)
    )
    return salted.groupBy("digest", "text").agg(*best).withColumnRenamed("who", "keep")


def exact_duplicates(
    docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS
) -> DataFrame:
    """(doc_id, row, keep_id, group_size, kept) and the text's digest, for every row of ``docs``."""
    pin_splits(docs.sparkSession)
    rows = _rows(docs, digest)
    slim = save(groups(rows, salts).select("digest", "keep", "n"), "exact-groups")
    release(docs.sparkSession)
    slim_rows, hot = rows.select("digest", "who"), hot_keys(slim, ["digest"], "n")
    shared = slim.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    if shared.isEmpty():
        found = join_back(slim_rows, slim, ["digest"], hot, ["who"])
    else:  # one digest stands for several texts: there the text itself is the key
        alone = slim.join(shared, "digest", "left_anti")
        plain = join_back(slim_rows, alone, ["digest"], hot_keys(alone, ["digest"], "n"), ["who"])
        clashing = rows.join(shared, "digest", "left_semi")
        own = save(groups(clashing, salts), "clashing-groups")
        both = join_back(clashing, own, ["digest", "text"], hot_keys(own, ["digest", "text"], "n"), ["who"])
        found = plain.unionByName(both.drop("text"))
    return found.select(
        F.col("who.doc_id").alias("doc_id"),
        F.col("who.row").alias("row"),
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("who.row") == F.col("keep.row")).alias("kept"),
        "digest",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns unchanged, whatever their names."""
    gone = exact_duplicates(docs).where(~F.col("kept")).select("row")
    return without_rows(docs, gone)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLES = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """
}
