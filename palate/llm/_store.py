"""Shared plumbing of the training-data operators: tables, row keys, lineage cuts."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` below ``sf_dir``, through Spark's own reader."""
    pin_splits(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pin_splits(spark: SparkSession) -> None:
    """Let all scans of a table cut its files alike from now on, also after executors came or went: row numbers
    and blocks that hang on the partition and the place in it have to be the same each time."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    pin_splits(df.sparkSession)
    return store.save(df, name)


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the row numbers in ``gone`` (row); its columns may have any names."""
    numbered = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"))
    return numbered.join(gone, "row", "left_anti").select("doc.*")


def part_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_text(docs: DataFrame) -> DataFrame:
    """Null texts read as empty ones."""
    return docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores before it one that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def in_fold(doc_id, folds: int):
    """True for rows whose crc32(doc_id as text) is a multiple of ``folds`` (null ids: as text '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds) == 0


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done with: its cleaner follows the collector."""
    for _ in range(2):  # the second round finds what the first one's finalisers let go
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
