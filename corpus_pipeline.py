"""From raw documents to packed token sequences: five stages, each written as Parquet and read again.

Every stage but the last returns the columns of its input, whatever they are called and however many there are
beside ``doc_id`` and ``text``; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palate.llm import exact_dedup, near_dedup, packing, quality, substring_dedup
from palate.llm._store import read_table, save


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null and empty texts are scored as empty ones; equal
    texts fare alike; null ids are no bar, but such rows are never learned from; without labels of both kinds every
    row gets the same score."""
    model = quality.learn(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id; null texts count as empty, null ids
    lose, and of rows equal in id and text one stays."""
    return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id; null and empty texts and texts of
    white space are a class each; null ids lose, and of rows equal in id and text one stays."""
    return near_dedup.keep_first(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that occur more than once: repeated rows lose all that is long enough.
    Null texts stay null. ``n_chars``, where it is, follows the text."""
    found = substring_dedup.without_repeats(docs)
    if "n_chars" not in docs.columns:
        return found
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, packed into sequences: one row a piece. Null and empty texts are their end id;
    repeated rows are packed each."""
    return packing.packed(docs.select("doc_id", "text")).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

#: Learned filters and minimum-slack packing have no SQL; the test compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
