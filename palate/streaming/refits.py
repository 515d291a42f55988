"""Scores that follow the change log: each micro-batch refits the viewers it touches and no others.

A viewer's scores hang on their own thumbs and on those of the accounts they follow. So after a batch only the accounts
whose thumbs really changed matter: they themselves and their followers are fitted anew, everybody else's scores stay.

Two tables are kept below a folder that all executors share: ``held`` (the thumbs as they are) and ``scores``. Both are dealt
into buckets by account. A batch writes the buckets it changes under its own number, whole, and then one row that says
so; a reader takes of each bucket the last version that has such a row. What a batch left that failed half-way has none,
so it is never read, and is written over when the batch runs again. A batch that has its row is done: given again, it changes
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import taste
from ..sources import store

BUCKETS = 64
HELD = "user_id string, item_id string, tag string, value int, event_id long"
SCORES = "viewer string, item_id string, tag string, score double, conf double, applies double"
_COMMITS = "version long, name string, bucket int"


class Versions:
    """Tables in buckets, of which each commit replaces some."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _there(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def commits(self) -> DataFrame:
        if not self._there(f"{self.root}/commits"):
            return self.spark.createDataFrame([], _COMMITS)
        return self.spark.read.schema(_COMMITS).parquet(f"{self.root}/commits/*")

    def done(self, version: int) -> bool:
        return self._there(f"{self.root}/commits/{version}/_SUCCESS")

    def bucket(self, name: str):
        return F.pmod(F.xxhash64(name), F.lit(self.buckets)).cast("int")

    def read(self, name: str, schema: str) -> DataFrame:
        """The table as the last commit left it: at most a path a bucket."""
        last = self.commits().where(F.col("name") == name).groupBy("bucket").agg(F.max("version").alias("version")).collect()
        paths = [f"{self.root}/{name}/{r.version}/bucket={r.bucket}" for r in last]
        paths = [p for p in paths if self._there(p)]  # a bucket that came out empty has no files
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, name: str, rows: DataFrame, key: str, version: int) -> None:
        """The rows of the buckets that this version replaces."""
        dealt = rows.withColumn("bucket", self.bucket(key))
        dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/{version}")

    def commit(self, version: int, changed: DataFrame) -> None:
        """``changed`` (name, bucket): from now on these are read in this version."""
        rows = changed.select(F.lit(version).cast("long").alias("version"), "name", "bucket")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/{version}")


def last_writes(events: DataFrame) -> DataFrame:
    """The last event of every key, in ``HELD``'s columns."""
    newest = F.row_number().over(Window.partitionBy("user_id", "item_id", "tag").orderBy(F.desc("event_id")))
    return events.withColumn("k", newest).where("k = 1").selectExpr("user_id", "item_id", "tag", "cast(value AS int) AS value", "event_id")


def apply_batch(events: DataFrame, version: int, follows: DataFrame, tables: Versions, rank: int = 3) -> bool:
    """Take in a batch of events (event_id, user_id, item_id, tag, value; 0 clears): False if it had been taken in before.
    Events older than what a key holds are ignored."""
    if tables.done(version):
        return False
    keys = ["user_id", "item_id", "tag"]
    new = last_writes(events)
    held = tables.read("held", HELD)
    touched = new.select(tables.bucket("user_id").alias("b")).distinct()
    near = held.withColumn("b", tables.bucket("user_id")).join(F.broadcast(touched), "b", "left_semi").drop("b")
    both = near.select(*keys, F.col("value").alias("old"), F.col("event_id").alias("old_id")).join(new, keys, "full")
    later = F.col("event_id").isNotNull() & (F.coalesce("old_id", F.lit(-1)) < F.col("event_id"))
    told = both.select(
        *keys,
        F.when(later, F.col("value")).otherwise(F.col("old")).alias("value"),
        F.when(later, F.col("event_id")).otherwise(F.col("old_id")).alias("event_id"),
        (later & (F.col("value") != F.coalesce("old", F.lit(0)))).alias("moved"),
    )
    told = store.save(told, "batch")  # used several times below, and the batch may be dear to read again
    # a cleared key stays as a row of value 0: what comes late must not bring it back
    tables.write("held", told.drop("moved"), "user_id", version)
    changed = told.where("moved").select("user_id").distinct()
    elsewhere = held.withColumn("b", tables.bucket("user_id")).join(F.broadcast(touched), "b", "left_anti").drop("b")
    thumbs = elsewhere.select(*keys, "value").unionByName(told.select(*keys, "value")).where("value <> 0")

    hit = follows.join(changed.withColumnRenamed("user_id", "followed_id"), "followed_id", "left_semi").select(F.col("follower_id").alias("viewer"))
    hit = hit.unionByName(changed.select(F.col("user_id").alias("viewer"))).distinct()
    edges = follows.join(hit.withColumnRenamed("viewer", "follower_id"), "follower_id", "left_semi")
    fitted = taste.taste(thumbs, edges, rank).where("kind = 'score'").select("viewer", "item_id", "tag", "score", "conf", "applies")
    spots = hit.select(tables.bucket("viewer").alias("b")).distinct()
    scores = tables.read("scores", SCORES).withColumn("b", tables.bucket("viewer")).join(F.broadcast(spots), "b", "left_semi").drop("b")
    tables.write("scores", scores.join(hit, "viewer", "left_anti").unionByName(fitted), "viewer", version)
    marks = touched.select(F.lit("held").alias("name"), F.col("b").alias("bucket")).unionByName(spots.select(F.lit("scores").alias("name"), F.col("b").alias("bucket")))
    tables.commit(version, marks)
    store.drop(told)
    return True


def keep_scores(log: DataFrame, follows: DataFrame, root: str, checkpoint: str, rank: int = 3, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Start following the stream ``log``; ``root`` and ``checkpoint`` are folders that all executors share."""
    tables = Versions(log.sparkSession, root, buckets)
    return (
        log.writeStream.foreachBatch(lambda events, version: apply_batch(events, version, follows, tables, rank) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
