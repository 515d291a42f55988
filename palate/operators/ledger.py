"""Asking an index about many things, in batches, so that a run that was stopped goes on where it was.

Whoever answers takes at most ``BATCH`` questions at a time. Equal questions are one; open ones are taken in waves of
batches, in their order. A wave's answers, also that there is none, are one table in the ledger, which counts once it
is written whole. So a run that is started again asks only what no finished wave has answered, and a wave that was cut off is
asked again as it was.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH, WAVE = 50, 64
ANSWERS = "question string, answers array<string>"

#: From (question, batch) to (question, answers): questions without an answer may be left out.
Ask = Callable[[DataFrame], DataFrame]


class Ledger:
    """Answers below a folder that all executors share, a table a stage and wave."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _waves(self, stage: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{stage}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        return sorted((n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(at, f"{n}/_SUCCESS"))), key=int)

    def answers(self, stage: str) -> DataFrame:
        paths = [f"{self.root}/{stage}/{n}" for n in self._waves(stage)]
        return self.spark.read.schema(ANSWERS).parquet(*paths) if paths else self.spark.createDataFrame([], ANSWERS)

    def add(self, stage: str, answers: DataFrame) -> None:
        waves = self._waves(stage)
        answers.select("question", "answers").write.mode("overwrite").parquet(f"{self.root}/{stage}/{int(waves[-1]) + 1 if waves else 0}")


def by_batch(call: Callable[[list[str]], dict[str, list[str]]]) -> Ask:
    """``call`` answers a batch's questions at once; batches are dealt over tasks."""

    def run(rows: pa.Table) -> pa.Table:
        asked = sorted(rows.column("question").to_pylist())
        told = call(asked)
        return pa.table({"question": pa.array(asked, pa.string()), "answers": pa.array([told.get(q, []) for q in asked], pa.list_(pa.string()))})

    return lambda asked: asked.groupBy("batch").applyInArrow(run, ANSWERS)


def ask_all(questions: DataFrame, ask: Ask, ledger: Ledger, stage: str, batch: int = BATCH, wave: int = WAVE) -> DataFrame:
    """(question, answers) of all ``questions`` (question), of which the ledger keeps what was answered before; answers
    sorted, empty where there is none. Null questions are none."""
    open_ = questions.select("question").where("question IS NOT NULL").distinct()
    while True:
        left = open_.join(ledger.answers(stage).select("question"), "question", "left_anti")
        now = left.orderBy("question").limit(batch * wave)
        place = F.row_number().over(Window.orderBy("question")) - 1  # over no more than a wave
        now = now.withColumn("batch", F.floor(place / batch).cast("long"))
        if now.isEmpty():
            return open_.join(ledger.answers(stage), "question")
        told = ask(now).select("question", F.array_sort("answers").alias("answers"))
        none = F.array().cast("array<string>")
        ledger.add(stage, now.select("question").join(told, "question", "left").withColumn("answers", F.coalesce("answers", none)))


def match_titles(rows: DataFrame, titles: Ask, labels: Ask, ledger: Ledger, batch: int = BATCH, wave: int = WAVE) -> DataFrame:
    """(row, answers, stage) of ``rows`` (row, title, label): what the title finds, else what the label finds. Labels are asked of those
    alone that their title has not found."""
    first = ask_all(rows.select(F.col("title").alias("question")), titles, ledger, "titles", batch, wave)
    told = rows.join(first.withColumnRenamed("question", "title"), "title", "left")
    missed = told.where("answers IS NULL OR size(answers) = 0").drop("answers")
    second = ask_all(missed.select(F.col("label").alias("question")), labels, ledger, "labels", batch, wave)
    late = missed.join(second.withColumnRenamed("question", "label"), "label").where("size(answers) > 0")
    found = told.where("size(answers) > 0").select("row", "answers", F.lit("titles").alias("stage"))
    return found.unionByName(late.select("row", "answers", F.lit("labels").alias("stage")))
