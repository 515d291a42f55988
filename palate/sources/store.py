"""Tables written to the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    Only local mode (tests) may do without: there, driver and executors are one process, and a folder of this
    machine is set. On a cluster that names none this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palate-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/palate/{spark.sparkContext.applicationId}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = f"{saved_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that ``save`` has given, once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/palate/" in path:
            path = jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_saved(spark: SparkSession) -> None:
    """Delete the tables that this application has saved. Results that are not yet written still read them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(saved_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
