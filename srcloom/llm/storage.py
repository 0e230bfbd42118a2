"""Where jobs of this subpackage keep intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Only a session on one machine (tests, bench) may go
    without: it gets a temporary folder there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="srcloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in any file system that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one job in the shared folder, by name; a table goes as soon as what was made of it is written."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.job, self.paths = spark, job, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns the written table: lineage ends there, and a lost executor costs no
        more than the tasks it was running."""
        path = new_path(self.spark, f"{self.job}-{name}")
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing will read again."""
        for name in names:
            remove(self.spark, self.paths.pop(name))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table that stays, as the caller's result depends on it."""
    return Scratch(df.sparkSession, "table").put(df, name)
