"""Cuts a plan that several others read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Only a session on one machine (tests, bench) may go without that
    setting."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found and not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or tempfile.mkdtemp(prefix="srcloom-")).rstrip("/")


def cut(rows: DataFrame) -> DataFrame:
    """The same rows, written once as Parquet to the folder of ``spark.checkpoint.dir`` and read from there.  Which task
    holds a row may change; ``cut_as_dealt`` keeps that."""
    at = f"{shared_dir(rows.sparkSession)}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input.  Both are shuffled: what Python tasks put out is taken
    for as small as what they read, so that without the hint such tables would be sent whole through the driver."""
    return left.join(right.hint("merge"), on, how)


def spread(rows: DataFrame, per_task: int = 20_000) -> DataFrame:
    """The same rows over as many tasks as run at once, and over more where a task would hold more than ``per_task``:
    a file of a table with few row groups is read by few tasks."""
    n = rows.count()
    return rows.repartition(max(1, min(n, max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // per_task)))))


def dealt(rows: DataFrame, key: str, per_task: int = 500_000) -> DataFrame:
    """The same rows by ``key`` over as many tasks as run at once, and over more where a task would hold more than
    ``per_task``: what a task gathers of them in hash tables doesn't grow with the table."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // per_task)), key)


def tasks_for(files: DataFrame, characters: int = 16_000_000) -> int:
    """How many tasks files (path, content) are dealt over, by the length of their texts."""
    n = files.agg(F.sum(F.length("content"))).first()[0] or 0
    return max(files.sparkSession.sparkContext.defaultParallelism, -(-n // characters))


def cut_as_dealt(rows: DataFrame) -> DataFrame:
    """The same rows in the same tasks and order, by a checkpoint."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    return rows.checkpoint()
