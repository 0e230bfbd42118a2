"""Integrity checks; each returns what is wrong, so nothing wrong is no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.schema import LABELS, MORE_LABELS, MORE_TYPES, TYPES


def unique_violations(nodes: DataFrame) -> DataFrame:
    """(kind, entityId, rows) of ids that a label holds more than once."""
    return nodes.groupBy("kind", "entityId").agg(F.count("*").alias("rows")).where("rows > 1")


def dangling_ends(rels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(entityId, side, end) of relationship ends without a node."""
    sides = rels.select("entityId", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("sourceId").alias("end")), F.struct(F.lit("target").alias("side"), F.col("targetId").alias("end")))).alias("e")).select("entityId", "e.side", "e.end")
    return sides.join(nodes.select(F.col("entityId").alias("end")), "end", "left_anti").select("entityId", "side", "end")


def unknown_labels(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("kind").isin(*LABELS, *MORE_LABELS)).groupBy("kind").agg(F.count("*").alias("rows"))


def unknown_types(rels: DataFrame) -> DataFrame:
    return rels.where(~F.col("type").isin(*TYPES, *MORE_TYPES)).groupBy("type").agg(F.count("*").alias("rows"))


def constraints(spark) -> DataFrame:
    """(label, constraint, column): the unique id that each label must have, and the columns to look up by."""
    rows = [(x, f"{x.lower()}_entityid_unique", "entityId") for x in LABELS]
    return spark.createDataFrame(rows, "label string, name string, column string")
