"""Aggregates over graph rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Syntax that adds a path.
DECISIONS = ("IfStatement", "ForStatement", "ForInStatement", "ForOfStatement", "WhileStatement", "DoStatement", "CaseClause", "CatchClause", "ConditionalExpression", "AmpersandAmpersandToken", "BarBarToken", "QuestionQuestionToken")


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("rows"))


def complexity(rows: DataFrame, by: list[str], kind: str, decisions: tuple[str, ...] = DECISIONS) -> DataFrame:
    """1 + the number of decision points."""
    return rows.groupBy(*by).agg((F.lit(1) + F.sum(F.when(F.col(kind).isin(*decisions), 1).otherwise(0))).cast("long").alias("complexity"))


def any_true(rows: DataFrame, by: list[str], condition: Column, name: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.bool_or(F.coalesce(condition, F.lit(False))).alias(name))


def ordered_list(rows: DataFrame, by: list[str], value: str, order: str, separator: str = ",") -> DataFrame:
    """Values of a group in order, joined; for groups of bounded size such as one import's names."""
    held = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return rows.groupBy(*by).agg(F.array_join(held, separator).alias(value))


def ordinals(rows: DataFrame, by: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def batches(rows: DataFrame, by: list[str], order: list[str], size: int = 100) -> DataFrame:
    """Number of the write batch of each row within its group."""
    return ordinals(rows, by, order).withColumn("batch", F.floor((F.col("ordinal") - 1) / size)).drop("ordinal")
