"""Deduplication by key with an explicit order, and the union of passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: that with the greatest order.  Partial aggregation, one shuffle."""
    return _pick(rows, keys, order, F.max_by)


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: that with the least order."""
    return _pick(rows, keys, order, F.min_by)


def _pick(rows: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    by = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return rows.groupBy(*keys).agg(pick(F.struct(*rest), by).alias("_row")).select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


def combine_passes(passes: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Union of passes; a later pass's row replaces an earlier one's, within a pass the last wins."""
    whole = None
    for k, p in enumerate(passes):
        p = p.withColumn("pass", F.lit(k + 1))
        whole = p if whole is None else whole.unionByName(p)
    return last_wins(whole, keys, ["pass", *order])


def collapse(rels: DataFrame, key: str = "entityId") -> DataFrame:
    """Relationships with equal ids as one, with the number of occurrences."""
    rest = [c for c in rels.columns if c != key]
    return rels.groupBy(key).agg(*(F.min(c).alias(c) for c in rest), F.count("*").alias("occurrences"))


def duplicate_report(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """Rows, distinct keys and surplus rows for each group."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), (F.count("*") - F.countDistinct(key)).alias("surplus"))
