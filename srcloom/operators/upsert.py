"""Upserts by key: nodes are replaced whole, relationships merge their properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_nodes(old: DataFrame, new: DataFrame, key: str = "entityId") -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_rels(old: DataFrame, new: DataFrame, key: str = "entityId") -> DataFrame:
    """A row for each key of either; where both have it, new's columns win unless they are null."""
    a, b = old.alias("a"), new.alias("b")
    rest = [c for c in old.columns if c != key]
    return a.join(b, key, "full").select(key, *(F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in rest))


def flatten(nodes: DataFrame, base: list[str], properties: str = "properties") -> DataFrame:
    """Base columns, each replaced by the property of its name where there is one; kind and id go."""
    keep = [c for c in base if c not in ("kind", "id")]
    return nodes.select(*(F.coalesce(F.col(properties)[c], F.col(c).cast("string")).alias(c) for c in keep))


def stored_rels(rels: DataFrame) -> DataFrame:
    """What is stored of a relationship: a missing weight is 0."""
    return rels.select("entityId", "sourceId", "targetId", "type", F.coalesce("weight", F.lit(0)).alias("weight"))
