"""Graph queries: neighbours, patterns, reachability, degrees, cycles, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcloom.operators.lineage import cut


def neighbors(rels: DataFrame, nodes: DataFrame, kind: str, direction: str = "out") -> DataFrame:
    """(entityId, name) of what stands at the other end, with the end asked about."""
    here, there = ("sourceId", "targetId") if direction == "out" else ("targetId", "sourceId")
    return rels.where(F.col("type") == kind).select(F.col(here).alias("fromId"), F.col(there).alias("entityId")).join(nodes.select("entityId", "name"), "entityId").select("fromId", "entityId", "name")


def two_hop(rels: DataFrame, first: str, second: str) -> DataFrame:
    a = rels.where(F.col("type") == first).select(F.col("sourceId").alias("startId"), F.col("targetId").alias("midId"))
    b = rels.where(F.col("type") == second).select(F.col("sourceId").alias("midId"), F.col("targetId").alias("endId"))
    return a.join(b, "midId").select("startId", "midId", "endId").distinct()


def reach(rels: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(entityId, depth): least number of steps from any start, up to ``depth``; a frontier join per step.  Steps and
    frontiers are written once, so no step's plan holds the ones before it; it ends early where nothing new comes.
    Equal relationships aren't made one, which would hold all pairs of ids in hash tables: frontiers hold each id once."""
    steps = cut(rels.select(F.col("sourceId").alias("entityId"), F.col("targetId").alias("next")))
    seen = frontier = cut(start.select("entityId").distinct().withColumn("depth", F.lit(0)))
    for k in range(1, depth + 1):
        frontier = cut(frontier.select("entityId").join(steps, "entityId").select(F.col("next").alias("entityId")).distinct().join(seen.select("entityId"), "entityId", "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def degrees(rels: DataFrame) -> DataFrame:
    """(entityId, outDegree, inDegree)."""
    ends = rels.select(F.explode(F.array(F.struct(F.col("sourceId").alias("entityId"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("targetId").alias("entityId"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.entityId").agg(F.sum("e.o").alias("outDegree"), F.sum("e.i").alias("inDegree"))


def top_degrees(rels: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The k nodes of each kind with most relationships; ties by id.  Each task keeps k rows of a kind
    before any are moved, as the limit of a rank is pushed below the exchange."""
    d = degrees(rels).withColumn("degree", F.col("outDegree") + F.col("inDegree")).join(nodes.select("entityId", "kind"), "entityId")
    w = Window.partitionBy("kind").orderBy(F.desc("degree"), "entityId")
    return d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("kind", "entityId", "degree", "place")


def cycles(rels: DataFrame, length: int) -> DataFrame:
    """Cycles of exactly ``length`` relationships over different nodes, each from its least node."""
    e = rels.select("sourceId", "targetId").where("sourceId <> targetId").distinct()
    path = e.select(F.col("sourceId").alias("n0"), F.col("targetId").alias("n1")).where("n1 > n0")
    for k in range(2, length):
        step = e.select(F.col("sourceId").alias(f"n{k - 1}"), F.col("targetId").alias(f"n{k}"))
        path = path.join(step, f"n{k - 1}").where(F.col(f"n{k}") > F.col("n0"))
        for j in range(1, k - 1):
            path = path.where(F.col(f"n{k}") != F.col(f"n{j}"))
    last = e.select(F.col("sourceId").alias(f"n{length - 1}"), F.col("targetId").alias("n0"))
    return path.join(last, [f"n{length - 1}", "n0"]).select(*(f"n{k}" for k in range(length)))


def summary(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """(part, name, rows): nodes by kind, relationships by type."""
    a = nodes.groupBy(F.lit("node").alias("part"), F.col("kind").alias("name")).agg(F.count("*").alias("rows"))
    return a.unionByName(rels.groupBy(F.lit("relationship").alias("part"), F.col("type").alias("name")).agg(F.count("*").alias("rows")))
