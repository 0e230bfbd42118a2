"""The property graph that the driver's tables project to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.functions.identity import entity_id, relationship_id
from srcloom.operators.lineage import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(rows: DataFrame, kind: str, name: str, order: str) -> DataFrame:
    return rows.select(entity_id(kind, F.col(name).cast("string")).alias("entityId"), F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), F.col(order).cast("long").alias("ord"))


KINDS = (("Region", "region", "r_name", "r_regionkey"), ("Nation", "nation", "n_name", "n_nationkey"), ("Customer", "customer", "c_name", "c_custkey"), ("Supplier", "supplier", "s_name", "s_suppkey"), ("Part", "part", "p_name", "p_partkey"), ("Order", "orders", "o_orderkey", "o_orderkey"))


def raw_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of six kinds before deduplication (parts share names)."""
    out = None
    for kind, name, column, order in KINDS:
        own = _nodes(table(spark, sf_dir, name), kind, column, order)
        out = own if out is None else out.unionByName(own)
    return out


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from srcloom.operators.dedup import last_wins

    return last_wins(raw_nodes(spark, sf_dir), ["entityId"], ["ord"])


def _rels(rows: DataFrame, kind: str, source: Column, target: Column, weight: int) -> DataFrame:
    return rows.select(relationship_id(kind, source, target).alias("entityId"), F.lit(kind).alias("type"), source.alias("sourceId"), target.alias("targetId"), F.lit(weight).alias("weight"))


def _numbered(rows: DataFrame, kind: str, key: str, name: str) -> DataFrame:
    """(row, id, number): each row's key, its entity's id, and the least key of that id."""
    rows = rows.select(F.col(key).alias("row"), entity_id(kind, F.col(name)).alias("id"))
    return rows.join(rows.groupBy("id").agg(F.min("row").alias("number")), "id")


def rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships of six types: regions' nations, nations' customers and suppliers, customers' orders, the
    parts of orders and of suppliers; one for each pair."""
    region, nation, customer, supplier, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "orders"))
    a = _rels(nation.join(region, nation.n_regionkey == region.r_regionkey), "CONTAINS", entity_id("Region", F.col("r_name")), entity_id("Nation", F.col("n_name")), 1)
    b = _rels(customer.join(nation, customer.c_nationkey == nation.n_nationkey), "HAS_CUSTOMER", entity_id("Nation", F.col("n_name")), entity_id("Customer", F.col("c_name")), 5)
    c = _rels(supplier.join(nation, supplier.s_nationkey == nation.n_nationkey), "HAS_SUPPLIER", entity_id("Nation", F.col("n_name")), entity_id("Supplier", F.col("s_name")), 5)
    d = _rels(orders.join(customer, orders.o_custkey == customer.c_custkey), "PLACED", entity_id("Customer", F.col("c_name")), entity_id("Order", F.col("o_orderkey").cast("string")), 9)
    # rows of one id are one whole number while pairs are made different; ids come last
    line, part = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), "l_orderkey"), _numbered(table(spark, sf_dir, "part"), "Part", "p_partkey", "p_name")
    made = _numbered(supplier, "Supplier", "s_suppkey", "s_name")
    lines = line.join(part.select(F.col("row").alias("l_partkey"), F.col("number").alias("part")), "l_partkey")
    part_ids, made_ids = (x.where("row = number").select(F.col("number").alias(c), F.col("id").alias(f"{c}Id")) for x, c in ((part, "part"), (made, "made")))
    e = lines.select("l_orderkey", "part").distinct().join(part_ids, "part")
    e = _rels(e, "INCLUDES_PART", entity_id("Order", F.col("l_orderkey").cast("string")), F.col("partId"), 7)
    s = lines.join(made.select(F.col("row").alias("l_suppkey"), F.col("number").alias("made")), "l_suppkey").select("made", "part").distinct()
    f = _rels(s.join(part_ids, "part").join(made_ids, "made"), "SUPPLIES", F.col("madeId"), F.col("partId"), 6)
    return a.unionByName(b).unionByName(c).unionByName(d).unionByName(e).unionByName(f)
