"""Queries on a store in buckets that is written, changed and read within the query."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.functions.identity import entity_id, relationship_id
from srcloom.operators.lineage import cut, shared_dir
from srcloom.plans.projection import table
from srcloom.sources.graph_store import GraphStore, drop

BUCKETS = 64


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and orders as nodes, orders' customers as relationships."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    who = entity_id("Customer", F.col("c_custkey").cast("string"))
    nodes = customer.select(who.alias("entityId"), F.lit("Customer").alias("kind"), F.col("c_name").alias("name"), F.lit("/c").alias("filePath"))
    order = entity_id("Order", F.col("o_orderkey").cast("string"))
    nodes = nodes.unionByName(orders.select(order.alias("entityId"), F.lit("Order").alias("kind"), F.col("o_orderstatus").alias("name"), F.lit("/o").alias("filePath")))
    source = entity_id("Customer", F.col("o_custkey").cast("string"))
    return nodes, orders.select(relationship_id("PLACED", source, order).alias("entityId"), F.lit("PLACED").alias("type"), source.alias("sourceId"), order.alias("targetId"), F.lit(1).alias("weight"), F.col("o_orderstatus").alias("status"))


def _changed(spark: SparkSession, sf_dir: str) -> tuple[list[dict], DataFrame, DataFrame]:
    """A store after two upserts and a deletion: some customers renamed, some new, some orders' relationships heavier
    and without status, some customers gone; what each change wrote; the nodes and relationships left."""
    at = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    store = GraphStore(spark, at, BUCKETS)
    nodes, rels = _graph(spark, sf_dir)
    steps = [*store.upsert(nodes, rels)]
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    key = lambda c: entity_id("Customer", c.cast("string"))
    renamed = customer.where("c_custkey % 997 = 1").select(key(F.col("c_custkey")).alias("entityId"), F.lit("Customer").alias("kind"), F.concat("c_name", F.lit("!")).alias("name"), F.lit("/c").alias("filePath"))
    fresh = customer.where("c_custkey % 997 = 2").select(key(F.col("c_custkey") + 10_000_000).alias("entityId"), F.lit("Customer").alias("kind"), F.lit("new").alias("name"), F.lit("/c").alias("filePath"))
    order, source = entity_id("Order", F.col("o_orderkey").cast("string")), key(F.col("o_custkey"))
    heavier = orders.where("o_orderkey % 9973 < 4").select(relationship_id("PLACED", source, order).alias("entityId"), F.lit("PLACED").alias("type"), source.alias("sourceId"), order.alias("targetId"), F.lit(5).alias("weight"), F.lit(None).cast("string").alias("status"))
    steps += store.upsert(renamed.unionByName(fresh), heavier)
    steps.append(store.nodes.change(None, customer.where("c_custkey % 997 = 3").select(key(F.col("c_custkey")).alias("entityId"))))
    store.vacuum()
    out = cut(store.nodes.read()), cut(store.rels.read())
    drop(spark, at)
    return steps, *out


def store_upsert_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store holds after its changes."""
    _, nodes, rels = _changed(spark, sf_dir)
    return nodes.select("entityId", F.col("kind").alias("what"), F.col("name").alias("a"), F.lit("").alias("b")).unionByName(rels.select("entityId", F.col("type").alias("what"), F.col("weight").cast("string").alias("a"), F.col("status").alias("b")))


def store_rewritten_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the store's buckets each change wrote."""
    steps, _, _ = _changed(spark, sf_dir)
    return spark.createDataFrame([(k, s["written"]) for k, s in enumerate(steps)], "step int, written int")


_NODES = "SELECT 'customer:' || c_custkey AS entityId, 'Customer' AS what, c_name AS a, c_custkey AS k FROM customer"
_RENAMED = "SELECT 'customer:' || c_custkey AS entityId FROM customer WHERE c_custkey % 997 = 1 UNION ALL SELECT 'customer:' || (c_custkey + 10000000) FROM customer WHERE c_custkey % 997 = 2"
_PLACED = "'placed:customer:' || o_custkey || ':order:' || o_orderkey"
_BUCKETS = f"count(DISTINCT CAST('0x' || substr(md5(entityId), 1, 8) AS BIGINT) % {BUCKETS})"
QUERIES = {f.__name__: f for f in (store_upsert_twice, store_rewritten_buckets)}
ORACLES = {
    "store_upsert_twice": f"""SELECT entityId, what, CASE WHEN k % 997 = 1 THEN a || '!' ELSE a END AS a, '' AS b FROM ({_NODES}) WHERE k % 997 <> 3
UNION ALL SELECT 'customer:' || (c_custkey + 10000000), 'Customer', 'new', '' FROM customer WHERE c_custkey % 997 = 2
UNION ALL SELECT 'order:' || o_orderkey, 'Order', o_orderstatus, '' FROM orders
UNION ALL SELECT {_PLACED}, 'PLACED', CASE WHEN o_orderkey % 9973 < 4 THEN '5' ELSE '1' END, o_orderstatus FROM orders""",
    "store_rewritten_buckets": " UNION ALL ".join(
        f"SELECT CAST({k} AS INTEGER) AS step, CAST({_BUCKETS} AS INTEGER) AS written FROM ({rows})" for k, rows in enumerate((
            f"SELECT entityId FROM ({_NODES}) UNION ALL SELECT 'order:' || o_orderkey FROM orders", f"SELECT {_PLACED} AS entityId FROM orders", _RENAMED, f"SELECT {_PLACED} AS entityId FROM orders WHERE o_orderkey % 9973 < 4", "SELECT 'customer:' || c_custkey AS entityId FROM customer WHERE c_custkey % 997 = 3",
        ))
    ),
}
