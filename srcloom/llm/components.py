"""Connected components as DataFrame joins, a join that spreads hot keys, and a filter before joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm.storage import Scratch

SALTS = 8
#: Places of the bitmap in ``maybe_in``: 2 ** 18 rows of 64 places at most, whatever the input.
PLACES = 1 << 24


def salted_join(rows: DataFrame, lookup: DataFrame, on: str, spread: F.Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Joins ``rows``, in which one key may hold a large share, with ``lookup``, which has a row for each
    key at most: ``rows`` are dealt by key and a salt from ``spread``, ``lookup`` is repeated for each salt."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [on, "_salt"], how).drop("_salt")


def maybe_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows with ``_maybe``: false where ``key`` is surely none of ``keys`` (one column; null is never in it).

    A bitmap of hashes, at most 2 ** 18 words, goes to all tasks, so that rows which can't meet a partner
    aren't shuffled for a join.  With very many keys it tells little, and the join behind it does all.
    """
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(PLACES))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    at = keys.select(F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(PLACES)).alias("_place"))
    words = at.groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(bit(F.col("_place"))).alias("_bits"))
    marked = rows.withColumn("_word", F.shiftright(place, 6)).join(F.broadcast(words), "_word", "left")
    return marked.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit(place)) != 0, F.lit(False)) & F.col(key).isNotNull()).drop("_word", "_bits")


def among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows whose ``key`` may be one of ``keys``; few others."""
    return maybe_in(rows, key, keys).where("_maybe").drop("_maybe")


def _sides(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _sides(edges)
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return salted_join(both.where("v > u"), low, "u", F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = salted_join(down, low, "u", F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def connected_components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges`` (u, v): root is the component's least node.

    Alternates large-star and small-star steps; each round is written to the shared folder and the next
    reads it.  Rounds grow with the logarithm of the longest path, a step's rows never exceed the edges'.
    Rows with a null end are no edges; an edge from a node to itself makes it a component.  The result is a
    written table; those of the rounds are deleted.
    """
    own = Scratch(edges.sparkSession, name)
    edges = own.put(edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL"), "edges")
    loops = edges.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("root"))
    now = own.put(edges.where("u <> v").distinct(), "0")
    was = _state(now)
    for k in range(most_rounds):
        if not was[0]:
            break
        now = own.put(_small_star(_large_star(now)), f"{k + 1}")
        own.drop(f"{k}")
        state = _state(now)
        if state == was:
            break
        was = state
    else:
        raise RuntimeError("components did not settle")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = own.put(found.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("root").alias("root")), "roots")
    own.drop("edges", *(k for k in own.paths if k.isdigit()))
    return out
