"""References to nodes: left resolution with placeholders, inner, by priority, first match, semi, anti."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.operators.lineage import joined


def resolve_left(refs: DataFrame, nodes: DataFrame, ref: str, node: str = "entityId") -> DataFrame:
    """refs with ``isPlaceholder``: whether no node has the id.  nodes hold each id once."""
    known = nodes.select(F.col(node).alias(ref), F.lit(False).alias("isPlaceholder"))
    return refs.join(known, ref, "left").withColumn("isPlaceholder", F.coalesce("isPlaceholder", F.lit(True)))


def resolve_inner(refs: DataFrame, nodes: DataFrame, ref: str, node: str = "entityId") -> DataFrame:
    """refs whose node exists, with the node's columns."""
    return refs.join(nodes, refs[ref] == nodes[node], "inner")


def resolve_priority(refs: DataFrame, lookups: list[tuple[str, DataFrame]], ref: str) -> DataFrame:
    """refs with ``resolved`` and ``via``: the first lookup, a table (key, value), that knows the reference."""
    out, values = refs, []
    for name, table in lookups:
        out = out.join(table.select(F.col("key").alias(ref), F.col("value").alias(f"_{name}")), ref, "left")
        values.append((name, F.col(f"_{name}")))
    via = None
    for name, v in values:
        via = F.when(v.isNotNull(), name) if via is None else via.when(v.isNotNull(), name)
    return out.withColumns({"resolved": F.coalesce(*(v for _, v in values)), "via": via}).drop(*(f"_{n}" for n, _ in values))


def first_match(nodes: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) of the first node of each key."""
    return nodes.groupBy(key).agg(F.min_by(value, order).alias(value))


def semi(rows: DataFrame, keep: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keep.select(*on), on, "left_semi")


def anti(rows: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(seen.select(*on), on, "left_anti")


def placeholders(rels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(entityId) of relationship ends that have no node: a bare node each."""
    ends = rels.select(F.explode(F.array("sourceId", "targetId")).alias("entityId"))
    return joined(ends.distinct(), nodes.select("entityId"), "entityId", "left_anti")


def with_placeholders(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    return nodes.unionByName(placeholders(rels, nodes), allowMissingColumns=True)


def weigh(rels: DataFrame, source_file: Column, target_file: Column, cross: int = 6, within: int = 7) -> DataFrame:
    """Adds isCrossFile and weight."""
    far = ~source_file.eqNullSafe(target_file)
    return rels.withColumns({"isCrossFile": far, "weight": F.when(far, cross).otherwise(within)})


def import_candidates(imports: DataFrame, files: DataFrame, extensions: list[str]) -> DataFrame:
    """imports (importer, specifier, ...) with ``resolved``: the first existing of the path itself, the path with
    each extension, and its index file with each; the bare path where none exists.  A specifier that isn't
    relative stays as it is.  Each file says which bases come to it, so that imports are looked up once and not once
    for each ending."""
    from srcloom.functions.identity import dirname, fold_dots, strip_script_extension

    base = fold_dots(F.concat(dirname(F.col("importer")), F.lit("/"), strip_script_extension(F.col("specifier"))))
    rows = imports.withColumns({"relative": F.col("specifier").startswith("."), "base": base})
    stems = [F.when(F.endswith("path", F.lit(e)), F.struct(F.expr(f"left(path, length(path) - {len(e)})").alias("key"), F.lit(k).alias("priority"))) for k, e in enumerate([*extensions, *("/index" + e for e in extensions)])]
    each = files.select("path", F.explode(F.filter(F.array(*stems), lambda x: x.isNotNull())).alias("s")).select("path", "s.*")
    hit = each.groupBy("key").agg(F.min_by("path", "priority").alias("found"))
    # what isn't relative has a key that is no file's, and not the same for all
    key = F.when(F.col("relative"), F.col("base")).otherwise(F.concat(F.lit("\x00"), F.col("importer")))
    return joined(rows.withColumn("key", key), hit, "key", "left").select(*imports.columns, F.when(F.col("relative"), F.coalesce("found", "base")).otherwise(F.col("specifier")).alias("resolved"), F.when(F.col("relative"), F.col("found").isNull()).otherwise(F.lit(True)).alias("isPlaceholder"))
