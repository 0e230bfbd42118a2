"""Which file a C or C++ include means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.extract.sources import file_id
from srcloom.functions.identity import dirname, fold_dots, relationship_id


def gate(nodes: DataFrame) -> DataFrame:
    """What stands in C and C++ files."""
    return nodes.where("language IN ('C', 'C++')")


def _folders(path: Column) -> Column:
    """A folder and all folders around it, the root (empty) last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def resolved_includes(nodes: DataFrame) -> DataFrame:
    """(importer, includePath, isSystem, resolved) of the includes of C and C++ files.

    A quoted include means the file at that path from the including file's folder, if there is one.  Otherwise, and
    for includes in angle brackets, it means a file whose path ends in it: of several the one in the innermost
    folder around the including file, there the one with the shortest path; where several are equally short, and where
    none is, ``resolved`` is null.  Dots at the front don't count for the end of a path.

    Files are looked up by (end of the path, folder around it), with one row for each such pair, so a name that every
    folder has isn't paired with all its includes.
    """
    rows = gate(nodes).where("kind = 'IncludeDirective'").select(F.col("filePath").alias("importer"), F.col("name").alias("includePath"), (F.col("extra") == "<").alias("isSystem")).distinct()
    rows = rows.withColumns({"folder": dirname(F.col("importer")), "tail": F.regexp_replace(fold_dots(F.col("includePath")), r"^/", "")})
    files = gate(nodes).where("kind = 'File'").select(F.col("filePath").alias("path"))
    beside = rows.where("NOT isSystem").select("importer", "includePath", fold_dots(F.concat("folder", F.lit("/"), "includePath")).alias("path")).join(files, "path").select("importer", "includePath", F.col("path").alias("beside"))
    # each way to cut a path in a folder and an end that some include names
    parts = F.split("path", "/")
    cuts = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k - 1), "/").alias("root"), F.array_join(F.slice(parts, k, F.size(parts)), "/").alias("tail")))).alias("c")).select("path", "c.*")
    named = cuts.join(rows.select("tail").distinct(), "tail", "left_semi")
    places = named.select("tail", "path", F.explode(_folders(F.col("root"))).alias("around")).groupBy("tail", "around", F.length("path").alias("size")).agg(F.count("*").alias("n"), F.min("path").alias("path"))
    places = places.groupBy("tail", "around").agg(F.min(F.struct("size", "n", "path")).alias("p")).select("tail", "around", "p.n", "p.path")
    asked = rows.select("importer", "includePath", "tail", F.posexplode(_folders(F.col("folder"))).alias("far", "around"))
    near = asked.join(places, ["tail", "around"]).groupBy("importer", "includePath").agg(F.min(F.struct("far", "n", "path")).alias("p"))
    near = near.select("importer", "includePath", F.when(F.col("p.n") == 1, F.col("p.path")).alias("near"))
    every = rows.join(beside, ["importer", "includePath"], "left").join(near, ["importer", "includePath"], "left")
    return every.select("importer", "includePath", "isSystem", F.when(F.col("isSystem"), F.col("near")).otherwise(F.coalesce("beside", "near")).alias("resolved")).distinct()


def includes(nodes: DataFrame) -> DataFrame:
    """INCLUDES from C and C++ files to the files that they include; a placeholder of the written path where none is meant."""
    rows = resolved_includes(nodes).select(file_id(F.col("importer")).alias("sourceId"), file_id(F.coalesce("resolved", "includePath")).alias("targetId"), "includePath", F.col("isSystem").alias("isSystemInclude"), F.col("resolved").isNull().alias("isPlaceholder"))
    first = rows.groupBy("sourceId", "targetId").agg(F.min(F.struct("isPlaceholder", "isSystemInclude", "includePath")).alias("x"))
    return first.select(relationship_id("INCLUDES", F.col("sourceId"), F.col("targetId")).alias("entityId"), F.lit("INCLUDES").alias("type"), "sourceId", "targetId", F.lit(4).alias("weight"), "x.includePath", "x.isSystemInclude", "x.isPlaceholder")
