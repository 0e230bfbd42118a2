"""SQL source: tables with columns, views, statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.extract.lexer import STATEMENTS, statements
from srcloom.extract.sources import file_id, file_nodes
from srcloom.functions.identity import entity_id, link_id, schema_and_name
from srcloom.operators.lineage import cut

_NAME = r'((?:"?\w+"?\.)*"?\w+"?)'
TABLE = rf"(?is)^\s*create\s+(?:global\s+|local\s+)?(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?{_NAME}\s*\((.*)\)[^)]*$"
VIEW = rf"(?is)^\s*create\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+(?:if\s+not\s+exists\s+)?{_NAME}\s"
CONSTRAINTS = r"(?i)^\s*(?:primary|foreign|unique|check|constraint|index|key)\b"
VERBS = {"select": "SQLSelectStatement", "with": "SQLSelectStatement", "insert": "SQLInsertStatement", "update": "SQLUpdateStatement", "delete": "SQLDeleteStatement"}


def declared(files: DataFrame) -> DataFrame:
    """(path, line, endLine, kind, name, entityId, body, columns) of statements that declare or do something; columns: (name, extra) of
    a table's.

    Statements end with a semicolon; one in a string or a comment doesn't count, comments are dropped.  What patterns find is
    worked out in steps, each once: a step's columns are used by the next.  One step with all of it would make a method that is too large
    for the JVM to compile, and a filter would be put before the steps and try the patterns twice."""
    rows = files.select("path", "content").mapInArrow(statements, STATEMENTS).withColumn("verb", F.lower(F.regexp_extract("text", r"^(\w+)", 1)))
    # a statement that creates nothing isn't tried as a table or a view
    creates = F.col("verb") == "create"
    rows = rows.withColumns({"table": F.when(creates, F.regexp_extract("text", TABLE, 1)), "view": F.when(creates, F.regexp_extract("text", VIEW, 1)), "inside": F.when(creates, F.regexp_extract("text", TABLE, 2))})
    rows = rows.withColumns({"full": F.translate(F.coalesce(F.nullif("table", F.lit("")), F.nullif("view", F.lit(""))), '"', ""), "isTable": F.col("table") != ""})
    rows = rows.withColumn("kind", F.when(F.col("isTable"), "SQLTable").when(F.col("full").isNotNull(), "SQLView").otherwise(F.try_element_at(F.create_map(*(F.lit(x) for pair in VERBS.items() for x in pair)), "verb")))
    schema, name = schema_and_name(F.col("full"))
    place = F.concat_ws(":", "path", F.col("line").cast("string"), F.col("column").cast("string"))
    rows = rows.withColumns({"name": F.when(F.col("full").isNotNull(), name).otherwise(F.col("verb")), "known": F.when(F.col("full").isNotNull(), F.concat_ws(".", schema, name)).otherwise(place)})
    column = lambda c: F.struct(F.regexp_extract(c, r'^\s*"?(\w+)', 1).alias("name"), F.regexp_extract(c, r'^\s*"?\w+"?\s+(\w+(?:\s*\([^)]*\))?)', 1).alias("extra"))
    pieces = F.filter(F.split("inside", r",(?![^(]*\))"), lambda c: ~c.rlike(CONSTRAINTS))
    rows = rows.withColumns({"entityId": entity_id(F.col("kind"), F.col("known")), "columns": F.when(F.col("isTable"), F.filter(F.transform(pieces, column), lambda c: c["name"] != ""))})
    body = F.when(~F.coalesce("isTable", F.lit(False)), F.trim(F.regexp_replace("text", r"\s+", " ")))
    own = F.struct("path", "line", "endLine", "kind", "name", "entityId", body.alias("body"), "columns")
    return rows.select(F.explode(F.when(F.col("kind").isNotNull(), F.array(own))).alias("own")).select("own.*")


def sql(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables with columns, views and statements; DEFINES_TABLE, DEFINES_VIEW and HAS_COLUMN."""
    path, rows = F.col("path"), cut(declared(files))
    named = F.col("kind").isin("SQLTable", "SQLView")
    whole = lambda parent: ("entityId", "kind", "name", path.alias("filePath"), F.col("line").alias("startLine"), "endLine", (F.col("endLine") - F.col("line") + 1).alias("loc"), F.lit("SQL").alias("language"), parent.alias("parentId"), "extra")
    out = rows.withColumn("extra", F.col("body")).select(*whole(F.when(named, file_id(path))))
    columns = rows.where("kind = 'SQLTable'").select("path", "line", "endLine", F.col("entityId").alias("table"), F.inline("columns"))
    # a table's id is sanitized, and a column's name has nothing that isn't allowed
    columns = columns.withColumns({"kind": F.lit("SQLColumn"), "entityId": F.concat(F.lit("sqlcolumn:"), "table", F.lit("."), F.lower("name"))})
    rel = lambda kind, a, b, w: (link_id(kind, a, b).alias("entityId"), kind.alias("type"), a.alias("sourceId"), b.alias("targetId"), F.lit(w).alias("weight"))
    rels = rows.where(named).select(*rel(F.when(F.col("kind") == "SQLTable", "DEFINES_TABLE").otherwise("DEFINES_VIEW"), file_id(path), F.col("entityId"), 9))
    rels = rels.unionByName(columns.select(*rel(F.lit("HAS_COLUMN"), F.col("table"), F.col("entityId"), 8)))
    return file_nodes(files).unionByName(out).unionByName(columns.select(*whole(F.col("table")))), rels
