"""JSX elements, attributes and utility classes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.extract.lexer import files_of, in_batches
from srcloom.functions.identity import entity_id, link_id, tokens
from srcloom.operators.lineage import cut, dealt

_VALUE = r"""(?:"[^"]*+"|'[^']*+'|\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\})"""
TAG = rf"(?<![\w.)])</?[A-Za-z][\w.]*(?:\s+(?:[\w:-]+(?:\s*=\s*{_VALUE})?|\{{\.\.\.[^}}]*\}}))*\s*/?>"
TAGS = re.compile(TAG, re.A)
NAME = re.compile(r"[\w.]+", re.A)
ELEMENTS = "path string, tag string, selfClosing boolean, attrs string, line int, column int, place string, parent string"
_ELEMENT = [(c, {"boolean": pa.bool_(), "int": pa.int32()}.get(kind, pa.string())) for c, kind in (x.split() for x in ELEMENTS.split(", "))]
ATTRIBUTE = rf"(?:^|\s)([\w:-]+)(?:\s*=\s*({_VALUE}))?(?=\s|/|>|$)"


def tags(content: str) -> Iterator[tuple[str, bool, str, int, int, str, str | None]]:
    """(tag, selfClosing, attrs, line, column, place, parent) of the tags that open an element, by one pass over a file; parent is
    the place of the last element one level up that was opened before."""
    depth, at, line, begins, opened = 0, 0, 1, 0, {}
    for m in TAGS.finditer(content):
        text, start = m[0], m.start()
        line += content.count("\n", at, start)
        begins = content.rfind("\n", at, start) + 1 or begins
        at = start
        if text[1] == "/":
            depth -= 1
            continue
        tag, single = NAME.match(text, 1)[0], text.endswith("/>")
        place = f"{tag}:{line}:{start - begins}"
        yield tag, single, text[1 + len(tag) : -2 if single else -1], line, start - begins, place, opened.get(depth)
        if not single:
            depth += 1
            opened[depth] = place


def elements(files: DataFrame) -> DataFrame:
    """(path, tag, selfClosing, attrs, line, column, entityId, parentId) of all elements.  Nothing is shuffled or sorted: an
    element's parent is in its own file, which one task reads."""
    found = files.select("path", "content").mapInArrow(lambda batches: in_batches(((path, *own) for path, content in files_of(batches) for own in tags(content or "")), _ELEMENT), ELEMENTS)
    ident = lambda place: entity_id("jsxelement", F.concat_ws(":", "path", place))
    return found.select("path", "tag", "selfClosing", "attrs", "line", "column", ident("place").alias("entityId"), F.when(F.col("parent").isNotNull(), ident("parent")).alias("parentId"))


def jsx(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSXElement, JSXAttribute and TailwindClass nodes; RENDERS_ELEMENT, HAS_PROP, USES_TAILWIND_CLASS.

    Elements with their attributes and uses of classes are written once.  Classes and uses are made distinct in tasks of
    a bounded number of rows, by ids before the longer ids of relationships are made of them."""
    props = F.transform(F.regexp_extract_all(F.regexp_replace("attrs", r"\{\.\.\.[^}]*\}", " "), F.lit(ATTRIBUTE), F.lit(0)), lambda a: F.struct(F.regexp_extract(a, ATTRIBUTE, 1).alias("name"), F.regexp_extract(a, ATTRIBUTE, 2).alias("raw")))
    found = cut(elements(files).withColumn("props", props).drop("attrs"))
    attrs = found.select("path", "line", F.col("entityId").alias("elementId"), F.inline("props"))
    value = F.when(F.col("raw") == "", "true").when(F.col("raw").rlike(r"""^["']"""), F.regexp_replace("raw", r"""^["']|["']$""", "")).otherwise(F.col("raw"))
    # an element's id is sanitized, and a name has nothing that isn't allowed
    attrs = attrs.withColumns({"value": value, "entityId": F.concat(F.lit("jsxattribute:"), "elementId", F.lit(":"), F.lower("name"))})
    classes = cut(attrs.where((F.col("name") == "className") & F.col("raw").rlike(r"""^["']""")).select("elementId", F.explode(tokens(F.col("value"))).alias("name")).withColumn("entityId", entity_id("tailwindclass", F.col("name"))))
    named = dealt(classes.select("entityId", "name"), "entityId").distinct()
    uses = dealt(classes.select("elementId", "entityId"), "elementId").distinct()
    node = lambda rows, kind, extra, path, line: rows.select("entityId", F.lit(kind).alias("kind"), "name", path.alias("filePath"), line.alias("startLine"), extra.alias("extra"))
    nodes = node(found.withColumn("name", F.col("tag")), "JSXElement", F.col("selfClosing").cast("string"), F.col("path"), F.col("line")).unionByName(node(attrs, "JSXAttribute", F.col("value"), F.col("path"), F.col("line"))).unionByName(node(named, "TailwindClass", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0)))
    rel = lambda rows, kind, a, b, w: rows.select(link_id(kind, F.col(a), F.col(b)).alias("entityId"), F.lit(kind).alias("type"), F.col(a).alias("sourceId"), F.col(b).alias("targetId"), F.lit(w).alias("weight"))
    rels = rel(found.where("parentId IS NOT NULL"), "RENDERS_ELEMENT", "parentId", "entityId", 6).unionByName(rel(attrs, "HAS_PROP", "elementId", "entityId", 7)).unionByName(rel(uses, "USES_TAILWIND_CLASS", "elementId", "entityId", 2))
    return nodes, rels
