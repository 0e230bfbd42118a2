"""Documentation comments and what they belong to."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.extract.lexer import BEFORE_REGEX, REGEX, TOKENS, files_of, in_batches
from srcloom.operators.lineage import cut, joined

COMMENTS = "path string, line int, description string, tags array<string>"


def doc_comments(content: str) -> list[tuple[int, str, list[str]]]:
    """(line of what follows, text before the first tag, names of the tags) of each ``/** */``; of several before one
    line the last counts."""
    out: dict[int, tuple[int, str, list[str]]] = {}
    line, at, last = 1, 0, ""
    while at < len(content):
        m = TOKENS.match(content, at)
        kind, s = m.lastgroup, m[0]
        if kind == "slash" and (not last or last in BEFORE_REGEX) and (r := REGEX.match(content, at)):
            kind, s = "string", r[0]
        at += len(s)
        line += len(re.findall(r"\r\n|\n|\r", s))
        if kind == "comment" and s.startswith("/**") and s != "/**/":
            rows = [re.sub(r"^\s*\*?\s?", "", x).rstrip() for x in re.split(r"\r\n|\n|\r", s[3:].removesuffix("*/"))]
            text = "\n".join(rows).strip()
            head = re.split(r"(?:^|\n)\s*@", text, maxsplit=1)[0].strip()
            next_line = line + len(re.findall(r"\r\n|\n|\r", re.compile(r"\s*").match(content, at)[0]))
            out[next_line] = (next_line, head, re.findall(r"(?:^|\n)\s*@(\w+)", text))
        elif kind == "string":
            last = '"'
        elif s.strip():
            last = s.rstrip()[-1]
    return list(out.values())


def documentation(files: DataFrame) -> DataFrame:
    """Rows of COMMENTS of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [("path", pa.string()), ("line", pa.int32()), ("description", pa.string()), ("tags", pa.list_(pa.string()))]
        return in_batches(((path, *own) for path, content in files_of(batches) for own in doc_comments(content or "")), columns)

    return files.select("path", "content").mapInArrow(run, COMMENTS)


def documented(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """nodes with ``documentation`` and ``tags`` of the comment before the line that they begin on; parameters have none."""
    rows = cut(documentation(files)).select(F.col("path").alias("filePath"), F.col("line").alias("startLine"), F.nullif("description", F.lit("")).alias("documentation"), "tags")
    found = joined(nodes, rows, ["filePath", "startLine"], "left")
    own = ~F.col("kind").isin("File", "Parameter", "JSXElement", "JSXAttribute", "TailwindClass")
    return found.withColumns({"documentation": F.when(own, F.col("documentation")), "tags": F.when(own, F.col("tags"))})
