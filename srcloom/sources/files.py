"""Source trees: the scan of a directory and its filters, and the dispatch to extractors."""

from __future__ import annotations

import logging
import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.functions.identity import extension
from srcloom.operators.lineage import cut
from srcloom.schema import IGNORES, PARSERS

log = logging.getLogger(__name__)
FOUND = "kind string, path string, name string, message string"


def glob_regex(globs) -> str:
    """One regular expression for whole paths: ``**`` crosses folders, ``*`` and ``?`` don't."""

    def one(glob: str) -> str:
        out, k = "", 0
        while k < len(glob):
            if glob.startswith("**/", k):
                out, k = out + "(?:.*/)?", k + 3
            elif glob.startswith("/**", k) and k + 3 == len(glob):
                out, k = out + "(?:/.*)?", k + 3
            elif glob.startswith("**", k):
                out, k = out + ".*", k + 2
            else:
                c = glob[k]
                out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), k + 1
        return out

    return "^(?:" + "|".join(one(g) for g in dict.fromkeys(globs)) + ")$"


def ignores(more=(), target: str = "") -> list[str]:
    """Defaults and the caller's; tests are looked at where the target itself lies among tests."""
    every = list(dict.fromkeys([*IGNORES, *more]))
    return [g for g in every if not (g == "**/__tests__/**" and "__tests__" in target)]


def scan(spark: SparkSession, directory: str, extensions=tuple(PARSERS), ignore=()) -> DataFrame:
    """(path, name, extension) of a directory's files: what ``scan_tree`` finds, with a warning of what it can't read."""
    files, errors = scan_tree(spark, directory, extensions, ignore)
    for e in errors.limit(20).collect():
        log.warning("not read: %s: %s", e["path"], e["message"])
    return files


def scan_tree(spark: SparkSession, directory: str, extensions=tuple(PARSERS), ignore=(), per_task: int = 64) -> tuple[DataFrame, DataFrame]:
    """(path, name, extension) of the files below a directory, and (path, message) of folders that couldn't be listed.

    Each round lists the folders that the one before found, in tasks, so a tree takes as many rounds as it is deep and
    the driver holds no listing.  Names that start with ``_`` or ``.`` count; ignored folders aren't entered, links aren't
    followed.  directory: a path, or a URI of a store that pyarrow reads (file, hdfs by libhdfs, s3, gs) and all
    executors reach.
    """
    bad = glob_regex(ignores(ignore, directory))
    root = directory.rstrip("/") if "://" in directory else os.path.abspath(directory)
    rounds, frontier = [], spark.createDataFrame([(root,)], "folder string")
    while True:
        n = max(1, -(-frontier.count() // per_task))
        found = cut(frontier.repartition(n).mapInPandas(_lister(bad, tuple(extensions)), FOUND))
        rounds.append(found)
        frontier = found.where("kind = 'folder'").select(F.col("path").alias("folder"))
        if frontier.isEmpty():
            break
    every = rounds[0]
    for found in rounds[1:]:
        every = every.unionByName(found)
    return every.where("kind = 'file'").select("path", "name", extension(F.col("path")).alias("extension")), every.where("kind = 'error'").select("path", "message")


def _store(path: str):
    """The file system of a path or URI, what stands before its paths, and the path in it."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), "", path
    store, inner = fs.FileSystem.from_uri(path)
    return store, path[: len(path) - len(inner)] if path.endswith(inner) else "", inner


def _lister(bad: str, extensions: tuple[str, ...]):
    skip = re.compile(bad)

    def run(batches):
        from pyarrow import fs

        for pdf in batches:
            rows = []
            for folder in pdf["folder"]:
                try:
                    store, head, inner = _store(folder)
                    found = store.get_file_info(fs.FileSelector(inner, recursive=False))
                except Exception as e:  # whatever a store raises is a row
                    rows.append(("error", folder, None, str(e)[:500]))
                    continue
                for info in found:
                    path, name = head + info.path, info.base_name
                    if skip.match(path) or isinstance(store, fs.LocalFileSystem) and os.path.islink(info.path):
                        continue
                    if info.type == fs.FileType.Directory:
                        rows.append(("folder", path, name, None))
                    elif info.type == fs.FileType.File and os.path.splitext(name)[1].lower() in extensions and not skip.match(name):
                        rows.append(("file", path, name, None))
            yield pd.DataFrame(rows, columns=["kind", "path", "name", "message"])

    return run


def read(files: DataFrame, per_task: int = 64) -> DataFrame:
    """Adds ``content``, the files' text, and ``error``, why it can't be read; one of them is null.  Read where the
    rows are, from any store that ``scan_tree`` lists; bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        for pdf in batches:
            pairs = [_text(p) for p in pdf["path"]]
            yield pdf.assign(content=[c for c, _ in pairs], error=[e for _, e in pairs])

    n = max(1, -(-files.count() // per_task))
    return files.repartition(n).mapInPandas(run, files.schema.simpleString()[7:-1].replace(":", " ") + ", content string, error string")


def _text(path: str) -> tuple[str | None, str | None]:
    try:
        store, _, inner = _store(path)
        with store.open_input_stream(inner) as f:
            return f.read().decode("utf-8", "replace"), None
    except Exception as e:  # whatever a store raises is a row
        return None, str(e)[:500]


def load(spark: SparkSession, directory: str, extensions=tuple(PARSERS), ignore=()) -> tuple[DataFrame, DataFrame]:
    """(path, content) of a directory's files, and (path, step, message) of what couldn't be listed or read."""
    files, errors = scan_tree(spark, directory, extensions, ignore)
    texts = cut(read(files))
    unread = errors.withColumn("step", F.lit("list")).unionByName(texts.where("error IS NOT NULL").select("path", F.col("error").alias("message")).withColumn("step", F.lit("read")))
    return texts.where("error IS NULL").select("path", "content"), unread.select("path", "step", "message")


def parser_of(path: Column) -> Column:
    """The extractor for a path's extension; null where there is none."""
    ext, out = extension(path), None
    for e, p in PARSERS.items():
        out = F.when(ext == e, p) if out is None else out.when(ext == e, p)
    return out


def language_of(path: Column) -> Column:
    """The language that a file's nodes carry."""
    ext = extension(path)
    return F.when(ext.isin(".tsx", ".jsx", ".js", ".mjs", ".cjs"), "TSX").when(ext == ".ts", "TypeScript").when(ext == ".py", "Python").when(ext.isin(".c", ".h"), "C").when(ext.isin(".cpp", ".hpp", ".cc", ".hh"), "C++").when(ext == ".java", "Java").when(ext == ".go", "Go").when(ext == ".cs", "C#").when(ext == ".sql", "SQL")
