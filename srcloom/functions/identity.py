"""Entity ids, instance ids and the string functions that feed them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def sanitize(name: Column) -> Column:
    """Lower case, and ``_`` for what isn't a letter, digit or one of ``_ . : / -``; a character outside
    the basic plane counts as two."""
    low = F.lower(normalize_path(name))
    two = F.when(F.octet_length(name) == F.length(name), low).otherwise(F.regexp_replace(low, r"[\x{10000}-\x{10FFFF}]", "__"))
    return F.regexp_replace(two, r"[^\w.:/-]", "_")  # no capital is left


def entity_id(prefix: str | Column, name: Column) -> Column:
    """``prefix:name``; empty parts become ``unknown``."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    known = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "unknown").otherwise(c)
    return F.concat(F.lower(known(prefix)), F.lit(":"), sanitize(known(name)))


def relationship_id(kind: str | Column, source: Column, target: Column) -> Column:
    """No call site is in it: equal ends and type are one relationship."""
    return entity_id(kind, F.concat_ws(":", source, target))


def link_id(kind: str | Column, source: Column, target: Column) -> Column:
    """``relationship_id`` of two ids, which have been sanitized already."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lower(kind), F.lit(":"), F.concat_ws(":", source, target))


def instance_id(prefix: str | Column, name: Column, line: Column, column: Column, counter: Column) -> Column:
    """An id of one occurrence: case is kept; line and column are left out where null."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    clean = F.regexp_replace(normalize_path(name), "[^a-zA-Z0-9_.:/-]", "_")
    return F.concat_ws(":", F.lower(prefix), clean, F.concat(F.lit("L"), line), F.concat(F.lit("C"), column), counter.cast("string"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(normalize_path(path), "/"), -1)


def dirname(path: Column) -> Column:
    path = normalize_path(path)
    return F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty for a name without one or of one leading dot only."""
    return F.lower(F.regexp_extract(basename(path), r"^.+?(\.[^.]+)$", 1))


def strip_script_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)\.jsx?$", "")


def fold_dots(path: Column) -> Column:
    """Resolves ``.`` and ``..`` segments: each ``..`` takes the segment before it."""
    near = F.replace(path, F.lit("/./"), F.lit("/"))
    parts = F.filter(F.split(near, "/"), lambda p: (p != ".") & (p != ""))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    # most paths have no more of them, and are as they stand
    return F.when(~near.rlike(r"(?s)//|/\.{1,2}(?:/|$)|./$|^\.{1,2}(?:/|$)"), near).otherwise(F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(done, "/")))


def tokens(value: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(value, r"\s+"), lambda t: t != "")


def callee_slug(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, "[^a-zA-Z0-9_]", "_"), 1, 30)


def path_hash(path: Column) -> Column:
    return F.sha2(normalize_path(path), 256)


def schema_and_name(name: Column) -> tuple[Column, Column]:
    """``schema.table`` in two; without a dot the schema is null; a third part is left out."""
    parts = F.split(name, r"\.")
    two = F.size(parts) > 1
    return F.when(two, parts[0]), F.when(two, parts[1]).otherwise(parts[0])


def inside_delimiters(text: Column) -> Column:
    return F.substring(text, 2, 1_000_000).substr(F.lit(1), F.greatest(F.length(text) - 2, F.lit(0)))
