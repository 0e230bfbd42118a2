"""Lines of source files with block depths, and what rules find in them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcloom.extract.lexer import LINES, lines
from srcloom.operators.lineage import cut


@dataclass(frozen=True)
class Rule:
    """What one line declares.

    pattern: on the line without comments and string contents, or with ``raw`` on the line itself.
    name, extra: its groups (0: none).  opens: whether members belong to it; ``body`` that it holds
    statements, so that nothing in it is a member.  where: a condition on depth, group and text.
    needs: words of which one is in every line that the pattern fits, looked for first, as that costs little.
    """

    kind: str
    pattern: str
    name: int = 1
    extra: int = 0
    opens: bool = False
    body: bool = False
    raw: bool = False
    where: str = "true"
    needs: tuple[str, ...] = ()


def code_lines(files: DataFrame, *columns: str, bare: bool = True) -> DataFrame:
    """The named columns of (path, line, text, clean, params, inside, last, before, opener, closer, group) of files (path, content).

    text and clean: the logical line, with and without strings and comments; params: what stands in its first
    parenthesis; inside: open blocks of branches and loops where it begins; last: the last line of it; before: open
    braces where it begins; opener: the line before it that opened, by a brace behind other text, the last block of
    that depth (0: none); closer: the first line from it on that closes a block of that depth; group: the word of the
    parenthesis that the line stands in.  bare: with lines that hold nothing or brackets only.
    files may be what ``lexed`` wrote of them, which has no bare lines.
    """
    if "clean" in files.columns:
        if bare:
            raise ValueError("bare lines aren't written")
        return files.select(*(F.coalesce("text", "clean").alias("text") if c == "text" else c for c in columns))
    return files.select("path", "content").mapInArrow(lambda batches: lines(batches, columns, bare), ", ".join(f"{c} {LINES[c]}" for c in columns))


def lexed(files: DataFrame, *columns: str) -> DataFrame:
    """Lines of files that aren't bare, written once for several that read them; text is null where it is as clean."""
    rows = code_lines(files, *columns, bare=False)
    return cut(rows.withColumn("text", F.nullif("text", "clean")) if "text" in columns else rows)


def declarations(files: DataFrame, rules: list[Rule], tasks: int) -> DataFrame:
    """(path, line, endLine, kind, name, extra, header, params, depth, ownerKind, ownerName, ownerLine), dealt by path over ``tasks``.

    Of several rules the first decides.  The owner is the innermost block that a declaration opened and
    the line stands in; null at the top and in blocks that nothing declared.
    """
    rows = code_lines(files, "path", "line", *(("text",) if any(r.raw for r in rules) else ()), "clean", "params", "last", "before", "opener", "closer", *(("group",) if any("group" in r.where for r in rules) else ()), bare=False)
    decl = None
    for r in rules:
        on = "text" if r.raw else "clean"
        found = F.struct(F.lit(r.kind).alias("kind"), F.regexp_extract(on, r.pattern, r.name).alias("name"), (F.regexp_extract(on, r.pattern, r.extra) if r.extra else F.lit(None).cast("string")).alias("extra"), F.lit(r.opens).alias("opens"), F.lit(r.body).alias("body"))
        fits = F.expr(r.where) & F.col(on).rlike(r.pattern)
        if r.needs:
            fits = reduce(or_, (F.contains(F.col(on), F.lit(x)) for x in r.needs)) & fits
        decl = F.when(fits, found) if decl is None else decl.when(fits, found)
    rows = rows.withColumn("decl", decl)
    # a declaration is one row at the depth where it stands and, where it holds others, one at the depth of those
    holds = F.col("decl.opens") | F.col("decl.body")
    scope = F.struct(F.col("decl.kind").alias("kind"), F.col("decl.name").alias("name"), "line")
    block = F.col("clean").contains("{") | ~F.col("clean").rlike(r"[;,)]\s*$") | (F.col("decl.body") & ~F.col("clean").rlike(r";\s*$"))
    end = F.when(block & holds, F.greatest(F.coalesce("closer", "line"), "last")).otherwise(F.when(F.col("decl.body"), F.col("last")).otherwise(F.col("line")))
    own = F.struct(end.cast("int").alias("endLine"), F.col("decl.kind").alias("kind"), F.col("decl.name").alias("name"), F.col("decl.extra").alias("extra"), F.col("clean").alias("header"), "params", "opener")
    no_scope, no_decl = F.lit(None).cast("struct<kind:string,name:string,line:int>"), F.lit(None).cast(rows.select(own.alias("own")).schema["own"].dataType)
    event = lambda depth, role, scope, own: F.struct(depth.alias("depth"), F.lit(role).alias("role"), scope.alias("scope"), own.alias("own"))
    # what declares nothing goes here and not by a filter, which would be put before the rules and try them twice
    events = F.when(F.col("decl").isNotNull(), F.array(event(F.col("before"), 0, no_scope, own), F.when(holds, event(F.col("before") + 1, 1, scope, no_decl))))
    every = rows.select("path", "line", F.explode(events).alias("e")).where("e IS NOT NULL").select("path", "line", "e.*").repartition(tasks, "path")
    earlier = Window.partitionBy("path", "depth").orderBy("line", "role").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("owner", F.last("scope", True).over(earlier)).where("role = 0")
    # what nothing declared has opened a block since
    inner = F.coalesce(F.col("own.opener") > F.col("owner.line"), F.col("own.opener") > 0)
    owner = F.when(F.col("depth") > 0, F.when(inner, F.struct(F.lit("block").alias("kind"), F.lit(None).cast("string").alias("name"), F.col("own.opener").alias("line"))).otherwise(F.col("owner")))
    return every.withColumn("owner", owner).select("path", "line", "own.endLine", "own.kind", "own.name", "own.extra", "own.header", "own.params", "depth", F.col("owner.kind").alias("ownerKind"), F.col("owner.name").alias("ownerName"), F.col("owner.line").alias("ownerLine"))


def declarators(rows: DataFrame, kinds: list[str], typed: bool = False) -> DataFrame:
    """A row for each name that a declaration of one of ``kinds`` declares (``int a, b = f(1, 2);``).
    typed: names have types behind a colon."""
    flat = F.col("header")
    for _ in range(6):  # nested brackets, from the inside
        flat = F.regexp_replace(flat, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>", "")
    flat = F.regexp_replace(F.regexp_replace(flat, r";.*$", ""), r"=[^,]*", "")
    flat = F.regexp_replace(flat, r":[^,]*", "") if typed else flat
    more = F.transform(F.slice(F.split(flat, ","), 2, 1_000_000), lambda x: F.regexp_extract(x, r"^\s*[*&]*([\w$]+)", 1))
    names = F.concat(F.array("name"), F.filter(more, lambda x: x != ""))
    return rows.withColumn("name", F.explode(F.when(F.col("kind").isin(*kinds), names).otherwise(F.array("name"))))
