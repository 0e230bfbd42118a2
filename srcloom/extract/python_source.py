"""Python source: statements with their blocks from one linear pass over a file's tokens, the rest DataFrame functions.

What stands inside f-strings is part of the string.  A file with an open bracket or string at its end, or with a
block that fits no indentation, has one row of kind Error and yields its File node only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.extract.lexer import files_of, in_batches
from srcloom.extract.sources import file_nodes
from srcloom.functions.identity import entity_id, link_id
from srcloom.operators.lineage import cut

TOKENS = re.compile(
    r'''(?P<comment>#[^\r\n]*)'''
    r'''|(?P<string>(?:\b[rRbBuUfF]{1,2})?(?:"""(?:[^"\\]|\\[\s\S]|"(?!""))*+(?P<a>""")?|\'\'\'(?:[^'\\]|\\[\s\S]|'(?!\'\'))*+(?P<b>\'\'\')?|"(?:[^"\\\n]|\\[\s\S])*+"?|'(?:[^'\\\n]|\\[\s\S])*+'?))'''
    r'''|(?P<joined>\\(?:\r\n|\n|\r))|(?P<newline>\r\n|\n|\r)|(?P<mark>[()\[\]{}:;])|(?P<rest>[A-Za-z_]\w*|[^#"'\\\r\n()\[\]{}:;\w]+|\w+|.)''',
    re.S,
)
#: Words that begin a statement with a block.
BLOCKS = re.compile(r"\s*(?:async\s+)?(?:(?:def|class|if|elif|else|for|while|try|except|finally|with)\b|(?:match|case)\b(?!\s*[:=.]))")
INDENT = re.compile(r"[ \t\f]*")
ENTRIES = "path string, kind string, n int, line int, last int, depth int, clean string, until int, owner int, params array<struct<name:string,line:int>>, ending int, around string, class string"
HEAD = re.compile(r"(?:async )?(?:def|class) [A-Za-z_]", re.A)
NOT_CALLED = ("if", "elif", "while", "for", "in", "not", "and", "or", "is", "return", "yield", "lambda", "assert", "del", "with", "except", "raise", "from", "import", "await", "else")


def statements(content: str) -> list[list]:
    """[first line, last line, indentation, text] of each statement, comments left out and strings blanked; a block's
    header and what follows it on its line are two, the second deeper by half.  Raises ValueError on open brackets or strings."""
    out: list[list] = []
    indent_at = lambda at: len(INDENT.match(content, at)[0].expandtabs(8))
    line, first, depth, text, indent, deeper = 1, 1, [], "", indent_at(0), 0.0

    def close() -> None:
        nonlocal text
        if text.strip():
            out.append([first, line, indent + deeper, text.strip()])
        text = ""

    for m in TOKENS.finditer(content):
        s, kind = m[0], "string" if m["string"] is not None else m.lastgroup
        if kind not in ("comment", "newline", "joined") and s.strip() and not text.strip():
            first = line
        if kind == "string":
            quote = s.lstrip("rRbBuUfF")
            long = quote[:3] in ('"""', "\'\'\'")
            if len(quote) < (6 if long else 2) or not quote.endswith(quote[:3] if long else quote[0]):
                raise ValueError(f"open string in line {line}")
            text += '""'
            line += len(re.findall(r"\r\n|\n|\r", s))
        elif kind == "joined":
            line += 1
            text += " "
        elif kind == "newline":
            if depth:
                text += "\n"
            else:
                close()
                indent, deeper = indent_at(m.end()), 0.0
            line += 1
        elif kind == "mark" and s in "([{":
            depth.append(s)
            text += s
        elif kind == "mark" and s in ")]}":
            if not depth or "([{".index(depth.pop()) != ")]}".index(s):
                raise ValueError(f"bracket in line {line}")
            text += s
        elif s == ";" and not depth:
            close()
        elif s == ":" and not depth and BLOCKS.match(text) and not re.search(r"\blambda\b[^:]*$", text):
            text += s
            close()
            deeper += 0.5
        elif kind != "comment":
            text += s
    if depth:
        raise ValueError("open bracket at the end")
    close()
    return out


def parameters(header: str, line: int) -> list[tuple[str, int]]:
    """Names and lines of the parameters that may be given by place or by name."""
    at = header.find("(")
    out, depth, start = [], 0, at + 1
    cuts = []
    for k in range(max(at, 0), len(header)):
        if header[k] in "([{":
            depth += 1
        elif header[k] in ")]}":
            depth -= 1
            if not depth:
                cuts.append((start, k))
                break
        elif header[k] == "," and depth == 1:
            cuts.append((start, k))
            start = k + 1
    for a, z in cuts:
        part = header[a:z]
        name = re.match(r"\s*(\*{0,2}|/)\s*([^\W\d]\w*)?", part)
        if part.strip() == "/":
            out = []  # those before it go by place only
        elif name[1].startswith("*"):
            break
        elif name[2]:
            out.append((name[2], line + header.count("\n", 0, a + name.start(2))))
    return out


def entries(path: str, content: str) -> list[tuple]:
    """Rows of ENTRIES of one file: statements with their depth, the last statement of the block that each opens, and the
    statement that a decorator belongs to; the last line of that block, the header of the innermost function or class that
    holds it (a header's decorators are in it), and that of the class around that one, however far out."""
    try:
        found = statements(content)
    except ValueError as e:
        return [(path, "Error", 0, 0, 0, 0, str(e), *[None] * 6)]
    levels, openers, until = [0.0], [], {}
    depths = []
    for n, (line, _, indent, text) in enumerate(found):
        while indent < levels[-1]:
            levels.pop()
        if indent > levels[-1]:
            if n == 0 or not found[n - 1][3].endswith(":"):
                return [(path, "Error", 0, line, line, 0, f"indentation in line {line}", *[None] * 6)]
            levels.append(indent)
        depth = len(levels) - 1
        while openers and openers[-1][0] >= depth:
            until[openers.pop()[1]] = n - 1
        if text.endswith(":"):
            openers.append((depth, n))
        depths.append(depth)
    for _, n in openers:
        until[n] = len(found) - 1
    owner, out = {}, []
    for n in range(len(found) - 1, -1, -1):
        owner[n] = owner.get(n + 1, n + 1) if found[n][3].startswith("@") else n
    clean = [re.sub(r"\s+", " ", text) for *_, text in found]
    heads, classes, held = [], [], []
    for n, text in enumerate(clean):
        for own in (heads, classes):
            while own and own[-1][0] < n:
                own.pop()
        if HEAD.match(text) and text.endswith(":"):
            heads.append((until.get(n, n), text, classes[-1][1] if classes else None))
            if text.startswith("class "):
                classes.append(heads[-1])
        held.append(heads[-1][1:] if heads else (None, None))
    for n, (line, last, _, text) in enumerate(found):
        is_def = bool(re.match(r"(?:async\s+)?def\b", text))
        out.append((path, "Line", n, line, last, depths[n], clean[n], until.get(n), owner[n], parameters(text, line) if is_def else None, found[until.get(n, n)][1], *held[owner[n]]))
    return out


def syntax(files: DataFrame) -> DataFrame:
    """Rows of ENTRIES of all files."""
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32())])), pa.int32(), pa.string(), pa.string())
    names = ("path", "kind", "n", "line", "last", "depth", "clean", "until", "owner", "params", "ending", "around", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for path, content in files_of(batches) for r in entries(path, content))
        return in_batches(((*r[:9], None if r[9] is None else [{"name": x, "line": y} for x, y in r[9]], *r[10:]) for r in rows), list(zip(names, kinds, strict=True)))

    return files.select("path", "content").where("content IS NOT NULL").mapInArrow(run, ENTRIES)


def _of(kind: Column, name: Column) -> Column:
    return F.when(kind == "File", entity_id("file", F.col("path"))).otherwise(entity_id(kind, F.concat_ws(":", "path", name)))


def python(files: DataFrame):
    """Functions, methods, parameters, classes, imported modules, variables, and calls to functions of the
    same name (placeholders where the file has none)."""
    name = lambda c: F.regexp_extract(c, r"^(?:async )?(?:def|class) ([^\W\d]\w*)", 1)
    none = F.lit(None).cast("string")
    own = F.nullif(name("around"), F.lit(""))
    rows = syntax(files).where("kind = 'Line'").withColumns({"class": F.nullif(name("class"), F.lit("")), "name": own, "isClass": F.col("around").startswith("class ")})
    what = F.when(F.col("isClass"), "PythonClass").when(F.col("class").isNotNull(), "PythonMethod").when(F.col("name").isNotNull(), "PythonFunction")
    full = F.when(F.col("isClass") | F.col("class").isNull(), F.col("name")).otherwise(F.concat_ws(".", "class", "name"))
    # what a statement belongs to: the innermost function or class; a header's defaults and decorators are the function's
    rows = cut(rows.withColumns({"what": what, "full": full}).drop("kind", "depth", "until"))
    heads = rows.where("clean = around AND clean RLIKE '^(async )?(def|class) '")
    member = F.col("what") == "PythonMethod"
    defined = heads.select("path", F.col("what").alias("kind"), "name", F.col("full").alias("qualified"), "line", F.col("ending").alias("endLine"), F.when(member, "PythonClass").otherwise("File").alias("parentKind"), F.when(member, F.col("class")).otherwise(F.lit("")).alias("parentName"), F.when(F.col("isClass"), "PYTHON_DEFINES_CLASS").when(member, "PYTHON_HAS_METHOD").otherwise("PYTHON_DEFINES_FUNCTION").alias("relType"), F.lit(None).cast("string").alias("extra"))
    args = heads.where("NOT isClass").select("path", "what", "full", F.explode("params").alias("p"))
    args = args.select("path", F.lit("PythonParameter").alias("kind"), F.col("p.name").alias("name"), F.concat(F.concat_ws(".", "full", "p.name"), F.lit(":"), F.col("p.line")).alias("qualified"), F.col("p.line").alias("line"), F.col("p.line").alias("endLine"), F.col("what").alias("parentKind"), F.col("full").alias("parentName"), F.lit("PYTHON_HAS_PARAMETER").alias("relType"), F.lit(None).cast("string").alias("extra"))
    # imports belong to the file wherever they stand
    plain = rows.where(F.col("clean").rlike(r"^import ")).select("path", "line", "last", F.explode(F.split(F.regexp_replace("clean", "^import ", ""), r"\s*,\s*")).alias("x")).select("path", "line", "last", F.regexp_extract("x", r"^([\w.]+)", 1).alias("name"), F.nullif(F.regexp_extract("x", r" as (\w+)", 1), F.lit("")).alias("extra"))
    names = F.transform(F.split(F.regexp_replace(F.regexp_extract("clean", r"^from [. \w]+ import (.*)$", 1), r"[()]", ""), ","), lambda x: F.regexp_extract(F.trim(x), r"^([\w*]+)", 1))
    of = rows.where(F.col("clean").rlike(r"^from [. \w]+ import ")).select("path", "line", "last", F.regexp_replace(F.regexp_extract("clean", r"^from ([. \w]+?) import ", 1), " ", "").alias("name"), F.array_join(F.filter(names, lambda x: x != ""), ",").alias("extra"))
    brought = plain.unionByName(of).where("name <> ''").select("path", F.lit("PythonModule").alias("kind"), "name", F.col("name").alias("qualified"), "line", F.col("last").alias("endLine"), F.lit("File").alias("parentKind"), F.lit("").alias("parentName"), F.lit("PYTHON_IMPORTS").alias("relType"), "extra")
    around = rows.select("path", F.col("line").alias("at"), "clean", "what", "full")
    targets = F.regexp_extract("clean", r"^((?:[\w.]++(?:\[[^\[\]]*+\])? ?=(?!=) ?)++)", 1)
    assigned = around.where(targets != "").select("path", "at", "what", "full", F.explode(F.filter(F.split(targets, r"\s*=\s*"), lambda x: x.rlike(r"^[^\W\d]\w*$"))).alias("name"))
    held = assigned.select("path", F.lit("PythonVariable").alias("kind"), "name", F.concat(F.col("name"), F.lit(":"), F.col("at")).alias("qualified"), F.col("at").alias("line"), F.col("at").alias("endLine"), F.coalesce("what", F.lit("File")).alias("parentKind"), F.coalesce("full", F.lit("")).alias("parentName"), none.alias("relType"), none.alias("extra"))
    called = around.select("path", "what", "full", F.explode(F.regexp_extract_all(F.regexp_replace("clean", r"^(?:async )?(?:def|class) \w+ ?|^(?:match|case) ?(?=\()", ""), F.lit(r"([^\W\d]\w*) ?\("), F.lit(1))).alias("name")).where(~F.col("name").isin(*NOT_CALLED))
    by = F.coalesce(F.col("what") != "PythonClass", F.lit(False))
    calls = called.select("path", F.lit("Call").alias("kind"), "name", F.col("name").alias("qualified"), F.lit(0).alias("line"), F.lit(0).alias("endLine"), F.when(by, F.col("what")).otherwise("File").alias("parentKind"), F.when(by, F.col("full")).otherwise("").alias("parentName"), F.lit("PYTHON_CALLS").alias("relType"), none.alias("extra"))
    every = defined.unionByName(args).unionByName(brought).unionByName(held).unionByName(calls)
    kind = F.when(F.col("kind") == "Call", "PythonFunction").otherwise(F.col("kind"))
    every = every.withColumns({"id": _of(kind, F.col("qualified")), "parentId": _of(F.col("parentKind"), F.col("parentName"))})
    loc = F.col("endLine") - F.col("line") + 1
    nodes = every.where("kind <> 'Call'").select(F.col("id").alias("entityId"), "kind", "name", F.col("path").alias("filePath"), F.col("line").alias("startLine"), "endLine", loc.alias("loc"), F.lit("Python").alias("language"), "parentId", "extra")
    rels = every.where("relType IS NOT NULL").select(link_id(F.col("relType"), F.col("parentId"), F.col("id")).alias("entityId"), F.col("relType").alias("type"), F.col("parentId").alias("sourceId"), F.col("id").alias("targetId"), F.lit(1).alias("weight"))
    return file_nodes(files).unionByName(nodes), rels
