"""Relationships across TypeScript files: imports, names, inheritance, calls, error handling.

Names resolve through a scope table: what a file declares, and under which name it imports what.  All
lookups are equi-joins on (path, name).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom.extract.call_spans import call_sites
from srcloom.extract.jsx import elements
from srcloom.extract.lines import code_lines
from srcloom.extract.sources import file_id
from srcloom.functions.identity import entity_id, link_id
from srcloom.operators import exports
from srcloom.operators.aggregate import DECISIONS
from srcloom.operators.lineage import cut, joined
from srcloom.operators.resolve import import_candidates
from srcloom.operators.spans import holding, innermost, outermost
from srcloom.operators.spans import within as in_outer

EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")
NOT_CALLS = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "super", "constructor", "async", "await", "new", "import")
#: How each decision point looks in a line; the names are those of ``aggregate.DECISIONS``.
_LOOKS = dict(zip(DECISIONS, (r"\bif\s*\(", r"\bfor\s*\((?![^)]*\b(?:of|in)\b)", r"\bfor\s*\([^)]*\bin\b", r"\bfor\s*(?:await\s*)?\([^)]*\bof\b", r"\bwhile\s*\(", r"\bdo\s*\{", r"\bcase\b", r"\bcatch\b", r"[^?]\?(?![?.:)])[^:]*:", r"&&", r"\|\|", r"\?\?(?!=)"), strict=True))


def _rel(rows: DataFrame, kind, weight, *more: str) -> DataFrame:
    kind, weight = (F.lit(x) if isinstance(x, str | int) else x for x in (kind, weight))
    return rows.select(link_id(kind, F.col("sourceId"), F.col("targetId")).alias("entityId"), kind.alias("type"), "sourceId", "targetId", weight.cast("int").alias("weight"), *more)


def _imports(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'Import'").select(F.col("filePath").alias("importer"), F.col("name").alias("specifier"), F.col("extra").alias("names"))


def import_targets(nodes: DataFrame, extensions=EXTENSIONS) -> DataFrame:
    """(importer, specifier, names, resolved, isPlaceholder) of all imports."""
    return import_candidates(_imports(nodes), nodes.where("kind = 'File'").select(F.col("filePath").alias("path")), list(extensions))


def linked(files: DataFrame, nodes: DataFrame, extensions=EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """What ``import_targets`` and ``exports.located`` give for imports and export clauses, looked up and written together."""
    clauses, own = exports.export_clauses(files).withColumnRenamed("path", "importer"), _imports(nodes)
    there = nodes.where("kind = 'File'").select(F.col("filePath").alias("path"))
    rows = cut(import_candidates(own.unionByName(clauses, allowMissingColumns=True), there, list(extensions)))
    found = F.when(~F.col("isPlaceholder"), F.col("resolved")).alias("resolved")
    return rows.where("line IS NULL").select(*own.columns, "resolved", "isPlaceholder"), rows.where("line IS NOT NULL").select(F.col("importer").alias("path"), "line", "exported", "local", "specifier", found)


def file_imports(targets: DataFrame) -> DataFrame:
    """IMPORTS from file to file; a file that isn't there is a placeholder."""
    rows = targets.select(file_id(F.col("importer")).alias("sourceId"), file_id(F.col("resolved")).alias("targetId"), "isPlaceholder").distinct()
    return _rel(rows, "IMPORTS", 5, "isPlaceholder")


def imported_names(targets: DataFrame) -> DataFrame:
    """(path, alias, original, resolved) of imported names; ``*`` is the namespace, ``default`` the default."""
    inner = F.regexp_extract("names", r"\{([^}]*)\}", 1)
    named = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")
    space = F.regexp_extract("names", r"\*\s+as\s+(\w+)", 1)
    default = F.regexp_extract("names", r"^\s*(\w+)\s*(?:,|$)", 1)
    pair = lambda a, o: F.struct(a.alias("alias"), o.alias("original"))
    every = F.concat(
        F.transform(named, lambda x: pair(F.when(x.rlike(r"\sas\s"), F.regexp_extract(x, r"\sas\s+(\w+)$", 1)).otherwise(F.regexp_replace(x, r"^type\s+", "")), F.regexp_extract(F.regexp_replace(x, r"^type\s+", ""), r"^(\w+)", 1))),
        F.when(space != "", F.array(pair(space, F.lit("*")))).otherwise(F.array()),
        F.when(default != "", F.array(pair(default, F.lit("default")))).otherwise(F.array()),
    )
    return targets.where("names IS NOT NULL AND NOT isPlaceholder").select(F.col("importer").alias("path"), "resolved", F.explode(every).alias("x")).select("path", "resolved", "x.alias", "x.original")


def declarations(nodes: DataFrame) -> DataFrame:
    """(path, name, rank, startLine, targetId, isExported) of what a file declares: functions before classes, interfaces, variables,
    types; its default export is declared as ``default`` too."""
    rank = F.array_position(F.array(*(F.lit(k) for k in ("Function", "Class", "Interface", "Variable", "TypeAlias"))), F.col("kind"))
    rows = nodes.where(F.col("kind").isin("Function", "Class", "Interface", "Variable", "TypeAlias"))
    names, exported = F.array("name"), F.col("isExported") if "isExported" in nodes.columns else F.lit(None).cast("boolean")
    if "isDefaultExport" in nodes.columns:
        names = F.when(F.col("isDefaultExport"), F.array("name", F.lit("default"))).otherwise(names)
    return rows.select(F.col("filePath").alias("path"), F.explode(names).alias("name"), rank.alias("rank"), "startLine", F.col("entityId").alias("targetId"), exported.alias("isExported"))


def declared(nodes: DataFrame) -> DataFrame:
    """(path, name, targetId) of ``declarations``, the first of each name."""
    return declarations(nodes).groupBy("path", "name").agg(F.min_by("targetId", F.struct("rank", "startLine")).alias("targetId"))


def export_names(files: DataFrame, nodes: DataFrame, targets: DataFrame, extensions=EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """The located export clauses of files, and what all names that they export come to, over any number of files
    (``exports.exported_names``).  files may be their lines (``lexed``, with text); nodes are read several times: hand in a written table or a cut plan."""
    clauses = exports.export_clauses(files)
    clauses = cut(exports.located(clauses if "clean" in files.columns else cut(clauses), nodes, extensions))
    return clauses, exports.exported_names(declarations(nodes), clauses, imported_names(targets))


def _there(nodes: DataFrame, names: DataFrame | None) -> DataFrame:
    """(resolved, original, targetId, targetPath) of what can be imported from files: what they declare, and with
    ``names`` (of ``export_names``) what they export comes first."""
    own = declared(nodes).select(F.col("path").alias("resolved"), F.col("name").alias("original"), "targetId", F.col("path").alias("targetPath"))
    if names is None:
        return own
    via = names.where("status = 'resolved'").select(F.col("path").alias("resolved"), F.col("name").alias("original"), "targetId", "targetPath")
    return via.unionByName(joined(own, names.select(F.col("path").alias("resolved"), F.col("name").alias("original")), ["resolved", "original"], "left_anti"))


def resolved_imports(nodes: DataFrame, targets: DataFrame, exported: DataFrame | None = None) -> DataFrame:
    """RESOLVES_IMPORT from a file to what it imports by name, or to the file for a namespace; with ``exported`` (of
    ``export_names``) through the files that hand names on."""
    names = imported_names(targets)
    known = joined(names, _there(nodes, exported), ["resolved", "original"])
    spaces = names.where("original = '*'").select("path", file_id(F.col("resolved")).alias("targetId"))
    rows = known.select("path", "targetId").unionByName(spaces).select(file_id(F.col("path")).alias("sourceId"), "targetId").distinct()
    return _rel(rows, "RESOLVES_IMPORT", 8)


def scope(nodes: DataFrame, targets: DataFrame, exported: DataFrame | None = None) -> DataFrame:
    """(path, name, targetId, targetPath): names as a file sees them; its own come before imported ones, which are
    followed through ``exported`` where that is given."""
    own = declared(nodes).withColumns({"targetPath": F.col("path"), "rank": F.lit(0)})
    via = joined(imported_names(targets), _there(nodes, exported), ["resolved", "original"]).select("path", F.col("alias").alias("name"), "targetId", "targetPath", F.lit(1).alias("rank"))
    return own.unionByName(via).groupBy("path", "name").agg(F.min_by(F.struct("targetId", "targetPath"), "rank").alias("t")).select("path", "name", "t.*")


def inheritance(nodes: DataFrame, targets: DataFrame, exported: DataFrame | None = None) -> DataFrame:
    """EXTENDS and IMPLEMENTS; a base that isn't found is a placeholder of its name."""
    rows = nodes.where("kind IN ('Class', 'Interface') AND extra IS NOT NULL").select(F.col("filePath").alias("path"), "kind", F.col("entityId").alias("sourceId"), F.regexp_replace("extra", r"<[^<>]*>|\{.*$", "").alias("extra"))
    part = lambda pattern, kind: F.transform(F.filter(F.split(F.regexp_extract("extra", pattern, 1), r"\s*,\s*"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.lit(kind).alias("type"), F.trim(x).alias("name")))
    bases = rows.select("path", "kind", "sourceId", F.explode(F.concat(part(r"\bextends\s+(.*?)(?:\bimplements\b|$)", "EXTENDS"), part(r"\bimplements\s+(.*)$", "IMPLEMENTS"))).alias("b")).select("path", "kind", "sourceId", "b.type", "b.name")
    found = joined(bases, scope(nodes, targets, exported), ["path", "name"], "left")
    other = F.when((F.col("type") == "EXTENDS") & (F.col("kind") == "Class"), entity_id("class", F.concat_ws(":", "path", "name"))).otherwise(entity_id("interface", F.concat_ws(":", "path", "name")))
    return _rel(found.withColumns({"isPlaceholder": F.col("targetId").isNull(), "targetId": F.coalesce("targetId", other)}), F.col("type"), 9, "isPlaceholder")


def gate(files: DataFrame, tsx: bool = True) -> DataFrame:
    """The files whose relationships are resolved: TypeScript and JavaScript, with ``tsx`` those with JSX too."""
    return files.where(F.lower("path").rlike(r"\.[cm]?[tj]s$" + (r"|\.[tj]sx$" if tsx else "")))


def _has(*words: str) -> Column:
    """Whether a line has one of some words."""
    return reduce(or_, (F.contains(F.col("clean"), F.lit(x)) for x in words))


def _bodies(nodes: DataFrame) -> DataFrame:
    """Outer functions and methods (path, sourceId, a, z): those that stand in no other."""
    return outermost(nodes.where("kind IN ('Function', 'Method')").select(F.col("filePath").alias("path"), F.col("entityId").alias("sourceId"), F.col("startLine").alias("a"), F.col("endLine").alias("z")))


def _receivers(within: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, sourceId, receiver, type) of parameters and variables whose class or interface the text names."""
    typed = nodes.where("kind = 'Parameter'").select(F.col("filePath").alias("path"), F.col("parentId").alias("sourceId"), F.col("name").alias("receiver"), F.regexp_extract("type", r"^([A-Za-z_$][\w$]*)(?:<.*>)?$", 1).alias("type"))
    names = lambda pattern: within.select("path", "sourceId", F.explode(F.regexp_extract_all("clean", F.lit(pattern), F.lit(0))).alias("x")).select("path", "sourceId", F.regexp_extract("x", pattern, 1).alias("receiver"), F.regexp_extract("x", pattern, 2).alias("type"))
    own = names(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*new\s+([A-Za-z_$][\w$]*)").unionByName(names(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*:\s*([A-Za-z_$][\w$]*)"))
    return typed.unionByName(own).where("type <> ''").groupBy("path", "sourceId", "receiver").agg(F.min("type").alias("type"))


def calls(files: DataFrame, nodes: DataFrame, targets: DataFrame, exported: DataFrame | None = None) -> DataFrame:
    """CALLS from outer functions and methods: by name, to methods of the same class by ``this.name``, of a class
    or interface by its name or by a parameter or variable of that type, to what a module imported as a whole
    declares; weight 6 across files, 7 within; imported names are followed through ``exported``, as in ``scope``.  Calls of unknown names have no row.  nodes are read many times: hand
    in a written table or a cut plan.  isConditional: whether any call stands in a branch or loop of the body, on its line or around it."""
    # lines that call, declare or begin a function; a function's first line is one of them
    lines = code_lines(files, "path", "line", "clean", "inside", bare=False).where(_has("(", "const", "let", "var", "function"))
    within = in_outer(lines, _bodies(nodes))
    start = F.first("inside").over(Window.partitionBy("path", "sourceId").orderBy("line"))
    within = cut(within.withColumn("branch", (F.col("inside") > start) | F.col("clean").rlike(r"\b(?:if|for|while|switch|case)\b|\?[^.?]")))
    found = within.select("path", "line", "sourceId", "branch", F.explode(F.regexp_extract_all("clean", F.lit(r"(?<![\w.$])((?:[A-Za-z_$][\w$]*\??\.)?[A-Za-z_$][\w$]*)\s*\("), F.lit(1))).alias("callee")).where(~F.col("callee").isin(*NOT_CALLS))
    found = found.withColumns({"receiver": F.regexp_extract("callee", r"^([\w$]+)\??\.", 1), "name": F.regexp_extract("callee", r"([\w$]+)$", 1)})
    names = cut(scope(nodes, targets, exported))
    methods = nodes.where("kind = 'Method'").select(F.col("entityId").alias("targetId"), "parentId", "name", F.col("filePath").alias("targetPath"))
    plain = joined(found.where("receiver = ''"), names, ["path", "name"])
    mine = joined(joined(found.where("receiver = 'this'"), nodes.where("kind = 'Method'").select(F.col("entityId").alias("sourceId"), "parentId"), "sourceId"), methods, ["parentId", "name"])
    known = joined(found.where("receiver NOT IN ('', 'this')"), _receivers(within, nodes), ["path", "sourceId", "receiver"], "left").withColumn("type", F.coalesce("type", "receiver"))
    owners = names.select("path", F.col("name").alias("type"), F.col("targetId").alias("parentId"))
    member = joined(joined(known, owners, ["path", "type"]), methods, ["parentId", "name"])
    spaces = imported_names(targets).where("original = '*'").select("path", F.col("alias").alias("receiver"), F.col("resolved").alias("targetPath"))
    through = joined(joined(found, spaces, ["path", "receiver"]), declared(nodes).withColumnRenamed("path", "targetPath"), ["targetPath", "name"])
    cols = ("path", "sourceId", "targetId", "targetPath", "branch")
    every = plain.select(*cols).unionByName(mine.select(*cols)).unionByName(member.select(*cols)).unionByName(through.select(*cols))
    rows = every.where("sourceId <> targetId").groupBy("sourceId", "targetId").agg(F.bool_or(F.col("path") != F.col("targetPath")).alias("isCrossFile"), F.bool_or("branch").alias("isConditional"))
    return _rel(rows, "CALLS", F.when(F.col("isCrossFile"), 6).otherwise(7), "isCrossFile", "isConditional")


def in_file_calls(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """CALLS within a file, a row for each call: of names that the file declares and of ``this.name`` of the same class,
    from outer functions and methods, with place, number and types of the arguments.  An argument that is one of the
    caller's parameters has the type that is written there."""
    sites = cut(in_outer(call_sites(files), _bodies(nodes)))
    callee = F.regexp_replace("callee", r"\?\.", ".")
    sites = sites.withColumns({"own": callee.rlike(r"^this\.[\w$#]+$"), "name": F.regexp_extract(callee, r"^(?:this\.)?([\w$#]+)$", 1)}).where("name <> ''")
    methods = nodes.where("kind = 'Method'").select(F.col("entityId").alias("targetId"), "parentId", "name")
    mine = joined(joined(sites.where("own"), nodes.where("kind = 'Method'").select(F.col("entityId").alias("sourceId"), "parentId"), "sourceId"), methods, ["parentId", "name"]).drop("parentId")
    every = joined(sites.where("NOT own"), declared(nodes), ["path", "name"]).unionByName(mine)
    typed = nodes.where("kind = 'Parameter' AND type IS NOT NULL").select(F.col("parentId").alias("sourceId"), "name", "type").distinct().groupBy("sourceId").agg(F.map_from_entries(F.collect_list(F.struct("name", "type"))).alias("typed"))
    types = F.zip_with("argument_types", "argument_names", lambda t, n: F.coalesce(F.when(t == "any", F.element_at("typed", F.coalesce(n, F.lit("")))), t))
    rows = joined(every, typed, "sourceId", "left").withColumn("argumentTypes", F.when(F.col("typed").isNull(), F.col("argument_types")).otherwise(types))
    rows = rows.withColumnsRenamed({"line": "startLine", "column": "startColumn", "argument_count": "argumentCount", "conditional": "isConditional"})
    return _rel(rows, "CALLS", 7, "startLine", "startColumn", "argumentCount", "argumentTypes", "isConditional")


def components(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Component nodes (NODE's columns and declarationId): functions, function variables and classes with a
    capital that hold JSX, or whose header names an element's type or React.FC; of equal names in a file the first."""
    rows = nodes.where("kind IN ('Function', 'Class') AND name RLIKE '^[A-Z]'").withColumns({"path": F.col("filePath"), "a": F.col("startLine"), "z": F.col("endLine")})
    says = code_lines(files, "path", "line", "clean", bare=False).where(_has("JSX.Element", "ReactElement", "React.FC") & F.col("clean").rlike(r"\)\s*:[^{=]*(?:JSX\.Element|ReactElement)|\b(?:const|let|var)\s+\w+\s*:[^=]*(?:JSX\.Element|React\.FC|ReactElement)")).select("path", "line")
    headers = joined(rows.where("kind = 'Function'"), says.withColumnRenamed("line", "startLine"), ["path", "startLine"], "left_semi").select(rows.columns)
    render = nodes.where("kind = 'Method' AND name = 'render' AND returnType RLIKE 'JSX\\\\.Element|ReactElement'").select(F.col("parentId").alias("entityId"))
    every = holding(rows, elements(files).select("path", "line")).unionByName(headers).unionByName(joined(rows, render, "entityId", "left_semi").select(rows.columns))
    own = every.withColumn("declarationId", F.col("entityId")).withColumns({"entityId": entity_id("component", F.concat_ws(":", "path", "name")), "kind": F.lit("Component"), "parentId": F.lit(None).cast("string"), "extra": F.lit(None).cast("string")})
    first = own.groupBy("entityId").agg(F.min_by(F.struct(*(c for c in own.columns if c not in ("entityId", "path", "a", "z"))), F.struct("startLine", "declarationId")).alias("x"))
    return first.select("entityId", "x.*")


def component_uses(files: DataFrame, nodes: DataFrame, targets: DataFrame, found: DataFrame) -> DataFrame:
    """USES_COMPONENT from the innermost component around a tag with a capital to the component that the tag
    names in its file's scope; tags outside components and of unknown names have no row."""
    tags = elements(files).where(F.col("tag").rlike("^[A-Z]")).select("path", "line", F.col("tag").alias("name"))
    spans = found.select(F.col("filePath").alias("path"), F.col("entityId").alias("sourceId"), F.col("startLine").alias("a"), F.col("endLine").alias("z"))
    there = found.select(F.col("declarationId").alias("declared"), F.col("entityId").alias("targetId"))
    uses = joined(joined(innermost(tags, spans).select("path", "sourceId", "name").distinct(), scope(nodes, targets).withColumnRenamed("targetId", "declared"), ["path", "name"]), there, "declared")
    rows = uses.groupBy("sourceId", "targetId").agg(F.bool_or(F.col("path") != F.col("targetPath")).alias("isCrossFile"))
    return _rel(rows, "USES_COMPONENT", 7, "isCrossFile")


def error_handlers(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """HANDLES_ERROR from outer functions and methods to a name for each catch."""
    lines = code_lines(files, "path", "line", "clean", bare=False).where(F.col("clean").rlike(r"\bcatch\b")).select("path", "line", F.regexp_extract("clean", r"\bcatch\s*\(\s*(\w+)", 1).alias("name"))
    rows = in_outer(lines, _bodies(nodes))
    target = F.when(F.col("name") != "", entity_id("parameter", F.concat_ws(":", "sourceId", "name"))).otherwise(entity_id("error_handler", F.concat_ws(":", "sourceId", F.col("line").cast("string"))))
    return _rel(rows.withColumn("targetId", target).select("sourceId", "targetId").distinct(), "HANDLES_ERROR", 5)


def mutations(files: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """MUTATES_STATE from outer functions and methods to variables of the file, or imported ones, that they assign
    by ``=``; names that the function declares itself, other assignment operators and properties have no row."""
    within = in_outer(code_lines(files, "path", "line", "clean", bare=False).where(_has("=", "const", "let", "var")), _bodies(nodes))
    within = cut(within.select("path", "sourceId", F.when(F.col("line") == F.col("a"), F.regexp_extract("clean", r"^[^{]*\{(.*)$", 1)).otherwise(F.col("clean")).alias("clean")))
    names = lambda pattern: within.select("path", "sourceId", F.explode(F.regexp_extract_all("clean", F.lit(pattern), F.lit(1))).alias("name")).distinct()
    local = names(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)").unionByName(nodes.where("kind = 'Parameter'").select(F.col("filePath").alias("path"), F.col("parentId").alias("sourceId"), "name"))
    assigned = joined(names(r"(?<![\w.$])([A-Za-z_$][\w$]*)\s*=(?![=>])"), local, ["path", "sourceId", "name"], "left_anti")
    return _rel(joined(assigned, scope(nodes, targets), ["path", "name"]).where(F.col("targetId").startswith("variable:")).select("sourceId", "targetId").distinct(), "MUTATES_STATE", 8)


def complexities(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(entityId, complexity) of functions and methods: 1 + the decision points in their lines."""
    points = None
    for look in _LOOKS.values():
        n = F.size(F.regexp_extract_all("clean", F.lit(look), F.lit(0)))
        points = n if points is None else points + n
    # how many stand in a file up to each line; a function's are those up to its end without those before it
    upto = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    seen = cut(code_lines(files, "path", "line", "clean").select("path", "line", points.alias("points")).withColumn("seen", F.sum("points").over(upto)))
    rows = nodes.where("kind IN ('Function', 'Method')").select("entityId", F.col("filePath").alias("path"), "startLine", "endLine")
    first = seen.select("path", F.col("line").alias("startLine"), (F.col("seen") - F.col("points")).alias("before"))
    last = seen.select("path", F.col("line").alias("endLine"), "seen")
    return joined(joined(rows, first, ["path", "startLine"]), last, ["path", "endLine"]).select("entityId", (F.col("seen") - F.col("before") + 1).cast("long").alias("complexity"))
