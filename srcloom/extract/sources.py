"""Nodes and relationships of source files by language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom.extract import rules
from srcloom.extract.lines import declarations, declarators
from srcloom.functions.identity import basename, entity_id, link_id
from srcloom.operators.lineage import cut, joined, tasks_for
from srcloom.sources.files import language_of, parser_of

NODE = ("entityId", "kind", "name", "filePath", "startLine", "endLine", "loc", "language", "parentId", "extra")
#: What some kinds have besides; null elsewhere.
MORE = {
    "type": "string", "returnType": "string", "visibility": "string", "isExported": "boolean", "isDefaultExport": "boolean", "isAbstract": "boolean", "isAsync": "boolean", "isStatic": "boolean",
    "isOptional": "boolean", "isRestParameter": "boolean", "isConstant": "boolean", "isEnum": "boolean", "modifierFlags": "array<string>", "createdAt": "string",
    "isTypeOnly": "boolean", "namedImports": "array<string>", "defaultImport": "string", "namespaceImport": "string", "implementsInterfaces": "array<string>", "documentation": "string", "tags": "array<string>",
}
REL = ("entityId", "type", "sourceId", "targetId", "weight")


def file_id(path: Column) -> Column:
    return entity_id("file", path)


def file_nodes(files: DataFrame) -> DataFrame:
    path, last = F.col("path"), F.size(F.split("content", r"\r\n|\n|\r"))
    return files.select(file_id(path).alias("entityId"), F.lit("File").alias("kind"), basename(path).alias("name"), path.alias("filePath"), F.lit(1).alias("startLine"), last.alias("endLine"), last.alias("loc"), language_of(path).alias("language"), F.lit(None).cast("string").alias("parentId"), F.lit(None).cast("string").alias("extra"))


def _declared(files: DataFrame, found: list, lines: DataFrame | None = None) -> DataFrame:
    """Declarations by rules, dealt by path."""
    return declarations(files if lines is None else lines, found, tasks_for(files))


def _nodes(rows: DataFrame, *more: str) -> DataFrame:
    loc = F.col("endLine") - F.col("line") + 1
    return rows.select("entityId", "kind", "name", F.col("path").alias("filePath"), F.col("line").alias("startLine"), "endLine", loc.cast("int").alias("loc"), language_of(F.col("path")).alias("language"), "parentId", F.nullif(F.col("extra"), F.lit("")).alias("extra"), *more)


def _rels(rows: DataFrame) -> DataFrame:
    """Relationships of rows with relType, relSource and weight."""
    return rows.where("relType IS NOT NULL").select(link_id(F.col("relType"), F.col("relSource"), F.col("entityId")).alias("entityId"), F.col("relType").alias("type"), F.col("relSource").alias("sourceId"), F.col("entityId").alias("targetId"), F.col("weight").cast("int").alias("weight"))


def _choose(kind: Column, cases: dict[str, Column | str | int]) -> Column:
    out = None
    for k, v in cases.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


def _placed(rows: DataFrame, ids: dict, types: dict, weights: dict, sources: dict, inside: tuple[str, ...]) -> DataFrame:
    """ids and sources: by kind the prefix and name of an id; they are put together behind the choice, so that the
    functions of an id stand once and not in each case.  inside: kinds whose source is their parent."""
    kind = F.col("kind")
    rows = rows.withColumns({f"_{c}{k}": _choose(kind, {x: F.col("path") if v is _FILE and k else v[k] for x, v in of.items()}) for c, of in (("own", ids), ("above", sources)) for k in (0, 1)})
    rows = rows.withColumns({"entityId": entity_id(F.col("_own0"), F.col("_own1")), "relType": _choose(kind, types), "relSource": F.when(kind.isin(*sources), entity_id(F.col("_above0"), F.col("_above1"))), "weight": _choose(kind, weights)})
    return rows.withColumn("parentId", F.when(kind.isin(*inside), F.col("relSource"))).drop("_own0", "_own1", "_above0", "_above1")


def _finish(rows: DataFrame, files: DataFrame, ids: dict, types: dict, weights: dict, sources: dict, inside: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    rows = cut(_placed(rows.select("path", "line", "endLine", "kind", "name", "extra", *(c for c in ("ownerKind", "ownerName", "package", "namespace") if c in rows.columns)), ids, types, weights, sources, inside))
    return file_nodes(files).unionByName(_nodes(rows)), _rels(rows)


def _first_in_file(rows: DataFrame, kind: str, name: str) -> DataFrame:
    w = Window.partitionBy("path")
    return rows.withColumn(name, F.min(F.when(F.col("kind") == kind, F.struct("line", "name"))).over(w)["name"])


def _in_file(kind: str) -> tuple:
    return kind, F.concat_ws(":", "path", "name")


def _at_line(kind: str) -> tuple:
    return kind, F.concat_ws(":", "path", "name", F.col("line").cast("string"))


def _member(kind: Column, owner: Column) -> Column:
    """The name in an id of a member: what its owner's id is made of, and its own."""
    return F.concat(F.lower(kind), F.lit(":"), owner, F.lit("."), F.col("name"))


_FILE = "file", "path"


def go(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages, imports, functions, methods, structs, interfaces, other types."""
    rows = _first_in_file(_declared(files, rules.GO), "PackageClause", "package")
    full = F.concat_ws(".", "package", "name")
    ids = {"PackageClause": _in_file("packageclause"), "ImportSpec": _at_line("importspec"), "GoFunction": ("gofunction", full), "GoMethod": ("gomethod", F.concat_ws(".", "extra", "name")), "GoStruct": ("gostruct", full), "GoInterface": ("gointerface", full), "TypeAlias": ("typealias", full)}
    struct = "gostruct", F.concat_ws(".", "package", "extra")
    return _finish(
        rows, files, ids,
        {"PackageClause": "DECLARES_PACKAGE", "ImportSpec": "GO_IMPORTS", "GoFunction": "DEFINES_FUNCTION", "GoMethod": "HAS_METHOD", "GoStruct": "DEFINES_STRUCT", "GoInterface": "DEFINES_INTERFACE"},
        {"PackageClause": 9, "ImportSpec": 5, "GoFunction": 8, "GoMethod": 8, "GoStruct": 9, "GoInterface": 9},
        {k: _FILE for k in ids} | {"GoMethod": struct}, ("GoMethod",),
    )


def java(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages, imports, types, methods, constructors, fields; members belong to the type they stand in."""
    rows = _first_in_file(_declared(files, rules.JAVA), "PackageDeclaration", "package")
    rows = declarators(rows, ["JavaField"]).where("kind <> 'JavaConstructor' OR name = ownerName").where("kind NOT IN ('JavaMethod', 'JavaField', 'JavaConstructor') OR ownerKind IN ('JavaClass', 'JavaInterface', 'JavaEnum')")
    rows = rows.withColumns({"kind": F.regexp_replace("kind", "JavaConstructor", "JavaMethod")})
    owner = F.col("ownerKind"), F.concat_ws(".", "package", "ownerName")
    full, member = F.concat_ws(".", "package", "name"), _member(*owner)
    types = ("JavaClass", "JavaInterface", "JavaEnum")
    ids = {"PackageDeclaration": _in_file("packagedeclaration"), "ImportDeclaration": _at_line("importdeclaration"), "JavaMethod": ("javamethod", member), "JavaField": ("javafield", member)} | {k: (k, full) for k in types}
    return _finish(
        rows, files, ids,
        {"PackageDeclaration": "DECLARES_PACKAGE", "ImportDeclaration": "JAVA_IMPORTS", "JavaClass": "DEFINES_CLASS", "JavaInterface": "DEFINES_INTERFACE", "JavaEnum": "DEFINES_ENUM", "JavaMethod": "HAS_METHOD", "JavaField": "HAS_FIELD"},
        {"PackageDeclaration": 9, "ImportDeclaration": 5, "JavaClass": 9, "JavaInterface": 9, "JavaEnum": 9, "JavaMethod": 8, "JavaField": 7},
        {k: _FILE for k in ids} | {"JavaMethod": owner, "JavaField": owner}, ("JavaMethod", "JavaField"),
    )


def csharp(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Namespaces, usings, classes, interfaces, structs, methods, properties, fields."""
    rows = _first_in_file(_declared(files, rules.CSHARP), "NamespaceDeclaration", "namespace")
    types = ("CSharpClass", "CSharpInterface", "CSharpStruct")
    rows = rows.where(F.col("kind").isin("NamespaceDeclaration", "UsingDirective") | F.coalesce(F.col("ownerKind").isin("NamespaceDeclaration", *types), F.lit(True))).where(~F.col("kind").isin("CSharpMethod", "Property", "Field") | F.col("ownerKind").isin(*types))
    owner = F.col("ownerKind"), F.concat_ws(".", "namespace", "ownerName")
    full, member = F.concat_ws(".", "namespace", "name"), _member(*owner)
    ids = {"NamespaceDeclaration": _in_file("namespacedeclaration"), "UsingDirective": _at_line("usingdirective"), "CSharpMethod": ("csharpmethod", member), "Property": ("property", member), "Field": ("field", member)} | {k: (k, full) for k in types}
    above = F.when(F.col("namespace").isNotNull(), "namespacedeclaration").otherwise("file"), F.concat_ws(":", "path", "namespace")
    rows = declarators(rows, ["Field"])
    return _finish(
        rows, files, ids,
        {"NamespaceDeclaration": "DECLARES_NAMESPACE", "UsingDirective": "CSHARP_USING", "CSharpClass": "DEFINES_CLASS", "CSharpInterface": "DEFINES_INTERFACE", "CSharpStruct": "DEFINES_STRUCT", "CSharpMethod": "HAS_METHOD", "Property": "HAS_PROPERTY", "Field": "HAS_FIELD"},
        {"NamespaceDeclaration": 9, "UsingDirective": 5, "CSharpClass": 9, "CSharpInterface": 9, "CSharpStruct": 9, "CSharpMethod": 8, "Property": 7, "Field": 7},
        {k: _FILE for k in ids} | {k: above for k in types} | {k: owner for k in ("CSharpMethod", "Property", "Field")}, ("CSharpMethod", "Property", "Field", *types),
    )


def c_cpp(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Includes, macros, functions, classes and their methods; members defined elsewhere are functions."""
    rows = _declared(files, rules.C_CPP).where("kind <> 'block'")
    rows = rows.where("kind <> 'CFunction' OR ownerKind IS NULL OR ownerKind IN ('CppClass', 'block')")
    rows = rows.withColumn("kind", F.when((F.col("kind") == "CFunction") & F.coalesce(F.col("ownerKind") == "CppClass", F.lit(False)), "CppMethod").otherwise(F.col("kind")))
    owner = "cppclass", F.concat_ws(":", "path", "ownerName")
    ids = {k: _at_line(k) for k in ("IncludeDirective", "MacroDefinition", "CFunction", "CppMethod")} | {"CppClass": _in_file("cppclass")}
    return _finish(
        rows, files, ids, {"IncludeDirective": "INCLUDES", "CFunction": "DEFINES_FUNCTION", "CppMethod": "HAS_METHOD", "CppClass": "DEFINES_CLASS"},
        {"IncludeDirective": 5, "CFunction": 8, "CppMethod": 8, "CppClass": 9}, {k: _FILE for k in ids} | {"CppMethod": owner}, ("CppMethod",),
    )


def typescript(files: DataFrame, lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Imports, functions, classes, methods, interfaces, types, variables, parameters.

    Kinds have the columns of MORE beside those of NODE, as far as the header says them.  lines: what ``lexed`` wrote of files.
    """
    rows = _declared(files, rules.TYPESCRIPT, lines)
    rows = rows.where("kind <> 'Method' OR ownerKind = 'Class'").where("kind <> 'Signature' OR ownerKind = 'Interface'").withColumn("kind", F.regexp_replace("kind", "Signature", "Method"))
    rows = declarators(rows, ["Variable"], typed=True)
    owner = F.col("ownerKind"), F.concat_ws(":", "path", "ownerName")
    ids = {"Import": _at_line("import"), "Function": _at_line("function"), "Variable": _at_line("variable"), "Class": _in_file("class"), "Interface": _in_file("interface"), "TypeAlias": _in_file("typealias"), "Method": ("method", F.concat(F.col("path"), F.lit(":"), F.col("ownerName"), F.lit("."), F.col("name")))}
    head = cut(_placed(rows, ids, {"Import": "IMPORTS", "Method": "HAS_METHOD"}, {"Import": 1, "Method": 10}, {"Import": _FILE, "Method": owner}, ("Method",)))
    rels = _rels(head)
    word = lambda x: F.col("header").rlike(rf"^[^=(\{{]*\b{x}\b")
    code, member = F.col("kind").isin("Function", "Method"), F.col("kind") == "Method"
    words = F.regexp_extract_all(F.regexp_extract("header", r"^\s*((?:(?:export|default|declare|abstract|public|private|protected|static|async|readonly|override|const|let|var)\s+)*)", 1), F.lit(r"\w+"), F.lit(0))
    brought, listed = F.col("kind") == "Import", F.regexp_extract("extra", r"\{([^}]*)\}", 1)
    items = F.filter(F.transform(F.split(listed, ","), lambda x: F.regexp_extract(F.trim(x), r"^(?:type\s+)?([\w$]+)", 1)), lambda x: x != "")
    some = lambda pattern: F.when(brought, F.nullif(F.regexp_extract("extra", pattern, 1), F.lit("")))
    bases = F.filter(F.transform(F.split(F.regexp_extract(F.regexp_replace("extra", r"<[^<>]*>|\{.*$", ""), r"\bimplements\s+(.*)$", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    flags = [
        F.when(brought, F.col("header").rlike(r"^\s*import\s+type\s+(?!from\b|,)")).alias("isTypeOnly"), F.when(brought & (F.size(items) > 0), items).alias("namedImports"), some(r"^\s*([\w$]+)\s*(?:,|$)").alias("defaultImport"), some(r"\*\s+as\s+([\w$]+)").alias("namespaceImport"),
        F.when((F.col("kind") == "Class") & (F.size(bases) > 0), bases).alias("implementsInterfaces"), F.when(code, F.nullif(F.trim(F.regexp_extract("header", r"\)\s*:\s*([^{;=]+?)\s*(?:\{|;|=>|$)", 1)), F.lit(""))).alias("returnType"),
        F.when(member, F.coalesce(F.nullif(F.regexp_extract("header", r"^\s*(?:\w+\s+)*?(public|private|protected)\b", 1), F.lit("")), F.lit("public"))).alias("visibility"),
        F.when(F.col("kind").isin("Function", "Class", "Interface", "TypeAlias", "Variable"), F.col("header").rlike(r"^\s*export\b")).alias("isExported"), F.when(F.col("kind").isin("Function", "Class", "Interface"), F.col("header").rlike(r"^\s*export\s+default\b")).alias("isDefaultExport"),
        F.when(F.col("kind") == "Class", word("abstract")).alias("isAbstract"), F.when(code, F.col("header").rlike(r"(?:^[^=({]*|=\s*)\basync\b")).alias("isAsync"), F.when(member, word("static")).alias("isStatic"),
        F.when(F.col("kind") == "Variable", F.col("extra") == "const").alias("isConstant"), F.when(F.col("kind") == "TypeAlias", F.col("extra") == "enum").alias("isEnum"), F.when(F.col("kind") != "Import", words).alias("modifierFlags"),
    ]
    said = head.select("*", *flags)
    nodes = file_nodes(files).unionByName(_nodes(said, *said.columns[len(head.columns) :]), allowMissingColumns=True)
    own = head.where(code).select("path", "line", "name", F.col("entityId").alias("parent"), F.posexplode("params").alias("place", "p")).withColumn("p", F.regexp_replace("p", r"^(?:(?:public|private|protected|readonly|override)\s+|@\w+(?:\([^)]*\))?\s*)+", ""))
    named = F.regexp_extract("p", r"^(?:\.\.\.)?\s*(\{[^}]*\}|\[[^\]]*\]|[\w$]+)", 1)
    params = own.select(
        entity_id("parameter", F.concat_ws(":", "parent", named)).alias("entityId"), F.lit("Parameter").alias("kind"), named.alias("name"), F.col("path").alias("filePath"), F.col("line").alias("startLine"), F.col("line").alias("endLine"), F.lit(1).alias("loc"), language_of(F.col("path")).alias("language"),
        F.col("parent").alias("parentId"), F.nullif(F.trim(F.regexp_extract("p", r"^(?:\.\.\.)?\s*(?:\{[^}]*\}|\[[^\]]*\]|[\w$]+)\??\s*:\s*((?:[^=]|=>)+)", 1)), F.lit("")).alias("type"),
        (F.col("p").rlike(r"^(?:\{[^}]*\}|\[[^\]]*\]|[\w$]+)\?") | F.col("p").rlike(r"[^=]=(?![>=])")).alias("isOptional"), F.col("p").startswith("...").alias("isRestParameter"), "place",
    ).where("name <> ''")
    first = params.groupBy("entityId").agg(F.min_by(F.struct(*(c for c in params.columns if c not in ("entityId", "place"))), "place").alias("x")).select("entityId", "x.*")
    rels = rels.unionByName(_rels(first.select(F.lit("HAS_PARAMETER").alias("relType"), F.col("parentId").alias("relSource"), "entityId", F.lit(8).alias("weight"))))
    return nodes.unionByName(first, allowMissingColumns=True), rels


def exports(nodes: DataFrame) -> DataFrame:
    """EXPORTS from a file to each top-level declaration that it exports, the default export among them."""
    rows = nodes.where("isExported AND kind IN ('Function', 'Class', 'Interface', 'TypeAlias', 'Variable')")
    return rows.select(F.lit("EXPORTS").alias("relType"), file_id(F.col("filePath")).alias("relSource"), "entityId", F.lit(8).alias("weight")).transform(_rels)


def typescript_with_jsx(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``typescript`` finds, functions without a name of their own, exports, and the elements of .tsx and .jsx files.
    What Python tasks read from the files is written, as nodes are read again for the exports."""
    from srcloom.extract.call_spans import lambda_nodes
    from srcloom.extract.docs import documented
    from srcloom.extract.jsx import jsx

    nodes, rels = typescript(files)
    nodes = documented(nodes, files)
    nodes = nodes.unionByName(joined(cut(lambda_nodes(files)), nodes.select("entityId"), "entityId", "left_anti"), allowMissingColumns=True)
    more, links = jsx(files.where(F.lower("path").rlike(r"\.[tj]sx$")))
    return nodes.unionByName(more, allowMissingColumns=True), rels.unionByName(exports(nodes)).unionByName(links)


EXTRACTORS = {"go": go, "java": java, "csharp": csharp, "c_cpp": c_cpp, "typescript": typescript_with_jsx}


def extract(files: DataFrame, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and relationships of files (path, content) of all languages, each id once; createdAt is the time of
    the run.  only: the parsers that the files need, where the caller knows them, for a smaller plan."""
    from srcloom.extract.python_source import python
    from srcloom.extract.sql_source import sql
    from srcloom.operators.dedup import last_wins

    files = files.where("content IS NOT NULL").withColumn("parser", parser_of(F.col("path")))
    nodes = rels = None
    for name, f in (EXTRACTORS | {"python": python, "sql": sql}).items():
        if only is not None and name not in only and (nodes is not None or name != "sql"):
            continue
        n, r = f(files.where(F.col("parser") == name).select("path", "content"))
        have = dict(n.dtypes)
        n = n.select(*(F.col(c) if c in have else F.lit(None).cast("int" if c in ("endLine", "loc") else "string").alias(c) for c in NODE), *(F.col(c) if c in have else F.lit(None).cast(kind).alias(c) for c, kind in MORE.items()))
        r = r.select(*REL)
        nodes, rels = (n, r) if nodes is None else (nodes.unionByName(n), rels.unionByName(r))
    nodes = nodes.withColumn("createdAt", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return last_wins(nodes, ["entityId"], ["filePath", "startLine", "kind"]), last_wins(rels, ["entityId"], ["type", "sourceId", "targetId"])
