"""Queries on source code.  The driver's tables hold none, so they read source files made of each row of a table,
and the SQL derives what is in them from the same row; what the rules give for a file is derived by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.extract import jsx as jsx_
from srcloom.extract import python_source, sources, sql_source
from srcloom.operators import resolve_ts
from srcloom.operators.lineage import cut, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

GO = 'package main\n\nimport (\n\t"fmt"\n\tlog "net/http"\n)\n\ntype PointKEY struct {\n\tX int\n}\n\nfunc (p *PointKEY) Move(dx int) {\n\tp.X += dx\n}\n\nfunc main() {\n\tfmt.Println("x { y")\n}\n'
JAVA = "package com.ex;\nimport java.util.List;\n\n/* class Not { */\npublic class AKEY extends B {\n  private int n = 0;\n  public AKEY(int n) {\n    int local = 3;\n  }\n  static class In {\n    void deep() { }\n  }\n  int after() { return 1; }\n}\nenum E { X, Y }\n"
CSHARP = 'using System;\n\nnamespace Inv.Core\n{\n    public class ProgramKEY\n    {\n        private int count = 0;\n        public string Name { get; set; }\n        public static void Main(string[] args)\n        {\n            var x = 1;\n        }\n    }\n    public interface IItem\n    {\n        int Get(int id);\n    }\n}\n'
CPP = '#include <iostream>\n#define MAX 3\nclass CircleKEY : public Shape {\npublic:\n  double area() const { return 1; }\n};\ndouble CircleKEY::far(int x) const\n{\n  return x;\n}\nint main() {\n  foo();\n}\n'
PYTHON = "import os\nX = 1\n\ndef greetKEY(name):\n    print(name)\n\nclass K:\n    def get(self):\n        return greetKEY(1)\n"
SQL = "-- tables\nCREATE TABLE shop.itemsKEY (\n  id INT PRIMARY KEY,\n  price DECIMAL(10,2),\n  PRIMARY KEY (id)\n);\nCREATE VIEW v AS SELECT * FROM shop.itemsKEY WHERE name <> ';';\nINSERT INTO shop.itemsKEY VALUES (1);\n"
TS_A = 'import { b, c as d } from "./b";\nimport * as all from "./b";\nimport x from "lib";\n\nexport const LIMIT = 3;\nexport function runKEY(n: number): number {\n  if (n > 1 && n < 5) {\n    return b(n);\n  }\n  return n;\n}\nexport class K extends d implements I {\n  async load(a: string): Promise<void> {\n    try { runKEY(1); this.step(); } catch (e) { }\n  }\n  step() {\n    unknown();\n  }\n}\nexport interface I {\n  size(): number;\n}\n'
TS_B = "export function b(n: number): number {\n  return n;\n}\nexport class c {\n}\n"
JSX = 'const A = () => (\n  <div className="p-KEY m-KEY">\n    <ItemKEY key={1} {...rest} on />\n    <span>hi</span>\n  </div>\n);\n'


def _files(spark: SparkSession, sf_dir: str, *rows: tuple[str, str]) -> DataFrame:
    """Files (path, content) of each customer: KEY in paths and texts is the customer's key."""
    customer = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key")))
    filled = lambda text: F.replace(F.lit(text), F.lit("KEY"), F.col("key"))
    out = None
    for path, text in rows:
        own = customer.select(filled(path).alias("path"), filled(text).alias("content"))
        out = own if out is None else out.unionByName(own)
    return out


def _graph(pair: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Nodes and relationships as one table of strings."""
    nodes, rels = pair
    a = nodes.select(F.col("kind").alias("what"), F.col("entityId").alias("a"), F.col("name").alias("b"), F.col("startLine").cast("string").alias("c"), F.col("endLine").cast("string").alias("d"))
    return a.unionByName(rels.select(F.col("type").alias("what"), F.col("sourceId").alias("a"), F.col("targetId").alias("b"), F.col("weight").cast("string").alias("c"), F.lit("").alias("d")))


def _values(text: str, columns: str = "what, a, b, c, d") -> str:
    """SQL of rows written one to a line, cells between bars, for each customer."""
    rows = ", ".join("(" + ", ".join("'" + c.strip().replace("'", "''") + "'" for c in line.split("|")) + ")" for line in text.strip().splitlines())
    cells = ", ".join(f"replace({c}, 'KEY', CAST(c_custkey AS VARCHAR)) AS {c}" for c in columns.split(", "))
    return f"SELECT {cells} FROM customer, (VALUES {rows}) AS t({columns})"


def source_query(expected: str, columns: str = "what, a, b, c, d"):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = _values(expected, columns)
        return f

    return add


@source_query("""
File|file:/s/KEY/main.go|main.go|1|19
PackageClause|packageclause:/s/KEY/main.go:main|main|1|1
ImportSpec|importspec:/s/KEY/main.go:fmt:4|fmt|4|4
ImportSpec|importspec:/s/KEY/main.go:net/http:5|net/http|5|5
GoStruct|gostruct:main.pointKEY|PointKEY|8|10
GoMethod|gomethod:pointKEY.move|Move|12|14
GoFunction|gofunction:main.main|main|16|18
DECLARES_PACKAGE|file:/s/KEY/main.go|packageclause:/s/KEY/main.go:main|9|
GO_IMPORTS|file:/s/KEY/main.go|importspec:/s/KEY/main.go:fmt:4|5|
GO_IMPORTS|file:/s/KEY/main.go|importspec:/s/KEY/main.go:net/http:5|5|
DEFINES_STRUCT|file:/s/KEY/main.go|gostruct:main.pointKEY|9|
HAS_METHOD|gostruct:main.pointKEY|gomethod:pointKEY.move|8|
DEFINES_FUNCTION|file:/s/KEY/main.go|gofunction:main.main|8|
""")
def go_extract(spark, sf):
    return _graph(sources.go(_files(spark, sf, ("/s/KEY/main.go", GO))))


@source_query("""
File|file:/s/KEY/a.java|A.java|1|16
PackageDeclaration|packagedeclaration:/s/KEY/a.java:com.ex|com.ex|1|1
ImportDeclaration|importdeclaration:/s/KEY/a.java:java.util.list:2|java.util.List|2|2
JavaClass|javaclass:com.ex.aKEY|AKEY|5|14
JavaField|javafield:javaclass:com.ex.aKEY.n|n|6|6
JavaMethod|javamethod:javaclass:com.ex.aKEY.aKEY|AKEY|7|9
JavaClass|javaclass:com.ex.in|In|10|12
JavaMethod|javamethod:javaclass:com.ex.in.deep|deep|11|11
JavaMethod|javamethod:javaclass:com.ex.aKEY.after|after|13|13
JavaEnum|javaenum:com.ex.e|E|15|15
DECLARES_PACKAGE|file:/s/KEY/a.java|packagedeclaration:/s/KEY/a.java:com.ex|9|
JAVA_IMPORTS|file:/s/KEY/a.java|importdeclaration:/s/KEY/a.java:java.util.list:2|5|
DEFINES_CLASS|file:/s/KEY/a.java|javaclass:com.ex.aKEY|9|
DEFINES_CLASS|file:/s/KEY/a.java|javaclass:com.ex.in|9|
DEFINES_ENUM|file:/s/KEY/a.java|javaenum:com.ex.e|9|
HAS_FIELD|javaclass:com.ex.aKEY|javafield:javaclass:com.ex.aKEY.n|7|
HAS_METHOD|javaclass:com.ex.aKEY|javamethod:javaclass:com.ex.aKEY.aKEY|8|
HAS_METHOD|javaclass:com.ex.in|javamethod:javaclass:com.ex.in.deep|8|
HAS_METHOD|javaclass:com.ex.aKEY|javamethod:javaclass:com.ex.aKEY.after|8|
""")
def java_extract(spark, sf):
    return _graph(sources.java(_files(spark, sf, ("/s/KEY/A.java", JAVA))))


@source_query("""
File|file:/s/KEY/p.cs|P.cs|1|19
UsingDirective|usingdirective:/s/KEY/p.cs:system:1|System|1|1
NamespaceDeclaration|namespacedeclaration:/s/KEY/p.cs:inv.core|Inv.Core|3|18
CSharpClass|csharpclass:inv.core.programKEY|ProgramKEY|5|13
Field|field:csharpclass:inv.core.programKEY.count|count|7|7
Property|property:csharpclass:inv.core.programKEY.name|Name|8|8
CSharpMethod|csharpmethod:csharpclass:inv.core.programKEY.main|Main|9|12
CSharpInterface|csharpinterface:inv.core.iitem|IItem|14|17
CSharpMethod|csharpmethod:csharpinterface:inv.core.iitem.get|Get|16|16
CSHARP_USING|file:/s/KEY/p.cs|usingdirective:/s/KEY/p.cs:system:1|5|
DECLARES_NAMESPACE|file:/s/KEY/p.cs|namespacedeclaration:/s/KEY/p.cs:inv.core|9|
DEFINES_CLASS|namespacedeclaration:/s/KEY/p.cs:inv.core|csharpclass:inv.core.programKEY|9|
DEFINES_INTERFACE|namespacedeclaration:/s/KEY/p.cs:inv.core|csharpinterface:inv.core.iitem|9|
HAS_FIELD|csharpclass:inv.core.programKEY|field:csharpclass:inv.core.programKEY.count|7|
HAS_PROPERTY|csharpclass:inv.core.programKEY|property:csharpclass:inv.core.programKEY.name|7|
HAS_METHOD|csharpclass:inv.core.programKEY|csharpmethod:csharpclass:inv.core.programKEY.main|8|
HAS_METHOD|csharpinterface:inv.core.iitem|csharpmethod:csharpinterface:inv.core.iitem.get|8|
""")
def csharp_extract(spark, sf):
    return _graph(sources.csharp(_files(spark, sf, ("/s/KEY/P.cs", CSHARP))))


@source_query("""
File|file:/s/KEY/m.cpp|m.cpp|1|14
IncludeDirective|includedirective:/s/KEY/m.cpp:iostream:1|iostream|1|1
MacroDefinition|macrodefinition:/s/KEY/m.cpp:max:2|MAX|2|2
CppClass|cppclass:/s/KEY/m.cpp:circleKEY|CircleKEY|3|6
CppMethod|cppmethod:/s/KEY/m.cpp:area:5|area|5|5
CFunction|cfunction:/s/KEY/m.cpp:circleKEY::far:7|CircleKEY::far|7|10
CFunction|cfunction:/s/KEY/m.cpp:main:11|main|11|13
INCLUDES|file:/s/KEY/m.cpp|includedirective:/s/KEY/m.cpp:iostream:1|5|
DEFINES_CLASS|file:/s/KEY/m.cpp|cppclass:/s/KEY/m.cpp:circleKEY|9|
HAS_METHOD|cppclass:/s/KEY/m.cpp:circleKEY|cppmethod:/s/KEY/m.cpp:area:5|8|
DEFINES_FUNCTION|file:/s/KEY/m.cpp|cfunction:/s/KEY/m.cpp:circleKEY::far:7|8|
DEFINES_FUNCTION|file:/s/KEY/m.cpp|cfunction:/s/KEY/m.cpp:main:11|8|
""")
def cpp_extract(spark, sf):
    return _graph(sources.c_cpp(_files(spark, sf, ("/s/KEY/m.cpp", CPP))))


@source_query("""
File|file:/s/KEY/p.py|p.py|1|10
PythonModule|pythonmodule:/s/KEY/p.py:os|os|1|1
PythonVariable|pythonvariable:/s/KEY/p.py:x:2|X|2|2
PythonFunction|pythonfunction:/s/KEY/p.py:greetKEY|greetKEY|4|5
PythonParameter|pythonparameter:/s/KEY/p.py:greetKEY.name:4|name|4|4
PythonClass|pythonclass:/s/KEY/p.py:k|K|7|9
PythonMethod|pythonmethod:/s/KEY/p.py:k.get|get|8|9
PythonParameter|pythonparameter:/s/KEY/p.py:k.get.self:8|self|8|8
PYTHON_IMPORTS|file:/s/KEY/p.py|pythonmodule:/s/KEY/p.py:os|1|
PYTHON_DEFINES_FUNCTION|file:/s/KEY/p.py|pythonfunction:/s/KEY/p.py:greetKEY|1|
PYTHON_HAS_PARAMETER|pythonfunction:/s/KEY/p.py:greetKEY|pythonparameter:/s/KEY/p.py:greetKEY.name:4|1|
PYTHON_CALLS|pythonfunction:/s/KEY/p.py:greetKEY|pythonfunction:/s/KEY/p.py:print|1|
PYTHON_DEFINES_CLASS|file:/s/KEY/p.py|pythonclass:/s/KEY/p.py:k|1|
PYTHON_HAS_METHOD|pythonclass:/s/KEY/p.py:k|pythonmethod:/s/KEY/p.py:k.get|1|
PYTHON_HAS_PARAMETER|pythonmethod:/s/KEY/p.py:k.get|pythonparameter:/s/KEY/p.py:k.get.self:8|1|
PYTHON_CALLS|pythonmethod:/s/KEY/p.py:k.get|pythonfunction:/s/KEY/p.py:greetKEY|1|
""")
def py_extract(spark, sf):
    return _graph(python_source.python(_files(spark, sf, ("/s/KEY/p.py", PYTHON))))


@source_query("""
File|file:/s/KEY/x.sql|x.sql|1|9
SQLTable|sqltable:shop.itemsKEY|itemsKEY|2|6
SQLColumn|sqlcolumn:sqltable:shop.itemsKEY.id|id|2|6
SQLColumn|sqlcolumn:sqltable:shop.itemsKEY.price|price|2|6
SQLView|sqlview:v|v|7|7
SQLInsertStatement|sqlinsertstatement:/s/KEY/x.sql:8:0|insert|8|8
DEFINES_TABLE|file:/s/KEY/x.sql|sqltable:shop.itemsKEY|9|
HAS_COLUMN|sqltable:shop.itemsKEY|sqlcolumn:sqltable:shop.itemsKEY.id|8|
HAS_COLUMN|sqltable:shop.itemsKEY|sqlcolumn:sqltable:shop.itemsKEY.price|8|
DEFINES_VIEW|file:/s/KEY/x.sql|sqlview:v|9|
""")
def sql_extract(spark, sf):
    return _graph(sql_source.sql(_files(spark, sf, ("/s/KEY/x.sql", SQL))))


@source_query("""
File|file:/s/KEY/a.ts|a.ts|1|23
Import|import:/s/KEY/a.ts:./b:1|./b|1|1
Import|import:/s/KEY/a.ts:./b:2|./b|2|2
Import|import:/s/KEY/a.ts:lib:3|lib|3|3
Variable|variable:/s/KEY/a.ts:limit:5|LIMIT|5|5
Function|function:/s/KEY/a.ts:runKEY:6|runKEY|6|11
Class|class:/s/KEY/a.ts:k|K|12|19
Method|method:/s/KEY/a.ts:k.load|load|13|15
Method|method:/s/KEY/a.ts:k.step|step|16|18
Interface|interface:/s/KEY/a.ts:i|I|20|22
Method|method:/s/KEY/a.ts:i.size|size|21|21
IMPORTS|file:/s/KEY/a.ts|import:/s/KEY/a.ts:./b:1|1|
IMPORTS|file:/s/KEY/a.ts|import:/s/KEY/a.ts:./b:2|1|
IMPORTS|file:/s/KEY/a.ts|import:/s/KEY/a.ts:lib:3|1|
HAS_METHOD|class:/s/KEY/a.ts:k|method:/s/KEY/a.ts:k.load|10|
HAS_METHOD|class:/s/KEY/a.ts:k|method:/s/KEY/a.ts:k.step|10|
HAS_METHOD|interface:/s/KEY/a.ts:i|method:/s/KEY/a.ts:i.size|10|
Parameter|parameter:function:/s/KEY/a.ts:runKEY:6:n|n|6|6
Parameter|parameter:method:/s/KEY/a.ts:k.load:a|a|13|13
HAS_PARAMETER|function:/s/KEY/a.ts:runKEY:6|parameter:function:/s/KEY/a.ts:runKEY:6:n|8|
HAS_PARAMETER|method:/s/KEY/a.ts:k.load|parameter:method:/s/KEY/a.ts:k.load:a|8|
""")
def ts_extract(spark, sf):
    return _graph(sources.typescript(_files(spark, sf, ("/s/KEY/a.ts", TS_A))))


@source_query("""
IMPORTS|file:/s/KEY/a.ts|file:/s/KEY/b.ts|5|false
IMPORTS|file:/s/KEY/a.ts|file:lib|5|true
RESOLVES_IMPORT|file:/s/KEY/a.ts|function:/s/KEY/b.ts:b:1|8|
RESOLVES_IMPORT|file:/s/KEY/a.ts|class:/s/KEY/b.ts:c|8|
RESOLVES_IMPORT|file:/s/KEY/a.ts|file:/s/KEY/b.ts|8|
EXTENDS|class:/s/KEY/a.ts:k|class:/s/KEY/b.ts:c|9|false
IMPLEMENTS|class:/s/KEY/a.ts:k|interface:/s/KEY/a.ts:i|9|false
CALLS|function:/s/KEY/a.ts:runKEY:6|function:/s/KEY/b.ts:b:1|6|true
CALLS|method:/s/KEY/a.ts:k.load|function:/s/KEY/a.ts:runKEY:6|7|false
CALLS|method:/s/KEY/a.ts:k.load|method:/s/KEY/a.ts:k.step|7|false
HANDLES_ERROR|method:/s/KEY/a.ts:k.load|parameter:method:/s/KEY/a.ts:k.load:e|5|
""")
def ts_resolve(spark, sf):
    files = _files(spark, sf, ("/s/KEY/a.ts", TS_A), ("/s/KEY/b.ts", TS_B))
    nodes = cut(sources.typescript(files)[0])
    targets = resolve_ts.import_targets(nodes)
    flag = lambda rows, c: rows.select(F.col("type").alias("what"), F.col("sourceId").alias("a"), F.col("targetId").alias("b"), F.col("weight").cast("string").alias("c"), (F.col(c).cast("string") if c else F.lit("")).alias("d"))
    parts = [flag(resolve_ts.file_imports(targets), "isPlaceholder"), flag(resolve_ts.resolved_imports(nodes, targets), ""), flag(resolve_ts.inheritance(nodes, targets), "isPlaceholder"), flag(resolve_ts.calls(files, nodes, targets), "isCrossFile"), flag(resolve_ts.error_handlers(files, nodes), "")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@source_query("function:/s/KEY/a.ts:runKEY:6|3\nmethod:/s/KEY/a.ts:k.load|2\nmethod:/s/KEY/a.ts:k.step|1\nmethod:/s/KEY/a.ts:i.size|1", "id, complexity")
def ts_complexity(spark, sf):
    files = _files(spark, sf, ("/s/KEY/a.ts", TS_A))
    return resolve_ts.complexities(files, sources.typescript(files)[0]).select(F.col("entityId").alias("id"), F.col("complexity").cast("string").alias("complexity"))


@source_query("""
JSXElement|jsxelement:/s/KEY/a.tsx:div:2:2|div|2
JSXElement|jsxelement:/s/KEY/a.tsx:itemKEY:3:4|ItemKEY|3
JSXElement|jsxelement:/s/KEY/a.tsx:span:4:4|span|4
JSXAttribute|jsxattribute:jsxelement:/s/KEY/a.tsx:div:2:2:classname|className|2
JSXAttribute|jsxattribute:jsxelement:/s/KEY/a.tsx:itemKEY:3:4:key|key|3
JSXAttribute|jsxattribute:jsxelement:/s/KEY/a.tsx:itemKEY:3:4:on|on|3
TailwindClass|tailwindclass:p-KEY|p-KEY|0
TailwindClass|tailwindclass:m-KEY|m-KEY|0
RENDERS_ELEMENT|jsxelement:/s/KEY/a.tsx:div:2:2|jsxelement:/s/KEY/a.tsx:itemKEY:3:4|6
RENDERS_ELEMENT|jsxelement:/s/KEY/a.tsx:div:2:2|jsxelement:/s/KEY/a.tsx:span:4:4|6
HAS_PROP|jsxelement:/s/KEY/a.tsx:div:2:2|jsxattribute:jsxelement:/s/KEY/a.tsx:div:2:2:classname|7
HAS_PROP|jsxelement:/s/KEY/a.tsx:itemKEY:3:4|jsxattribute:jsxelement:/s/KEY/a.tsx:itemKEY:3:4:key|7
HAS_PROP|jsxelement:/s/KEY/a.tsx:itemKEY:3:4|jsxattribute:jsxelement:/s/KEY/a.tsx:itemKEY:3:4:on|7
USES_TAILWIND_CLASS|jsxelement:/s/KEY/a.tsx:div:2:2|tailwindclass:p-KEY|2
USES_TAILWIND_CLASS|jsxelement:/s/KEY/a.tsx:div:2:2|tailwindclass:m-KEY|2
""", "what, a, b, c")
def jsx_extract(spark, sf):
    nodes, rels = jsx_.jsx(_files(spark, sf, ("/s/KEY/a.tsx", JSX)))
    a = nodes.select(F.col("kind").alias("what"), F.col("entityId").alias("a"), F.col("name").alias("b"), F.col("startLine").cast("string").alias("c"))
    return a.unionByName(rels.select(F.col("type").alias("what"), F.col("sourceId").alias("a"), F.col("targetId").alias("b"), F.col("weight").cast("string").alias("c")))


#: A source file for each row: what the braces, quotes and comments in it hide must not count.
_JAVA_OF_PART = """package shop.s{size};
/* class Fake {{ */
public class P{key} {{
  private int a, b{size} = f(1, 2);
  String label = "{{ " + "http://{name}";
  public void m{key}(
      int x,
      String y) {{
    if (x > 0) {{ return; }}
  }}
}}
"""
_TS_OF_CUSTOMER = """import {{
  helper as h{key}
}} from './lib';
export default class C{key} {{
  public async load(
    id: number,
    name?: string
  ): Promise<void> {{
    const url = `http://x/{key} {{ `;
  }}
}}
export const A{key} = 1, B{key} = "a, b";
"""


def sources_of(rows: DataFrame, template: str, path, **values) -> DataFrame:
    """(path, content) of a template with a row's values in it."""
    parts = [F.lit("")]
    for k, piece in enumerate(template.replace("{{", "\x01").replace("}}", "\x02").split("{")):
        name, rest = piece.split("}") if k else ("", piece)
        parts += [values[name].cast("string")] if k else []
        parts += [F.lit(rest.replace("\x01", "{").replace("\x02", "}"))]
    return spread(rows).select(path.alias("path"), F.concat(*parts).alias("content"))


def _of_rows(table: str, key: str, *rows: tuple[str, str, str, str, str]) -> str:
    """SQL of rows (what, a, b, c, d), expressions over each row of a table."""
    return " UNION ALL ".join(f"SELECT DISTINCT '{what}' AS what, {a} AS a, {b} AS b, '{c}' AS c, '{d}' AS d FROM (SELECT {key} FROM {table})" for what, a, b, c, d in rows)


def java_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_name")
    files = sources_of(part, _JAVA_OF_PART, F.concat(F.lit("/p/P"), "p_partkey", F.lit(".java")), key=F.col("p_partkey"), size=F.col("p_size"), name=F.col("p_name"))
    return _graph(sources.java(files)).where("what <> 'File'")


def ts_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    files = sources_of(customer, _TS_OF_CUSTOMER, F.concat(F.lit("/c/C"), "c_custkey", F.lit(".ts")), key=F.col("c_custkey"))
    nodes, rels = sources.typescript_with_jsx(files)
    return _graph((nodes, rels)).where("what <> 'File'")


def ts_columns_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What headers say beside names and places."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    files = sources_of(customer, _TS_OF_CUSTOMER, F.concat(F.lit("/c/C"), "c_custkey", F.lit(".ts")), key=F.col("c_custkey"))
    nodes, _ = sources.typescript(files)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    says = {"Class": ("isExported", "isDefaultExport", "isAbstract"), "Method": ("visibility", "isAsync", "returnType"), "Parameter": ("type", "isOptional", "isRestParameter"), "Variable": ("isConstant", "isExported", "kind")}
    out = None
    for kind, names in says.items():
        own = nodes.where(F.col("kind") == kind).select("entityId", *(text(c).alias(x) for c, x in zip(names, "abc", strict=True)))
        out = own if out is None else out.unionByName(own)
    return out


_MUTATING_TS = """export let total{key} = 0;
let other{key} = 1;
export function add{key}(n: number) {{
  total{key} = total{key} + n;
  if (other{key} == n) {{
    let local = 1;
    local = 2;
  }}
  other{key} += 1;
}}
"""


def ts_mutations_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    files = sources_of(customer, _MUTATING_TS, F.concat(F.lit("/m/C"), "c_custkey", F.lit(".ts")), key=F.col("c_custkey"))
    nodes, _ = sources.typescript(files)
    return resolve_ts.mutations(files, nodes, resolve_ts.import_targets(nodes))


_CALLING_TS = """import * as all from './L{key}';
import {{ Tool }} from './L{key}';
export class Own{key} {{
  static make() {{
    return 1;
  }}
}}
export function go{key}(t: Tool, n: number) {{
  all.help{key}(n);
  if (n > 1) {{
    const s = "Own{key}.other()";
    t.use();
  }}
  for (const x of [1])
    Own{key}.make();
  n.toFixed();
}}
"""
_CALLED_TS = """export class Tool {{
  use() {{
  }}
}}
export function help{key}(n: number) {{
}}
"""
_USING_TSX = """import {{ Badge{key} }} from './B{key}';
export const Card{key} = () => (
  <div>
    <Badge{key} size="1" />
    <Row{key}><b>x</b></Row{key}>
    <Unknown />
  </div>
);
export function Row{key}(): JSX.Element {{
  return null;
}}
export const helper = () => <Badge{key} />;
"""
_USED_TSX = """export class Badge{key} {{
  render() {{
    return <i />;
  }}
}}
export class Plain {{
}}
"""


def _pairs_of_customers(spark: SparkSession, sf_dir: str, one: tuple[str, str], other: tuple[str, str], end: str) -> DataFrame:
    """Two files of each customer: (folder and letter, template) each."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    a, b = (sources_of(customer, text, F.concat(F.lit(head), "c_custkey", F.lit(end)), key=F.col("c_custkey")) for head, text in (one, other))
    return a.unionByName(b)


def ts_calls_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of members of a module, a class and a typed parameter, some in branches."""
    files = _pairs_of_customers(spark, sf_dir, ("/k/C", _CALLING_TS), ("/k/L", _CALLED_TS), ".ts")
    nodes = cut(sources.typescript(files)[0])
    return resolve_ts.calls(files, nodes, resolve_ts.import_targets(nodes)).drop("entityId")


def tsx_components_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components and which uses which."""
    files = _pairs_of_customers(spark, sf_dir, ("/x/C", _USING_TSX), ("/x/B", _USED_TSX), ".tsx")
    nodes = cut(sources.typescript(files)[0])
    found = cut(resolve_ts.components(files, nodes))
    return _graph((found, resolve_ts.component_uses(files, nodes, resolve_ts.import_targets(nodes), found)))


_P = "p_partkey, p_size, 'javaclass:shop.s' || p_size || '.p' || p_partkey AS o, '/p/p' || p_partkey || '.java' AS f"
_C = "c_custkey AS k, '/c/c' || c_custkey || '.ts' AS f, 'method:/c/c' || c_custkey || '.ts:c' || c_custkey || '.load' AS m"
QUERIES |= {"java_of_parts": java_of_parts, "ts_of_customers": ts_of_customers, "ts_columns_of_customers": ts_columns_of_customers, "ts_mutations_of_customers": ts_mutations_of_customers, "ts_calls_of_customers": ts_calls_of_customers, "tsx_components_of_customers": tsx_components_of_customers}
ORACLES |= {
    "ts_calls_of_customers": " UNION ALL ".join(
        f"SELECT 'CALLS' AS type, 'function:/k/c' || k || '.ts:go' || k || ':8' AS sourceId, {target} AS targetId, {weight} AS weight, {far} AS isCrossFile, {often} AS isConditional FROM (SELECT c_custkey AS k FROM customer)" for target, weight, far, often in (
            ("'function:/k/l' || k || '.ts:help' || k || ':5'", 6, "true", "false"), ("'method:/k/l' || k || '.ts:tool.use'", 6, "true", "true"), ("'method:/k/c' || k || '.ts:own' || k || '.make'", 7, "false", "true"),
        )
    ),
    "tsx_components_of_customers": _of_rows(
        "customer", "c_custkey AS k, 'component:/x/c' || c_custkey || '.tsx:card' || c_custkey AS card, 'component:/x/c' || c_custkey || '.tsx:row' || c_custkey AS r, 'component:/x/b' || c_custkey || '.tsx:badge' || c_custkey AS badge",
        ("Component", "card", "'Card' || k", "2", "8"), ("Component", "r", "'Row' || k", "9", "11"), ("Component", "badge", "'Badge' || k", "1", "5"), ("USES_COMPONENT", "card", "badge", "7", ""), ("USES_COMPONENT", "card", "r", "7", ""),
    ),
    "ts_mutations_of_customers": "SELECT 'mutates_state:' || a || ':' || b AS entityId, 'MUTATES_STATE' AS type, a AS sourceId, b AS targetId, 8 AS weight FROM (SELECT 'function:/m/c' || c_custkey || '.ts:add' || c_custkey || ':3' AS a, 'variable:/m/c' || c_custkey || '.ts:total' || c_custkey || ':1' AS b FROM customer)",
    "java_of_parts": _of_rows(
        "part", _P, ("PackageDeclaration", "'packagedeclaration:' || f || ':shop.s' || p_size", "'shop.s' || p_size", "1", "1"), ("JavaClass", "o", "'P' || p_partkey", "3", "11"),
        ("JavaField", "'javafield:' || o || '.a'", "'a'", "4", "4"), ("JavaField", "'javafield:' || o || '.b' || p_size", "'b' || p_size", "4", "4"), ("JavaField", "'javafield:' || o || '.label'", "'label'", "5", "5"),
        ("JavaMethod", "'javamethod:' || o || '.m' || p_partkey", "'m' || p_partkey", "6", "10"), ("DECLARES_PACKAGE", "'file:' || f", "'packagedeclaration:' || f || ':shop.s' || p_size", "9", ""), ("DEFINES_CLASS", "'file:' || f", "o", "9", ""),
        ("HAS_FIELD", "o", "'javafield:' || o || '.a'", "7", ""), ("HAS_FIELD", "o", "'javafield:' || o || '.b' || p_size", "7", ""), ("HAS_FIELD", "o", "'javafield:' || o || '.label'", "7", ""), ("HAS_METHOD", "o", "'javamethod:' || o || '.m' || p_partkey", "8", ""),
    ),
    "ts_of_customers": _of_rows(
        "customer", _C, ("Import", "'import:' || f || ':./lib:1'", "'./lib'", "1", "1"), ("Class", "'class:' || f || ':c' || k", "'C' || k", "4", "11"), ("Method", "m", "'load'", "5", "10"),
        ("Parameter", "'parameter:' || m || ':id'", "'id'", "5", "5"), ("Parameter", "'parameter:' || m || ':name'", "'name'", "5", "5"), ("Variable", "'variable:' || f || ':a' || k || ':12'", "'A' || k", "12", "12"), ("Variable", "'variable:' || f || ':b' || k || ':12'", "'B' || k", "12", "12"),
        ("IMPORTS", "'file:' || f", "'import:' || f || ':./lib:1'", "1", ""), ("HAS_METHOD", "'class:' || f || ':c' || k", "m", "10", ""), ("HAS_PARAMETER", "m", "'parameter:' || m || ':id'", "8", ""), ("HAS_PARAMETER", "m", "'parameter:' || m || ':name'", "8", ""),
        ("EXPORTS", "'file:' || f", "'class:' || f || ':c' || k", "8", ""), ("EXPORTS", "'file:' || f", "'variable:' || f || ':a' || k || ':12'", "8", ""), ("EXPORTS", "'file:' || f", "'variable:' || f || ':b' || k || ':12'", "8", ""),
    ),
    "ts_columns_of_customers": " UNION ALL ".join(
        f"SELECT {e} AS entityId, '{a}' AS a, '{b}' AS b, '{c}' AS c FROM (SELECT {_C} FROM customer)" for e, a, b, c in (
            ("'class:' || f || ':c' || k", "true", "true", "false"), ("m", "public", "true", "Promise<void>"), ("'parameter:' || m || ':id'", "number", "false", "false"), ("'parameter:' || m || ':name'", "string", "true", "false"),
            ("'variable:' || f || ':a' || k || ':12'", "true", "true", "Variable"), ("'variable:' || f || ':b' || k || ':12'", "true", "true", "Variable"),
        )
    ),
}
