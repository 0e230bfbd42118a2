"""Queries on modules of several files made of each row of a table: names through re-exports, lists and barrels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcloom.analyze import analyze
from srcloom.extract import sources
from srcloom.extract.lines import lexed
from srcloom.functions.identity import extension, inside_delimiters
from srcloom.operators import exports, includes, resolve_ts
from srcloom.operators.lineage import cut
from srcloom.plans.source_queries import sources_of
from srcloom.schema import PARSERS
from srcloom.sources.files import parser_of

#: A module of six files for each customer: a barrel of a barrel of a barrel, and two files that name each other.
FILES = {
    "a": """export class Core{key} {{
}}
export function make{key}(n: number) {{
}}
const hidden{key} = 1;
export {{ hidden{key} as shown{key} }};
""",
    "b": """export * from './a';
export {{ make{key} as build{key} }} from './a';
""",
    "c": """export {{
  Core{key} as default, // renamed
  build{key}
}} from './b';
export * as all{key} from './a';
export function make{key}() {{
}}
export * from './b';
""",
    "d": """export * from './c';
export {{ loop{key} }} from './e';
export {{ lost{key} as found{key} }} from './a';
export {{ gone{key} }} from './nowhere';
""",
    "e": """export {{ loop{key} }} from './d';
export {{ loop{key} as around{key} }} from './d';
export * from './a';
export * from './f';
""",
    "f": """import Main{key}, {{ build{key} as fresh{key} }} from './c';
import {{ shown{key}, make{key} }} from './d';
export default Main{key};
export const Core{key} = 5;
export {{ fresh{key} as made{key}, make{key} as other{key} }};
export function run{key}() {{
  fresh{key}(1);
  make{key}();
}}
""",
}


def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    out = None
    for name, text in FILES.items():
        own = sources_of(customer, text, F.concat(F.lit("/g/"), F.col("c_custkey").cast("string"), F.lit(f"/{name}.ts")), key=F.col("c_custkey"))
        out = own if out is None else out.unionByName(own)
    return out


def _module(spark: SparkSession, sf_dir: str, *more: str):
    """The lines of the modules' files, with more columns than declarations take, their nodes, imports, export clauses and exported names."""
    files = module_files(spark, sf_dir)
    code = lexed(files, "path", "line", "text", "clean", "params", "last", "before", "opener", "closer", *more)
    nodes = sources.typescript(files, code)[0]
    targets, clauses = resolve_ts.linked(code, nodes)
    return code, nodes, targets, clauses, exports.exported_names(resolve_ts.declarations(nodes), clauses, resolve_ts.imported_names(targets))


def ts_exported_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each exported name comes to, over how many files."""
    return _module(spark, sf_dir)[4].select("path", "name", "status", "targetId", "hops")


def ts_export_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPORTS of declarations, lists, defaults and re-exports."""
    _, nodes, _, clauses, names = _module(spark, sf_dir)
    own = sources.exports(nodes).withColumn("isReExport", F.lit(False))
    return own.unionByName(exports.export_relationships(clauses, names))


def ts_calls_through_barrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and resolved imports of names that other files hand on."""
    code, nodes, targets, _, names = _module(spark, sf_dir, "inside")
    names = cut(names)
    calls = resolve_ts.calls(code, nodes, targets, names).select("type", "sourceId", "targetId", "weight")
    return calls.unionByName(resolve_ts.resolved_imports(nodes, targets, names).select("type", "sourceId", "targetId", "weight"))


_LAMBDAS_TS = """import {{ app{key} }} from './app';
export const handle{key} = (a: number) => {{
  items.map(i => i + {key});
  return a;
}};
setTimeout(() => {{
  tick("a, b) => {{");
}}, {key});
app{key}.get("/x", async (req,
  res) => {{
  res.send({{ each: v => 1 }});
}});
class Box{key} {{
  on = () => {key};
  run() {{
    rows.filter(x => x > 1)
      .forEach(function (x) {{ log(x); }});
  }}
}}
// no(() => comment)
"""
_ARGUMENTS_TS = """function send{key}(id: number, name: string) {{
  if (id > 1) {{
    store{key}(id, "a, (b", {{ x: 1, y: [2, 3] }});
  }}
  store{key}(
    name, // first, of two
    new Map<string, number>(),
    true
  );
  return store{key}();
}}
function store{key}(...all: any[]) {{
  other{key}(1);
}}
class Own{key} {{
  first(a: Date) {{
    this.second(a, `t`, -{key}, nested{key}(1, 2));
    for (const x of [1]) this.second(x);
  }}
  second(a: any) {{
  }}
}}
"""


def _of_customers(spark: SparkSession, sf_dir: str, text: str, folder: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return sources_of(customer, text, F.concat(F.lit(f"/{folder}/"), F.col("c_custkey").cast("string"), F.lit(".ts")), key=F.col("c_custkey"))


def ts_lambdas_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions without a name of their own, by the variable or call around them."""
    nodes, _ = sources.typescript_with_jsx(_of_customers(spark, sf_dir, _LAMBDAS_TS, "l"))
    return nodes.where("kind = 'Function'").select("entityId", "name", "startLine", "endLine", "isAsync", F.coalesce("isExported", F.lit(False)).alias("isExported"))


def ts_arguments_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls within a file with the numbers and types of their arguments."""
    files = _of_customers(spark, sf_dir, _ARGUMENTS_TS, "n")
    rows = resolve_ts.in_file_calls(files, cut(sources.typescript(files)[0]))
    return rows.select("sourceId", "targetId", "weight", "startLine", "startColumn", "argumentCount", F.array_join("argumentTypes", "|").alias("argumentTypes"), "isConditional")


_DETAILS_TS = """import Main{key}, {{ a as b{key}, type T{key} }} from './x{key}';
import type {{
  Only{key}
}} from './types';
import * as all{key} from "lib";
import './effects';

/** Says {{ nothing.
 * Twice over.
 * @internal
 * @since {key}
 */
export abstract class K{key} extends Base<string> implements I{key}, J<number> {{
  /** Runs. @not a tag
   * @returns {key} */
  go(): number {{
    const s = "/** @no */";
    return 1;
  }}
}}
/** An alias. */
export type Alias{key} = string | number;

export const enum Level{key} {{
  Low, High
}}
type Inner = {{ a: 1 }};
"""


def ts_details_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What imports bring, what classes implement, aliases and enums, documentation and its tags."""
    nodes, _ = sources.typescript_with_jsx(_of_customers(spark, sf_dir, _DETAILS_TS, "d"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    many = lambda c: F.coalesce(F.array_join(c, "+"), F.lit("-"))
    rows = nodes.where("kind IN ('Import', 'Class', 'Method', 'TypeAlias')")
    return rows.select("kind", "startLine", "endLine", many("namedImports").alias("named"), text("defaultImport").alias("byDefault"), text("namespaceImport").alias("whole"), text("isTypeOnly").alias("typeOnly"), many("implementsInterfaces").alias("implements"), text("isEnum").alias("isEnum"), F.coalesce(F.regexp_replace("documentation", "\n", "/"), F.lit("-")).alias("says"), many("tags").alias("tags"), "entityId")


_ENDS = ("ts", "tsx", "js", "mjs", "py", "c", "h", "cpp", "hh", "java", "go", "cs", "sql", "JSX", "txt")


def file_rows_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File rows of all languages: dispatch, language and lines; the gate of what is resolved, without and with JSX files."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    end = F.element_at(F.array(*(F.lit(e) for e in _ENDS)), (F.col("c_custkey") % len(_ENDS) + 1).cast("int"))
    files = customer.select(F.concat(F.lit("/F/.x/_f"), F.col("c_custkey").cast("string"), F.lit("."), end).alias("path"), F.concat(F.lit("// a\n"), F.repeat(F.lit("\r\n"), (F.col("c_custkey") % 7).cast("int")), F.lit("last")).alias("content"))
    gated = lambda tsx: resolve_ts.gate(files, tsx).select(F.col("path").alias("filePath"), F.lit(True).alias(f"g{int(tsx)}"))
    rows = sources.file_nodes(files).join(gated(False), "filePath", "left").join(gated(True), "filePath", "left")
    return rows.select("entityId", "name", "endLine", "loc", F.coalesce("language", F.lit("-")).alias("language"), F.coalesce(parser_of(F.col("filePath")), F.lit("-")).alias("parser"), F.coalesce("g0", F.lit(False)).alias("resolved"), F.coalesce("g1", F.lit(False)).alias("resolvedWithJsx"))


_DEFAULTS = {"a": "import Any{key}, {{ other{key} }} from './b';\nimport Sum{key} from './c';\nimport Lost{key} from './d';\n", "b": "export default class Thing{key} {{\n}}\nexport const other{key} = 1;\n", "c": "export default function sum{key}(a: number) {{\n}}\n", "d": "export const none{key} = 1;\n"}


def ts_default_imports_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default imports, of a class, a function, and of a file that has no default."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    files = None
    for name, text in _DEFAULTS.items():
        own = sources_of(customer, text, F.concat(F.lit("/v/"), F.col("c_custkey").cast("string"), F.lit(f"/{name}.ts")), key=F.col("c_custkey"))
        files = own if files is None else files.unionByName(own)
    nodes = cut(sources.typescript(files)[0])
    return resolve_ts.resolved_imports(nodes, resolve_ts.import_targets(nodes))


def words_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands between a text's first and last character, how it starts and ends, and whether its ending is scanned,
    numbered in order of brand and key."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    path = F.concat("p_name", F.lit("."), F.substring("p_brand", -2, 1))
    path = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit(".TS"))).when(F.col("p_partkey") % 4 == 1, F.concat("p_name", F.lit(".d.cpp"))).otherwise(path)
    order = Window.partitionBy("p_brand").orderBy("p_partkey")
    return part.select("p_partkey", inside_delimiters(F.concat(F.lit("<"), "p_name", F.lit(">"))).alias("inner"), F.col("p_name").startswith("a").alias("starts"), F.col("p_name").endswith("e").alias("ends"), extension(path).alias("extension"), extension(path).isin(*PARSERS).alias("scanned"), F.row_number().over(order).alias("ord"))


#: Headers beside, in a folder of the project, in every project, in two folders alike, nowhere; a file of another language.
_HEADERS = {
    "src/main.cpp": """#include <vector>
#include "util.h"
#include "shared/api.h"
#include "twice.h"
#include "../lib/up.h"
#include <own/angle{key}.hpp>
#include "gone.h"
#include "data.sql"
int main() {{
}}
""",
    "src/util.h": "int util();\n",
    "include/shared/api.h": "#include \"util.h\"\n",
    "a/twice.h": "int a;\n",
    "b/twice.h": "int b;\n",
    "lib/up.h": "int up;\n",
    "deep/own/angle{key}.hpp": "int own;\n",
    "src/data.sql": "CREATE TABLE t (id INT);\n",
}


def cpp_includes_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Includes resolved by folders and ends of paths."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    files = None
    for name, text in _HEADERS.items():
        head, _, tail = name.partition("{key}")
        path = F.concat(F.lit("/w/"), F.col("s_suppkey").cast("string"), F.lit(f"/{head}"), *([F.col("s_suppkey").cast("string"), F.lit(tail)] if tail else []))
        own = sources_of(supplier, text, path, key=F.col("s_suppkey"))
        files = own if files is None else files.unionByName(own)
    nodes = sources.c_cpp(files.where("path NOT LIKE '%.sql'"))[0]
    return includes.includes(cut(nodes)).drop("entityId")


def whole_graph_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by kind and relationships by type of a project of ten files for each supplier, through all passes."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    files = None
    for name, text in {**{f"{k}.ts": v for k, v in FILES.items()}, "l.ts": _LAMBDAS_TS, "n.ts": _ARGUMENTS_TS, "m.cpp": _HEADERS["src/main.cpp"], "util.h": _HEADERS["src/util.h"]}.items():
        own = sources_of(supplier, text, F.concat(F.lit("/g/"), F.col("s_suppkey").cast("string"), F.lit(f"/{name}")), key=F.col("s_suppkey"))
        files = own if files is None else files.unionByName(own)
    nodes, rels = (cut(x) for x in analyze(files))
    kinds = nodes.groupBy(F.coalesce("kind", F.lit("placeholder")).alias("what")).agg(F.count("*").alias("rows"))
    return kinds.unionByName(rels.groupBy(F.col("type").alias("what")).agg(F.count("*").alias("rows")))


def _ids(text: str) -> str:
    return "replace(" + text + ", '{k}', CAST(k AS VARCHAR))"


#: (file, name, next file, next name, declaration) as the six files state them.
_EDGES = """
a|core{k}||| class:/g/{k}/a.ts:core{k}
a|make{k}||| function:/g/{k}/a.ts:make{k}:3
a|shown{k}||| variable:/g/{k}/a.ts:hidden{k}:5
b|build{k}|a|make{k}|
c|default|b|core{k}|
c|build{k}|b|build{k}|
c|all{k}||| file:/g/{k}/a.ts
c|make{k}||| function:/g/{k}/c.ts:make{k}:6
d|loop{k}|e|loop{k}|
d|found{k}|a|lost{k}|
d|gone{k}|z|gone{k}|
e|loop{k}|d|loop{k}|
e|around{k}|d|loop{k}|
f|default|c|default|
f|core{k}||| variable:/g/{k}/f.ts:core{k}:4
f|made{k}|c|build{k}|
f|other{k}|d|make{k}|
f|run{k}||| function:/g/{k}/f.ts:run{k}:6
"""
_ROWS = ", ".join("(" + ", ".join(f"'{x.strip()}'" if x.strip() else "NULL" for x in line.split("|")) + ")" for line in _EDGES.strip().splitlines())
_WALK = f"""
WITH RECURSIVE c AS (SELECT c_custkey AS k FROM customer),
own AS (SELECT k, f, {_ids("n")} AS n, nf, {_ids("nn")} AS nn, {_ids("t")} AS t FROM c, (VALUES {_ROWS}) AS v(f, n, nf, nn, t)),
stars AS (SELECT * FROM (VALUES ('b', 'a'), ('c', 'b'), ('d', 'c'), ('e', 'a'), ('e', 'f')) AS v(f, x)),
handed AS (SELECT k, f, n, f AS origin FROM own WHERE n <> 'default'
  UNION SELECT h.k, s.f, h.n, h.origin FROM handed h JOIN stars s ON s.x = h.f WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.k = h.k AND o.f = s.f AND o.n = h.n)),
edges AS (SELECT * FROM own UNION ALL SELECT k, f, n, origin, n, NULL FROM handed WHERE f <> origin),
walk AS (SELECT k, f, n, nf, nn, t, 1 AS hops FROM edges
  UNION SELECT w.k, w.f, w.n, e.nf, e.nn, e.t, w.hops + 1 FROM walk w JOIN edges e ON e.k = w.k AND e.f = w.nf AND e.n = w.nn WHERE w.t IS NULL AND w.hops < 20),
ends AS (SELECT k, f, n, count(DISTINCT t) AS found, min(t) AS t, min(hops) FILTER (t IS NOT NULL) AS hops, max(hops) AS longest FROM walk GROUP BY ALL),
names AS (SELECT k, f, n, CASE WHEN found = 1 THEN 'resolved' WHEN found > 1 THEN 'ambiguous' WHEN longest = 20 THEN 'cycle' ELSE 'missing' END AS status, CASE WHEN found = 1 THEN t END AS t, CASE WHEN found = 1 THEN hops END AS hops FROM ends)
"""
#: Names as they are written; the rows above have them as ids have them.
_WRITTEN = "CASE WHEN n = 'core' || k THEN 'Core' || k ELSE n END"
_REL = "SELECT DISTINCT {id} AS entityId, 'EXPORTS' AS type, 'file:/g/' || k || '/' || f || '.ts' AS sourceId, {target} AS targetId, {weight} AS weight, {again} AS isReExport FROM {rows}"


def _rel(rows: str, target: str, weight: int, tail: str = "", again: str = "false") -> str:
    source = "'file:/g/' || k || '/' || f || '.ts'"
    return _REL.format(id=f"'exports:' || {source} || ':' || {target}" + (f" || ':{tail}'" if tail else ""), target=target, weight=weight, again=again, rows=rows)


_DECLARED = "(SELECT k, f, t FROM own WHERE t IS NOT NULL AND n <> 'shown' || k AND n <> 'all' || k) x"
_AGAIN = "(SELECT k, f, nf FROM own WHERE nf IS NOT NULL AND f <> 'f' AND nf <> 'z' UNION SELECT k, f, x FROM stars, c UNION SELECT k, 'c', 'a' FROM c) x"
_LOCAL = "(SELECT k, f, t FROM names WHERE status = 'resolved' AND (f = 'f' AND n IN ('made' || k, 'other' || k) OR f = 'a' AND n = 'shown' || k)) x"
#: name, first and last line, async, exported; source, target, line, column, number of arguments, types, in a branch.
_FOUND_LAMBDAS = """
handle{k}|2|5|false|true
callback_setTimeout_arg0|6|8|false|false
callback_app{k}_get_arg1|9|12|true|false
callback_res_send_arg-1|11|11|false|false
anonymousLambda|14|14|false|false
callback_rows_filter_arg0|16|16|false|false
callback_rows_filter_x____x___1_________arg0|17|17|false|false
"""
_FOUND_CALLS = """
function:/n/{k}.ts:send{k}:1|function:/n/{k}.ts:store{k}:12|3|4|3|number,"a~ (b",any|true
function:/n/{k}.ts:send{k}:1|function:/n/{k}.ts:store{k}:12|5|2|3|string,Map,true|false
function:/n/{k}.ts:send{k}:1|function:/n/{k}.ts:store{k}:12|10|9|0||false
method:/n/{k}.ts:own{k}.first|method:/n/{k}.ts:own{k}.second|17|4|4|Date,string,-{k},any|false
method:/n/{k}.ts:own{k}.first|method:/n/{k}.ts:own{k}.second|18|25|1|any|true
"""
#: kind, lines, named, default, namespace, type only, implements, enum, documentation, tags, id.
_FOUND_DETAILS = """
Import|1|1|a+T{k}|Main{k}|-|false|-|-|-|-|import:/d/{k}.ts:./x{k}:1
Import|2|2|Only{k}|-|-|true|-|-|-|-|import:/d/{k}.ts:./types:2
Import|5|5|-|-|all{k}|false|-|-|-|-|import:/d/{k}.ts:lib:5
Import|6|6|-|-|-|false|-|-|-|-|import:/d/{k}.ts:./effects:6
Class|13|20|-|-|-|-|I{k}+J|-|Says { nothing./Twice over.|internal+since|class:/d/{k}.ts:k{k}
Method|16|19|-|-|-|-|-|-|Runs. @not a tag|returns|method:/d/{k}.ts:k{k}.go
TypeAlias|22|22|-|-|-|-|-|false|An alias.||typealias:/d/{k}.ts:alias{k}
TypeAlias|24|26|-|-|-|-|-|true|-|-|typealias:/d/{k}.ts:level{k}
TypeAlias|27|27|-|-|-|-|-|false|-|-|typealias:/d/{k}.ts:inner
"""
#: language, parser, resolved, resolved with JSX, for each of the endings.
_FOUND_FILES = "('ts', 'TypeScript', 'typescript', true, true), ('tsx', 'TSX', 'typescript', false, true), ('js', 'TSX', 'typescript', true, true), ('mjs', 'TSX', 'typescript', true, true), ('py', 'Python', 'python', false, false), ('c', 'C', 'c_cpp', false, false), ('h', 'C', 'c_cpp', false, false), ('cpp', 'C++', 'c_cpp', false, false), ('hh', 'C++', 'c_cpp', false, false), ('java', 'Java', 'java', false, false), ('go', 'Go', 'go', false, false), ('cs', 'C#', 'csharp', false, false), ('sql', 'SQL', 'sql', false, false), ('JSX', 'TSX', 'typescript', false, true), ('txt', '-', '-', false, false)"
#: Of one project, through all passes; headers that none has are six placeholders more for all of them.
_FOUND_IN_ALL = """
File|10
Class|3
Function|12
Method|3
Variable|2
Parameter|7
Import|3
CFunction|1
IncludeDirective|8
placeholder|2
CALLS|4
DEFINES_FUNCTION|1
EXPORTS|19
HAS_METHOD|3
HAS_PARAMETER|7
IMPORTS|6
INCLUDES|16
RESOLVES_IMPORT|4
"""
_cells = lambda text: ", ".join("(" + ", ".join(f"'{x}'" for x in line.split("|")) + ")" for line in text.strip().splitlines())
QUERIES = {f.__name__: f for f in (ts_exported_names, ts_export_relationships, ts_calls_through_barrels, ts_lambdas_of_customers, ts_arguments_of_customers, cpp_includes_of_suppliers, whole_graph_of_suppliers, ts_details_of_customers, file_rows_of_customers, ts_default_imports_of_customers, words_of_parts)}
ORACLES = {
    "ts_exported_names": f"{_WALK} SELECT '/g/' || k || '/' || f || '.ts' AS path, {_WRITTEN} AS name, status, t AS targetId, CAST(hops AS BIGINT) AS hops FROM names",
    "ts_export_relationships": _WALK + " UNION ALL ".join((_rel(_DECLARED, "t", 8), _rel(_AGAIN, "'file:/g/' || k || '/' || nf || '.ts'", 4, "reexport", "true"), _rel(_LOCAL, "t", 8), _rel("(SELECT k, f, t FROM names WHERE f = 'f' AND n = 'default' AND status = 'resolved') x", "t", 8, "default"))),
    "ts_calls_through_barrels": f"""{_WALK}, imported AS (SELECT k, f, n, t FROM names WHERE status = 'resolved' AND (f = 'c' AND n IN ('default', 'build' || k) OR f = 'd' AND n IN ('shown' || k, 'make' || k)))
SELECT 'CALLS' AS type, 'function:/g/' || k || '/f.ts:run' || k || ':6' AS sourceId, t AS targetId, 6 AS weight FROM imported WHERE n IN ('build' || k, 'make' || k)
UNION ALL SELECT 'RESOLVES_IMPORT', 'file:/g/' || k || '/f.ts', t, 8 FROM imported""",
    "ts_lambdas_of_customers": f"""SELECT 'function:/l/' || k || '.ts:' || lower({_ids("n")}) || ':' || a AS entityId, {_ids("n")} AS name, CAST(a AS INTEGER) AS startLine, CAST(z AS INTEGER) AS endLine, CAST(s AS BOOLEAN) AS isAsync, CAST(x AS BOOLEAN) AS isExported
FROM (SELECT c_custkey AS k FROM customer), (VALUES {_cells(_FOUND_LAMBDAS)}) AS v(n, a, z, s, x)""",
    "ts_arguments_of_customers": f"""SELECT {_ids("s")} AS sourceId, {_ids("t")} AS targetId, 7 AS weight, CAST(l AS INTEGER) AS startLine, CAST(c AS INTEGER) AS startColumn, CAST(n AS INTEGER) AS argumentCount, replace(replace({_ids("y")}, ',', '|'), '~', ',') AS argumentTypes, CAST(b AS BOOLEAN) AS isConditional
FROM (SELECT c_custkey AS k FROM customer), (VALUES {_cells(_FOUND_CALLS)}) AS v(s, t, l, c, n, y, b)""",
    "cpp_includes_of_suppliers": f"""SELECT 'INCLUDES' AS type, 'file:/w/' || k || '/' || s AS sourceId, CASE WHEN p THEN 'file:' ELSE 'file:/w/' || k || '/' END || {_ids("t")} AS targetId, 4 AS weight, {_ids("w")} AS includePath, y AS isSystemInclude, p AS isPlaceholder
FROM (SELECT s_suppkey AS k FROM supplier), (VALUES ('src/main.cpp', 'vector', 'vector', true, true), ('src/main.cpp', 'src/util.h', 'util.h', false, false), ('src/main.cpp', 'include/shared/api.h', 'shared/api.h', false, false), ('src/main.cpp', 'twice.h', 'twice.h', false, true), ('src/main.cpp', 'lib/up.h', '../lib/up.h', false, false),
  ('src/main.cpp', 'deep/own/angle{{k}}.hpp', 'own/angle{{k}}.hpp', true, false), ('src/main.cpp', 'gone.h', 'gone.h', false, true), ('src/main.cpp', 'data.sql', 'data.sql', false, true), ('include/shared/api.h', 'src/util.h', 'util.h', false, false)) AS v(s, t, w, y, p)""",
    "whole_graph_of_suppliers": f"SELECT what, CAST(CAST(n AS BIGINT) * (SELECT count(*) FROM supplier) + CASE WHEN what = 'placeholder' THEN 6 ELSE 0 END AS BIGINT) AS rows FROM (VALUES {_cells(_FOUND_IN_ALL)}) AS v(what, n)",
    "ts_details_of_customers": f"""SELECT a AS kind, CAST(b AS INTEGER) AS startLine, CAST(c AS INTEGER) AS endLine, {_ids("d")} AS named, {_ids("e")} AS byDefault, {_ids("f")} AS whole, g AS typeOnly, {_ids("h")} AS implements, i AS isEnum, j AS says, l AS tags, {_ids("m")} AS entityId
FROM (SELECT c_custkey AS k FROM customer), (VALUES {_cells(_FOUND_DETAILS)}) AS v(a, b, c, d, e, f, g, h, i, j, l, m)""",
    "file_rows_of_customers": f"""SELECT 'file:/f/.x/_f' || k || '.' || lower(e) AS entityId, '_f' || k || '.' || e AS name, CAST(2 + k % 7 AS INTEGER) AS endLine, CAST(2 + k % 7 AS INTEGER) AS loc, l AS language, p AS parser, r AS resolved, x AS resolvedWithJsx
FROM (SELECT c_custkey AS k, [{", ".join(f"'{e}'" for e in _ENDS)}][CAST(c_custkey % {len(_ENDS)} + 1 AS BIGINT)] AS ending FROM customer) JOIN (VALUES {_FOUND_FILES}) AS v(e, l, p, r, x) ON e = ending""",
    "ts_default_imports_of_customers": """SELECT 'resolves_import:file:/v/' || k || '/a.ts:' || t AS entityId, 'RESOLVES_IMPORT' AS type, 'file:/v/' || k || '/a.ts' AS sourceId, t AS targetId, 8 AS weight
FROM (SELECT c_custkey AS k, unnest(['class:/v/' || c_custkey || '/b.ts:thing' || c_custkey, 'variable:/v/' || c_custkey || '/b.ts:other' || c_custkey || ':3', 'function:/v/' || c_custkey || '/c.ts:sum' || c_custkey || ':1']) AS t FROM customer)""",
    "words_of_parts": f"""SELECT p_partkey, p_name AS "inner", starts_with(p_name, 'a') AS starts, ends_with(p_name, 'e') AS ends, CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.cpp' ELSE '.' || substr(p_brand, length(p_brand) - 1, 1) END AS extension,
p_partkey % 4 < 2 AS scanned, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS ord FROM part""",
}
