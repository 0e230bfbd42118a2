"""What keeps time and memory in proportion: tasks of a table in one file, plans without broadcasts, files read once."""

import os
import random
import time

from pyspark.sql import functions as F

from srcloom.extract import call_spans, jsx, lexer, sources, sql_source
from srcloom.operators import exports, resolve, resolve_ts
from srcloom.operators.lineage import cut, dealt
from srcloom.plans import module_queries, projection, source_queries

SF = "/root/testdata/sf0.001"
TEXT = "export function f(n: number) {\n  if (n) {\n    f(1);\n  }\n}\nclass K {\n  m() {\n  }\n}\n"


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_files_of_one_row_group_are_dealt_over_tasks(spark):
    files = source_queries._files(spark, SF, ("/s/KEY/a.ts", TEXT))
    assert spark.read.parquet(f"{SF}/customer.parquet").rdd.getNumPartitions() == 1
    assert files.rdd.getNumPartitions() >= 4 and files.count() == spark.read.parquet(f"{SF}/customer.parquet").count()


def test_complexities_send_no_table_through_the_driver(spark):
    files = source_queries._files(spark, SF, ("/s/KEY/a.ts", TEXT))
    rows = resolve_ts.complexities(files, sources.typescript(files)[0])
    assert "BroadcastExchange" not in plan(rows)
    assert {r.complexity for r in rows.where(F.col("entityId").contains("function")).collect()} == {2}


def test_files_are_read_once_for_nodes_and_relationships(spark):
    files = source_queries._files(spark, SF, ("/s/KEY/a.ts", TEXT))
    nodes, rels = sources.typescript(files)
    assert "MapInArrow" not in plan(nodes) and "MapInArrow" not in plan(rels)


def test_depths_and_groups_of_lines():
    assert list(lexer.braces(["{ }", "} {", "var (", "x", ")", "}"])) == [(0, 0, 0, None), (0, 0, -1, None), (0, 0, 0, None), (0, 0, 0, "var"), (0, 0, 0, "var"), (0, -1, -1, None)]


def test_long_literals_and_words_cost_no_square():
    began = time.time()
    calls, _ = call_spans.spans('f("' + "x" * 300_000 + '");\n' + "1x" * 100_000 + "(2);\n")
    assert [c[2][:3] for c in calls] == ["f", "x1x"] and time.time() - began < 10


def test_imports_are_looked_up_once_and_by_priority(spark):
    files = spark.createDataFrame([(p,) for p in ("/s/b.js", "/s/b.ts", "/s/c/index.tsx", "/s/c/index.ts", "/s/d.d.ts", "/lib.ts")], "path string")
    asked = spark.createDataFrame([("/s/a.ts", x) for x in ("./b", "./c", "./d.d", "./none", "lib", "../lib")], "importer string, specifier string")
    rows = resolve.import_candidates(asked, files, [".ts", ".tsx", ".js", ".jsx"])
    assert plan(rows).count("SortMergeJoin") <= 1
    assert {(r.specifier, r.resolved, r.isPlaceholder) for r in rows.collect()} == {("./b", "/s/b.ts", False), ("./c", "/s/c/index.ts", False), ("./d.d", "/s/d.d.ts", False), ("./none", "/s/none", True), ("lib", "lib", True), ("../lib", "/lib.ts", False)}


def test_export_clauses_and_comments_are_read_once(spark):
    files = spark.createDataFrame([("/s/a.ts", "export { x } from './b';\n/** d */\nconst f = () => g(x => x);\n"), ("/s/b.ts", "export const x = 1;\n")], "path string, content string")
    nodes, rels = sources.typescript_with_jsx(files)
    assert "MapInArrow" not in plan(nodes) and "MapInArrow" not in plan(rels)
    clauses, _ = resolve_ts.export_names(files, nodes, resolve_ts.import_targets(nodes))
    assert "MapInArrow" not in plan(clauses) and [(r.exported, r.resolved) for r in clauses.collect()] == [("x", "/s/b.ts")]


def test_rows_of_a_large_table_are_dealt_by_key_over_tasks(spark):
    rows = dealt(spark.range(60_000).select((F.col("id") % 20_000).alias("k")), "k", 5_000).withColumn("task", F.spark_partition_id())
    found = rows.groupBy("task").agg(F.count("*").alias("n"), F.count_distinct("k").alias("keys")).collect()
    assert len(found) == 12 and sum(r.keys for r in found) == 20_000 and max(r.n for r in found) < 7_500
    assert "hashpartitioning(l_orderkey" in plan(projection.rels(spark, SF))


def test_elements_are_found_in_one_pass_without_sorts(spark):
    text = "x\n<a>\r\n<b c='1'\n/> <d></d></a></a>\n  <e><f/>"
    files = spark.createDataFrame([("/s/a.tsx", text), ("/s/b.tsx", None)], "path string, content string")
    rows = jsx.elements(files)
    assert not [x for x in ("Window", "Sort", "Exchange") if x in plan(rows)]
    own = lambda x: x and x.rpartition("/s/a.tsx:")[2]
    # a tag at the start of a line is in column 0, whatever stands above
    assert [(own(r.entityId), own(r.parentId), r.attrs) for r in rows.collect()] == [("a:2:0", None, ""), ("b:3:0", "a:2:0", " c='1'\n"), ("d:4:3", "a:2:0", ""), ("e:5:2", None, ""), ("f:5:5", "e:5:2", "")]


def test_classes_are_made_distinct_in_bounded_tasks(spark):
    files = spark.createDataFrame([("/s/A.tsx", '<a className="p q p"/>'), ("/s/a.tsx", '<a className="p"/>')], "path string, content string")
    nodes, rels = jsx.jsx(files)
    assert "hashpartitioning(entityId" in plan(nodes) and "hashpartitioning(elementId" in plan(rels) and "REPARTITION_BY_NUM" in plan(nodes) and "REPARTITION_BY_NUM" in plan(rels)
    assert sorted(r["name"] for r in nodes.where("kind = 'TailwindClass'").collect()) == ["p", "q"]
    # ids don't tell capitals in paths apart, so both files use p once
    assert sorted(r.targetId for r in rels.where("type = 'USES_TAILWIND_CLASS'").collect()) == ["tailwindclass:p", "tailwindclass:q"]


def test_statements_are_worked_out_once_in_methods_that_are_compiled(spark):
    text = "-- a\n  CREATE TABLE s.T (\n id INT, \"q\" DECIMAL(10, 2),\n PRIMARY KEY (id)\n) ;\n \n  \n  select 1;\n\ncreate view v as select ';'\n; ; -- b"
    files = spark.createDataFrame([("/s/a.sql", text), ("/s/b.sql", None)], "path string, content string")
    nodes, rels = sql_source.sql(files)
    optimized = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    assert sql_source.TABLE not in optimized(nodes) + optimized(rels)
    assert optimized(sql_source.declared(files)).count(sql_source.TABLE) == 2  # name, and what stands inside
    made = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
    for rows in (nodes, rels, sql_source.declared(files), source_queries._graph((nodes, rels))):
        parts = made.codegenStringSeq(rows._jdf.queryExecution().executedPlan())
        assert all(parts.apply(k)._3().maxMethodCodeSize() < 8000 for k in range(parts.size()))  # larger ones are interpreted
    own = sorted((r.kind, r["name"], r.startLine, r.endLine, r.extra) for r in nodes.where("kind <> 'File'").collect())
    assert own == [("SQLColumn", "id", 2, 5, "INT"), ("SQLColumn", "q", 2, 5, "DECIMAL(10, 2)"), ("SQLSelectStatement", "select", 8, 8, "select 1"), ("SQLTable", "T", 2, 5, None), ("SQLView", "v", 10, 10, "create view v as select ';'")]
    assert [r.entityId for r in nodes.where("kind = 'SQLSelectStatement'").collect()] == ["sqlselectstatement:/s/a.sql:8:2"]


def modules(spark, seed, folders=6, files=5):
    """Files of some folders that export, import and hand on few names from each other, within their folder or beyond it."""
    draw, out = random.Random(seed), []
    for d in range(folders):
        for f in range(files):
            at = lambda: f"./{draw.randrange(files + 1)}" if d % 3 or draw.random() < 0.6 else f"../{draw.choice((d, (d + 3) % folders))}/{draw.randrange(files)}"  # noqa: B023, E731
            name = lambda: draw.choice("abcde")
            kinds = (lambda: f"export const {name()} = 1;", lambda: f"const {name()} = 1;", lambda: f"export * from '{at()}';", lambda: f"export * as {name()} from '{at()}';", lambda: f"export {{ {name()}, {name()} as {name()} }} from '{at()}';",
                     lambda: f"export {{ {name()} as {name()} }};", lambda: f"import {{ {name()}, {name()} as {name()} }} from '{at()}';", lambda: f"import * as {name()} from '{at()}';", lambda: f"export default {name()};", lambda: f"import {name()} from \"{at()}\";")
            out.append((f"/m/{d}/{f}.ts", "\n".join(draw.choice(kinds)() for _ in range(draw.randrange(1, 7)))))
    return spark.createDataFrame(out, "path string, content string")


def test_names_of_small_groups_come_from_one_pass_and_are_those_of_joins(spark, monkeypatch):
    def names(files, group):
        monkeypatch.setattr(exports, "GROUP", group)
        nodes = cut(sources.typescript(files)[0])
        return resolve_ts.export_names(files, nodes, cut(resolve_ts.import_targets(nodes)))[1]

    statuses = set()
    for seed, group in ((1, 0), (2, 30)):
        files = cut(modules(spark, seed))
        quick, slow = names(files, 10**6), names(files, group)
        # the only join is that of folders with their group
        assert plan(quick).count("SortMergeJoin") <= 1 < plan(slow).count("SortMergeJoin")
        found = sorted(map(tuple, quick.collect()), key=repr)
        assert found == sorted(map(tuple, slow.collect()), key=repr)
        statuses |= {x[2] for x in found}
    assert statuses == {"resolved", "ambiguous", "cycle", "missing"}


def test_groups_are_folders_that_name_each_others_files(spark):
    links = spark.createDataFrame([("/a/1.ts", "/b/1.ts"), ("/c/1.ts", "/b/2.ts"), ("/c/1.ts", "/d/1.ts"), ("/e/1.ts", "/e/2.ts"), ("/e/1.ts", None), ("/g/1.ts", "/f/1.ts")], "path string, resolved string")
    assert {(r.folder, r.group) for r in exports.groups(links).collect()} == {("/a", "/a"), ("/b", "/a"), ("/c", "/a"), ("/d", "/a"), ("/f", "/f"), ("/g", "/f")}
    assert exports.groups(links.where("path LIKE '/e%'")) is None


def test_long_chains_within_a_group():
    rows = [(f"/{k}", "x", f"/{k + 1}", "x", None, None, None) for k in range(1500)] + [("/1500", "x", None, None, "t", "/1500", None), ("/s", "*", None, None, None, None, "/0"), ("/s", "*", None, None, None, None, "/700"), ("/u", "y", "", "y", None, None, None)]
    found = {(p, n): (s, t, at, hops) for p, n, s, t, at, hops in exports.walk(rows)}
    assert found["/0", "x"] == ("resolved", "t", "/1500", 1501) and found["/s", "x"] == ("resolved", "t", "/1500", 802) and found["/u", "y"] == ("missing", None, None, None) and len(found) == 1503


def test_modules_are_lexed_once_and_few_tables_are_written(spark):
    at = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    rows = module_queries.ts_export_relationships(spark, SF)
    written = set(os.listdir(at)) - before
    assert len(written) <= 7 and plan(rows).count("MapInArrow") == 1


def test_lines_with_strings_are_read_as_by_tokens():
    text = "import a, { b } from './x/y'; f(\"(\", '}');\nexport { c } from \"./{z}\";\nexport { d as e\" }\" from './d';\nf }\n"
    assert [(t, c) for t, c, _ in lexer.logical_lines(text)][:2] == [("import a, { b } from './x/y'; f(\"(\", '}');", "import a, { b } from ''; f(\"\", '');"), ('export { c } from "./{z}";', 'export { c } from "";')]
    assert lexer.logical_lines(text)[2][0].endswith("f }")
