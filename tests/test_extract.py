"""Sources that are empty, broken or odd; the whole extraction; the stream."""

import json
from collections import Counter

from srcloom.extract import lexer, python_source, sources
from srcloom.operators import includes, resolve_ts
from srcloom.streaming.ingest import current, ingest, landing


def of(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def test_empty_and_broken_files(spark):
    files = of(spark, ("/a.go", ""), ("/b.java", "}}} class {"), ("/c.py", "def ("), ("/d.ts", None), ("/e.cs", "/* class A {"))
    nodes, rels = sources.extract(files)
    assert sorted(r.filePath for r in nodes.collect() if r.kind == "File") == ["/a.go", "/b.java", "/c.py", "/e.cs"]
    assert [r for r in nodes.collect() if r.kind.startswith("CSharp")] == []
    assert python_source.syntax(of(spark, ("/c.py", "def ("))).first().kind == "Error"


def test_ids_are_unique_over_languages(spark):
    files = of(spark, ("/a.go", "package p\nfunc f() {\n}\n"), ("/b.go", "package p\nfunc f() {\n}\n"), ("/c.py", "def f(a, a2):\n  return f(a)\n"))
    nodes, rels = sources.extract(files)
    ids = [r.entityId for r in nodes.collect()]
    assert len(ids) == len(set(ids)) and ids.count("gofunction:p.f") == 1
    assert len({r.entityId for r in rels.collect()}) == rels.count()


def test_members_follow_braces(spark):
    java = "class A {\n  void f() {\n    if (x) { y(); }\n    int local = 1;\n  }\n  int after;\n}\nclass B\n{\n  void g()\n  {\n  }\n}\n"
    nodes, _ = sources.java(of(spark, ("/A.java", java)))
    found = {(r.kind, r.name, r.startLine, r.endLine, r.parentId) for r in nodes.collect() if r.kind != "File"}
    assert found == {("JavaClass", "A", 1, 7, None), ("JavaMethod", "f", 2, 5, "javaclass:a"), ("JavaField", "after", 6, 6, "javaclass:a"), ("JavaClass", "B", 8, 13, None), ("JavaMethod", "g", 10, 12, "javaclass:b")}


def test_stream_keeps_the_last_version(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    put = lambda name, *rows: (land / name).write_text("\n".join(json.dumps(r) for r in rows))
    for k, body in enumerate(("package p\nfunc f() {\n}\n", "package p\n\nfunc f() {\n}\nfunc g() {\n}\n")):
        put(f"{k}.json", {"path": "/a.go", "content": body, "version": k})
        ingest(landing(spark, str(land)), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    found = {r.name: r.startLine for r in current(spark, str(tmp_path / "store"), "nodes").collect() if r.kind == "GoFunction"}
    assert found == {"f": 3, "g": 5}


def test_lexer_blanks_strings_and_joins_headers():
    text = "import {\n  a\n} from './x'; // {\nclass K {\n  m(\n    p = `{ ${`n`} // no`,\n  ) {\n    const r = /[/\"{]+/g, q = 4 / 2 / 1; /* {\n } */ f(() => {\n    });\n  }\n}"
    clean = [c for _, c, _ in lexer.logical_lines(text)]
    assert [k for _, _, k in lexer.logical_lines(text)] == [3, 2, 3, 4, 7, 6, 7, 8, 9, 10, 11, 12][: len(clean)]
    assert [" ".join(c.split()) for c in clean] == ["import { a } from '';", "", "", "class K {", "m( p = ``, ) {", "", "", 'const r = "", q = 4 / 2 / 1;', "f(() => {", "});", "}", "}"]
    assert lexer.parameters("m(a: (x: number) => void, {b, c}: P, d = [1, 2])") == ["a: (x: number) => void", "{b, c}: P", "d = [1, 2]"]
    assert lexer.sql_statements("a ';' -- ;\nb; /* ; */ c") == [("a ';' \nb", 0), ("  c", 1)]


def test_very_long_literals_and_lines(spark):
    long = "x" * 3_000_000
    files = of(spark, ("/a.java", f'class A {{\n  String s = "{long}";\n  int b, c;\n}}\n'), ("/b.sql", f"INSERT INTO t VALUES ('{long}');\n" + "INSERT INTO t VALUES ('a;b');\n" * 3000), ("/c.tsx", f"const A = () => (\n  <div title=\"{long}\">\n  </div>\n);\n"))
    nodes, _ = sources.extract(files)
    found = Counter(r.kind for r in nodes.select("kind").collect())
    assert found["JavaField"] == 3 and found["SQLInsertStatement"] == 3001 and found["JSXElement"] == 1


def test_includes_and_default_imports(spark):
    nodes, _ = sources.c_cpp(of(spark, ("/s/a.c", '#include "lib/b.h"\n#include "../no.h"\n#include <stdio.h>\n'), ("/s/lib/b.h", "int b;\n")))
    got = {(r.targetId, r.isPlaceholder) for r in includes.includes(nodes).collect()}
    assert got == {("file:/s/lib/b.h", False), ("file:../no.h", True), ("file:stdio.h", True)}
    nodes, _ = sources.typescript(of(spark, ("/s/a.ts", "import Thing from './b';\n"), ("/s/b.ts", "export default class K {\n}\n")))
    rows = resolve_ts.resolved_imports(nodes, resolve_ts.import_targets(nodes)).collect()
    assert [(r.sourceId, r.targetId) for r in rows] == [("file:/s/a.ts", "class:/s/b.ts:k")]


def test_mutations_of_locals_and_imports(spark):
    a = "import { shared } from './b';\nlet own = 0;\nfunction f(own, x = 1) {\n  own = 2;\n  shared = 3;\n}\nclass K {\n  m() { own = 1; this.own = 2; own => 3; }\n}\n"
    files = of(spark, ("/s/a.ts", a), ("/s/b.ts", "export let shared = 0;\n"))
    nodes, _ = sources.typescript(files)
    got = {(r.sourceId, r.targetId) for r in resolve_ts.mutations(files, nodes, resolve_ts.import_targets(nodes)).collect()}
    assert got == {("function:/s/a.ts:f:3", "variable:/s/b.ts:shared:1"), ("method:/s/a.ts:k.m", "variable:/s/a.ts:own:2")}


def test_store_is_wiped_and_dropped(spark, tmp_path):
    from srcloom.sources import graph_store

    nodes, _ = sources.go(of(spark, ("/a.go", "package p\nfunc f() {\n}\n")))
    path = str(tmp_path / "nodes")
    graph_store.write_nodes(nodes, path)
    columns = set(spark.read.parquet(path).columns)
    graph_store.wipe(spark, path)
    assert spark.read.parquet(path).count() == 0 and set(spark.read.parquet(path).columns) == columns
    graph_store.drop(spark, path, path)
    assert not (tmp_path / "nodes").exists()


def test_lambdas_and_calls_over_several_lines():
    from srcloom.extract.call_spans import Brackets, spans

    text = "const a = [\n  x => x,\n  { f: async (y) => { g(y); } }\n];\nfoo<A, B>(1,\n  function () { return ')'; });\nclass K {\n  m(): void { this.n?.(2); }\n  n = (z) => z;\n  abstract o(p: number): string;\n}\nif (h(3)) i(4); else j(5);\nk ? l(6) : m(7);\n// q(8)\nr(9);\n"
    calls, found = spans(text)
    b = Brackets(text)
    assert [(b.line(s), name, len(args), b.branches(s)) for s, _, name, args in calls] == [(3, "g", 1, False), (5, "foo", 2, False), (8, "this.n", 1, False), (12, "h", 1, True), (12, "i", 1, True), (12, "j", 1, True), (13, "l", 1, True), (13, "m", 1, True), (15, "r", 1, False)]
    assert found == [("a", 1, 4, False, False), ("a", 1, 4, True, False), ("callback_foo_arg1", 6, 6, False, False), ("anonymousLambda", 9, 9, False, False)]
    assert spans("") == ([], []) and spans("((([[[{{{") == ([], []) and spans(")))]]]}}} => f(")[0] == []


def test_spans_of_a_long_file():
    import time

    from srcloom.extract.call_spans import spans

    began = time.time()
    calls, found = spans("f(x => {\n  g(1, 'a');\n});\n" * 20_000)
    assert len(calls) == 40_000 and len(found) == 20_000 and time.time() - began < 20


def test_python_statements_match_the_syntax_tree(spark):
    import ast
    import pathlib

    here = pathlib.Path(__file__).parent.parent
    texts = [(str(p), p.read_text()) for p in sorted(here.glob("srcloom/**/*.py"))]
    odd = "if a: b = 1; c = d = g()\nelse: pass\nx = {\n  'k': (1,\n    2)}\n@deco(1)\nclass K(B()):\n  def m(self, a, /, b: int = f(1), *c, d=2):\n    '''\n  text: (\n'''\n    return lambda q: h(q)\n  y = \\\n    i()\nasync def n(): await j()\nmatch = k(1)\nfrom . import (a as b,\n  c)\nimport os.path as p, sys\n"
    want = set()
    for path, text in [*texts, ("/odd.py", odd)]:
        for node in ast.walk(ast.parse(text)):
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                want.add((path, node.name, node.lineno, node.end_lineno))
    nodes, rels = python_source.python(of(spark, *texts, ("/odd.py", odd)))
    nodes = nodes.collect()
    assert {(r.filePath, r.name, r.startLine, r.endLine) for r in nodes if r.kind in ("PythonFunction", "PythonMethod", "PythonClass")} == want and len(want) > 300
    mine = {(r.kind, r.name, r.startLine, r.parentId) for r in nodes if r.filePath == "/odd.py" and r.kind not in ("File", "PythonFunction", "PythonMethod", "PythonClass")}
    assert mine == {
        ("PythonVariable", "b", 1, "file:/odd.py"), ("PythonVariable", "c", 1, "file:/odd.py"), ("PythonVariable", "d", 1, "file:/odd.py"), ("PythonVariable", "x", 3, "file:/odd.py"), ("PythonVariable", "y", 13, "pythonclass:/odd.py:k"), ("PythonVariable", "match", 16, "file:/odd.py"),
        ("PythonParameter", "b", 8, "pythonmethod:/odd.py:k.m"), ("PythonModule", ".", 17, "file:/odd.py"), ("PythonModule", "os.path", 19, "file:/odd.py"), ("PythonModule", "sys", 19, "file:/odd.py"),
    }
    calls = {(r.sourceId, r.targetId.rpartition(":")[2]) for r in rels.collect() if r.type == "PYTHON_CALLS" and ":/odd.py" in r.sourceId}
    assert calls == {("file:/odd.py", x) for x in ("g", "deco", "b", "i", "k")} | {("pythonmethod:/odd.py:k.m", "f"), ("pythonmethod:/odd.py:k.m", "h"), ("pythonfunction:/odd.py:n", "j")}


def test_broken_python(spark):
    for text in ("def (", "x = '''open", "a = 'b\n", "  x = 1\n y = (]\n", "if a:\n    b\n  c\n"):
        assert [r.kind for r in python_source.syntax(of(spark, ("/c.py", text))).collect()] == ["Error"], text
    long = "x = [\n" + "  f(1),\n" * 30_000 + "]\n" + "a = 'b' + \\\n" * 2 + "''\n"
    assert python_source.syntax(of(spark, ("/l.py", long))).count() == 2
