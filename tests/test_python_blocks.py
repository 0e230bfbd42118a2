"""What a statement of Python belongs to comes from the pass over its file, not from joins."""

from srcloom.extract import python_source

CODE = "@dec(h())\nclass B(k()):\n    @p(q())\n    async def m(self, a=z()):\n        def inner(): w()\n        class C:\n            def deep(self): r()\n    y = 2\nv = u()\n"


def test_calls_and_variables_of_nested_blocks(spark):
    nodes, rels = python_source.python(spark.createDataFrame([("/b.py", CODE)], "path string, content string"))
    for rows in (nodes, rels):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan
    assert {(r["kind"], r["entityId"], r["startLine"], r["endLine"]) for r in nodes.collect() if r["kind"] in ("PythonClass", "PythonMethod", "PythonFunction", "PythonVariable")} == {
        ("PythonClass", "pythonclass:/b.py:b", 2, 8), ("PythonMethod", "pythonmethod:/b.py:b.m", 4, 7), ("PythonMethod", "pythonmethod:/b.py:b.inner", 5, 5), ("PythonClass", "pythonclass:/b.py:c", 6, 7),
        ("PythonMethod", "pythonmethod:/b.py:c.deep", 7, 7), ("PythonVariable", "pythonvariable:/b.py:y:8", 8, 8), ("PythonVariable", "pythonvariable:/b.py:v:9", 9, 9),
    }
    assert {(r["sourceId"].rsplit(":", 1)[1], r["targetId"].rsplit(":", 1)[1]) for r in rels.where("type = 'PYTHON_CALLS'").collect()} == {("/b.py", x) for x in ("dec", "h", "k", "u")} | {("b.m", x) for x in ("p", "q", "z")} | {("b.inner", "w"), ("c.deep", "r")}
