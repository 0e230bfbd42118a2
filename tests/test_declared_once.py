"""What the extractors do for each line: rules tried once, one sort by path, nothing for lines of brackets."""

from pyspark.sql import functions as F

from srcloom.extract import lexer, rules
from srcloom.extract.lines import code_lines, declarations
from srcloom.functions.identity import entity_id, link_id, relationship_id
from srcloom.operators.spans import innermost, outermost, within

CODE = "/* import java.util.Fake;\nimport java.util.Worse; */\npackage a.b;\npublic class A\n{\n  int n = 1;\n  void f() { g(); }\n  class In {\n    int x;\n  }\n  int y;\n}\n"


def plan_of(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_declarations_are_sorted_once_and_rules_tried_once(spark):
    files = spark.createDataFrame([("/A.java", CODE)], "path string, content string")
    found = declarations(files, rules.JAVA, 2)
    plan = plan_of(found)
    assert plan.count("Window [") == 1
    assert plan.count(rules.JAVA[0].pattern) == 2  # fits, and its name
    rows = {(r["kind"], r["name"]): (r["line"], r["endLine"], r["ownerName"]) for r in found.collect()}
    assert rows[("JavaClass", "A")] == (4, 12, None) and rows[("JavaField", "n")] == (6, 6, "A") and rows[("JavaMethod", "f")] == (7, 7, "A")
    assert rows[("JavaClass", "In")] == (8, 10, "A") and rows[("JavaField", "x")] == (9, 9, "In") and rows[("JavaField", "y")] == (11, 11, "A")
    assert not [k for k in rows if k[0] == "ImportDeclaration"]  # comments hide them


def test_lines_of_brackets_stay_in_the_lexer(spark):
    files = spark.createDataFrame([("/A.java", CODE)], "path string, content string")
    assert sorted(r["line"] for r in code_lines(files, "line", "clean", bare=False).collect()) == [3, 4, 6, 7, 8, 9, 11]
    assert code_lines(files, "line").count() == 13


def test_plain_lines_are_read_as_by_tokens(monkeypatch):
    text = 'a(b, (c)) {\r\n} else {\nimport {\n  x } from "y";\nvar (\n  q\n)\nf(\n  1)\n}\n\n// end'
    quick = lexer.logical_lines(text)
    monkeypatch.setattr(lexer, "PLAIN", lexer.re.compile(r"(?!)"))
    assert lexer.logical_lines(text) == quick


def test_blocks_are_matched():
    assert lexer.blocks(["class A", "{", "f() {", "}", "g() { }", "}"]) == ([0, 0, 1, 2, 1, 1], [0, 0, 0, 3, 0, 0], [6, 6, 4, None, 5, None], [None] * 6)


def test_ids_of_ids(spark):
    names = ["a b", "Ä\\ß", "x😀y", "", "/s/A.java:m$1", "unknown"]
    rows = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    a, b = entity_id("K", F.col("a")), entity_id("l", F.col("b"))
    got = rows.select(link_id("T_X", a, b).alias("x"), relationship_id("T_X", a, b).alias("y"), a.alias("z")).collect()
    assert all(r["x"] == r["y"] for r in got)
    assert {r["z"] for r in got} == {"k:a_b", "k:_/_", "k:x__y", "k:unknown", "k:/s/a.java:m_1"}


def test_within_outer_spans(spark):
    spans = outermost(spark.createDataFrame([("p", "a", 1, 5), ("p", "b", 2, 3), ("p", "c", 5, 9), ("p", "d", 12, 12), ("q", "e", 2, 4)], "path string, name string, a int, z int"))
    points = spark.createDataFrame([(p, k) for p in "pqr" for k in range(14)], "path string, line int")
    rows = sorted(tuple(r) for r in within(points, spans).select("path", "line", "name").collect())
    # the line that two share is the later one's, and so is what follows
    assert rows == [*(("p", k, "a") for k in range(1, 5)), *(("p", k, "c") for k in range(5, 10)), ("p", 12, "d"), *(("q", k, "e") for k in range(2, 5))]
    assert plan_of(within(points, spans)).count("Window [") < plan_of(innermost(points, spans)).count("Window [")
