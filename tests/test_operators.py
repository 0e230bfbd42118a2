"""Rules that hold for any rows."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from srcloom.functions import identity as I
from srcloom.operators import checks, dedup, graph, resolve, upsert
from srcloom.schema import LABELS, TYPES
from srcloom.sources import files


def test_identity_rules(spark):
    names = ["C:\\a\\Foo.ts:B-x y", "p-[3px]", "Ünïx", "\U0001f600", "", None, "a/b_c"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(I.entity_id("File", F.col("n"))).collect()]
    assert got == ["file:c:/a/foo.ts:b-x_y", "file:p-_3px_", "file:_n_x", "file:__", "file:unknown", "file:unknown", "file:a/b_c"]
    again = [r[0] for r in df.select(I.sanitize(I.sanitize(F.col("n")))).collect()]
    assert again == [r[0] for r in df.select(I.sanitize(F.col("n"))).collect()]


@pytest.mark.parametrize(("path", "folded"), [("/a/b/../c", "/a/c"), ("/a/./b", "/a/b"), ("/../a", "/a"), ("a/b/../../c", "c")])
def test_fold_dots(spark, path, folded):
    assert spark.range(1).select(I.fold_dots(F.lit(path))).first()[0] == folded


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5)), max_size=12))
def test_dedup_keeps_one_row_of_each_key(spark, pairs):
    rows = [(k, v, i) for i, (k, v) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "k int, v int, ord int")
    last = {r.k: (r.v, r.ord) for r in dedup.last_wins(df, ["k"], ["ord"]).collect()}
    first = {r.k: (r.v, r.ord) for r in dedup.first_wins(df, ["k"], ["ord"]).collect()}
    assert last == {k: (v, i) for k, v, i in rows}
    assert first == {k: (v, i) for k, v, i in reversed(rows)}


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "entityId string, x int")
    new = spark.createDataFrame([("b", 3), ("c", None)], "entityId string, x int")
    once = upsert.replace_nodes(old, new)
    assert {tuple(r) for r in once.collect()} == {("a", 1), ("b", 3), ("c", None)} == {tuple(r) for r in upsert.replace_nodes(once, new).collect()}
    merged = upsert.merge_rels(old, new)
    assert {tuple(r) for r in merged.collect()} == {("a", 1), ("b", 3), ("c", None)} == {tuple(r) for r in upsert.merge_rels(merged, new).collect()}


def test_placeholders_leave_no_end_dangling(spark):
    nodes = spark.createDataFrame([("a",)], "entityId string")
    rels = spark.createDataFrame([("r", "a", "b"), ("s", "c", "a")], "entityId string, sourceId string, targetId string")
    assert checks.dangling_ends(rels, nodes).count() == 2
    assert checks.dangling_ends(rels, resolve.with_placeholders(nodes, rels)).count() == 0


def test_reach_and_cycles(spark):
    random.seed(3)
    edges = {(random.randrange(12), random.randrange(12)) for _ in range(30)}
    df = spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in edges], "sourceId string, targetId string")
    seen, frontier = {0: 0}, {0}
    for k in range(1, 4):
        frontier = {b for a, b in edges if a in frontier} - set(seen)
        seen |= {b: k for b in frontier}
    got = {r.entityId: r.depth for r in graph.reach(df, spark.createDataFrame([("n00",)], "entityId string"), 3).collect()}
    assert got == {f"n{k:02}": d for k, d in seen.items()}
    want = {(a, b, c) for a, b in edges for b2, c in edges if b == b2 and (c, a) in edges and a < b and a < c and len({a, b, c}) == 3}
    assert {tuple(int(x[1:]) for x in r) for r in graph.cycles(df, 3).collect()} == want


def test_registries():
    assert len(LABELS) == len(set(LABELS)) == 56
    assert len(TYPES) == len(set(TYPES)) == 36


def test_scan(spark, tmp_path):
    for name in ("a.ts", "__init__.py", "_b.ts", "node_modules/x/e.js", "src/c.spec.ts", "src/D.JAVA", "n.txt", ".DS_Store"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"// {name}\n")
    found = files.scan(spark, str(tmp_path), ignore=("**/_b.ts",))
    assert sorted(r.path.removeprefix(str(tmp_path)) for r in found.collect()) == ["/__init__.py", "/a.ts", "/src/D.JAVA"]
    assert {r.content for r in files.read(found).collect()} == {"// __init__.py\n", "// a.ts\n", "// src/D.JAVA\n"}
    assert files.scan(spark, str(tmp_path / "nothing")).count() == 0
