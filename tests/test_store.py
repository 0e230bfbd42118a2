"""The store in buckets, its look-ups, and the stream that keeps it."""

import json

import pytest
from pyspark.sql import functions as F

from srcloom.sources import files, graph_store
from srcloom.sources.graph_store import BucketTable, Conflict, GraphStore
from srcloom.streaming.ingest import current, ingest, landing


def rows(spark, *values):
    return spark.createDataFrame(list(values), "entityId string, name string, filePath string")


def test_changes_write_touched_buckets_only(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), buckets=16)
    assert t.read() is None and t.change(rows(spark)) == {"version": 0, "written": 0, "kept": 0}
    first = t.change(rows(spark, *((f"n{k}", "a", "f") for k in range(200)), (None, "no key", "f")))
    assert first == {"version": 1, "written": 16, "kept": 0} and t.read().count() == 200
    before = t.read()
    second = t.change(rows(spark, ("n1", "b", None), ("new", "c", "g")))
    assert second["version"] == 2 and second["written"] <= 2 and second["written"] + second["kept"] == 16
    got = {r.entityId: (r.name, r.filePath) for r in t.read().collect()}
    assert len(got) == 201 and got["n1"] == ("b", None) and got["new"] == ("c", "g") and got["n2"] == ("a", "f")
    assert {r.name for r in before.collect()} == {"a"}  # the version that a reader began with
    assert t.change(rows(spark, ("n1", None, "h")), merge=True)["written"] == 1
    assert t.lookup(rows(spark, ("n1", None, None))).collect()[0].asDict() == {"entityId": "n1", "name": "b", "filePath": "h"}
    t.change(None, rows(spark, ("n2", None, None), ("never", None, None)))
    assert t.read().count() == 200 and t.read().where("entityId = 'n2'").count() == 0
    assert t.vacuum() > 0 and t.read().count() == 200 and t.vacuum() == 0
    more = t.change(rows(spark, ("n3", "d", "f")).withColumn("loc", F.lit(5)))
    assert more["version"] == 5 and {(r.entityId, r.loc) for r in t.read().where("loc IS NOT NULL").collect()} == {("n3", 5)}
    t.change(None, t.read())
    assert t.read().count() == 0 and t.manifest()["generations"] == {}


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    t = BucketTable(spark, str(tmp_path / "t"), buckets=2)
    t.change(rows(spark, ("a", "1", "f")))
    stale = t.manifest()
    t.change(rows(spark, ("a", "2", "f")))
    monkeypatch.setattr(t, "manifest", lambda: stale)
    with pytest.raises(Conflict):
        t.change(rows(spark, ("a", "3", "f")))
    monkeypatch.undo()
    assert t.read().collect()[0].name == "2"


def scanned(df):
    """Rows that the scan gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName().startswith("Adaptive") else plan
    while plan.children().size():
        plan = plan.children().apply(0)
    return plan.metrics().apply("numOutputRows").value()


def test_look_ups_skip_row_groups(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), sort=("filePath", "name"), bloom=("entityId", "name"), buckets=1, group_bytes=1 << 14)
    n = 60_000
    made = spark.range(n).select(F.concat(F.lit("id"), F.sha2(F.col("id").cast("string"), 256)).alias("entityId"), F.sha2(F.concat(F.lit("x"), "id"), 256).alias("name"), F.format_string("/src/%06d.ts", "id").alias("filePath"))
    t.change(made)
    whole = t.read()
    assert scanned(whole) == n
    assert scanned(whole.where("filePath = '/src/031234.ts'")) < n / 4  # by bounds
    wanted = whole.where("filePath = '/src/031234.ts'").first()
    assert scanned(whole.where(F.col("entityId") == wanted.entityId)) < n / 2  # by bloom filters, as hashes have no order
    assert whole.where(F.col("entityId") == wanted.entityId).count() == 1
    rels = BucketTable(spark, str(tmp_path / "r"), sort=("type", "sourceId"), bloom=("targetId",), buckets=1, group_bytes=1 << 14)
    rels.change(made.select("entityId", F.lit("CALLS").alias("type"), F.col("filePath").alias("sourceId"), F.col("name").alias("targetId")))
    assert scanned(rels.read().where("sourceId = '/src/000007.ts'")) < n / 4 and scanned(rels.read().where(F.col("targetId") == wanted.name)) < n / 2


def test_files_are_replaced_whole(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path / "s"), buckets=4)
    rel = lambda *r: spark.createDataFrame(list(r), "entityId string, type string, sourceId string, targetId string, weight int")
    of = lambda *r: spark.createDataFrame(list(r), "path string, version long")
    s.replace_files(of(("a", 1), ("b", 1)), rows(spark, ("f", "f", "a"), ("g", "g", "a"), ("h", "h", "b"), ("t", "shared", None)), rel(("r1", "CALLS", "f", "g", 1), ("r2", "CALLS", "h", "g", 1), ("r3", "USES", "g", "t", 1)))
    assert {r.entityId for r in s.nodes.read().collect()} == {"f", "g", "h", "t"} and s.rels.read().count() == 3
    # g moves from a to b; f stays
    s.replace_files(of(("a", 2), ("b", 2)), rows(spark, ("f", "f2", "a"), ("g", "g", "b")), rel(("r2", "CALLS", "g", "f", 5)))
    assert {(r.entityId, r.name, r.filePath) for r in s.nodes.read().collect()} == {("f", "f2", "a"), ("g", "g", "b"), ("t", "shared", None)}
    assert {(r.entityId, r.weight) for r in s.rels.read().collect()} == {("r2", 5)}
    # an older version changes nothing, the same one again neither
    s.replace_files(of(("a", 1)), rows(spark, ("old", "old", "a")), rel())
    s.replace_files(of(("b", 2)), rows(spark, ("g", "g", "b")), rel(("r2", "CALLS", "g", "f", 5)))
    assert {r.entityId for r in s.nodes.read().collect()} == {"f", "g", "t"}
    s.replace_files(of(("b", 3)), rows(spark), rel())
    assert {r.entityId for r in s.nodes.read().collect()} == {"f", "t"} and s.rels.read().count() == 0


def test_schema_is_applied_once(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path / "s"), buckets=2)
    assert s.violations().count() == 0
    made = s.apply_schema().collect()
    assert {r.state for r in made} == {"made"} and {(r.table, r.column) for r in made if r.kind == "unique"} == {("nodes", "entityId"), ("rels", "entityId"), ("files", "filePath")}
    assert s.nodes.read().count() == 0 and {r.state for r in s.apply_schema().collect()} == {"kept"}
    s.upsert(rows(spark, ("a", "1", "f")).withColumn("kind", F.lit("Odd")), spark.createDataFrame([("r", "CALLS", "a", "b", 1)], graph_store.RELS))
    assert s.nodes.read().first().name == "1" and [tuple(r) for r in s.violations().collect()] == [("nodes", "Odd", 1)]
    assert {r.state for r in s.apply_schema(force=True).collect()} == {"made"} and s.nodes.read().count() == 0


def test_stream_takes_out_what_a_new_version_lacks(spark, tmp_path):
    land, store = tmp_path / "land", str(tmp_path / "store")
    land.mkdir()

    def arrive(k, *batch):
        (land / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("path", "content", "version"), r, strict=True))) for r in batch))
        ingest(landing(spark, str(land)), store, str(tmp_path / "check")).awaitTermination()
        return {r.name for r in current(spark, store, "nodes").collect() if r.kind == "GoFunction"}, current(spark, store, "rels").count()

    assert arrive(0, ("/a.go", "package p\nfunc f() {\n}\nfunc g() {\n}\n", 1), ("/b.go", "package p\nfunc h() {\n}\n", 1)) == ({"f", "g", "h"}, 5)
    assert arrive(1, ("/a.go", "package p\nfunc f() {\n}\n", 2), ("/a.go", "package p\nfunc z() {\n}\n", 1)) == ({"f", "h"}, 4)
    assert arrive(2, ("/a.go", "package p\nfunc late() {\n}\n", 1)) == ({"f", "h"}, 4)
    assert arrive(3, ("/b.go", None, 2)) == ({"f"}, 2)
    assert len(graph_store.listed(spark, f"{store}/nodes/manifests")) == 1


def test_scan_lists_in_rounds_and_keeps_errors(spark, tmp_path):
    (tmp_path / "a" / "deep" / "_x").mkdir(parents=True)
    (tmp_path / "node_modules").mkdir()
    for name in ("a/deep/_x/.b.ts", "a/c.go", "a/d.txt", "node_modules/e.ts"):
        (tmp_path / name).write_text("// é\n")
    (tmp_path / "a" / "link.ts").symlink_to(tmp_path / "a" / "c.go")
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / "a" / "bad.ts").write_bytes(b"\xff ok")
    found, errors = files.scan_tree(spark, str(tmp_path))
    assert {r.path.removeprefix(f"{tmp_path}/") for r in found.collect()} == {"a/deep/_x/.b.ts", "a/c.go", "a/bad.ts"} and errors.count() == 0
    (tmp_path / "a" / "c.go").unlink()
    texts = {r.name: (r.content, r.error) for r in files.read(found).collect()}
    assert texts[".b.ts"] == ("// é\n", None) and texts["bad.ts"] == ("� ok", None) and texts["c.go"][0] is None and "c.go" in texts["c.go"][1]
    nowhere, errors = files.scan_tree(spark, str(tmp_path / "nothing"))
    assert nowhere.count() == 0 and [r.path for r in errors.collect()] == [str(tmp_path / "nothing")]
    loaded, wrong = files.load(spark, f"file://{tmp_path}")
    assert {r.path for r in loaded.collect()} == {f"file://{tmp_path}/a/deep/_x/.b.ts", f"file://{tmp_path}/a/bad.ts"} and wrong.count() == 0


def test_a_directory_becomes_a_graph_in_the_store(spark, tmp_path):
    from srcloom.analyze import analyze_directory

    src = tmp_path / "src"
    (src / "lib").mkdir(parents=True)
    (src / "a.ts").write_text("export * from './lib/b';\nexport function own() {\n}\n")
    (src / "lib" / "b.ts").write_text("export function deep(n: number) {\n}\n")
    (src / "c.ts").write_text("import { deep } from './a';\nexport function go() {\n  deep(1);\n}\n")
    (src / "lib" / "x.h").write_text("int x;\n")
    (src / "y.cpp").write_text('#include "x.h"\n')
    store = str(tmp_path / "store")
    assert analyze_directory(spark, str(src), store).count() == 0
    s = GraphStore(spark, store)
    at = f"{src}".lower()
    rels = {(r.type, r.sourceId.replace(at, ""), r.targetId.replace(at, "")) for r in s.rels.read().collect()}
    assert {("CALLS", "function:/c.ts:go:2", "function:/lib/b.ts:deep:1"), ("EXPORTS", "file:/a.ts", "file:/lib/b.ts"), ("EXPORTS", "file:/a.ts", "function:/a.ts:own:2"), ("INCLUDES", "file:/y.cpp", "file:/lib/x.h"), ("RESOLVES_IMPORT", "file:/c.ts", "function:/lib/b.ts:deep:1")} <= rels
    nodes = s.nodes.read()
    assert [tuple(r) for r in s.violations().collect()] == []
    assert nodes.where("kind IS NULL").count() == 0 and nodes.count() == nodes.select("entityId").distinct().count()
    before = {tuple(r) for r in s.rels.read().collect()}
    analyze_directory(spark, str(src), store)
    assert {tuple(r) for r in s.rels.read().collect()} == before
