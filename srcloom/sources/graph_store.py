"""The graph as Parquet: plain tables by kind or type, and tables in buckets that are changed in place.

A ``BucketTable`` deals rows by a hash of their key over a fixed number of buckets.  A change reads and writes the
buckets that hold its keys, as files of a new generation; a manifest names the generation of each bucket, and the
change counts from the moment the next manifest is there.  Manifests are created, never overwritten, so of two
writers that started from one version the later fails and can try again; readers keep the version that they began with
until ``vacuum`` deletes what no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from srcloom.operators import checks
from srcloom.operators.lineage import cut
from srcloom.operators.upsert import merge_rels, replace_nodes

BUCKETS = 64
#: The columns that a store begins with; changes may bring more.
NODES = "entityId string, kind string, name string, filePath string, startLine int, endLine int, loc int, language string, parentId string, extra string"
RELS = "entityId string, type string, sourceId string, targetId string, weight int"
FILES = "filePath string, version long, nodeIds array<string>, relIds array<string>"


def write_nodes(nodes: DataFrame, path: str) -> None:
    """Partitioned by kind; sorted in files, so that readers skip row groups by filePath and name."""
    nodes.sortWithinPartitions("kind", "filePath", "name").write.mode("overwrite").partitionBy("kind").parquet(path)


def write_rels(rels: DataFrame, path: str) -> None:
    """Partitioned by type; sorted in files, so that readers skip row groups by sourceId."""
    rels.sortWithinPartitions("type", "sourceId", "targetId").write.mode("overwrite").partitionBy("type").parquet(path)


def wipe(spark: SparkSession, path: str) -> None:
    """Leaves an empty table of the columns that the one at ``path`` has."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables whole; one that isn't there is no error."""
    for path in paths:
        store, at = _hadoop(spark, path)
        store.delete(at, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    store, at = _hadoop(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else []


class Conflict(RuntimeError):
    """Another writer has made the next version."""


class BucketTable:
    """A table with a key, in buckets.  sort: what the rows of a file are sorted by, for row groups that readers skip by
    their bounds; bloom: columns that also get Parquet's bloom filters, for look-ups by single values."""

    def __init__(self, spark: SparkSession, path: str, key: str = "entityId", sort: tuple[str, ...] = (), bloom: tuple[str, ...] = (), buckets: int = BUCKETS, group_bytes: int = 8 << 20):
        self.spark, self.path, self.key, self.sort, self.bloom, self.buckets, self.group_bytes = spark, path.rstrip("/"), key, sort, bloom, buckets, group_bytes

    def bucket(self, key: Column | None = None) -> Column:
        """The bucket of a key: the first 32 bits of its MD5."""
        return (F.conv(F.substring(F.md5(F.col(self.key) if key is None else key), 1, 8), 16, 10).cast("long") % self.buckets).cast("int")

    def manifest(self) -> dict:
        """The newest version: its number, each bucket's generation, and the schema."""
        names = [int(n.removesuffix(".json")) for n in listed(self.spark, f"{self.path}/manifests") if n.endswith(".json")]
        if not names:
            return {"version": 0, "buckets": self.buckets, "generations": {}, "schema": None}
        found = json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.path}/manifests/{max(names)}.json", 1).first()[1])
        self.buckets = found["buckets"]
        return found

    def _commit(self, version: int, generations: dict, schema: StructType) -> None:
        store, at = _hadoop(self.spark, f"{self.path}/manifests/{version}.json")
        try:
            out = store.create(at, False)
        except Exception as e:
            raise Conflict(f"version {version} of {self.path} is there already") from e
        try:
            out.write(bytearray(json.dumps({"version": version, "buckets": self.buckets, "generations": generations, "schema": schema.json()}).encode()))
        finally:
            out.close()

    def read(self, only: Iterable[int] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """The rows of all buckets, or of some; None before the first write."""
        m = manifest or self.manifest()
        if m["schema"] is None:
            return None
        schema = StructType.fromJson(json.loads(m["schema"]))
        keep = m["generations"] if only is None else {str(b): m["generations"][str(b)] for b in only if str(b) in m["generations"]}
        if not keep:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/data/generation={g}/bucket={b}" for b, g in sorted(keep.items())]
        return self.spark.read.schema(schema).parquet(*paths)

    def lookup(self, keys: DataFrame, column: str | None = None) -> DataFrame | None:
        """The rows whose key is in ``column`` of ``keys``; only their buckets are read."""
        column = column or self.key
        asked = keys.select(F.col(column).alias(self.key)).where(F.col(self.key).isNotNull()).distinct()
        m = self.manifest()
        touched = [r[0] for r in asked.select(self.bucket().alias("b")).distinct().collect()]  # as many as there are buckets at most
        rows = self.read(touched, m)
        return None if rows is None else rows.join(asked, self.key, "left_semi")

    def change(self, put: DataFrame | None = None, gone: DataFrame | None = None, merge: bool = False) -> dict:
        """Puts rows in and takes the keys of ``gone`` out, as the next version.  A row whose key is there replaces it,
        or with ``merge`` fills it up: its columns win unless they are null.  Returns the version, and how many buckets
        were written and how many stayed.  Doing the same change again leaves the same rows."""
        m = self.manifest()
        keys = [x.select(self.key) for x in (put, gone) if x is not None]
        every = keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1])
        touched = sorted(r[0] for r in every.where(F.col(self.key).isNotNull()).select(self.bucket().alias("b")).distinct().collect())
        if not touched:
            return {"version": m["version"], "written": 0, "kept": len(m["generations"])}
        rows = self.read(touched, m)
        if rows is not None and gone is not None:
            rows = rows.join(gone.select(self.key).distinct(), self.key, "left_anti")
        if rows is None:
            rows = put if put is not None else None
        elif put is not None and merge:
            old, new = set(rows.columns), set(put.columns)
            more = lambda x, other, names: x.withColumns({c: F.lit(None).cast(other.schema[c].dataType) for c in names})
            rows = merge_rels(more(rows, put, new - old), more(put, rows, old - new), self.key)
        elif put is not None:
            rows = replace_nodes(rows, put, self.key)
        if rows is None:
            return {"version": m["version"], "written": 0, "kept": 0}
        rows = rows.where(F.col(self.key).isNotNull())
        generation, order = uuid.uuid4().hex, [c for c in self.sort if c in rows.columns]
        dealt = rows.withColumn("bucket", self.bucket()).repartition(len(touched), "bucket").sortWithinPartitions("bucket", *order)
        writer = dealt.write.partitionBy("bucket").option("parquet.block.size", self.group_bytes)
        for c in self.bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(f"{self.path}/data/generation={generation}")
        written = {n.removeprefix("bucket=") for n in listed(self.spark, f"{self.path}/data/generation={generation}") if n.startswith("bucket=")}
        # a bucket whose last row has gone has no files
        generations = {b: g for b, g in m["generations"].items() if int(b) not in set(touched)} | {b: generation for b in written}
        self._commit(m["version"] + 1, generations, rows.schema)
        return {"version": m["version"] + 1, "written": len(touched), "kept": len(generations) - len(written)}

    def vacuum(self) -> int:
        """Deletes older manifests and the files that the newest doesn't name; returns how many folders went.  Readers and
        writers of older versions must have ended."""
        m, went = self.manifest(), 0
        used = {(g, b) for b, g in m["generations"].items()}
        for generation in listed(self.spark, f"{self.path}/data"):
            own = [n.removeprefix("bucket=") for n in listed(self.spark, f"{self.path}/data/{generation}") if n.startswith("bucket=")]
            stale = [b for b in own if (generation.removeprefix("generation="), b) not in used]
            went += len(stale)
            drop(self.spark, *([f"{self.path}/data/{generation}"] if len(stale) == len(own) else [f"{self.path}/data/{generation}/bucket={b}" for b in stale]))
        drop(self.spark, *(f"{self.path}/manifests/{n}" for n in listed(self.spark, f"{self.path}/manifests") if n != f"{m['version']}.json"))
        return went


class GraphStore:
    """Nodes and relationships in buckets by id, and for each file the ids that it declares."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.nodes = BucketTable(spark, f"{self.path}/nodes", "entityId", ("kind", "filePath", "name"), ("entityId", "filePath", "name"), buckets)
        self.rels = BucketTable(spark, f"{self.path}/rels", "entityId", ("type", "sourceId", "targetId"), ("entityId", "sourceId", "targetId"), buckets)
        self.files = BucketTable(spark, f"{self.path}/files", "filePath", ("filePath",), ("filePath",), buckets)

    def apply_schema(self, force: bool = False) -> DataFrame:
        """Makes the tables with their columns, empty, where they aren't there; with ``force`` drops all first.  Returns
        (table, name, column, kind, state) of what the store holds to: unique keys, sorted and bloom-filtered columns;
        state is ``made`` or ``kept``.  Raises what a table's making raises, and then no table has changed but dropped ones."""
        if force:
            drop(self.spark, self.path)
        rows = []
        for name, t, schema in (("nodes", self.nodes, NODES), ("rels", self.rels, RELS), ("files", self.files, FILES)):
            state = "kept" if t.manifest()["schema"] else "made"
            if state == "made":
                t._commit(1, {}, self.spark.createDataFrame([], schema).schema)
            rows += [(name, f"{name}_{c}_{kind}".lower(), c, kind, state) for kind, columns in (("unique", (t.key,)), ("sorted", t.sort), ("bloom", t.bloom)) for c in columns]
        return self.spark.createDataFrame(rows, "table string, name string, column string, kind string, state string")

    def violations(self) -> DataFrame:
        """(table, key, rows) of keys that a table holds more than once, and of nodes of unknown kinds and relationships of
        unknown types by their first id; a sound store has none."""
        out = None
        for name, t, check, column in (("nodes", self.nodes, checks.unknown_labels, "kind"), ("rels", self.rels, checks.unknown_types, "type"), ("files", self.files, None, None)):
            rows = t.read()
            if rows is None:
                continue
            own = rows.groupBy(F.col(t.key).alias("key")).agg(F.count("*").alias("rows")).where("rows > 1")
            if check:
                own = own.unionByName(check(rows).where(f"{column} IS NOT NULL").select(F.col(column).alias("key"), "rows"))
            own = own.select(F.lit(name).alias("table"), "key", "rows")
            out = own if out is None else out.unionByName(own)
        return out if out is not None else self.spark.createDataFrame([], "table string, key string, rows long")

    def upsert(self, nodes: DataFrame, rels: DataFrame) -> tuple[dict, dict]:
        """Nodes replace those of their ids, relationships fill theirs up."""
        return self.nodes.change(cut(nodes)), self.rels.change(cut(rels), merge=True)

    def replace_files(self, files: DataFrame, nodes: DataFrame, rels: DataFrame) -> None:
        """Makes the store hold, of ``files`` (path, version), just what ``nodes`` and ``rels`` say.

        What a file declared before and doesn't any more goes, unless another file declares it now; so does all of a file
        that ``nodes`` doesn't hold.  Nodes of no file are shared and stay.  Files whose stored version is higher are left as
        they are.  Doing it again changes nothing, so a batch that failed between two tables can be replayed.
        """
        seen = self.files.lookup(files, "path")
        if seen is not None:
            newer = seen.select(F.col("filePath").alias("path"), F.col("version").alias("_stored"))
            files = files.join(newer, "path", "left").where("_stored IS NULL OR version >= _stored").drop("_stored")
        files = cut(files.select("path", "version"))
        here = files.select(F.col("path").alias("filePath"))
        nodes = cut(nodes.join(here, "filePath", "left_semi").unionByName(nodes.where("filePath IS NULL")))
        rels = cut(rels)
        by_node = nodes.where("filePath IS NOT NULL").select(F.col("entityId").alias("sourceId"), "filePath")
        owned = rels.join(by_node, "sourceId")
        rels = rels.join(by_node.select("sourceId"), "sourceId", "left_semi").select(*rels.columns)
        ids = by_node.groupBy("filePath").agg(F.collect_set("sourceId").alias("nodeIds"))
        links = owned.groupBy("filePath").agg(F.collect_set("entityId").alias("relIds"))
        none = F.array().cast("array<string>")
        rows = cut(files.withColumnRenamed("path", "filePath").join(ids, "filePath", "left").join(links, "filePath", "left").select("filePath", "version", F.coalesce("nodeIds", none).alias("nodeIds"), F.coalesce("relIds", none).alias("relIds")))
        gone_nodes = gone_rels = None
        if seen is not None:
            old = seen.join(here, "filePath", "left_semi")
            left = old.select("filePath", F.explode("nodeIds").alias("entityId")).join(nodes.select("entityId"), "entityId", "left_anti")
            stored = self.nodes.lookup(left)
            # an id that has moved to another file is that file's
            gone_nodes = cut(left.join(stored.select("entityId", "filePath"), ["entityId", "filePath"], "left_semi").select("entityId")) if stored is not None else None
            gone_rels = cut(old.select(F.explode("relIds").alias("entityId")).join(rels.select("entityId"), "entityId", "left_anti"))
        self.nodes.change(nodes, gone_nodes)
        self.rels.change(rels, gone_rels, merge=True)
        self.files.change(rows)

    def vacuum(self) -> int:
        return sum(t.vacuum() for t in (self.nodes, self.rels, self.files))
