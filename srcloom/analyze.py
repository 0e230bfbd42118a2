"""From files to the whole graph: what each file holds, what files have to do with each other, and the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.extract.sources import extract
from srcloom.operators import exports, includes, resolve_ts
from srcloom.operators.dedup import last_wins
from srcloom.operators.lineage import cut
from srcloom.operators.resolve import placeholders
from srcloom.sources.files import load, parser_of
from srcloom.sources.graph_store import GraphStore

#: Columns of relationships, and what some types say besides.
REL = ("entityId", "type", "sourceId", "targetId", "weight")
MORE = {"isPlaceholder": "boolean", "isCrossFile": "boolean", "isConditional": "boolean", "isReExport": "boolean", "includePath": "string", "isSystemInclude": "boolean"}


def _as_rels(rows: DataFrame) -> DataFrame:
    return rows.select(*REL, *(F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in MORE.items()))


def across_files(files: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Component nodes, and relationships across files: imports, names behind them, exports, inheritance, calls,
    mutations, error handling, components and their use, includes.  nodes are read many times: hand in a written table."""
    script = resolve_ts.gate(files)
    own = nodes.where("language IN ('TypeScript', 'TSX')")
    targets = cut(resolve_ts.import_targets(own))
    clauses, names = resolve_ts.export_names(script, own, targets)
    names = cut(names)
    found = cut(resolve_ts.components(script, own))
    parts = [
        resolve_ts.file_imports(targets), resolve_ts.resolved_imports(own, targets, names), exports.export_relationships(clauses, names), resolve_ts.inheritance(own, targets, names),
        resolve_ts.calls(script, own, targets, names), resolve_ts.mutations(script, own, targets), resolve_ts.error_handlers(script, own), resolve_ts.component_uses(script, own, targets, found), includes.includes(nodes),
    ]
    rels = _as_rels(parts[0])
    for p in parts[1:]:
        rels = rels.unionByName(_as_rels(p))
    return found.drop("declarationId"), rels


def analyze(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and relationships of files (path, content), each id once.  Ends of relationships that no node has become
    placeholder nodes, with an id and nothing else."""
    files = cut(files.where("content IS NOT NULL"))
    needed = [r[0] for r in files.select(parser_of(F.col("path"))).distinct().collect() if r[0]]  # one of each language at most
    first, rels = (cut(x) for x in extract(files, needed))
    more, links = across_files(files, first)
    nodes = cut(first.unionByName(more.select(*(c for c in more.columns if c in first.columns)), allowMissingColumns=True))
    rels = cut(last_wins(_as_rels(rels).unionByName(links), ["entityId"], ["type", "weight", "sourceId", "targetId"]))
    nodes = last_wins(nodes, ["entityId"], ["filePath", "startLine", "kind"])
    return nodes.unionByName(placeholders(rels, nodes), allowMissingColumns=True), rels


def analyze_directory(spark: SparkSession, directory: str, store: str, extensions=None, ignore=()) -> DataFrame:
    """Scans a directory, analyzes its files and puts the graph in the store; returns (path, step, message) of what
    couldn't be read.  Doing it again leaves the same graph; files that have gone since stay until they are taken out."""
    files, errors = load(spark, directory, ignore=ignore) if extensions is None else load(spark, directory, tuple(extensions), ignore)
    GraphStore(spark, store).upsert(*analyze(files))
    return errors
