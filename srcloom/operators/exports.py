"""What TypeScript files export, and which declaration each exported or imported name comes to.

A name of a file is a key (path, name).  Each key that the file itself exports has one edge: to a declaration, or
to the key that an export clause or an import names.  Names that ``export *`` hands on get an edge to each key
that they come from.  Folders whose files name each other's are a group: what small groups export is worked out by
tasks that hold whole groups (``walked``), that of large ones by joins: ``follow`` doubles the pointers, so a chain of
n files takes log2(n) of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.extract.lexer import in_batches
from srcloom.extract.lines import code_lines
from srcloom.extract.sources import file_id
from srcloom.functions.identity import dirname, entity_id, relationship_id
from srcloom.operators.lineage import cut, joined
from srcloom.operators.resolve import import_candidates

_LIST = r"^\s*export\s+(?:type\s+)?\{([^}]*)\}"
_STAR = r"^\s*export\s+(?:type\s+)?\*\s*(?:as\s+([\w$]+)\s+)?from\b"
_NAME = r"^\s*export\s*(?:=|default\b)\s*([A-Za-z_$][\w$]*)\s*;?\s*$"
_FROM = r"""\bfrom\s*["']([^"']+)["']\s*;?\s*(?://.*|/\*.*)?$"""
EDGES = ("path", "name", "nextPath", "nextName", "targetId", "targetPath", "hops")
#: Declarations, imports and clauses that a group of folders has at most to be one task's: the keys that stars hand on in it are
#: at most a quarter of the square.
GROUP = 2000
#: Rows of a task that holds whole groups.
TASK = 500_000
#: What is said of names of a file: a declaration, one with ``export``, an import, a clause of the file's own names, one that names a file.
_FACTS = {"role": "int", "key": "string", "rank": "long", "name": "string", "target": "string", "to": "string", "word": "string"}
_DECLARED, _OPEN, _IMPORT, _INSIDE, _ACROSS = range(5)
_EDGE = "path string, name string, nextPath string, nextName string, targetId string, targetPath string, through string"
NAMES = "path string, name string, status string, targetId string, targetPath string, hops long"


def export_clauses(files: DataFrame) -> DataFrame:
    """(path, line, exported, local, specifier) of export lists, re-exports, ``export *`` (exported and local are
    ``*``; local alone with ``as``), and of names that are exported as the default; specifier is null within the file."""
    clean = F.col("clean")
    lines = code_lines(files, "path", "line", "text", "clean", bare=False).where(clean.rlike(r"^\s*export\b"))
    lines = lines.where(F.contains(clean, F.lit("{")) | F.contains(clean, F.lit("*")) | clean.rlike(_NAME))
    star, own = F.contains(clean, F.lit("*")) & clean.rlike(_STAR), F.regexp_extract("clean", _NAME, 1)
    default = ~own.isin("", "function", "class", "async", "abstract", "interface", "null", "true", "false", "undefined", "new")
    items = F.when(star, F.array(F.lit("*"))).when(default, F.array(own)).otherwise(F.split(F.regexp_extract("clean", _LIST, 1), ","))
    specifier = F.when(star | clean.rlike(_LIST), F.nullif(F.regexp_extract("text", _FROM, 1), F.lit("")))
    word = F.when(star, F.nullif(F.regexp_extract("clean", _STAR, 1), F.lit("")))
    rows = lines.select("path", "line", specifier.alias("specifier"), word.alias("word"), star.alias("star"), default.alias("default"), F.explode(items).alias("x")).where(F.col("x").rlike(r"\S"))
    kind = lambda as_star, as_default, as_item: F.when(F.col("star"), as_star).when(F.col("default"), as_default).otherwise(as_item)
    exported = kind(F.coalesce("word", F.lit("*")), F.lit("default"), F.regexp_extract("x", r"([\w$]+)\s*$", 1))
    local = kind(F.lit("*"), F.col("x"), F.regexp_extract("x", r"^\s*(?:type\s++(?=\S)(?!as\s+\S))?+([\w$]+)", 1))
    return rows.select("path", "line", exported.alias("exported"), local.alias("local"), "specifier")


def located(clauses: DataFrame, nodes: DataFrame, extensions) -> DataFrame:
    """clauses with ``resolved``, the file that the specifier names: null within the file and where there is none."""
    files = nodes.where("kind = 'File'").select(F.col("filePath").alias("path"))
    found = import_candidates(clauses.withColumnRenamed("path", "importer"), files, list(extensions))
    return found.select(F.col("importer").alias("path"), *(c for c in clauses.columns if c != "path"), F.when(~F.col("isPlaceholder"), F.col("resolved")).alias("resolved"))


def facts(declarations: DataFrame, clauses: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, ...) of what is said of names of files: declarations (path, name, rank, startLine, targetId, isExported), imports
    (path, alias, original, resolved), and located clauses.  target is a declaration, or the file where a whole module is meant."""
    row = lambda rows, role, rank, **have: rows.select("path", *({"role": role, "rank": rank, **have}.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in _FACTS.items()))
    whole = lambda word: F.when(F.col(word) == "*", file_id(F.col("resolved")))
    declared = row(declarations, F.when(F.col("isExported"), _OPEN).otherwise(_DECLARED), F.col("rank") * F.lit(1 << 32) + F.col("startLine"), key=F.col("name"), target=F.col("targetId"))
    brought = row(imports, F.lit(_IMPORT), F.lit(0), key=F.col("alias"), to=F.col("resolved"), word=F.col("original"), target=whole("original"))
    # a star or a whole module that isn't found has nothing to go on to
    named = clauses.where("specifier IS NULL OR resolved IS NOT NULL OR local <> '*'")
    inside = F.col("specifier").isNull()
    said = row(named, F.when(inside, _INSIDE).otherwise(_ACROSS), F.col("line"), key=F.when(inside, F.col("local")), name=F.col("exported"), to=F.coalesce("resolved", "specifier"), word=F.when(~inside, F.col("local")), target=F.when(~inside, whole("local")))
    return declared.unionByName(brought).unionByName(said)


def own_edges(path: str, rows: Iterable[tuple]) -> Iterator[tuple]:
    """(path, name, nextPath, nextName, targetId, targetPath, through) of the keys that a file exports itself, one for each, and with ``*``
    and ``through`` of the files whose names it hands on, from its facts (role, key, rank, name, target, to, word).

    A declaration with ``export`` comes first, then clauses by line.  What a clause names within its file is the file's own
    declaration, else what it imports under that name; where neither is there, a key that nothing exports.
    """
    declared, opened, imports, clauses, best, stars = {}, {}, defaultdict(list), [], {}, set()

    def offer(name: str, rank: int, edge: tuple) -> None:
        order = rank, edge[2] or edge[0] or ""
        if name not in best or order < best[name][0]:
            best[name] = order, edge

    for role, key, rank, name, target, to, word in rows:
        if role <= _OPEN:
            for known in (declared, opened)[: role + 1]:
                if key not in known or rank < known[key][0]:
                    known[key] = rank, target
        elif role == _IMPORT:
            imports[key].append((None, None, target, to) if word == "*" else (to, word, None, None))
        elif name == "*" and role == _ACROSS:
            stars.add(to)
        elif role == _ACROSS:
            offer(name, rank, (None, None, target, to) if word == "*" else (to, word, None, None))
        else:
            clauses.append((key, rank, name))
    for key, (_, target) in opened.items():
        offer(key, 0, (None, None, target, path))
    for key, rank, name in clauses:
        for edge in ((None, None, declared[key][1], path),) if key in declared else imports.get(key, (("", key, None, None),)):
            offer(name, rank, edge)
    for name, (_, edge) in best.items():
        yield path, name, *edge, None
    for to in stars - {path}:
        yield path, "*", None, None, None, None, to


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return (row for batch in batches for row in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns), strict=True))


def _edges(rows: Iterable[tuple]) -> Iterator[tuple]:
    return (edge for path, own in groupby(rows, lambda row: row[0]) for edge in own_edges(path, (row[1:] for row in own)))


def edges_of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``own_edges`` of facts (path, ...) that are sorted by path."""
    return in_batches(_edges(_rows(batches)), [(c.split()[0], pa.string()) for c in _EDGE.split(", ")])


def star_edges(own: DataFrame, stars: DataFrame) -> DataFrame:
    """Edges of the names that ``export *`` hands on, to the keys that they come from, one for each; stars: (path, through).

    A file's own names hide those of the same name behind it, and the default isn't handed on.  Each round goes one file
    further; files that hand on each other's names end it, as nothing new comes.
    """
    keys = own.select("path", "name")
    found, frontier = None, keys.where("name <> 'default'").withColumn("origin", F.col("path"))
    while True:
        step = joined(joined(stars, frontier.withColumnRenamed("path", "through"), "through").select("path", "name", "origin").distinct(), keys, ["path", "name"], "left_anti")
        frontier = cut(step if found is None else joined(step, found, ["path", "name", "origin"], "left_anti"))
        if found is not None and frontier.isEmpty():
            break
        found = frontier if found is None else cut(found.unionByName(frontier))
    none = F.lit(None).cast("string")
    return found.select("path", "name", F.col("origin").alias("nextPath"), F.col("name").alias("nextName"), none.alias("targetId"), none.alias("targetPath"), F.lit(1).cast("long").alias("hops"))


def follow(edges: DataFrame) -> DataFrame:
    """(path, name, status, targetId, targetPath, hops) of all keys with edges.

    status: ``resolved``; ``ambiguous`` where edges end at several declarations; ``cycle`` where they never end;
    ``missing`` where they end at a key that nothing exports.  Each round joins the pointers with themselves and so
    doubles how far they reach; a round that ends none for the first time leaves cycles only, as on a chain that is longer still
    some key would have ended.
    """
    # keys that nothing exports end there, at an empty target
    keys = edges.select(F.col("path").alias("nextPath"), F.col("name").alias("nextName")).distinct()
    none = F.lit(None).cast("string")
    gone = edges.where("targetId IS NULL").select("nextPath", "nextName").distinct()
    gone = joined(gone, keys, ["nextPath", "nextName"], "left_anti")
    gone = gone.select(F.col("nextPath").alias("path"), F.col("nextName").alias("name"), none.alias("nextPath"), none.alias("nextName"), F.lit("").alias("targetId"), none.alias("targetPath"), F.lit(0).cast("long").alias("hops"))
    rows = cut(edges.select(*EDGES).unionByName(gone))
    done = rows.where("targetId IS NOT NULL").count()
    while True:
        ahead = rows.select(F.col("path").alias("nextPath"), F.col("name").alias("nextName"), F.col("nextPath").alias("p"), F.col("nextName").alias("n"), F.col("targetId").alias("t"), F.col("targetPath").alias("tp"), F.col("hops").alias("h"))
        on = joined(rows.where("targetId IS NULL"), ahead, ["nextPath", "nextName"]).select("path", "name", F.col("p").alias("nextPath"), F.col("n").alias("nextName"), F.col("t").alias("targetId"), F.col("tp").alias("targetPath"), (F.col("hops") + F.col("h")).alias("hops"))
        every = rows.where("targetId IS NOT NULL").unionByName(on)
        rows = cut(every.groupBy("path", "name", "nextPath", "nextName", "targetId").agg(F.min("targetPath").alias("targetPath"), F.min("hops").alias("hops")))
        now = rows.where("targetId IS NOT NULL").count()
        if now == done or rows.where("targetId IS NULL").isEmpty():
            break
        done = now
    real = F.col("targetId") != ""
    ends = rows.groupBy("path", "name").agg(F.count_distinct(F.when(real, F.col("targetId"))).alias("n"), F.min(F.when(real, F.struct("targetId", "targetPath", "hops"))).alias("end"), F.bool_or(F.col("targetId").isNull()).alias("open"))
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").when(F.col("open"), "cycle").otherwise("missing")
    one = status == "resolved"
    return joined(ends, edges.select("path", "name").distinct(), ["path", "name"], "left_semi").select("path", "name", status.alias("status"), *(F.when(one, F.col(f"end.{c}")).alias(c) for c in ("targetId", "targetPath", "hops")))


def walk(rows: Iterable[tuple]) -> Iterator[tuple]:
    """What ``follow`` says of the keys of a group, from its edges (path, name, nextPath, nextName, targetId, targetPath, through)."""
    own, behind = {}, defaultdict(list)
    for path, name, next_path, next_name, target, there, through in rows:
        if through is None:
            own[path, name] = (target, there), (next_path, next_name)
        else:
            behind[through].append(path)
    # names go from file to file against the stars, as far as a file's own don't hide them
    ahead = {key: [to] if target is None else [] for key, ((target, _), to) in own.items()}
    todo = [(path, name, path) for path, name in own if path in behind and name != "default"]
    seen = set()
    for at, name, origin in todo:
        for path in behind.get(at, ()):
            if (path, name) not in own and (path, name, origin) not in seen:
                seen.add((path, name, origin))
                todo.append((path, name, origin))
                ahead.setdefault((path, name), []).append((origin, name))
    back, ends, found = defaultdict(list), defaultdict(list), {}
    for key, nexts in ahead.items():
        for to in nexts:
            back[to].append(key)
        if not nexts:
            ends[own[key][0]].append(key)
    # from each declaration back, one edge further each time
    for (target, there), level in ends.items():
        reached, hops = set(level), 1
        while level:
            for key in level:
                known = found.setdefault(key, {})
                path, least = known.get(target, (there, hops))
                known[target] = min(path, there), min(least, hops)
            level = [key for key in dict.fromkeys(k for at in level for k in back.get(at, ())) if key not in reached]
            reached.update(level)
            hops += 1
    endless = ()
    if len(found) < len(ahead):  # what is left when ends, and what has no way on but to them, are taken away
        endless, ways = set(ahead), {key: len(nexts) for key, nexts in ahead.items()}
        over = [key for key, n in ways.items() if not n] + [key for key in back if key not in ahead]
        for key in over:
            endless.discard(key)
            for before in back.get(key, ()):
                ways[before] -= 1
                if not ways[before]:
                    over.append(before)
    for key in ahead:
        if len(known := found.get(key, ())) == 1:
            ((target, (path, hops)),) = known.items()
            yield *key, "resolved", target, path, hops
        else:
            yield *key, "ambiguous" if known else "cycle" if key in endless else "missing", None, None, None


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``walk`` over facts (group, path, ...) that are sorted by group and path."""
    found = (name for _, own in groupby(_rows(batches), lambda row: row[0]) for name in walk(_edges(row[1:] for row in own)))
    return in_batches(found, [("path", pa.string()), ("name", pa.string()), ("status", pa.string()), ("targetId", pa.string()), ("targetPath", pa.string()), ("hops", pa.int64())])


def groups(links: DataFrame) -> DataFrame | None:
    """(folder, group) of the folders that links (path, resolved) go from or to across folders: the least folder that any way
    along such links leads to; None where there are none.  Every other folder is a group of its own.

    Folders point to the least that they are linked with, larger ones and smaller ones in turn, until nothing changes.
    """
    pairs = links.select(dirname(F.col("path")).alias("a"), dirname(F.col("resolved")).alias("b")).where("a <> b")
    now = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = lambda: tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    was = state()
    if not was[0]:
        return None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"))
        now = cut(joined(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        moved = joined(now, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(moved.where("u <> v").distinct())
        if (then := state()) == was:
            break
        was = then
    return now.select(F.col("u").alias("folder"), F.col("v").alias("group")).unionByName(now.select(F.col("v").alias("folder"), F.col("v").alias("group")).distinct())


def exported_names(declarations: DataFrame, clauses: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, name, status, targetId, targetPath, hops) of all names that files export, their own and handed-on ones."""
    rows = facts(declarations, clauses, imports).withColumn("group", dirname(F.col("path")))
    labels = groups(clauses.select("path", "resolved").unionByName(imports.select("path", "resolved")))
    if labels is not None:
        rows = joined(rows.withColumnRenamed("group", "folder"), labels, "folder", "left").withColumn("group", F.coalesce("group", "folder")).drop("folder")
    sizes = cut(rows.groupBy("group").agg(F.count("*").alias("n")))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    small, large = rows, None
    if (most or 0) > GROUP:
        large = sizes.where(F.col("n") > GROUP).select("group")
        small, large = joined(rows, large, "group", "left_anti"), joined(rows, large, "group", "left_semi")
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // TASK))
    names = small.repartition(tasks, "group").sortWithinPartitions("group", "path").select("group", "path", *_FACTS).mapInArrow(walked, NAMES)
    if large is None:
        return names
    edges = cut(large.repartition(tasks, "path").sortWithinPartitions("path").select("path", *_FACTS).mapInArrow(edges_of_files, _EDGE).withColumn("hops", F.lit(1).cast("long")))
    own = edges.where("through IS NULL").select(*EDGES)
    return names.unionByName(follow(own.unionByName(star_edges(own, edges.where("through IS NOT NULL").select("path", "through")))))


def export_relationships(clauses: DataFrame, names: DataFrame) -> DataFrame:
    """EXPORTS of export clauses: to the file of a re-export (weight 4), to the declarations that lists and defaults
    within a file come to (8); nothing where file or declaration isn't found."""
    source = file_id(F.col("path"))
    again = clauses.where("specifier IS NOT NULL AND resolved IS NOT NULL").select(source.alias("sourceId"), file_id(F.col("resolved")).alias("targetId")).distinct()
    known = names.where("status = 'resolved'").select("path", F.col("name").alias("exported"), "targetId")
    local = clauses.where("specifier IS NULL").select("path", "exported").distinct()
    local = joined(local, known, ["path", "exported"]).select(source.alias("sourceId"), "targetId", (F.col("exported") == "default").alias("default")).distinct()
    rel = lambda rows, rid, weight, again: rows.select(rid.alias("entityId"), F.lit("EXPORTS").alias("type"), "sourceId", "targetId", F.lit(weight).alias("weight"), F.lit(again).alias("isReExport"))
    plain = relationship_id("EXPORTS", F.col("sourceId"), F.col("targetId"))
    tail = lambda word: entity_id("exports", F.concat_ws(":", "sourceId", "targetId", F.lit(word)))
    return rel(again, tail("reexport"), 4, True).unionByName(rel(local, F.when(F.col("default"), tail("default")).otherwise(plain), 8, False))
