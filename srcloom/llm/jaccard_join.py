"""Near-duplicate documents by a chosen-path join on word 5-grams.

A document's set is the set of hashes of its 5-word shingles (words: lower-cased runs between white
space; of one to four words, one shingle of them all).  Rows with equal sets are one node, known by a
number.  A node's set is sampled by 128 minhashes, the tokens (place, value) that the paths are made of.

Chosen paths.  At a path a node goes on with each of its tokens whose hash with the path is below a
threshold, 1 / threshold of them on average, so that nodes at the wanted similarity share one child of
a shared path on average.  The first step takes ``runs`` places at once, as many as the target recall
needs; each is a run of its own.  Buckets are the nodes at a path of depth 3, the only depth there is:
the recall is that of ``runs_needed``, whatever a bucket's size.  Each path's nodes are counted before any
is moved: a path of two nodes is known by its least and largest number, a small bucket gives all its pairs,
and of a large one all pairs are compared by sketches, in pairs of blocks of about 1024 nodes; a pair of
blocks gives one link per node that keeps what agrees connected.  A sketch is the last byte of each minhash;
pairs that agree too little are put aside (an estimate at 4 standard errors below the threshold), the
others are links between candidates.

Exact step.  Candidates that are connected are cut into blocks of about 512 nodes, fewer where their sets
are large.  Each pair of blocks computes all its exact similarities from the whole sets, counts each node's
links, and returns one link per node that keeps what is connected connected; no pair leaves the task.
Components of those links are the classes.  Work is square only in the number of different near copies in
one class, and is spread over tasks of two blocks each.

Texts are read twice and never shuffled but those of candidates: a bitmap of bounded size keeps the others
back.  Tables between the steps go as soon as the next is written.

Defined results: null, empty and blank texts have no shingles: a class of their own, no links.
Equal sets are links of similarity 1.  class_id is the least doc_id of the class (null where all are
null); repeated rows are rows of one class.  Very long texts are sets like others; a block holds fewer of
them.  An empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm.bytes_kernel import LETTER, NUMBER, OTHER, words_by_row
from srcloom.llm.components import among, connected_components, maybe_in, salted_join
from srcloom.llm.storage import Scratch
from srcloom.llm.tasks import tidy

WORDS, THRESHOLD, RECALL, PLACES, DEPTH, SEED = 5, 0.8, 0.999, 128, 3, 11
SMALL, BLOCK, SKETCH_BLOCK, ERRORS = 16, 512, 1024, 4
#: Shingles in a block of the exact step, on average at most, unless one set alone has more.
BLOCK_SHINGLES = 250_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
FEATURES = "doc_id long, ref long, node binary, size long, sketch binary, paths array<long>"


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x + MIX[0]
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(col) -> Iterator[np.ndarray]:
    """Each row's word hashes, in order of rows."""
    low = pc.utf8_lower(pc.fill_null(col.cast(pa.large_string()), ""))
    return words_by_row(low, (LETTER, NUMBER, OTHER), lambda found: np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found), np.uint64, len(found)))


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """The sorted set of hashes of n-word shingles."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = mix(words[: len(words) - n + 1])
    for k in range(1, n):
        out = mix(out ^ words[k : len(words) - n + 1 + k])
    return np.unique(out)


def node_key(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def sketch(own: np.ndarray) -> np.ndarray:
    """Minhashes of a set: (PLACES,) uint32."""
    odd = (mix(np.arange(PLACES, dtype=np.uint64) + np.uint64(SEED << 32)) | np.uint64(1))[None]
    out = np.full(PLACES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(own), 1024):
        out = np.minimum(out, ((own[k : k + 1024, None] * odd) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return out


def features(docs: DataFrame, runs: int, threshold: float = THRESHOLD) -> DataFrame:
    """Of every row of docs (doc_id, ref, text): doc_id, ref, node (digest of the set; null where it is empty),
    size, sketch and paths."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                node, size, held = [], [], []
                for words in word_hashes(batch.column(2)):
                    own = shingles(words)
                    size.append(len(own))
                    node.append(node_key(own) if len(own) else None)
                    if len(own):
                        held.append(sketch(own))
                tokens = np.array(held, np.uint32).reshape(-1, PLACES)
                paths = iter(paths_of(tokens, runs, threshold))
                low = iter(digests(tokens))
                columns = [pa.array(node, pa.binary()), pa.array(size, pa.int64()), pa.array([next(low) if n else None for n in size], pa.binary()), pa.array([next(paths) if n else None for n in size], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "ref", "node", "size", "sketch", "paths"])

    return docs.select("doc_id", "ref", "text").mapInArrow(tidy(run), FEATURES)


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> int:
    """First steps so that a pair at the threshold shares a bucket with at least this probability: behind
    a shared first step a pair's shared paths are a branching process with one child on average."""
    alive = 1.0
    for _ in range(depth - 1):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold * alive))


def _children(owner: np.ndarray, path: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Next steps of paths: owner and path of each child.  tokens: (nodes, PLACES) sketches."""
    place = np.arange(1, PLACES + 1, dtype=np.uint64) * MIX[0]
    limit = np.uint64(int(2.0**64 / (threshold * PLACES)))
    who, new = [], []
    for k in range(0, len(path), 4096):
        p = path[k : k + 4096]
        row, col = np.nonzero(mix(p[:, None] ^ place[None]) < limit)
        own = owner[k : k + 4096][row]
        who.append(own)
        new.append(mix(p[row] ^ (tokens[own, col].astype(np.uint64) << np.uint64(8)) ^ col.astype(np.uint64) ^ MIX[1]))
    return (np.concatenate(who), np.concatenate(new)) if who else (owner, path)


def digests(tokens: np.ndarray) -> list[bytes]:
    """The last byte of each minhash: what sets are compared by."""
    return [row.tobytes() for row in (tokens & np.uint32(0xFF)).astype(np.uint8)]


def _sketches(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, PLACES)


def paths_of(tokens: np.ndarray, runs: int, threshold: float = THRESHOLD) -> list[np.ndarray]:
    """Each set's different paths of depth DEPTH.  tokens: (sets, PLACES) minhashes."""
    places = np.random.default_rng(SEED).permutation(PLACES)[np.arange(runs) % PLACES]
    out = []
    for k in range(0, len(tokens), 512):
        own = tokens[k : k + 512]
        owner = np.repeat(np.arange(len(own)), runs)
        path = mix(own[:, places].astype(np.uint64) ^ (np.arange(runs, dtype=np.uint64) << np.uint64(40))[None]).reshape(-1)
        for _ in range(DEPTH - 1):
            owner, path = _children(owner, path, own, threshold)
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(len(own) + 1))
        out += [np.unique(path[order[a:b]].view(np.int64)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


def least_agreement(threshold: float = THRESHOLD) -> float:
    """The share of minhashes in which a pair must agree to be compared exactly."""
    return threshold - ERRORS * math.sqrt(threshold * (1 - threshold) / PLACES)


def _forest(near, order: list[int]) -> np.ndarray:
    """Each item's root: breadth first in ``order``; near(todo, unseen) says which unseen ones have a link to todo."""
    root = np.arange(len(order))
    seen = np.zeros(len(order), bool)
    for k in order:
        if seen[k]:
            continue
        seen[k], todo = True, np.array([k])
        while len(todo):
            unseen = np.flatnonzero(~seen)
            todo = unseen[near(todo, unseen)]
            seen[todo], root[todo] = True, k
    return root


def _dealt(members: DataFrame, owner: str) -> DataFrame:
    """Rows of pairs of blocks (owner, low, high), each pair in one task and in one piece."""
    return members.repartition(owner, "low", "high").sortWithinPartitions(owner, "low", "high", "num")


def _by_group(batches, links) -> Iterator[pa.RecordBatch]:
    """links of each run of rows that agree in their first three columns."""
    group, key = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != key:
                if len(group) > 1:
                    yield links(group)
                group, key = [], row[:3]
            group.append(row)
    if len(group) > 1:
        yield links(group)


def sketch_blocks(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(u, v), links that connect what agrees, from rows (path, low, high, num, sketch) of pairs of blocks."""
    least = least_agreement(threshold) * PLACES

    def links(rows: list[tuple]) -> pa.RecordBatch:
        tokens = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, PLACES)

        def near(todo: np.ndarray, unseen: np.ndarray) -> np.ndarray:
            hit = np.zeros(len(unseen), bool)
            for k in todo:
                left = np.flatnonzero(~hit)
                if not len(left):
                    break
                hit[left] = (tokens[unseen[left]] == tokens[k]).sum(axis=1) >= least
            return hit

        root = _forest(near, list(range(len(rows))))
        far = np.flatnonzero(root != np.arange(len(rows)))
        return pa.RecordBatch.from_arrays([pa.array([rows[root[k]][3] for k in far], pa.int64()), pa.array([rows[k][3] for k in far], pa.int64())], ["u", "v"])

    return _dealt(members.select("path", "low", "high", "num", "sketch"), "path").mapInArrow(tidy(lambda batches: _by_group(batches, links)), "u long, v long")


def _paired(rows: DataFrame) -> DataFrame:
    """rows (num, blocks) once for each pair (low, high) of blocks that the node's own block is in."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})


def candidate_links(nodes: DataFrame, threshold: float = THRESHOLD, own: Scratch | None = None) -> DataFrame:
    """(u, v) of nodes (num, sketch, paths) that share a bucket and whose sketches agree enough; of large
    buckets links that connect the same nodes."""
    own = own or Scratch(nodes.sparkSession, "candidates")
    paths = nodes.select("num", F.explode("paths").alias("path"))
    shared = own.put(paths.groupBy("path").agg(F.count("*").alias("n"), F.min("num").alias("u"), F.max("num").alias("v")).where("n > 1"), "shared")
    more = shared.where("n > 2").select("path", "n")
    rows = own.put(salted_join(among(paths, "path", more), more, "path", F.col("num"), salts=4), "buckets")
    small = rows.where(F.col("n") <= SMALL).groupBy("path").agg(F.array_sort(F.collect_list("num")).alias("nums"))
    first = small.select(F.explode(F.expr("transform(nums, (x, i) -> struct(x AS u, slice(nums, i + 2, size(nums)) AS rest))")).alias("f"))
    found = shared.where("n = 2").select("u", "v").unionByName(first.select("f.u", F.explode("f.rest").alias("v"))).distinct()
    pairs = own.put(found, "pairs")
    large = rows.where(F.col("n") > SMALL)
    ends = pairs.select(F.explode(F.array("u", "v")).alias("num")).unionByName(large.select("num"))
    known = own.put(among(nodes.select("num", "sketch"), "num", ends), "sketches")
    members = _paired(large.join(known, "num").withColumn("blocks", F.ceil(F.col("n") / SKETCH_BLOCK).cast("int")).drop("n"))
    hot = sketch_blocks(members, threshold)
    with_u = salted_join(pairs, known.select(F.col("num").alias("u"), F.col("sketch").alias("su")), "u", F.col("v"), salts=2)
    with_both = salted_join(with_u, known.select(F.col("num").alias("v"), F.col("sketch").alias("sv")), "v", F.col("u"), salts=2)
    least = least_agreement(threshold)

    def agree(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                keep = (_sketches(batch.column("su")) == _sketches(batch.column("sv"))).mean(axis=1) >= least
                yield batch.select(["u", "v"]).filter(pa.array(keep))

    links = own.put(with_both.select("u", "v", "su", "sv").mapInArrow(tidy(agree), "u long, v long").unionByName(hot), "links")
    own.drop("shared", "buckets", "pairs", "sketches")
    return links


def _exact_links(sets: list[np.ndarray], side: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of links between sets; of two different sides only where side says so."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(n), size.astype(np.int64))
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.append(True, flat[1:] != flat[:-1])
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1  # a shingle of one set adds to no intersection
    who, col = who[shared], col[shared]
    both = np.zeros((n, n), np.float32)  # whole numbers below 2 ** 24 but for sets of more shingles than that
    if len(size) and size.max() >= 1 << 24:
        both = both.astype(np.float64)
    if len(col):
        col = np.cumsum(np.append(True, col[1:] != col[:-1])) - 1
        for a in range(0, int(col[-1]) + 1, 4096):
            lo, hi = np.searchsorted(col, [a, a + 4096])
            x = np.zeros((n, min(4096, int(col[-1]) + 1 - a)), np.float32)
            x[who[lo:hi], col[lo:hi] - a] = 1
            both += x @ x.T
    union = size[:, None] + size[None] - both
    link = both >= threshold * union - 1e-9
    np.fill_diagonal(link, False)
    return link & side


def exact_blocks(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(num, links, other) from rows (root, low, high, num, block, copies, shingles) of pairs of blocks."""

    def links(rows: list[tuple]) -> pa.RecordBatch:
        low, high = rows[0][1], rows[0][2]
        block = np.array([r[4] for r in rows])
        side = np.ones((len(rows), len(rows)), bool) if low == high else block[:, None] != block[None]
        link = _exact_links([np.frombuffer(r[6], np.uint64) for r in rows], side, threshold)
        copies = np.array([r[5] for r in rows], np.float64)
        root = _forest(lambda todo, unseen: link[np.ix_(todo, unseen)].any(axis=0), sorted(range(len(rows)), key=lambda k: rows[k][3]))
        return pa.RecordBatch.from_arrays([pa.array([r[3] for r in rows], pa.int64()), pa.array((link @ copies).astype(np.int64)), pa.array([rows[k][3] for k in root], pa.int64())], ["num", "links", "other"])

    dealt = _dealt(members.select("root", "low", "high", "num", "block", "copies", "shingles"), "root")
    return dealt.mapInArrow(tidy(lambda batches: _by_group(batches, links)), "num long, links long, other long")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles) of rows (text), shingles as sorted 8-byte hashes."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                sets = [shingles(w) for w in word_hashes(whole.slice(k, 256).column(0))]
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([node_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    return docs.select("text").mapInArrow(tidy(run), "node binary, shingles binary")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links of every row of docs (doc_id, text)."""
    own = Scratch(docs.sparkSession, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("ref", F.coalesce("doc_id", F.xxhash64("text")))
    found = own.put(features(docs, runs_needed(threshold, recall), threshold), "features")
    least = found.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.min("ref").alias("ref"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
    nodes = own.put(least.withColumn("num", F.monotonically_increasing_id()), "nodes")  # numbers hold once written
    rows = own.put(found.select("doc_id", "node"), "rows")
    own.drop("features")
    near = connected_components(candidate_links(nodes, threshold, own), "candidates")
    own.drop("links")
    placed = near.select(F.col("node").alias("num"), "root").join(among(nodes.select("num", "node", "copies", "ref", "size"), "num", near.select("node")), "num")
    sizes = placed.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = own.put(salted_join(placed, sizes, "root", F.col("num")), "placed")
    texts = among(docs, "ref", placed.select("ref")).join(placed.select("ref").distinct(), "ref", "left_semi")
    sets = shingle_sets(texts).groupBy("node").agg(F.first("shingles").alias("shingles"))
    exact = own.put(exact_blocks(_paired(placed.join(sets, "node")), threshold), "exact")
    own.drop("placed")
    links = exact.groupBy("num").agg(F.sum("links").alias("links")).where("links > 0")
    roots = connected_components(exact.where("num <> other").select(F.col("num").alias("u"), F.col("other").alias("v")), "classes").select(F.col("node").alias("num"), "root")
    special = nodes.select("num", "node", "copies", "first_doc").join(roots, "num", "left").join(links, "num", "left").where("copies > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "num"))
    special = own.put(special, "special")
    own.drop("exact", "nodes")
    least = special.groupBy("root").agg(F.min("first_doc").alias("class_id"))
    classes = own.put(salted_join(special, least, "root", F.col("num")).select("node", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    own.drop("special")
    # most rows are alone; of the others a hot node is spread by doc_id
    marked = maybe_in(rows, "node", classes.select("node"))
    alone = marked.where("NOT _maybe").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    met = salted_join(marked.where("_maybe").select("doc_id", "node"), classes, "node", F.col("doc_id"), "left")
    return alone.unionByName(met.select("doc_id", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Rows of docs, all columns, without near duplicates: of each class the row with the least doc_id stays.

    Of rows that share that doc_id one stays; rows whose class has no doc_id all stay, as do null and empty
    texts.  Columns may have any name; only rows that may go are shuffled.
    """
    names = docs.columns
    found = near_duplicates(docs, threshold, recall)
    one = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("doc_id").eqNullSafe(F.col("class_id")).cast("int")).alias("keep"))
    odd = Scratch(docs.sparkSession, "near").put(one.where("keep = 0 OR rows > 1"), "dropped")
    held = maybe_in(docs.select(F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("row")), "id", odd.select("doc_id"))
    free = held.where("NOT _maybe").select("row")
    marked = held.where("_maybe").join(odd, F.col("id") == F.col("doc_id"), "left")
    sole = marked.where("rows IS NULL").select("row")
    repeated = marked.where("keep = 1").groupBy("id").agg(F.first("row").alias("row")).select("row")
    return free.unionByName(sole).unionByName(repeated).select(*(F.col("row")[c].alias(c) for c in names))
