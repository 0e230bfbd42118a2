"""Hard negatives by inner products, with an orthogonal PCA rotation that lets most pairs go early.

Vectors are made whole numbers (``quantised``).  The rotation holds the eigenvectors of the second moments of all
rows, largest first, so the first components of rotated vectors carry most of each product.  Rows and anchors
are dealt in blocks of bounded size, by hashes of what they hold; a task gets one block of each, so no side is
broadcast, and work is rows x anchors whatever the labels.  Within a pair of blocks products are accumulated over
the components, ``STEPS`` at a time; after each step what the rest can add is at most the product of the residual
norms, plus a slack for rounding, and a pair goes as soon as it can't reach what its anchor needs:

- for positives, the fifth best product of the block that is known so far;
- for negatives, the range that the anchor's positives leave.

What stays is multiplied as whole numbers, which alone decides.  Pairs are looked at as a matrix for a slice of
anchors while many are left and one by one afterwards.  Each block returns its best; a window ranks them.

Defined results: rows with a null vec_id, label or vector, with a null, infinite or not-a-number component, or
whose squared length is 2^62 or more, take no part; shorter vectors are filled up with zeros; equal rows (vec_id,
label and whole numbers) count once, other rows of one vec_id all take part, with ties by the hash of what they
hold; anchors without positives, and positives without negatives in range, give no rows; an empty table gives
none; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcloom.llm.storage import Scratch
from srcloom.llm.tasks import release, tidy

ANCHOR_EVERY, POSITIVES, NEGATIVES, LEAST, MOST = 100, 5, 5, 80, 100
#: Most rows and anchors of a block, fewest rows of one, anchors that are compared at once, pairs that are multiplied at once.
ROWS, ANCHORS, FEWEST, SLICE, PAIRS = 16384, 8192, 64, 256, 1 << 15
#: Parts of the components after which pairs go, and the share of pairs up to which they are looked at one by one.
STEPS, SPARSE = 4, 1 / 16
FOUND = "anchor_id long, anchor_key long, limit_id long, limit_key long, limit_score long, id long, key long, score long"


def quantised(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, v (array<long>) and key (a hash of the row) of the rows that take part, each once."""
    x = F.col(vector)
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = embeddings.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * 256)).alias("v"))
    rows = rows.where(F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double")) < float(1 << 62)).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return rows.distinct().withColumn("key", F.xxhash64("vec_id", "label", "v"))


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """Vectors of one length or several as rows of d numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()] if len(column) else np.zeros(0, np.int64)
    if (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.arange(d)[None] < sizes[:, None]] = flat
    return out


def rotation(rows: DataFrame) -> np.ndarray:
    """Eigenvectors of the second moments of all rows as columns, that with the most first.  Tasks add up their own
    rows; what the driver gets is one number for each two components."""
    d = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = _matrix(batch.column(0), d).astype(float)
            total += x.T @ x
        cells = np.flatnonzero(np.triu(np.ones((d, d), bool)))
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells])], ["cell", "value"])

    total = np.zeros(d * d)
    for r in rows.select("v").mapInArrow(tidy(moments), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        total[r["cell"]] = r["value"]
    total = total.reshape(d, d)
    total += np.triu(total, 1).T
    scale = np.abs(total).max() or 1.0
    return np.linalg.eigh(total / scale)[1][:, ::-1].copy()


class Side:
    """A block's vectors as whole numbers and rotated, with the norms of what each step leaves."""

    def __init__(self, v: np.ndarray, turn: np.ndarray, ends: list[int]):
        self.v = v
        turned = v.astype(float) @ turn
        squares = np.cumsum((turned * turned)[:, ::-1], axis=1)[:, ::-1]
        self.norm = np.sqrt(squares[:, 0])
        self.rest = [np.sqrt(squares[:, e]) if e < v.shape[1] else np.zeros(len(v)) for e in ends]
        self.turned = turned.astype(np.float32)


def products(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whole-number products of pairs."""
    return np.concatenate([np.einsum("ij,ij->i", a.v[i[k : k + PAIRS]], b.v[j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS)]) if len(i) else np.zeros(0, np.int64)


def survivors(a: Side, b: Side, lo: int, ends: list[int], allowed: np.ndarray, least, most) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor's place, row's place) of a slice of anchors from ``lo`` on that may have a product from least to
    most.  allowed: which pairs count.  least(bounds): what each anchor needs at least, from lower bounds of all
    its products after the first step; most: or None, what it takes at most."""
    sub = slice(lo, lo + SLICE)
    # float32 products of d terms are off by less than (d + 8) units in the last place of the norms' product
    slack = (b.v.shape[1] + 8) * 2.0**-23
    total = a.turned[sub, : ends[0]] @ b.turned[:, : ends[0]].T
    spread = np.outer(a.rest[0][sub] * (1 + slack), b.rest[0]) + slack * np.outer(a.norm[sub], b.norm) + 1e-6
    floor = least(np.where(allowed, total - spread, -np.inf))
    keep = allowed & (total + spread >= floor[:, None])
    if most is not None:
        keep &= total - spread <= most[:, None]
    for k in range(1, len(ends)):
        cut = slice(ends[k - 1], ends[k])
        if keep.mean() > SPARSE:
            total += a.turned[sub, cut] @ b.turned[:, cut].T
            spread = np.outer(a.rest[k][sub] * (1 + slack), b.rest[k]) + slack * np.outer(a.norm[sub], b.norm) + 1e-6
            keep &= total + spread >= floor[:, None]
            if most is not None:
                keep &= total - spread <= most[:, None]
        else:
            i, j = np.nonzero(keep)
            return _one_by_one(a, b, lo, ends, k, i, j, total[i, j], floor, most, slack)
    i, j = np.nonzero(keep)
    return i + lo, j


def _one_by_one(a, b, lo, ends, k, i, j, total, floor, most, slack):
    """The steps from k on for single pairs."""
    for k in range(k, len(ends)):
        cut = slice(ends[k - 1], ends[k])
        total = total + np.concatenate([np.einsum("ij,ij->i", a.turned[i[p : p + PAIRS] + lo, cut], b.turned[j[p : p + PAIRS], cut]) for p in range(0, len(i), PAIRS)]) if len(i) else total
        spread = a.rest[k][i + lo] * (1 + slack) * b.rest[k][j] + slack * a.norm[i + lo] * b.norm[j] + 1e-6
        keep = total + spread >= floor[i]
        if most is not None:
            keep &= total - spread <= most[i]
        i, j, total = i[keep], j[keep], total[keep]
    return i + lo, j


def best(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's first k by score, then id and key."""
    order = np.lexsort((keys, ids, -scores, groups))
    g = groups[order]
    first = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
    rank = np.arange(len(g)) - np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
    return order[rank < k]


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def compare(turn: np.ndarray, ends: list[int], negatives: bool, count: int, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """The first ``count`` rows of a block for each anchor of a block (positives) or for each of its positives."""
    d, out = len(turn), []
    if anchors.num_rows and rows.num_rows:
        a, b = Side(_matrix(anchors.column("v"), d), turn, ends), Side(_matrix(rows.column("v"), d), turn, ends)
        label, ids, keys = _column(rows, "label"), _column(rows, "vec_id"), _column(rows, "key")
        own_label, own_id, own_key = _column(anchors, "label"), _column(anchors, "vec_id"), _column(anchors, "key")
        if negatives:
            limits = anchors.column("limits").combine_chunks()
            at = limits.offsets.to_numpy()
            flat = limits.values
            whose = np.repeat(np.arange(len(own_id)), np.diff(at))
            lim = {x: flat.field(x).to_numpy(zero_copy_only=False)[at[0] : at[-1]] for x in ("id", "key", "score")}
            low, high = np.full(len(own_id), np.inf), np.full(len(own_id), -np.inf)
            np.minimum.at(low, whose, lim["score"] * (LEAST / 100))
            np.maximum.at(high, whose, lim["score"] * (MOST / 100))
            low, high = low - 1 - np.abs(low) * 1e-12, high + 1 + np.abs(high) * 1e-12  # room for rounding
        for lo in range(0, len(own_id), SLICE):
            same = own_label[lo : lo + SLICE, None] == label[None]
            if negatives:
                i, j = survivors(a, b, lo, ends, ~same, lambda _, lo=lo: low[lo : lo + SLICE], high[lo : lo + SLICE])
                score = products(a, b, i, j)
                # to each of the anchor's positives; pairs stand by anchor
                first, last = np.searchsorted(whose, i), np.searchsorted(whose, i, "right")
                for k in range(int((last - first).max(initial=0))):
                    p = np.where(first + k < last, first + k, 0)
                    fit = (first + k < last) & (_fits(score, lim["score"][p]) if len(p) else False)
                    own, at_row, s, p = i[fit], j[fit], score[fit], p[fit]
                    pick = best(p, s, ids[at_row], keys[at_row], count)
                    out.append((own_id[own[pick]], own_key[own[pick]], lim["id"][p[pick]], lim["key"][p[pick]], lim["score"][p[pick]], ids[at_row[pick]], keys[at_row[pick]], s[pick]))
            else:
                allowed = same & ~((own_id[lo : lo + SLICE, None] == ids[None]) & (own_key[lo : lo + SLICE, None] == keys[None]))

                def kth(bounds):
                    n = bounds.shape[1]
                    return np.partition(bounds, n - count, axis=1)[:, n - count] if n > count else np.full(len(bounds), -np.inf)

                i, j = survivors(a, b, lo, ends, allowed, kth, None)
                score = products(a, b, i, j)
                pick = best(i, score, ids[j], keys[j], count)
                none = np.zeros(len(pick), np.int64)
                out.append((own_id[i[pick]], own_key[i[pick]], none, none, none, ids[j[pick]], keys[j[pick]], score[pick]))
    names = [x.split()[0] for x in FOUND.split(", ")]
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names)


def _fits(score: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """LEAST * positive <= 100 * score <= MOST * positive, without leaving 64 bits."""
    ask = lambda share: (positive // 100) * share + ((positive % 100) * share + 99) // 100  # noqa: E731  rounded up
    most = (positive // 100) * MOST + ((positive % 100) * MOST) // 100
    return (score >= ask(LEAST)) & (score <= most)


def _compared(anchors: DataFrame, rows: DataFrame, turn: np.ndarray, negatives: bool, count: int, a_blocks: int, r_blocks: int) -> DataFrame:
    """What ``compare`` finds in all pairs of blocks."""
    d = len(turn)
    ends = sorted({max(1, d * k // STEPS) for k in range(1, STEPS + 1)})

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return compare(turn, ends, negatives, count, left, right)
        finally:
            release()

    block = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = anchors.withColumn("a", block(a_blocks, 1)).withColumn("r", every(r_blocks))
    # under aliases, as both sides may come from one table
    right = rows.select(*(F.col(c).alias(c) for c in rows.columns), block(r_blocks, 2).alias("r")).withColumn("a", every(a_blocks))
    return left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInArrow(run, FOUND)


def mine(embeddings: DataFrame, anchor_every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (rows whose vec_id is
    divisible by ``anchor_every``) and each of its first positives the first negatives within the range."""
    spark = embeddings.sparkSession
    own = Scratch(spark, "negatives")
    rows = own.put(quantised(embeddings), "rows")
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    n, m = rows.count(), anchors.count()
    turn = rotation(rows)
    # blocks of bounded size, and enough of them for all cores
    cores = spark.sparkContext.defaultParallelism
    r_blocks, a_blocks = max(1, -(-n // ROWS), min(n // FEWEST, 4 * cores)), max(1, -(-m // ANCHORS))
    found = _compared(anchors, rows, turn, False, positives, a_blocks, r_blocks)
    first = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("score"), "id", "key")
    found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives)
    limits = found.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_key").alias("key")).agg(F.collect_list(F.struct("id", "key", "score")).alias("limits"))
    limits = own.put(anchors.join(limits, ["vec_id", "key"]), "limits")
    found = _compared(limits, rows, turn, True, negatives, a_blocks, r_blocks)
    nearest = Window.partitionBy("anchor_id", "anchor_key", "limit_id", "limit_key").orderBy(F.desc("score"), "id", "key")
    found = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= negatives)
    out = own.put(found.select("anchor_id", F.col("limit_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("limit_score").alias("positive_score"), F.col("score").alias("negative_score")), "found")
    own.drop("rows", "limits")
    return out


#: The same in SQL, but for repeated rows and vectors of several lengths.
SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
