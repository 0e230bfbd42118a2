"""Benchmark decontamination: BM25 over an inverted index of test items, pruned by block maxima.

Test items are the indexed documents, training passages the queries.  A passage is a window of twice
as many words as the longest item has, each window half a window after the last, so that every run of
words as long as an item lies in one window whole.  A term's impact on an item is its BM25 weight over
the item's score with itself, so one threshold, a share of that score, serves all items.

Items stand in blocks in the index; each term has its largest impact in each block and overall.  Passages
go through it by block-max WAND (``ItemIndex.search``): from pivot to pivot, opening only blocks whose terms'
block maxima reach the threshold; in these each item is scored from the postings.  Nothing at or above the
threshold is lost by that.

An item that is retrieved is verified: of its question (all sentences but the last; of one sentence,
the first three quarters) and of its answer (the rest), at least ``overlap`` of the words, counted with
repetition, must stand in one stretch of the passage no longer than 1.25 times the item.

The index is sent to the executors.  Its size is checked: the benchmark is dealt into shards of at
most ``shard_chars`` characters on average, each an index of its own with the statistics of the whole, and
the documents are read once for each shard; a usual benchmark is one shard.

Defined results: null and empty texts and items match nothing; words are lower-cased runs of letters
and digits; of windows that match one item the best is returned (higher overlap, then earlier); equal
items each match; repeated rows each match; an empty benchmark or table gives no rows; extra columns
aren't read, and pass through ``decontaminated`` unchanged.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm.bytes_kernel import LETTER, NUMBER, ragged, words_by_row
from srcloom.llm.tasks import tidy

K1, B, SHARE, OVERLAP, BLOCK, SHARD_CHARS = 1.2, 0.75, 0.5, 0.8, 16, 4_000_000
#: Words that are scored at once.
BATCH_WORDS = 1 << 18
MATCHES = "doc_id long, item_id long, start long, score double, question_overlap double, answer_overlap double"


def item_words(text: str | None) -> tuple[list[bytes], int]:
    """Words of an item, and how many of them are the question's."""
    text = (text or "").strip()
    split = lambda t: [w for row in words_by_row(pa.array([t.lower()], pa.large_string()), (LETTER, NUMBER), lambda x: np.array(x, object)) for w in row]
    words = split(text)
    cut = max((m.end() for m in re.finditer(r"[.!?]\s+|\n", text)), default=0)
    question = len(split(text[:cut])) if cut else 0
    if not 0 < question < len(words):
        question = len(words) - max(1, len(words) // 4) if len(words) > 1 else len(words)
    return words, question


class ItemIndex:
    """Postings of items, cut in cells of one term and one block of items, with the largest impact of each cell.

    statistics: items, mean length, longest length and each word's number of items in the whole benchmark; without
    it, of these items.  All of it is as large as the items' text, whatever the number of terms and blocks.
    """

    def __init__(self, items: list[tuple[int, str]], block: int = BLOCK, statistics: tuple[int, float, int, dict[bytes, int]] | None = None):
        rows = [(i, *item_words(t)) for i, t in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))]
        rows = [r for r in rows if r[1]]
        self.ids = [r[0] for r in rows]
        if statistics is None:
            statistics = len(rows), sum(len(r[1]) for r in rows) / max(len(rows), 1), max((len(r[1]) for r in rows), default=0), Counter(w for r in rows for w in set(r[1]))
        n, mean, self.longest, df = statistics
        self.term: dict[bytes, int] = {}
        self.words = [np.array([self.term.setdefault(w, len(self.term)) for w in r[1]], np.int64) for r in rows]
        self.question = [r[2] for r in rows]
        rare = np.array([math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in self.term], np.float64)
        terms, places, impacts = [], [], []
        for k, w in enumerate(self.words):
            t, f = np.unique(w, return_counts=True)
            weight = rare[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean))
            terms.append(t), places.append(np.full(len(t), k)), impacts.append(weight / weight.sum())
        term, item, impact = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((terms, np.int64), (places, np.int64), (impacts, np.float64)))
        order = np.lexsort((item, term))
        self.block, self.blocks = block, -(-len(rows) // block)
        self.item, self.impact = item[order], impact[order]
        key = term[order] * max(self.blocks, 1) + self.item // block
        self.start = np.flatnonzero(np.diff(key, prepend=-1))  # of each cell in item and impact
        self.length = np.diff(np.append(self.start, len(key)))
        self.cell = key[self.start]
        self.cell_most = np.maximum.reduceat(self.impact, self.start) if len(key) else np.zeros(0)
        self.list_start = np.searchsorted(self.cell, np.arange(len(self.term) + 1) * max(self.blocks, 1))
        self.most = np.maximum.reduceat(self.cell_most, self.list_start[:-1]) if len(key) else np.zeros(0)

    def lookup(self, found: list[bytes]) -> np.ndarray:
        get = self.term.get
        return np.fromiter((get(w, -1) for w in found), np.int64, len(found))

    def search(self, passages: list[np.ndarray], share: float = SHARE) -> Iterator[tuple[int, int, float]]:
        """(passage, item, score) of all items at or above the threshold.

        Block-max WAND for many passages at a time.  In each step a passage's lists stand in the order of their
        next blocks; its pivot is the first block at which the largest impacts of the lists up to there reach the
        threshold, so that no item before it can.  Where the cells' maxima in the pivot block reach it too, the
        block's items are scored.  The lists then move behind the pivot; a passage without a pivot is done.
        """
        if not passages or not self.ids:
            return
        who = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
        flat = np.concatenate(passages)
        known = flat >= 0
        pairs = np.unique(who[known] * len(self.term) + flat[known])
        every, least = pairs // len(self.term), share - 1e-6
        begin = np.flatnonzero(np.diff(every, prepend=-1))
        bounds = np.append(begin[:: self.PASSAGES], len(every))
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield from self._walk(every[a:z], pairs[a:z] % len(self.term), least)

    #: Passages that go through the index together.
    PASSAGES = 1024

    def _walk(self, who: np.ndarray, term: np.ndarray, least: float) -> Iterator[tuple[int, int, float]]:
        most, at, blocks = self.most[term], self.list_start[term], self.blocks
        end, base = self.list_start[term + 1], term * blocks
        next_ = self.cell[at] - base
        while len(who):
            order = np.argsort(who * blocks + next_, kind="stable")
            who, most, at, end, base, next_ = (x[order] for x in (who, most, at, end, base, next_))
            first = np.flatnonzero(np.diff(who, prepend=-1))
            size = np.diff(np.append(first, len(who)))
            run = np.cumsum(most)
            short = np.add.reduceat(run - np.repeat(run[first] - most[first], size) < least, first, dtype=np.int64)
            live = short < size
            pivot = np.where(live, next_[first + np.minimum(short, size - 1)], -1)
            seg = np.repeat(np.arange(len(first)), size)
            near = np.flatnonzero(next_ <= pivot[seg])
            own = seg[near]
            cell = np.searchsorted(self.cell, base[near] + pivot[own])
            hit = cell < end[near]
            hit[hit] = self.cell[cell[hit]] == (base[near] + pivot[own])[hit]
            open_ = np.bincount(own[hit], self.cell_most[cell[hit]], len(first)) >= least
            take = hit & open_[own]
            if take.any():
                rank = np.cumsum(open_) - 1
                c, q = cell[take], rank[own[take]]
                post = ragged(self.start[c], self.length[c])
                score = np.bincount(np.repeat(q, self.length[c]) * self.block + self.item[post] % self.block, self.impact[post], int(open_.sum()) * self.block)
                which = np.flatnonzero(open_)
                for x in np.flatnonzero(score >= least).tolist():
                    k = which[x // self.block]
                    yield int(who[first[k]]), int(pivot[k]) * self.block + x % self.block, float(score[x])
            at[near] = cell + hit
            stay = live[seg] & (at < end)
            who, most, at, end, base = (x[stay] for x in (who, most, at, end, base))
            next_ = self.cell[at] - base

    def verify(self, passage: np.ndarray, k: int) -> tuple[float, float]:
        """Overlaps of question and answer in the stretch where the lesser of them is largest."""
        q = self.question[k]
        need = [Counter(self.words[k][:q].tolist()), Counter(self.words[k][q:].tolist())]
        total = [max(1, sum(x.values())) for x in need]
        width = math.ceil(1.25 * len(self.words[k]))
        have, got, best = Counter(), [0, 0], (-1.0, 0.0, 0.0)
        own = passage.tolist()
        for i, t in enumerate(own):
            for side in (0, 1):
                got[side] += have[t] < need[side][t]
            have[t] += 1
            if i >= width:
                old = own[i - width]
                have[old] -= 1
                for side in (0, 1):
                    got[side] -= have[old] < need[side][old]
            over = [g / n if x else 1.0 for g, n, x in zip(got, total, need, strict=True)]
            best = max(best, (min(over), *over))
        return best[1], best[2]


def windows(words: np.ndarray, stride: int) -> Iterator[tuple[int, np.ndarray]]:
    """Windows of two strides; together they hold each run of up to ``stride`` words whole."""
    k = 0
    while k == 0 or len(words) - k > stride:
        yield k, words[k : k + 2 * stride]
        k += stride


def find_items(index: ItemIndex, texts, share: float, overlap: float) -> Iterator[list[tuple]]:
    """For each row of a text column its verified items: (item, start, score, question, answer overlap)."""
    passages: list[np.ndarray] = []
    place: list[tuple[int, int]] = []
    size = rows = 0

    def found() -> Iterator[list[tuple]]:
        best: dict[int, dict[int, tuple]] = {}
        for p, k, score in index.search(passages, share):
            row, start = place[p]
            q, a = index.verify(passages[p], k)
            if min(q, a) >= overlap - 1e-9:
                old = best.setdefault(row, {}).get(k)
                new = (q + a, -start, score, q, a)
                best[row][k] = new if old is None else max(old, new)
        for row in range(first, rows):
            yield [(index.ids[k], -x[1], x[2], x[3], x[4]) for k, x in sorted(best.get(row, {}).items())]

    first = 0
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    for words in words_by_row(low, (LETTER, NUMBER), index.lookup):
        if len(words):
            for start, own in windows(words, max(index.longest, 1)):
                passages.append(own)
                place.append((rows, start))
                size += len(own)
        rows += 1
        if size >= BATCH_WORDS:
            yield from found()
            passages, place, size, first = [], [], 0, rows
    yield from found()


def benchmark_statistics(items: DataFrame) -> tuple[tuple[int, float, int], DataFrame]:
    """(items with words, their mean and longest length) and a table (shard, word, df) of each shard's words, where
    df counts items of the whole benchmark."""

    def words(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [item_words(t)[0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array([len(r) for r in rows], pa.int64()), pa.array([sorted(set(r)) for r in rows], pa.list_(pa.binary()))], ["shard", "n", "words"])

    found = items.select("shard", "text").mapInArrow(tidy(words), "shard long, n long, words array<binary>").where("n > 0")
    n, mean, longest = found.agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(0.0)), F.coalesce(F.max("n"), F.lit(0))).first()
    by_shard = found.select("shard", F.explode("words").alias("word")).groupBy("shard", "word").count()
    return (n, mean, longest), by_shard.join(by_shard.groupBy("word").agg(F.sum("count").alias("df")), "word").select("shard", "word", "df")


def item_indexes(benchmark: DataFrame, shard_chars: int = SHARD_CHARS) -> Iterator[ItemIndex]:
    """An index for each shard of (item_id, text); all have the statistics of the whole benchmark, so an item's
    scores don't depend on the shards."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_chars))
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).alias("shard"))
    sizes, df = benchmark_statistics(rows)
    for s in range(shards):
        own = {bytes(r["word"]): r["df"] for r in df.where(F.col("shard") == s).collect()}
        yield ItemIndex([(r["item_id"], r["text"]) for r in rows.where(F.col("shard") == s).collect()], statistics=(*sizes, own))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, overlap: float = OVERLAP, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """A row for each document and item found in it."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def scan(index: ItemIndex) -> DataFrame:
        sent = spark.sparkContext.broadcast(index)

        def run(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(d, *x) for d, items in zip(batch.column(0).to_pylist(), find_items(sent.value, batch.column(1), share, overlap), strict=True) for x in items]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in MATCHES.split(", ")])

        return rows.mapInArrow(tidy(run), MATCHES)

    parts = [scan(index) for index in item_indexes(benchmark, shard_chars)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, overlap: float = OVERLAP, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Rows of docs, all columns, in which no item is found; no shuffle."""
    spark = docs.sparkSession
    for index in item_indexes(benchmark, shard_chars):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not items for items in find_items(sent.value, batch.column("text"), share, overlap)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
