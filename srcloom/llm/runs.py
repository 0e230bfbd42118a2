"""Periodic runs of words, found in the Lyndon arrays of a text's words in both orders.

The method (Ellert and Fischer).  A run is a stretch of smallest period q and at least 2 * q words that can't be
extended; in one of the two orders of words, some place i in its first q words has its next smaller suffix at
i + q.  ``lyndon_edges`` goes through the places from left to right with a stack of suffixes that still wait for
a smaller one, and knows for every pair that it compares how far both agree:

- after a popped suffix, the next one on the stack agrees with it as far as was found when it was pushed, which
  decides the comparison unless both extents are equal; then it goes on from there;
- inside the stretch that was last found equal to an earlier one (from ``start`` up to ``reach``), the earlier
  pair's extent is taken over, as long as it ends before ``reach``; otherwise it goes on from ``reach``.

So no word to the right is read twice for its place, and the time is linear.  Words are only compared; there is
neither a suffix array nor a hash.  ``runs_of`` extends the edges that agree in a word at least to the left,
each stretch of a period once.

Defined results: null, empty and white texts have no words, no runs and an empty collapsed text; repeated rows
have equal results; texts of any length are read whole, one at a time in a task; an empty table gives no rows;
other columns aren't read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm.tasks import tidy

#: A run has so many words at least.
SHORTEST = 12
#: Bytes of collapsed texts in a batch.
BATCH = 1 << 24
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"


def lyndon_edges(words: list, up: bool = True) -> Iterator[tuple[int, int, int]]:
    """(i, j, how many words from i and j on are equal) of each place i whose next smaller suffix is at j, where
    that is one word at least; by rising j.  up: whether smaller words come first; the end of the text comes before all
    words either way."""
    n = len(words)
    # previous smaller suffixes and how far they agree; next smaller ones, likewise
    before, before_equal, after, after_equal = [-1] * n, [0] * n, [n] * n, [0] * n
    start = reach = shift = 0
    for j in range(1, n):
        x, i, equal = words[j], j - 1, 0
        while True:
            y = words[i]
            if equal:  # the suffix above on the stack agreed so far with j, and ``known`` far with i
                if known < equal:
                    before[j], before_equal[j] = i, known
                    break
                own = equal
                searching = known == equal
            elif y == x:
                own, searching = 0, True
            elif (y < x) is up:
                before[j] = i
                break
            else:
                after[i] = j
                i = before[i]
                if i < 0:
                    break
                continue
            if searching:
                if j < reach and i >= start:
                    a, b = i - shift, j - shift
                    own = after_equal[a] if after[a] == b else before_equal[b]
                    searching = j + own >= reach
                    own = min(own, reach - j)
                if searching:
                    while j + own < n and words[i + own] == words[j + own]:
                        own += 1
                    if j + own >= reach:
                        start, reach, shift = j, j + own, j - i
            if j + own < n and (words[i + own] < words[j + own]) is up:
                before[j], before_equal[j] = i, own
                break
            after[i], after_equal[i] = j, own
            if own:
                yield i, j, own
            equal, known = own, before_equal[i]
            i = before[i]
            if i < 0:
                break


def runs_of(words: list, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``shortest`` words or more, by start and period."""
    out = []
    for up in (True, False):
        done = [0] * (len(words) + 1)  # for each period the end of the last stretch
        for i, j, right in lyndon_edges(words, up):
            period = j - i
            if i < done[period]:
                continue
            done[period] = i + right
            left = i
            while left and words[left - 1] == words[left - 1 + period]:
                left -= 1
            length = j + right - left
            if length >= max(shortest, 2 * period):
                out.append((left, length, period))
    out.sort()
    return [r for k, r in enumerate(out) if not k or r != out[k - 1]]


def kept(words: list, runs: list[tuple[int, int, int]]) -> list:
    """Words that no run holds after its first period."""
    out, at = [], 0
    for a, z in sorted((s + p, s + n) for s, n, p in runs):
        out += words[at:a] if a > at else []
        at = max(at, z)
    return out + words[at:]


def repeated_tail(words: list, crc: int) -> list:
    """The words, from place a on as repeats of a stretch of p words, where the checksum chooses so."""
    g, n = crc // 10, len(words)
    if crc % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def find_runs(docs: DataFrame, shortest: int = SHORTEST, change: Callable[[list, int], list] | None = None) -> DataFrame:
    """doc_id, n_words, runs and the text without repeats (binary UTF-8, words joined by one space).

    change: makes other words of a text's words and the crc32 of its doc_id in decimal before runs are sought; a
    row without doc_id stays as it is.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, found, texts, size = [], [], [], [], 0

            def ready():
                runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in found], pa.list_(RUN))
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), runs, pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

            for doc_id, text, crc in zip(*batch.columns, strict=True):
                words = (text.as_py() or b"").split()  # at the six ASCII white spaces
                if change and crc.is_valid:
                    words = change(words, crc.as_py())
                runs = runs_of(words, shortest)
                ids.append(doc_id.as_py())
                counts.append(len(words))
                found.append(runs)
                texts.append(b" ".join(kept(words, runs)))
                size += len(texts[-1])
                if size > BATCH:
                    yield ready()
                    ids, counts, found, texts, size = [], [], [], [], 0
            yield ready()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("crc"))
    return rows.mapInArrow(tidy(find), FOUND)


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, number of runs, the longest one and digests of all runs and of the collapsed text, with repeated tails."""
    rows = find_runs(docs, change=repeated_tail)
    # the longest; of equally long ones the first
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("place"), (-r["period"]).alias("size"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = rows.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.place")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.size")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / (-F.col("best.size"))).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
