"""Licence scans: phrases, and spans that agree with templates, found by votes of word k-grams for diagonals.

Words are runs of ASCII letters and digits, A-Z lower-cased, and of all characters beyond ASCII.  The base finds
phrases word for word.  The method:

1. ``grams`` gives a hash for each ``K`` words of each text, at all places; Spark joins them with the places of the
   templates' k-grams.  The templates' table goes to all tasks if it has ``MOST_GRAMS`` rows at most, and is
   shuffled if it has more.
2. A hit votes for its diagonal, the place in the text less the place in the template.  Votes are counted by text,
   template and diagonal as sets of the template's places, so that copies of a text count once.
3. Neighbouring diagonals are merged: words put in or left out move later hits to a diagonal nearby.  A diagonal
   whose merged votes no neighbour beats is a candidate if they are ``VOTES`` of the template's k-grams.
4. A candidate's words, with room at both ends, are aligned with the template's (longest common subsequence; of
   equally long ones the shortest span).  It is a licence span if the common words are ``SHARE`` of the longer of
   both, and the template's naming words stand together in it.

Texts are known by their MD5; a bitmap of bounded size keeps texts without a candidate from being shuffled.

Defined results: null and empty texts have no words, places or labels and a score of 0; texts of any length are
read whole; repeated rows and copies have equal results; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcloom.llm.components import among, maybe_in, salted_join
from srcloom.llm.jaccard_join import mix
from srcloom.llm.license_texts import PHRASES, TEMPLATES
from srcloom.llm.storage import Scratch
from srcloom.llm.tasks import tidy

K, VOTES, SHARE, SHIFT = 3, 0.25, 0.8, 8
#: Bytes of text that are hashed at once; rows of the templates' table that may be broadcast.
SLICE, MOST_GRAMS = 1 << 20, 500_000
BASE = 0x9E3779B97F4A7C15
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = rb"[^0-9a-z\x80-\xff]+"


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.translate(LOWER))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and their inverses."""
    one = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)], dtype=np.uint64)
    return one(BASE), one(pow(BASE, -1, 1 << 64))


def hashed_words(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in lower-cased bytes, and their hashes; cut into slices between words."""
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(low):
        end = at + SLICE
        while end < len(low) and len(free := np.flatnonzero(~IS_WORD[low[end : end + 65536]])) == 0:
            end += 65536
        end = end + int(free[0]) if end < len(low) else len(low)
        part = low[at:end]
        power, inverse = _powers(1 << max(16, int(len(part)).bit_length()))
        edge = np.diff(np.concatenate([[0], IS_WORD[part].astype(np.int8), [0]]))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * power[: len(part)], dtype=np.uint64)])
        starts.append(s + at)
        hashes.append(mix((total[e] - total[s]) * inverse[s]))
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def gram_hashes(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all rolling k-grams; fewer words than k have none."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out = mix(words[: len(words) - k + 1])
    for i in range(1, k):
        out = mix(out ^ words[i : len(words) - k + 1 + i])
    return out


def _groups(texts: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Rows in groups of about a slice: first row, end, their lower-cased bytes with a space after each, and where each begins."""
    at, n = 0, len(texts)
    while at < n:
        end, size, own = at, 0, []
        while end < n and (size < SLICE or end == at):
            own.append((texts[end].as_py() or b"").translate(LOWER))
            size += len(own[-1]) + 1
            end += 1
        yield at, end, b" ".join([*own, b""]), np.cumsum([0, *(len(x) + 1 for x in own)])
        at = end


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))


def grams(docs: DataFrame) -> DataFrame:
    """(key, place, gram) of all rolling k-grams of docs (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, z, blob, off in _groups(batch.column(1)):
                starts, hashes = hashed_words(np.frombuffer(blob, np.uint8))
                first = np.searchsorted(starts, off)
                row = np.repeat(np.arange(z - a), np.diff(first))
                own = gram_hashes(hashes)
                whole = np.flatnonzero(row[: len(own)] == row[K - 1 :]) if len(own) else np.zeros(0, np.int64)
                for lo in range(0, len(whole), 1 << 19):
                    i = whole[lo : lo + (1 << 19)]
                    key = np.array(keys[a:z], "V16")[row[i]]
                    cells = pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(np.arange(0, 16 * len(i) + 1, 16, dtype=np.int32)), pa.py_buffer(key.tobytes())])
                    yield pa.RecordBatch.from_arrays([cells, pa.array((i - first[row[i]]).astype(np.int32)), pa.array(own[i].view(np.int64))], ["key", "place", "gram"])

    return docs.select("key", "text").mapInArrow(tidy(run), "key binary, place int, gram long")


def template_table(templates=TEMPLATES) -> list[tuple[int, str, str, list[bytes], int]]:
    """(number, label, naming words, words, shift) of the templates; those with fewer than k words find nothing."""
    rows = []
    for n, (label, must, text) in enumerate(templates):
        words = words_of(text.encode())
        rows.append((n, label, b" ".join(words_of(must.encode())), words, max(1, min(SHIFT, len(words) // 4))))
    return rows


def template_grams(spark: SparkSession, table) -> DataFrame:
    """(gram, template, at, shift, need) of all k-grams of all templates."""
    rows = []
    for n, _, _, words, shift in table:
        own = gram_hashes(hashed_words(np.frombuffer(b" ".join(words), np.uint8))[1])
        rows += [(int(g), n, at, shift, max(1.0, VOTES * len(own))) for at, g in enumerate(own.view(np.int64))]
    return spark.createDataFrame(rows, "gram long, template int, at int, shift int, need double")


def diagonals(docs: DataFrame, table) -> DataFrame:
    """(key, template, shift, need, diagonal, votes) of docs (key, text)."""
    known = template_grams(docs.sparkSession, table)
    known = F.broadcast(known) if sum(len(words) for *_, words, _ in table) <= MOST_GRAMS else known
    hits = grams(docs).join(known, "gram").groupBy("key", "template", "shift", "need", (F.col("place") - F.col("at")).alias("diagonal"))
    return hits.agg(F.size(F.collect_set("at")).alias("votes"))


def candidates(found: DataFrame) -> DataFrame:
    """(key, template, diagonal) of diagonals whose votes, with their neighbours', are enough and the most nearby."""
    near = Window.partitionBy("key", "template").orderBy(F.col("diagonal") / F.col("shift")).rangeBetween(-1, 1)
    rows = found.withColumn("merged", F.sum("votes").over(near))
    own = F.struct("merged", (-F.col("diagonal")).alias("place"))
    rows = rows.withColumn("most", F.max(own).over(near))
    return rows.where((F.col("merged") >= F.col("need")) & (F.col("most.merged") == F.col("merged")) & (F.col("most.place") == -F.col("diagonal"))).select("key", "template", "diagonal")


def aligned(template: list[bytes], words: list[bytes]) -> tuple[int, int, int]:
    """(common words, start, end) of the longest common subsequence; of equally long ones in the shortest span."""
    n = len(words)
    code = {w: k for k, w in enumerate(dict.fromkeys(template))}
    own = np.array([code.get(w, -1) for w in words], np.int64)
    unit = n + 1  # a cell is common words * unit + the place of the first one
    best, place = np.zeros(n + 1, np.int64), np.arange(n)
    for w in template:
        step = np.where(best[:-1] >= unit, best[:-1] + unit, unit + place)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(own == code[w], step, 0)))
    common = int(best[-1] // unit)
    ends = np.flatnonzero(best // unit == common)
    k = ends[np.argmin(ends - best[ends] % unit)]
    return (common, int(best[k] % unit), int(k)) if common else (0, 0, 0)


def verified(texts: DataFrame, table) -> DataFrame:
    """(key, label, template, start, words, share) of the candidates of texts (key, text, places) that are licence spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, places in zip(*batch.columns, strict=True):
                words, seen = words_of(text.as_py()), set()
                for p in places.as_py():
                    n, label, must, own, shift = table[p["template"]]
                    room = shift + len(own) // 4
                    lo = max(0, p["diagonal"] - room)
                    common, a, z = aligned(own, words[lo : max(0, p["diagonal"] + len(own) + room)])
                    share = common / max(len(own), z - a)
                    named = b" " + must + b" " in b" " + b" ".join(words[lo + a : lo + z]) + b" " if must else True
                    if share >= SHARE and named and (n, lo + a) not in seen:
                        seen.add((n, lo + a))
                        out.append((key.as_py(), label, n, lo + a, z - a, share))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "label", "template", "start", "words", "share"])

    return texts.select("key", "text", "places").mapInArrow(tidy(run), "key binary, label string, template int, start long, words long, share double")


def license_spans(docs: DataFrame, templates=TEMPLATES, own: Scratch | None = None) -> DataFrame:
    """(key, label, template, start, words, share) of licence spans of docs (key, text), once for each different text; worked
    out anew by each action, so write what is read twice."""
    own, table = own or Scratch(docs.sparkSession, "licenses"), template_table(templates)
    found = own.put(candidates(diagonals(docs, table)), "candidates")
    texts = among(docs.select("key", "text"), "key", found.select("key")).groupBy("key").agg(F.first("text").alias("text"))
    places = found.groupBy("key").agg(F.collect_list(F.struct("template", "diagonal")).alias("places"))
    return verified(texts.join(places, "key"), table)


def phrase_places(docs: DataFrame, phrases=PHRASES) -> DataFrame:
    """doc_id, key, n_words, n_base, first_word, last_word and base_labels of docs (doc_id, key, text): where the phrases' words stand together."""
    patterns = [(re.compile(GAP.join(words_of(p.encode())) + rb"(?![0-9a-z\x80-\xff])"), label) for p, label in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, blob, off in _groups(batch.column(2)):
                starts = np.flatnonzero(np.diff(np.concatenate([[0], IS_WORD[np.frombuffer(blob, np.uint8)].astype(np.int8)])) == 1)
                first = np.searchsorted(starts, off)
                places: list[list[int]] = [[] for _ in range(z - a)]
                labels: list[set[str]] = [set() for _ in range(z - a)]
                for pattern, label in patterns:
                    for m in pattern.finditer(blob):
                        row = int(np.searchsorted(off, m.start(), "right")) - 1
                        if m.end() < off[row + 1] and (m.start() == 0 or not IS_WORD[blob[m.start() - 1]]):
                            places[row].append(int(np.searchsorted(starts, m.start()) - first[row]))
                            labels[row].add(label)
                cells = [pa.array(np.diff(first)), pa.array([len(p) for p in places], pa.int64()), pa.array([min(p, default=None) for p in places], pa.int64()), pa.array([max(p, default=None) for p in places], pa.int64()), pa.array([sorted(x) for x in labels], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], batch.column(1)[a:z], *cells], ["doc_id", "key", "n_words", "n_base", "first_word", "last_word", "base_labels"])

    return docs.select("doc_id", "key", "text").mapInArrow(tidy(run), "doc_id long, key binary, n_words long, n_base long, first_word long, last_word long, base_labels array<string>")


def license_report(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: 1 where a phrase stands, else the largest share of a licence span, else 0.
    """
    own, rows = Scratch(docs.sparkSession, "licenses"), _keyed(docs)
    spans = license_spans(rows, templates, own)
    by_text = own.put(spans.groupBy("key").agg(F.collect_set("label").alias("more"), F.max("share").alias("share")), "labels")
    own.drop("candidates")
    base = maybe_in(phrase_places(rows, phrases), "key", by_text.select("key"))
    joined = salted_join(base.where("_maybe"), by_text, "key", F.col("doc_id"), "left")
    every = joined.unionByName(base.where("NOT _maybe").withColumns({"more": F.lit(None).cast("array<string>"), "share": F.lit(None).cast("double")}))
    labels = F.array_join(F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>")))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return every.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), labels.alias("labels"), score.alias("score"))
