"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1; a trigram's vector binds (multiplies) its letters'
vectors after permuting (rotating) them by place; a text's vector bundles (adds) its trigrams; a
language's prototype bundles the unit vectors of labelled texts.  A text gets the language whose
prototype has the largest cosine with it.

Trigrams stay inside words, which are runs of letters, lower-cased, with a boundary on either side.
Every code point has a vector of its own, made from its number by a hash, so no table of letters is kept.
Prototypes are fitted on at most about ``per_language`` texts of each language (a documented bound;
rows are chosen by a 62-bit hash of doc_id, by a share that follows from exact counts and isn't 0 for any
number of rows), predictions cover every row.  A fit sends languages x dimensions numbers to the driver.

Defined results: ``und`` and score 0 where text is null or has no letter, or where nothing could be
learned; of equal cosines the first language in order wins; equal texts get equal results; held_out
is false for a null doc_id; a very long text is bundled in parts, each with one letter of its neighbours,
so that its vector is that of the whole; an empty table gives no rows; extra columns aren't read, and in
``predict`` pass through but for lang_pred and score, which are made anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm.jaccard_join import mix
from srcloom.llm.tasks import tidy

DIMENSIONS, SEED, PER_LANGUAGE = 1024, 7, 2000
#: Characters that are bundled at once, and trigrams whose vectors are built at once.
CHUNK, COLUMNS = 1 << 18, 2048
#: Symbols are code points; they fit in so many bits.
BITS = 21
SHARES = 1 << 62


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for a in range(0, 0x110000, 0x1000):
        out[a : a + 0x1000] = [not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(a, a + 0x1000)]
    return out


def item_memory(dimensions: int, seed: int, symbols: np.ndarray | None = None) -> np.ndarray:
    """Vectors of symbols (code points; 0 is the word boundary) for first, second and third place: a hash of
    symbol, seed and place in the vector gives 64 signs at a time."""
    symbols = np.arange(1 << 10) if symbols is None else symbols
    words = -(-dimensions // 64)
    x = symbols.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)[None]
    bits = np.unpackbits(mix(x ^ mix(np.array([seed], np.uint64))).view(np.uint8), axis=1)[:, :dimensions]
    base = bits.astype(np.int8) * 2 - 1
    return np.stack([np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base])


def _trigrams(low: list[str], before: str = "", behind: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Codes of all trigrams of lower-cased texts and the text each comes from.  before, behind: the
    characters on either side of a part that was cut out of a text."""
    points = np.frombuffer(("\n" + before + "\n".join(low) + behind + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    doc = np.append(doc, len(low) - 1) if len(low) else doc
    if before or behind:
        doc = np.zeros(len(points), np.int64)
        doc[[*range(1, 1 + len(before)), *range(len(points) - 1 - len(behind), len(points) - 1)]] = -1
    letter = _is_letter()[points]
    symbol = np.where(letter, points, 0)
    # each word with one boundary before and one behind
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]
    single = ~letter & keep  # a boundary between two words serves both
    symbol, doc, single = symbol[keep], doc[keep], single[keep]
    if len(symbol) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    middle = ~single[1:-1] & (doc[1:-1] >= 0)
    code = (symbol[:-2] << 2 * BITS) | (symbol[1:-1] << BITS) | symbol[2:]
    return code[middle], doc[1:-1][middle]


def _parts(low: list[str]) -> Iterator[tuple[int, int, list[str], str, str]]:
    """Texts low[k:j] that are bundled at once, with what stands around a part of a long text."""
    k = 0
    while k < len(low):
        j, size = k, 0
        while j < len(low) and (j == k or size + len(low[j]) <= CHUNK):
            size, j = size + len(low[j]), j + 1
        if size <= CHUNK:
            yield k, j, low[k:j], "", ""
        else:
            for a in range(0, size, CHUNK):
                yield k, j, [low[k][a : a + CHUNK]], low[k][max(0, a - 1) : a], low[k][a + CHUNK : a + CHUNK + 1]
        k = j


def bundle(texts: list[str], dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """The bundled vector of each text."""
    out = np.zeros((len(texts), dimensions), np.float32)
    mask = (1 << BITS) - 1
    for k, j, part, before, behind in _parts([t.lower() for t in texts]):
        code, doc = _trigrams(part, before, behind)
        if not len(code):
            continue
        kinds, which = np.unique(code, return_inverse=True)
        symbols, places = np.unique(np.concatenate([kinds >> 2 * BITS, kinds >> BITS & mask, kinds & mask]), return_inverse=True)
        items, places = item_memory(dimensions, seed, symbols), places.reshape(3, -1)
        order = np.argsort(which, kind="stable")
        which, doc = which[order], doc[order]
        for a in range(0, len(kinds), COLUMNS):
            n = len(kinds[a : a + COLUMNS])
            lo, hi = np.searchsorted(which, [a, a + n])
            count = np.bincount(doc[lo:hi] * n + which[lo:hi] - a, minlength=len(part) * n).reshape(len(part), n).astype(np.float32)
            first, second, third = places[:, a : a + n]
            vector = items[0][first]
            vector *= items[1][second]
            vector *= items[2][third]
            out[k:j] += count @ vector.astype(np.float32)
    return out


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def share_of(wanted: int, rows: int) -> int:
    """How many of SHARES hash values choose about ``wanted`` of ``rows`` rows."""
    return SHARES if rows <= wanted else max(1, SHARES * wanted // rows)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Unit prototypes by language from rows (doc_id, text, lang)."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.lit(0).cast("long")
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(share_of(per_language, n)).cast("long")).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(SHARES)) < share).select("text", "lang")

    def run(batches) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                vectors = bundle(batch.column(0).to_pylist(), dimensions, seed)
                length = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = vectors / np.where(length > 0, length, 1)
                for lang, v in zip(batch.column(1).to_pylist(), vectors, strict=True):
                    total[lang] = total.get(lang, 0) + v.astype(np.float64)
        if total:
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(list(total), dimensions)), pa.array(np.tile(np.arange(dimensions), n).astype(np.int32)), pa.array(np.concatenate(list(total.values())))], ["lang", "place", "part"])

    sums = sample.mapInArrow(tidy(run), "lang string, place int, part double").groupBy("lang", "place").agg(F.sum("part").alias("part"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(r["lang"], np.zeros(dimensions))[r["place"]] = r["part"]
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(out.items()) if np.linalg.norm(v) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """Adds lang_pred and score (cosine, 0 where negative) to (doc_id, text, ...); predictions read text only."""
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double")
    names = list(prototypes)
    matrix = np.stack([prototypes[x] for x in names]).astype(np.float32) if names else None

    def run(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                n = batch.num_rows
                lang, score = ["und"] * n, np.zeros(n)
                if names:
                    vectors = bundle([t or "" for t in batch.column("text").to_pylist()], dimensions, seed)
                    length = np.linalg.norm(vectors, axis=1)
                    cosine = (vectors @ matrix.T) / np.where(length > 0, length, 1)[:, None]
                    best = cosine.argmax(axis=1)
                    lang = [names[b] if z > 0 else "und" for b, z in zip(best, length, strict=True)]
                    score = np.where(length > 0, np.clip(cosine[np.arange(n), best], 0, 1), 0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*rest, "lang_pred", "score"])

    return docs.select(*rest).mapInArrow(tidy(run), schema)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from rows that aren't held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out())
    prototypes = fit(rows.where(~F.col("held_out")), per_language)
    return predict(rows.select("doc_id", "held_out", "text"), prototypes).select("doc_id", "held_out", "lang_pred", "score")
