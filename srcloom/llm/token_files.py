"""Token ids in patched frame-of-reference blocks.

A segment holds the ids of whole documents, in ascending order of doc_id.  Its ids are cut into
blocks of 256.  Of each block the minimum is subtracted; the rest is packed at the width that covers
``PERCENTILE`` of the block's values; of larger values the low bits are packed too, and position and
high bits go to the segment's exception lists.  An index holds the start of each block, so that a
reader can unpack any of them alone.  Segments are rows of Parquet files (one binary column beside
shard, segment and counts): Spark's commit protocol then covers lost executors and any file system.

Layout of a segment, little-endian: magic, documents, ids, blocks, exceptions (5 x uint32); doc_id
(int64 each, and a byte each that is 1 for a null); ids per document (int64); block minimum (uint32),
width (uint8), start in 8-byte words (uint32), number of exceptions (uint16); packed words (uint64);
exception positions (uint8), exception high bits (uint32).

Shards are ranges of doc_id whose bounds come from quantiles of the doc_id column alone, and a doc_id
with more rows than a shard holds is dealt over several by its texts; a shard is sorted and written by one
task.  There is one for each SHARD_BYTES of text, at least as many as the session has shuffle partitions.

Defined results: null and empty texts hold the end id only; null doc_ids come first; rows with equal
doc_id are ordered by their ids within a shard, equal rows follow one another; an empty table gives no
segments; extra columns aren't read; a very long text is one document of one segment.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcloom.llm.bytes_kernel import PieceCache, encode_column, ragged
from srcloom.llm.storage import new_path
from srcloom.llm.tasks import tidy

BLOCK, PERCENTILE, MAGIC = 256, 0.9, 0x31464F50
SHARD_BYTES = 1 << 30
#: Ids and documents after which a segment is closed.
SEGMENT_IDS, SEGMENT_DOCS = 1 << 19, 8192
#: Pieces whose ids a task remembers (about 200 bytes each).
PIECES = 700_000
SEGMENT = "shard int, segment int, n_docs long, n_ids long, before long, payload binary"


def bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Packs (m, 64) values of ``width`` bits to (m, width) words."""
    m = len(values)
    lanes = np.ascontiguousarray(values.T).astype(np.uint64)
    words = np.zeros((max(width, 1), m), np.uint64)
    for j in range(64 if width else 0):
        w, s = divmod(j * width, 64)
        words[w] |= lanes[j] << np.uint64(s)
        if s + width > 64:
            words[w + 1] |= lanes[j] >> np.uint64(64 - s)
    return np.ascontiguousarray(words[:width].T)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The (m, 64) values of (m, width) words."""
    m = len(words)
    lanes = np.zeros((64, m), np.uint32)
    cols, mask = np.ascontiguousarray(words.T), np.uint64((1 << width) - 1)
    for j in range(64 if width else 0):
        w, s = divmod(j * width, 64)
        x = cols[w] >> np.uint64(s)
        if s + width > 64:
            x = x | cols[w + 1] << np.uint64(64 - s)
        lanes[j] = x & mask
    return np.ascontiguousarray(lanes.T)


def write_segment(doc_ids: list[int | None], lens: np.ndarray, ids: np.ndarray) -> bytes:
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    v = np.zeros((blocks, BLOCK), np.uint32)
    v.reshape(-1)[:n] = ids
    if n:
        v.reshape(-1)[n:] = ids[-1]
    low = v.min(axis=1) if blocks else np.zeros(0, np.uint32)
    d = v - low[:, None]
    k = min(BLOCK - 1, int(BLOCK * PERCENTILE))
    width = np.partition(bit_lengths(d), k, axis=1)[:, k] if blocks else np.zeros(0, np.uint8)
    high = d >> width[:, None]
    row, col = np.nonzero(high)
    words_each = width.astype(np.int64) * (BLOCK // 64)
    start = np.cumsum(words_each) - words_each
    words = np.zeros(int(words_each.sum()), np.uint64)
    for w in np.unique(width).tolist():
        if w:
            own = np.flatnonzero(width == w)
            part = (d[own] & np.uint32((1 << w) - 1)).reshape(-1, 64)
            words[ragged(start[own], words_each[own])] = pack(part, w).reshape(-1)
    null = np.array([x is None for x in doc_ids], np.uint8)
    return b"".join([
        np.array([MAGIC, len(doc_ids), n, blocks, len(row)], "<u4").tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), null.tobytes(), lens.astype("<i8").tobytes(),
        low.astype("<u4").tobytes(), width.tobytes(), start.astype("<u4").tobytes(), np.bincount(row, minlength=blocks).astype("<u2").tobytes() if blocks else b"",
        words.astype("<u8").tobytes(), col.astype(np.uint8).tobytes(), high[row, col].astype("<u4").tobytes(),
    ])


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids per document, and all ids."""
    magic, docs, n, blocks, exceptions = np.frombuffer(data, "<u4", 5).tolist()
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = 20

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    own, null, lens = take("<i8", docs), take("u1", docs), take("<i8", docs)
    low, width, start, held = take("<u4", blocks), take("u1", blocks), take("<u4", blocks).astype(np.int64), take("<u2", blocks)
    words = take("<u8", int(width.astype(np.int64).sum()) * (BLOCK // 64))
    col, high = take("u1", exceptions), take("<u4", exceptions)
    v = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        if w:
            mine = np.flatnonzero(width == w)
            each = np.full(len(mine), w * (BLOCK // 64))
            v[mine] = unpack(words[ragged(start[mine], each)].reshape(-1, w), w).reshape(-1, BLOCK)
    row = np.repeat(np.arange(blocks), held)
    v[row, col] |= high << width[row]
    v += low[:, None]
    return [None if z else int(x) for x, z in zip(own.tolist(), null.tolist(), strict=True)], lens, v.reshape(-1)[:n]


def library_encoder(path: str):
    """A function from pieces of text to their ids by the tokenizers library, and the special strings."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()

    special = {x.content.encode(): i for i, x in t.get_added_tokens_decoder().items() if x.special}
    sep = next(iter(special), None)

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A special string between pieces keeps them apart, so that the library makes one result for many."""
        if sep is None:
            got = [e.ids for e in t.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
            lens = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter((i for x in got for i in x), np.uint32, int(lens.sum())), lens
        plain = [w for w in words if w not in special]
        joined = [sep.join(plain[k : k + 50]).decode() + sep.decode() for k in range(0, len(plain), 50)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in t.encode_batch_fast(joined, add_special_tokens=False))])
        ends = np.flatnonzero(ids == special[sep])
        flat, lens = ids[ids != special[sep]], np.diff(np.append(-1, ends)) - 1
        for k, w in enumerate(words):
            if w in special:
                flat, lens = np.insert(flat, int(lens[:k].sum()), special[w]), np.insert(lens, k, 1)
        return flat, lens

    return encode, tuple(special)


def shards_of(docs: DataFrame) -> int:
    """Shards of about SHARD_BYTES of text each, at least as many as the session has shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))


def doc_bounds(docs: DataFrame, shards: int) -> list[int]:
    """Ascending bounds of ``shards`` about equal ranges of doc_id.  A doc_id that has more rows than a shard
    holds is several bounds; rows without one count as the least."""
    if shards < 2:
        return []
    return docs.select(F.percentile_approx(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), [k / shards for k in range(1, shards)], 10 * shards)).first()[0] or []


def deal(doc: np.ndarray, text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Shards of rows by doc_id; rows of a doc_id that is several bounds are dealt by a hash of their texts over
    the shards between these bounds."""
    low, high = (np.searchsorted(bounds, doc, side=side) for side in ("left", "right"))
    several = np.maximum(high - low, 1)
    return (high - several + 1 + text % several).astype(np.int32)


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int = 2, shards: int | None = None) -> None:
    """Encodes ``text`` of every row, appends ``end_id``, and writes segments to the folder ``out``.

    One shuffle: of ids, not of texts, by shard.  Segments stand in ascending doc_id order; rows of one doc_id by
    shard, then by ids.
    """
    shards = shards or shards_of(docs)
    bounds = doc_bounds(docs, shards)

    def encode(batches) -> Iterator[pa.RecordBatch]:
        encode_words, specials = library_encoder(path)
        cache, edge = PieceCache(encode_words, PIECES), np.array(bounds, np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                rows: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
                for own, n, ids in encode_column(batch.column("text"), cache, specials):
                    raw, at = ids.astype("<u4"), np.concatenate([[0], np.cumsum(n)]).tolist()
                    for d, a, b in zip(own.tolist(), at[:-1], at[1:], strict=True):
                        rows[d].append(raw[a:b].tobytes())
                end = np.array([end_id], "<u4").tobytes()
                doc = batch.column("doc_id")
                blobs = [_narrow(b"".join(r) + end) for r in rows]
                shard = deal(doc.fill_null(-(1 << 63)).to_numpy(), np.fromiter(map(zlib.crc32, blobs), np.int64, len(blobs)), edge)
                yield pa.RecordBatch.from_arrays([pa.array(shard), doc, pa.array(blobs, pa.binary())], ["shard", "doc_id", "ids"])

    def segments(batches) -> Iterator[pa.RecordBatch]:
        shard, number, before, docs_, lens, ids = None, 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            nonlocal number, before, docs_, lens, ids
            flat = np.concatenate(ids)
            row = pa.RecordBatch.from_pylist([{"shard": shard, "segment": number, "n_docs": len(docs_), "n_ids": len(flat), "before": before, "payload": write_segment(docs_, np.array(lens, np.int64), flat)}], schema=SEGMENT_ARROW)
            number, before, docs_, lens, ids = number + 1, before + len(flat), [], [], []
            return row

        held = 0
        for batch in batches:
            for s, d, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if s != shard:
                    if docs_:
                        yield close()
                    shard, number, before, held = s, 0, 0, 0
                own = _wide(raw.as_py())
                docs_.append(d), lens.append(len(own)), ids.append(own)
                held += len(own)
                if held >= SEGMENT_IDS or len(docs_) >= SEGMENT_DOCS:
                    yield close()
                    held = 0
        if docs_:
            yield close()

    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(encode), "shard int, doc_id long, ids binary")
    dealt = encoded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    dealt.mapInArrow(tidy(segments), SEGMENT).write.parquet(out)


SEGMENT_ARROW = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("before", pa.int64()), ("payload", pa.binary())])


def _narrow(raw: bytes) -> bytes:
    """Ids for the shuffle: two bytes each where all fit; a first byte tells."""
    x = np.frombuffer(raw, "<u4")
    return b"\x02" + x.astype("<u2").tobytes() if x.max() < 1 << 16 else b"\x04" + raw


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=1).astype(np.uint32)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with ``start``, the number of ids in all segments before.

    Within a shard the writer has counted; across shards one row per shard (as many as the writer had
    shuffle partitions, whatever the rows) is summed and sent to the readers.
    """
    stored = spark.read.parquet(folder)
    per_shard = stored.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    base = per_shard.select("shard", (F.sum("shard_ids").over(Window.orderBy("shard")) - F.col("shard_ids")).alias("base"))
    return stored.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("before")).drop("base", "before")


def document_digest(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document from its segment's bytes."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, lens, ids = read_segment(payload.as_py())
                at = np.concatenate([[0], np.cumsum(lens)])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(at[:-1] + start), pa.array(lens), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("start", "payload").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes the token files of ``docs`` to the shared folder, reads them back and digests each document."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    write_tokens(docs, path, folder, end_id)
    return document_digest(read_tokens(spark, folder))
