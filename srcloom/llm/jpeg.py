"""Baseline JPEG in numpy: payloads kept losslessly in DC coefficients, and DC-only thumbnails.

``payload_jpegs`` stores bytes as a grey baseline JPEG: each byte is the DC coefficient of one 8 x 8
block (quantiser 8, so a byte is just the block's grey level), 64 blocks to a row, a restart marker
after each row.  A payload of more rows than one JPEG holds becomes several JPEGs one after the other.

``thumbnails`` reads baseline JPEGs in general: it parses the markers, Huffman-decodes the scans
(any sampling factors; AC coefficients are decoded and passed over) and rebuilds the DC-only
luminance thumbnail, one sample for each 8 x 8 block.  Restart intervals and images are decoded side
by side as lanes of one numpy loop.

Defined results: null and empty texts are one row of 64 zero bytes; equal texts have equal values;
rows that repeat are repeated; extra columns aren't read; bytes that aren't a baseline JPEG raise
ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm.bytes_kernel import ragged, utf8_column
from srcloom.llm.storage import new_path
from srcloom.llm.tasks import tidy

ROW, MOST_ROWS, DC_QUANT = 64, 8191, 8
#: Bytes of payload that are coded at once.
BATCH = 1 << 20
#: The usual luminance DC table of the JPEG standard (annex K), codes by length, then symbols.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: Our AC table has the end of a block only.
AC_COUNTS, AC_SYMBOLS = (1, *(0,) * 15), (0,)


def huffman_codes(counts, symbols) -> dict[int, tuple[int, int]]:
    """symbol -> code, length, by the standard's rule."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup_table(counts, symbols) -> np.ndarray:
    """For each 16 bits that may come next: symbol + 256 x code length, or 0."""
    table = np.zeros(1 << 16, np.int32)
    for s, (code, length) in huffman_codes(counts, symbols).items():
        table[code << (16 - length) : (code + 1) << (16 - length)] = s + 256 * length
    return table


def _marker(code: int, body: bytes) -> bytes:
    return bytes([0xFF, code]) + (len(body) + 2).to_bytes(2, "big") + body


def _head(rows: int) -> bytes:
    return b"".join([
        b"\xff\xd8", _marker(0xDB, bytes([0, DC_QUANT, *[1] * 63])),
        _marker(0xC0, bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * ROW).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
        _marker(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])), _marker(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])),
        _marker(0xDD, ROW.to_bytes(2, "big")), _marker(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


_CODES = huffman_codes(DC_COUNTS, DC_SYMBOLS)
_CODE = np.array([_CODES[k][0] for k in range(12)], np.int64)
_LENGTH = np.array([_CODES[k][1] for k in range(12)], np.int64)


def _entropy_rows(rows: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded data of (m, 64) levels, without restart markers, each row on whole bytes; row starts."""
    m = len(rows)
    dc = rows.astype(np.int64) - 128
    diff = np.diff(dc, axis=1, prepend=0)
    size = np.frexp(np.abs(diff).astype(np.float64))[1].astype(np.int64)
    bits = np.where(diff < 0, diff + (1 << size) - 1, diff)
    length = _LENGTH[size] + size + 1  # and one zero bit: the end of the block
    code = ((_CODE[size] << size) | bits) << 1
    in_row = np.cumsum(length, axis=1)
    total = in_row[:, -1]
    nbytes = -(-total // 8)
    start = np.cumsum(nbytes) - nbytes
    # bits up to the next byte are ones
    pad = nbytes * 8 - total
    at = np.concatenate([(in_row - length + start[:, None] * 8), (total + start * 8)[:, None]], axis=1).reshape(-1)
    code = np.concatenate([code, ((1 << pad) - 1)[:, None]], axis=1).reshape(-1)
    length = np.concatenate([length, pad[:, None]], axis=1).reshape(-1)
    word, shift = at >> 5, 64 - (at & 31) - length
    spread = code.astype(np.uint64) << shift.astype(np.uint64)
    n = int(nbytes.sum()) // 4 + 2
    words = np.bincount(word, (spread >> np.uint64(32)).astype(np.float64), n)[:n] + np.bincount(word + 1, (spread & np.uint64(0xFFFFFFFF)).astype(np.float64), n)[:n]
    return words.astype(">u4").tobytes()[: int(nbytes.sum())], np.append(start, nbytes.sum())


def payload_jpegs(payloads: list[np.ndarray]) -> list[bytes]:
    """JPEGs of payloads, each a whole number of rows of 64 bytes."""
    if not payloads:
        return []
    data, start = _entropy_rows(np.concatenate(payloads).reshape(-1, ROW))
    raw = np.frombuffer(data, np.uint8)
    # row after row: its bytes, each FF followed by 00, then a restart marker
    ff = np.flatnonzero(raw == 0xFF)
    stuffed = np.insert(raw, ff + 1, 0)
    edge = start + np.searchsorted(ff, start)
    out, row = [], 0
    for p in payloads:
        rows = len(p) // ROW
        files = []
        for k in range(0, rows, MOST_ROWS):
            n = min(MOST_ROWS, rows - k)
            a = edge[row + k : row + k + n + 1]
            own = stuffed[a[0] : a[-1]]
            if n > 1:
                marks = np.stack([np.full(n - 1, 0xFF, np.uint8), (0xD0 + np.arange(n - 1) % 8).astype(np.uint8)], axis=1).reshape(-1)
                own = np.insert(own, np.repeat(a[1:-1] - a[0], 2), marks)
            files.append(_head(n) + own.tobytes() + b"\xff\xd9")
        out.append(b"".join(files))
        row += rows
    return out


class Frame:
    """One baseline JPEG's headers and the place of its scan."""

    __slots__ = ("components", "data", "end", "height", "interval", "quant", "tables", "width")


def parse(data: bytes, at: int = 0) -> Frame:
    """Parses the markers of the JPEG that starts at ``at``."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of an image")
    f, quant, tables, at = Frame(), {}, {}, at + 2
    f.interval, f.components = 0, []
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("marker expected")
        code = data[at + 1]
        if code == 0xFF:
            at += 1
            continue
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if code == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1:3], "big") if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif code == 0xC4:
            while body:
                counts = tuple(body[1:17])
                tables[body[0]] = (counts, tuple(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif code == 0xC0:
            f.height, f.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            f.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif 0xC1 <= code <= 0xCF and code not in (0xC8, 0xCC):
            raise ValueError("not baseline")
        elif code == 0xDD:
            f.interval = int.from_bytes(body, "big")
        elif code == 0xDA:
            own = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            if not f.components or len(own) != len(f.components):
                raise ValueError("one scan with all components is expected")
            f.tables = tuple((tables[own[c] >> 4], tables[16 + (own[c] & 15)]) for c, *_ in f.components)
            f.quant = [quant[q] for *_, q in f.components]
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise ValueError("no end of the scan")
                if data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            f.data, f.end = (at, end), end + 2
            return f


def _lanes(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A scan without stuffing and restart markers, and where its intervals start."""
    ff = np.flatnonzero(scan[:-1] == 0xFF) if len(scan) else np.zeros(0, np.int64)
    nxt = scan[ff + 1]
    marks = ff[(nxt >= 0xD0) & (nxt <= 0xD7)]
    drop = np.concatenate([ff[nxt == 0] + 1, marks, marks + 1])
    keep = np.ones(len(scan), bool)
    keep[drop] = False
    return scan[keep], np.append(0, marks - np.searchsorted(np.sort(drop), marks))


def decode_dc(frames: list[Frame], scans: list[np.ndarray]) -> list[list[np.ndarray]]:
    """DC levels of each component of frames that share tables and sampling: (blocks down, blocks across)."""
    f0 = frames[0]
    single = len(f0.components) == 1
    h = [1 if single else c[1] for c in f0.components]
    v = [1 if single else c[2] for c in f0.components]
    unit = np.array([k for k in range(len(h)) for _ in range(h[k] * v[k])])  # component of each block of an MCU
    grid = [(-(-f.height // (8 * max(v))), -(-f.width // (8 * max(h)))) for f in frames]
    parts, base, firsts, mcus = [], 0, [], []
    for f, s, (down, across) in zip(frames, scans, grid, strict=True):
        own, at = _lanes(s)
        total = down * across
        step = f.interval or total
        lanes = -(-total // step)
        if len(at) < lanes:
            raise ValueError("restart markers are missing")
        parts.append(own), firsts.append(at[:lanes] + base)
        mcus.append(np.minimum(step, total - step * np.arange(lanes)))
        base += len(own)
    raw = np.concatenate([*parts, np.zeros(8, np.uint8)]).astype(np.int64)
    first, count = np.concatenate(firsts), np.concatenate(mcus)
    todo = count * len(unit)
    out_at = np.cumsum(todo) - todo
    out = np.zeros(int(todo.sum()), np.int64)
    dc = [lookup_table(*t[0]) for t in f0.tables]
    ac = [lookup_table(*t[1]) for t in f0.tables]
    table = np.concatenate([*dc, *ac])
    lane = np.arange(len(first))
    bit, block, coef = first * 8, np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    pred = np.zeros((len(unit) and max(unit) + 1, len(first)), np.int64)
    limit = 8 * (len(raw) - 6)
    ones = len(f0.components) == 1
    while len(lane):
        if (bit > limit).any():
            raise ValueError("the scan ends early")
        c = 0 if ones else unit[block % len(unit)]
        byte = bit >> 3
        window = (raw[byte] << 32 | raw[byte + 1] << 24 | raw[byte + 2] << 16 | raw[byte + 3] << 8 | raw[byte + 4]) << (bit & 7)
        is_dc = coef == 0
        entry = table[((window >> 24) & 0xFFFF) + (c + np.where(is_dc, 0, len(dc))) * 65536]
        if (entry == 0).any():
            raise ValueError("bad Huffman code")
        length, symbol = entry >> 8, (entry & 255).astype(np.int64)
        size = symbol & 15
        bits = ((window << length) & 0xFFFFFFFFFF) >> (40 - size)
        bit = bit + length + size
        d = np.flatnonzero(is_dc)
        if len(d):
            n, b = size[d], bits[d]
            diff = np.where((n > 0) & (b < (1 << np.maximum(n - 1, 0))), b - (1 << n) + 1, b)
            own = 0 if ones else c[d]
            level = pred[own, lane[d]] + diff
            pred[own, lane[d]] = level
            out[out_at[lane[d]] + block[d]] = level
        run = symbol >> 4
        coef = np.where(is_dc, 1, np.where(size > 0, coef + run + 1, np.where(run == 15, coef + 16, 64)))
        ended = coef >= 64
        block = block + ended
        coef = np.where(ended, 0, coef)
        going = block < todo[lane]
        if not going.all():
            lane, bit, block, coef = lane[going], bit[going], block[going], coef[going]
    images, at = [], 0
    for down, across in grid:
        n = down * across * len(unit)
        levels = out[at : at + n].reshape(down, across, len(unit))
        at += n
        own, k = [], 0
        for hh, vv in zip(h, v, strict=True):
            part = levels[:, :, k : k + hh * vv].reshape(down, across, vv, hh).transpose(0, 2, 1, 3).reshape(down * vv, across * hh)
            own.append(part)
            k += hh * vv
        images.append(own)
    return images


def thumbnails(files: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each stored value its images: width, height, luminance thumbnail (uint8)."""
    frames: list[tuple[int, Frame, np.ndarray]] = []
    for i, data in enumerate(files):
        at = 0
        while at < len(data):
            f = parse(data, at)
            frames.append((i, f, np.frombuffer(data, np.uint8)[f.data[0] : f.data[1]]))
            at = f.end
    alike: dict[tuple, list[int]] = {}
    for k, (_, f, _) in enumerate(frames):
        alike.setdefault((f.tables, tuple(c[1:3] for c in f.components)), []).append(k)
    levels: dict[int, np.ndarray] = {}
    for own in alike.values():
        for k, image in zip(own, decode_dc([frames[k][1] for k in own], [frames[k][2] for k in own]), strict=True):
            levels[k] = image[0]
    out: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in files]
    for k, (i, f, _) in enumerate(frames):
        hh = max(c[1] for c in f.components) if len(f.components) > 1 else 1
        vv = max(c[2] for c in f.components) if len(f.components) > 1 else 1
        y_h, y_v = (f.components[0][1], f.components[0][2]) if len(f.components) > 1 else (1, 1)
        down, across = -(-(-(-f.height * y_v // vv)) // 8), -(-(-(-f.width * y_h // hh)) // 8)
        grey = np.clip(np.round(levels[k][:down, :across] * f.quant[0] / 8 + 128), 0, 255).astype(np.uint8)
        out[i].append((f.width, f.height, grey))
    return out


def thumbnail_hash(grey: np.ndarray) -> str:
    """64 bits: whether each cell of an 8 x 8 grid of means is lighter than the one to its right."""
    rows = np.array_split(np.arange(grey.shape[0]), 8) if grey.shape[0] >= 8 else [np.array([k * grey.shape[0] // 8]) for k in range(8)]
    cols = np.array_split(np.arange(grey.shape[1]), 9) if grey.shape[1] >= 9 else [np.array([k * grey.shape[1] // 9]) for k in range(9)]
    down = np.stack([grey[r].astype(np.float64).sum(axis=0) / len(r) for r in rows])
    cells = np.stack([down[:, c].sum(axis=1) / len(c) for c in cols], axis=1)
    return np.packbits(cells[:, :-1] > cells[:, 1:]).tobytes().hex()


def _payloads(col) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Texts as padded payloads, about BATCH bytes at a time: lengths before padding, payloads."""
    data, off = utf8_column(col)
    n = np.diff(off)
    k = 0
    while k < len(n):
        j = max(k + 1, int(np.searchsorted(off, off[k] + BATCH, side="right")) - 1)
        out = []
        for i in range(k, j):
            p = np.zeros(max(ROW, -(-int(n[i]) // ROW) * ROW), np.uint8)
            p[: n[i]] = data[off[i] : off[i + 1]]
            out.append(p)
        yield n[k:j], out
        k = j


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``, the text's payload as JPEG."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for n, payloads in _payloads(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(n)), pa.array(n), pa.array(payload_jpegs(payloads), pa.binary())], ["doc_id", "n_bytes", "media"])
                at += len(n)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary")


def stored_media(docs: DataFrame) -> DataFrame:
    """The table of ``store_media`` as written to the shared folder, to be read from there."""
    path = new_path(docs.sparkSession, "media")
    store_media(docs).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema("doc_id long, n_bytes long, media binary").parquet(path)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width long, height long, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """Reads ``media`` back and adds dimensions (of several images: the sum of heights), the payload's
    digests and ``feature``, the thumbnail's hash and dimensions."""
    rest = [c for c in media.columns if c != "media"]
    schema = media.select(*rest).schema
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for x in FEATURES.split(", "):
        schema = schema.add(*x.split())

    def features(files: list[bytes]) -> Iterator[tuple]:
        for data, images in zip(files, thumbnails(files), strict=True):
            grey = np.concatenate([g for _, _, g in images])
            payload = grey.tobytes()
            w, h = images[0][0], sum(x[1] for x in images)
            yield len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(data), hashlib.sha256(data).hexdigest(), w, h, f"{thumbnail_hash(grey)}:{w}x{h}"

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, k = batch.column("media"), 0
            while k < batch.num_rows:
                files, size, j = [], 0, k
                while j < batch.num_rows and (not files or size < 2 * BATCH):
                    files.append(col[j].as_py())
                    size, j = size + len(files[-1]), j + 1
                found = list(zip(*features(files), strict=True))
                own = batch.slice(k, j - k)
                cols = [pa.array(x, pa.string() if isinstance(x[0], str) else pa.int64()) for x in found]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in rest), *cols], [*rest, *names])
                k = j

    return media.select(*rest, "media").mapInArrow(tidy(run), schema)
