"""Numpy kernels over UTF-8 columns: splitting into the pieces of the byte-level tokenizer, ragged gathers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel handles at once.
SLICE = 1 << 20
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def utf8_column(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and their offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    lens = lens.astype(np.int64)
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    return np.repeat(starts.astype(np.int64) - before, lens) + np.arange(total)


def slices(data: np.ndarray, off: np.ndarray, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cuts a column into slices of about ``size`` bytes: bytes, offsets of pieces, document of each piece.

    A document longer than a slice is cut between an ASCII character that is no white space and a
    blank, where the tokenizer's own pattern always cuts too; where it has no such place it stays whole.
    """
    n = len(off) - 1
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, side="right")) - 1
        if j > i:
            yield data[off[i] : off[j]], off[i : j + 1] - off[i], np.arange(i, j)
            i = j
            continue
        a, end = int(off[i]), int(off[i + 1])
        while a < end:
            b, at = end, a + size
            while at < end:
                part = data[at - 1 : min(end, at + 65536)]
                hit = np.flatnonzero((part[1:] == 0x20) & (part[:-1] > 0x20) & (part[:-1] < 0x80))
                if len(hit):
                    b = at + int(hit[0])
                    break
                at += 65535
            yield data[a:b], np.array([0, b - a], np.int64), np.array([i])
            a = b
        i += 1


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    for a in range(0, 0x110000, 0x800):
        if a != 0xD800:  # surrogates
            every = "".join(map(chr, range(a, a + 0x800)))
            for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
                for m in regex.finditer(pattern, every):
                    table[a + m.start() : a + m.end()] = kind
    return table


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    table = _classes()
    cls = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = np.concatenate([data, np.zeros(4, np.uint8)])
        b0, b1, b2, b3 = (b[lead + k].astype(np.int64) for k in range(4))
        two, three = b0 < 0xE0, (b0 >= 0xE0) & (b0 < 0xF0)
        cp = np.where(two, (b0 & 0x1F) << 6 | b1 & 0x3F, np.where(three, (b0 & 0x0F) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F, (b0 & 7) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | b3 & 0x3F))
        kind = table[cp]
        for k in range(4):
            own = (k < 2) | (~two & (k < 3)) | ~(two | three)
            cls[lead[own] + k] = kind[own]
    return cls


def pieces(data: np.ndarray, off: np.ndarray, specials: tuple[bytes, ...] = ()) -> np.ndarray:
    """Starts of the tokenizer's pieces, and the end: what its split pattern would match, text by text.

    Runs of one class are pieces; the last blank before other text joins what follows; a contraction
    is a piece of its own; strings in ``specials`` are pieces whatever stands around them.
    """
    n = len(data)
    if not n:
        return np.zeros(1, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    cls = byte_classes(data)
    whole = data.tobytes() if specials else b""
    held = []
    for s in specials:
        at = whole.find(s)
        while at >= 0:
            a, b = at, at + len(s)
            if not edge[a + 1 : b].any():
                edge[a] = edge[b] = True
                cls[a:b] = OTHER
                held.append((a, b))
            at = whole.find(s, b)
    new = edge[:-1].copy()
    new[1:] |= cls[1:] != cls[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    kind = cls[start]
    last = edge[end]
    cut = new
    # white space before other text: all but its last character, then that one
    k = np.flatnonzero((kind == SPACE) & ~last)
    at = end[k] - 1
    for _ in range(3):
        at = np.where((data[at] & 0xC0) == 0x80, at - 1, at)
    cut[at] = True
    joins = data[at] == 0x20
    joined = np.zeros(n + 1, bool)
    joined[end[k[joins]]] = True
    cut[end[k[joins]]] = False
    # contractions
    k = np.flatnonzero((kind == OTHER) & (end - start == 1) & (data[start] == 0x27) & ~last & ~joined[start])
    if len(k):
        k = k[kind[np.minimum(k + 1, len(kind) - 1)] == LETTER]
        at, stop = end[k], end[np.minimum(k + 1, len(kind) - 1)]
        c0 = data[at]
        c1 = np.where(stop - at >= 2, data[np.minimum(at + 1, n - 1)], 0)
        one = np.isin(c0, np.frombuffer(b"stmd", np.uint8))
        two = ((c0 == 0x72) | (c0 == 0x76)) & (c1 == 0x65) | (c0 == 0x6C) & (c1 == 0x6C)
        take = np.where(one, 1, np.where(two, 2, 0))
        hit = take > 0
        cut[at[hit]] = False
        inside = hit & (at + take < stop)
        cut[(at + take)[inside]] = True
    for a, b in held:
        cut[a] = True
        cut[a + 1 : b] = False
        if b < n:
            cut[b] = True
    return np.append(np.flatnonzero(cut), n)


def distinct_pieces(data: np.ndarray, cuts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct pieces and, for each piece in order, which of them it is."""
    n = len(cuts) - 1
    if n <= 0 or not len(data):
        return [], np.zeros(0, np.int64)
    arr = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    enc = arr.dictionary_encode()
    return enc.dictionary.to_pylist(), enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)


class PieceCache:
    """Token ids of pieces seen before; it starts anew when it holds ``most`` pieces or KEY_BYTES of them, so
    memory is bounded."""

    KEY_BYTES = 1 << 24

    def __init__(self, encode, most: int = 300_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.size = 0
        self.starts, self.lens = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """Slots of words."""
        if len(self.slot) + len(words) > self.most or self.size > self.KEY_BYTES:
            self._clear()
        get = self.slot.get
        slots = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        miss = np.flatnonzero(slots < 0)
        if len(miss):
            new = [words[k] for k in miss]
            ids, lens = self.encode(new)
            first = len(self.slot)
            self.size += sum(map(len, new))
            self.slot.update(zip(new, range(first, first + len(new)), strict=True))
            self.starts, self.lens = self._room(self.starts, first + len(new)), self._room(self.lens, first + len(new))
            self.ids = self._room(self.ids, self.used + len(ids))
            self.lens[first : first + len(new)] = lens
            self.starts[first : first + len(new)] = self.used + np.cumsum(lens) - lens
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            slots[miss] = np.arange(first, first + len(new))
        return slots


def encode_column(col, cache: PieceCache, specials: tuple[bytes, ...], size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Token ids of a text column, slice by slice: documents, their numbers of ids here, the ids."""
    data, off = utf8_column(col)
    for part, poff, docs in slices(data, off, size):
        cuts = pieces(part, poff, specials)
        words, codes = distinct_pieces(part, cuts)
        if not len(codes):
            yield docs, np.zeros(len(docs), np.int64), np.zeros(0, np.uint32)
            continue
        slots = cache.lookup(words)[codes]
        lens = cache.lens[slots]
        ids = cache.ids[ragged(cache.starts[slots], lens)]
        upto = np.concatenate([[0], np.cumsum(lens)])
        edges = np.searchsorted(cuts[:-1], poff)
        yield docs, np.diff(upto[edges]), ids


def words(col, kinds: tuple[int, ...]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Words, runs of characters of the given classes, slice by slice: distinct words, which of them each
    word is, offsets of the pieces' words, document of each piece."""
    data, off = utf8_column(col)
    member = np.isin(np.arange(4), kinds)
    for part, poff, docs in slices(data, off):
        text = member[byte_classes(part)]
        edge = np.zeros(len(part) + 1, bool)
        edge[poff] = True
        start = np.flatnonzero(text & (edge[:-1] | np.append(True, ~text[:-1])[: len(text)]))
        kept = np.cumsum(text)
        cuts = np.append(kept[start] - 1, kept[-1] if len(kept) else 0)
        found, codes = distinct_pieces(part[text], cuts)
        yield found, codes, np.searchsorted(start, poff), docs


def words_by_row(col, kinds: tuple[int, ...], value) -> Iterator[np.ndarray]:
    """For each row, in order, ``value(distinct words)`` of its words as one array."""
    own: list[np.ndarray] = []
    last = -1
    for found, codes, at, docs in words(col, kinds):
        values = value(found)[codes] if found else value([])
        for k, d in enumerate(docs.tolist()):
            if d != last and last >= 0:
                yield np.concatenate(own)
                own = []
            last = d
            own.append(values[at[k] : at[k + 1]])
    if last >= 0:
        yield np.concatenate(own)
