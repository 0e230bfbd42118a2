"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

Encoding.  ``sufficient_lookahead`` computes from the merge list how far the end of a text can reach
back.  Let two runs of the merges see the same prefix, one with more text behind it, and watch the
last symbol start that both have in common.  It moves left only by a merge (a, b) that one run makes
and the other doesn't; then b starts where the symbol of the previous such merge started, that is, b
is that merge's left operand or grew from it by merges to its right, and the rank is higher.  So the
distance is at most the largest sum of left operands' lengths along such chains of rising rank, which
one pass over the merge list finds.  Tokens that end that many bytes before the end of what has been
seen can be emitted: no continuation changes them.

Each text is a stream through its ``Transducer``, chunk by chunk: pieces (what merges never cross) are
emitted once nothing that follows can change where they end, and a piece longer than the lookahead and the
longest token is streamed itself, by ``LongPiece``.  A transducer holds one chunk and one such window,
whatever the length of its text.  The machines of neighbouring texts go in step (``feed_in_step``,
``close_in_step``): one pass finds the pieces of all their windows, and each settles and keeps its own.  Behind them,
``merge_flat`` merges many pieces in step, and a cache of bounded size remembers the ids of short pieces.

Decoding is a state machine from ids to text that holds at most the bytes of one unfinished character.

Defined results: null and empty texts have no ids and decode to the empty text; the special token's
string is one id wherever it stands; repeated rows have equal results; extra columns pass through
where their names don't clash with the result's.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcloom.llm.bytes_kernel import OTHER, SLICE, SPACE, PieceCache, byte_classes, distinct_pieces, pieces, ragged, utf8_column
from srcloom.llm.tasks import tidy

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NONE = np.int64(1 << 40)
#: Bytes that a transducer takes at once.
CHUNK = 1 << 16


def byte_letters() -> dict[str, int]:
    """The vocabulary's letter for each byte: printable Latin-1 stands for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token that settle it; see the module's text."""
    reach: dict[bytes, int] = {}
    left: dict[bytes, bytes] = {}
    most = 1
    for a, b in merges:
        far, spine = 0, b
        while spine is not None:
            far = max(far, reach.get(spine, 0))
            spine = left.get(spine)
        far += len(a)
        most = max(most, far)
        if far > reach.get(a, 0):
            reach[a] = far
        left.setdefault(a + b, a)
    return most


class Vocabulary:
    """A byte-level BPE vocabulary with its merges in order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_letters()
        raw = lambda s: bytes(back[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        self.token = [b""] * self.size
        for t, i in vocab.items():
            if t.encode() not in self.specials:
                self.token[i] = raw(t)
        for t, i in self.specials.items():
            self.token[i] = t
        self.lookahead = sufficient_lookahead([(raw(a), raw(b)) for a, b in merges])
        self.longest = max(map(len, self.token))
        #: Bytes of a piece that are held before tokens are emitted from it.
        self.window = self.lookahead + self.longest
        self.of_byte = np.zeros(256, np.int64)
        for c, b in back.items():
            self.of_byte[b] = vocab[c]
        # open addressing: pair of ids -> rank and merged id
        bits = max(8, int(np.ceil(np.log2(len(merges) * 4 + 1))))
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.rank, self.made = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE), np.zeros(1 << bits, np.int64)
        self.probes = 1
        pairs = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        for r, ((a, b), key, h) in enumerate(zip(merges, pairs.tolist(), self._hash(pairs).tolist(), strict=True)):
            step = 1
            while self.keys[h] >= 0:
                h, step = (h + 1) & self.mask, step + 1
            self.probes = max(self.probes, step)
            self.keys[h], self.rank[h], self.made[h] = key, r, vocab[a + b]
        self.bytes_of = np.frombuffer(b"".join(self.token), np.uint8)
        self.token_len = np.array([len(t) for t in self.token], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.text_of = [str(i) for i in range(self.size)]

    def _hash(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """Places of pairs in the table; a place whose rank is NONE where the pair has no merge."""
        at = self._hash(pairs)
        todo = np.flatnonzero((self.keys[at] != pairs) & (self.keys[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            k = self.keys[at[todo]]
            todo = todo[(k != pairs[todo]) & (k >= 0)]
        return at

    def merge_flat(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the symbols of many words in step; word: to which word each symbol belongs, ascending.

        In each round every word that has a merge left makes its lowest one, wherever it occurs in it.
        """
        if len(ids) < 2:
            return ids, word
        same = np.append(word[:-1] == word[1:], False)
        rank, made = self._merges(ids, np.append(ids[1:], 0), same)
        at = np.arange(len(ids))
        out = []
        while True:
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(word)))
            low = np.minimum.reduceat(rank, first)
            if not (low < NONE).all():
                going = np.repeat(low < NONE, size)
                out.append((ids[~going], word[~going], at[~going]))
                ids, word, at, rank, made = (x[going] for x in (ids, word, at, rank, made))
                size, low = size[low < NONE], low[low < NONE]
            if not len(ids):
                break
            hit = np.flatnonzero(rank == np.repeat(low, size))
            if len(hit) > 1 and (np.diff(hit) == 1).any():  # one symbol again and again merges two by two from the left
                new = np.append(True, np.diff(hit) != 1)
                hit = hit[(np.arange(len(hit)) - np.flatnonzero(new)[np.cumsum(new) - 1]) % 2 == 0]
            ids[hit] = made[hit]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            spot = hit - np.arange(len(hit))
            ids, word, at, rank, made = (x[keep] for x in (ids, word, at, rank, made))
            stale = np.unique(np.concatenate([spot, np.maximum(spot - 1, 0)]))
            nxt = np.minimum(stale + 1, len(ids) - 1)
            rank[stale], made[stale] = self._merges(ids[stale], ids[nxt], (word[stale] == word[nxt]) & (nxt > stale))
        ids, word, at = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(at, kind="stable")
        return ids[order], word[order]

    def _merges(self, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = np.where(same, a * self.size + b, -2)
        place = self.find(pair)
        return np.where(self.keys[place] == pair, self.rank[place], NONE), self.made[place]

    def encode_pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (whole pieces) one after the other, and how many each has."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        odd = {int(k): np.concatenate(list(LongPiece(self).whole(words[k]))) for k in np.flatnonzero(lens > self.window)}
        for s, i in self.specials.items():
            odd |= {int(k): np.array([i], np.int64) for k in np.flatnonzero(lens == len(s)) if words[k] == s}
        usual = np.ones(len(words), bool)
        usual[list(odd)] = False
        pick = np.flatnonzero(usual)
        data = np.frombuffer(b"".join([words[k] for k in pick]), np.uint8)
        ids, word = self.merge_flat(self.of_byte[data], np.repeat(np.arange(len(pick)), lens[pick]))
        out_n = np.zeros(len(words), np.int64)
        out_n[pick] = np.bincount(word, minlength=len(pick))
        for k, v in odd.items():
            out_n[k] = len(v)
        at = np.cumsum(out_n) - out_n
        out = np.zeros(int(out_n.sum()), np.uint32)
        out[ragged(at[pick], out_n[pick])] = ids
        for k, v in odd.items():
            out[at[k] : at[k] + len(v)] = v
        return out, out_n


class LongPiece:
    """Streams the bytes of one piece of any length to token ids; it holds the bytes that aren't settled."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.held = vocab, b""

    def feed(self, more: bytes, spare: int = 0) -> np.ndarray:
        """Ids that no continuation changes, even if the last ``spare`` bytes don't belong to the piece."""
        v = self.vocab
        self.held += more
        if len(self.held) <= v.window + spare:
            return np.zeros(0, np.int64)
        ids, _ = v.merge_flat(v.of_byte[np.frombuffer(self.held, np.uint8)], np.zeros(len(self.held), np.int64))
        ends = np.cumsum(v.token_len[ids])
        stable = int(np.searchsorted(ends, len(self.held) - v.lookahead - spare, side="right"))
        if stable:
            self.held = self.held[int(ends[stable - 1]) :]
        return ids[:stable]

    def close(self) -> np.ndarray:
        v = self.vocab
        ids, _ = v.merge_flat(v.of_byte[np.frombuffer(self.held, np.uint8)], np.zeros(len(self.held), np.int64))
        self.held = b""
        return ids

    def whole(self, piece: bytes, chunk: int = 4096) -> Iterator[np.ndarray]:
        for k in range(0, len(piece), chunk):
            yield self.feed(piece[k : k + chunk])
        yield self.close()


class Transducer:
    """Streams the bytes of one text to token ids: ``feed`` takes whole characters and returns the ids that
    are settled, ``close`` the rest.  A piece is settled when what follows can't change its end; a piece that
    is longer than the window is streamed itself.  It holds a window and one chunk, whatever the text's length."""

    def __init__(self, vocab: Vocabulary, cache: PieceCache | None = None, chunk: int = CHUNK):
        self.vocab, self.cache, self.chunk = vocab, cache or PieceCache(vocab.encode_pieces, 4096), chunk
        self.specials = tuple(vocab.specials)
        self.spare = max([4, *(len(s) for s in self.specials)])
        self.text, self.piece, self.kind = b"", None, OTHER

    @property
    def window(self) -> bytes:
        """What it holds."""
        return self.text if self.piece is None else self.piece.held + self.text

    def feed(self, more: bytes) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        a = 0
        while a < len(more):
            b = min(len(more), a + self.chunk)
            while b < len(more) and more[b] & 0xC0 == 0x80:
                b += 1
            self.text += more[a:b]
            a = b
            while self.text:
                before = len(self.text), self.piece
                out += self._in_text() if self.piece is None else self._in_piece()
                if (len(self.text), self.piece) == before:
                    break
        return np.concatenate(out)

    def close(self) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        if self.piece is not None:
            out.append(self.piece.close())
            self.piece = None
        if self.text:
            out.append(self._ids(self.text, np.array([0, len(self.text)])))
            self.text = b""
        return np.concatenate(out)

    def _ids(self, text: bytes, off: np.ndarray, upto: int | None = None) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        cuts = pieces(data, off, self.specials)
        return self._of(data, cuts if upto is None else cuts[: upto + 1])

    def _of(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        words, codes = distinct_pieces(data[: cuts[-1]], cuts)
        if not len(codes):
            return np.zeros(0, np.int64)
        slots = self.cache.lookup(words)[codes]
        return self.cache.ids[ragged(self.cache.starts[slots], self.cache.lens[slots])].astype(np.int64)

    def _begun(self, text: bytes) -> int:
        """Bytes at the end that may be the start of a special string."""
        return max((k for s in self.specials for k in range(1, len(s)) if text.endswith(s[:k])), default=0)

    def _in_text(self) -> list[np.ndarray]:
        """Ids of the settled pieces of ``text``; a last piece that is too long becomes ``piece``."""
        data = np.frombuffer(self.text, np.uint8)
        cuts = pieces(data, np.array([0, len(data)]), self.specials)
        begun = self._begun(self.text)
        last = min(len(cuts) - 2, int(np.searchsorted(cuts[1:], len(data) - begun, side="right")))
        long = last == len(cuts) - 2 and cuts[-1] - cuts[-2] > self.vocab.window + self.spare
        if cuts[last + 1] - cuts[last] < 8:  # a contraction may begin one piece earlier
            last = max(0, last - 1)
        for _ in range(3):  # white space before a special string is one piece
            last -= bool(begun and last and byte_classes(data[: cuts[last]])[-1] == SPACE)
        out = [self._of(data, cuts[: last + 1])] if last else []
        self.text = self.text[int(cuts[last]) :]
        if long:
            self.piece, self.kind = LongPiece(self.vocab), int(byte_classes(data[-4:] if (data[-1] & 0x80) == 0 else data[_last_char(data) :])[-1])
            out.append(self.piece.feed(self.text, self.spare))
            self.text = b""
        return out

    def _in_piece(self) -> list[np.ndarray]:
        """Ids of the long piece, which goes on to the first character of another class or a special string."""
        text, held = self.text, self.piece.held
        other = np.flatnonzero(byte_classes(np.frombuffer(text, np.uint8)) != self.kind)
        stop = int(other[0]) if len(other) else len(text)
        tail = held[len(held) - self.spare :]
        found = [at - len(tail) for s in self.specials if (at := (tail + text).find(s)) >= 0]
        ended = stop < len(text)
        if found and min(found) <= stop:
            stop, ended = min(found), True
        if not ended:
            self.text = b""
            return [self.piece.feed(text, self.spare)]
        if not found and 0 < (begun := self._begun(tail + text)) and len(text) - begun <= stop:
            return []  # a special string may begin in the piece
        whole = held + text
        end = len(held) + stop
        if self.kind == SPACE and not (found and stop == min(found)):  # the last blank goes with what follows
            end = _last_char(np.frombuffer(whole[:end], np.uint8))
        self.piece.held, self.text = whole[:end], whole[end:]
        out = [self.piece.close()]
        self.piece = None
        return out


def _placed(n: np.ndarray, own: np.ndarray, singly: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of machines in order: ``own`` has those of all machines but the ones in ``singly``, n how many each has."""
    for k, ids in singly.items():
        n[k] = len(ids)
    if not singly:
        return n, own
    at, out = np.cumsum(n) - n, np.zeros(int(n.sum()), np.int64)
    rest = np.ones(len(n), bool)
    rest[list(singly)] = False
    out[ragged(at[rest], n[rest])] = own
    for k, ids in singly.items():
        out[at[k] : at[k] + n[k]] = ids
    return n, out


def _in_step(machines: list[Transducer], texts: list[bytes], closing: bool) -> tuple[np.ndarray, np.ndarray]:
    """What machines outside long pieces settle of their windows, and what they keep is in their ``text``.  By the rules
    of ``Transducer._in_text``, which also takes the windows that end in the start of a special string or in a piece too long."""
    first = machines[0]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    n = np.zeros(len(machines), np.int64)
    if not off[-1]:
        return n, np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    cuts = pieces(data, off, first.specials)
    low, high = np.searchsorted(cuts, off[:-1]), np.searchsorted(cuts, off[1:])
    singly: dict[int, np.ndarray] = {}
    if closing:
        upto = high
        for m in machines:
            m.text = b""
    else:
        some = high > low
        size = np.where(some, cuts[high] - cuts[np.maximum(high - 1, 0)], 0)
        upto = np.where(some, np.maximum(high - 1 - (size < 8), low), low)  # a contraction may begin one piece earlier
        odd = some & ((size > first.vocab.window + first.spare) | np.fromiter(map(first._begun, texts), np.int64, len(texts)).astype(bool))
        kept = (cuts[upto] - off[:-1]).tolist()
        for k, (m, t) in enumerate(zip(machines, texts, strict=True)):
            if odd[k]:
                m.text, upto[k] = b"", low[k]
                singly[k] = m.feed(t)
            else:
                m.text = t[kept[k] :]
    words, codes = distinct_pieces(data, cuts)
    chosen = ragged(low, upto - low)
    slots = first.cache.lookup(words)[codes[chosen]]
    each = first.cache.lens[slots]
    own = first.cache.ids[ragged(first.cache.starts[slots], each)].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(each)])
    at = np.concatenate([[0], np.cumsum(upto - low)])
    n[:] = ends[at[1:]] - ends[at[:-1]]
    return _placed(n, own, singly)


def feed_in_step(machines: list[Transducer], chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``feed`` of machines of one vocabulary and cache, a chunk each: how many ids each settles, and the ids in order."""
    ready = [k for k, (m, c) in enumerate(zip(machines, chunks, strict=True)) if m.piece is None and len(c) <= m.chunk]
    singly = {k: machines[k].feed(chunks[k]) for k in set(range(len(machines))) - set(ready)}
    n = np.zeros(len(machines), np.int64)
    some, own = _in_step([machines[k] for k in ready], [machines[k].text + chunks[k] for k in ready], False) if ready else (0, np.zeros(0, np.int64))
    n[ready] = some
    return _placed(n, own, singly)


def close_in_step(machines: list[Transducer]) -> tuple[np.ndarray, np.ndarray]:
    """``close`` of machines of one vocabulary and cache."""
    ready = [k for k, m in enumerate(machines) if m.piece is None]
    singly = {k: machines[k].close() for k in set(range(len(machines))) - set(ready)}
    n = np.zeros(len(machines), np.int64)
    some, own = _in_step([machines[k] for k in ready], [machines[k].text for k in ready], True) if ready else (0, np.zeros(0, np.int64))
    n[ready] = some
    return _placed(n, own, singly)


def _last_char(data: np.ndarray) -> int:
    """Where the last character begins."""
    at = len(data) - 1
    while at and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


class Decoder:
    """Ids to text; its state is the bytes of a character that isn't complete."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.state = vocab, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        v = self.vocab
        return self.state.decode(v.bytes_of[ragged(v.token_at[ids], v.token_len[ids])].tobytes())

    def close(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_rows(col, vocab: Vocabulary, cache: PieceCache, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Token ids of a text column in order of rows: rows, their numbers of ids here, the ids.

    Each text is fed to a transducer of its own.  One of more than CHUNK bytes comes in parts, chunk by chunk; the
    machines of shorter ones are fed and closed in step with their neighbours'.
    """
    data, off = utf8_column(col)
    lens = np.diff(off)
    k = 0
    while k < len(lens):
        if lens[k] > CHUNK:
            machine, text = Transducer(vocab, cache), data[off[k] : off[k + 1]]
            a = 0
            while a < len(text):
                b = min(len(text), a + CHUNK)
                while b < len(text) and text[b] & 0xC0 == 0x80:
                    b += 1
                ids = machine.feed(text[a:b].tobytes())
                yield np.array([k]), np.array([len(ids)]), ids
                a = b
            ids = machine.close()
            yield np.array([k]), np.array([len(ids)]), ids
            k += 1
            continue
        j = k
        while j < len(lens) and lens[j] <= CHUNK and (j == k or off[j + 1] - off[k] <= size):
            j += 1
        raw, at = data[off[k] : off[j]].tobytes(), (off[k : j + 1] - off[k]).tolist()
        machines = [Transducer(vocab, cache) for _ in range(k, j)]
        settled, ids = feed_in_step(machines, [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
        rest, tail = close_in_step(machines)
        n = settled + rest
        begin, both = np.cumsum(n) - n, np.zeros(int(n.sum()), np.int64)
        both[ragged(begin, settled)], both[ragged(begin + settled, rest)] = ids, tail
        ids = both
        yield np.arange(k, j), n, ids
        k = j


def encode_text(text: str, vocab: Vocabulary) -> list[int]:
    """Ids of one text."""
    return [int(x) for _, _, ids in encode_rows(pa.array([text], pa.string()), vocab, PieceCache(vocab.encode_pieces)) for x in ids]


def bpe_encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``, the token ids (array of int) of ``text``; null and empty texts have an empty array."""
    rest = [c for c in docs.columns if c != out]
    schema = docs.select(*rest).schema.add(out, T.ArrayType(T.IntegerType()))

    def run(batches):
        vocab = vocabulary(path)
        cache = PieceCache(vocab.encode_pieces)
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                lens, parts = np.zeros(batch.num_rows, np.int64), [np.zeros(0, np.int64)]
                for rows, n, ids in encode_rows(batch.column(text), vocab, cache):
                    np.add.at(lens, rows, n)
                    parts.append(ids)
                flat = np.concatenate(parts).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*rest, out])

    return docs.select(*rest).mapInArrow(tidy(run), schema)


def bpe_decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds ``out``, the text of the token ids in ``ids``; a null array decodes to the empty text."""
    rest = [c for c in docs.columns if c != out]
    schema = docs.select(*rest).schema.add(out, "string")

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            texts = []
            for x in batch.column(ids):
                machine = Decoder(vocab)
                own = np.array(x.as_py() or [], np.int64)
                texts.append("".join([*(machine.feed(own[k : k + 65536]) for k in range(0, len(own), 65536)), machine.close()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*rest, out])

    return docs.select(*rest).mapInArrow(tidy(run), schema)


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every whole text and returns doc_id, the number of ids and digests of the ids
    and of the decoded text; ids and texts never leave the task, so nothing is shuffled."""

    def digest(col, vocab: Vocabulary, cache: PieceCache) -> Iterator[tuple[int, str, str]]:
        name, at = vocab.text_of, -1
        for rows, n, ids in encode_rows(col, vocab, cache):
            ends = np.cumsum(n).tolist()
            for row, a, b in zip(rows.tolist(), [0, *ends], ends, strict=False):
                if row != at:
                    if at >= 0:
                        text_hash.update(machine.close().encode())
                        yield count, ids_hash.hexdigest(), text_hash.hexdigest()
                    at, ids_hash, text_hash, machine, count = row, hashlib.sha256(), hashlib.sha256(), Decoder(vocab), 0
                if b > a:
                    own = ids[a:b]
                    ids_hash.update((("," if count else "") + ",".join([name[i] for i in own.tolist()])).encode())
                    text_hash.update(machine.feed(own).encode())
                    count += b - a
        if at >= 0:
            text_hash.update(machine.close().encode())
            yield count, ids_hash.hexdigest(), text_hash.hexdigest()

    def run(batches):
        vocab = vocabulary(path)
        cache = PieceCache(vocab.encode_pieces)
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                n, sha, back = zip(*digest(batch.column(1), vocab, cache), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), ENCODED)
