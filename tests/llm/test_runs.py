"""Periodic runs."""

import hashlib
import random
import zlib

import pytest

from srcloom.llm import runs


def brute_runs(words, shortest):
    """All (start, length, period) by trying each period."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            z = s
            while z + q < n and words[z] == words[z + q]:
                z += 1
            if z - s >= q and z + q - s >= shortest:
                out.setdefault((s, z + q - s), q)  # the smallest period comes first
            s = z + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def brute_edges(words, up):
    rank = {w: k for k, w in enumerate(sorted(set(words), reverse=not up))}
    suffix = [[rank[w] for w in words[k:]] for k in range(len(words))]
    out = set()
    for i in range(len(words)):
        j = next((j for j in range(i + 1, len(words)) if suffix[j] < suffix[i]), None)
        equal = 0
        while j is not None and j + equal < len(words) and words[i + equal] == words[j + equal]:
            equal += 1
        if equal:
            out.add((i, j, equal))
    return out


def texts():
    random.seed(13)
    for k in range(400):
        letters = "abcdefgh"[: 1 + k % 6]
        yield [random.choice(letters) for _ in range(random.randrange(60))]
    a, b = "a", "ab"
    for _ in range(7):
        a, b = b, b + a
        yield list(b)
    thue = "a"
    for _ in range(7):
        thue += thue.translate(str.maketrans("ab", "ba"))
        yield list(thue)
    for k in range(100):
        unit = [random.choice("abc") for _ in range(1 + k % 9)]
        yield [random.choice("abc") for _ in range(k % 7)] + (unit * 9)[: random.randrange(60)] + [random.choice("abc") for _ in range(k % 5)] + (unit * 3)[: random.randrange(20)]


@pytest.mark.parametrize("up", [True, False])
def test_edges_match_brute_force(up):
    for words in texts():
        assert set(runs.lyndon_edges(words, up)) == brute_edges(words, up), words


@pytest.mark.parametrize("shortest", [2, 12])
def test_runs_match_brute_force(shortest):
    for words in texts():
        assert runs.runs_of(words, shortest) == brute_runs(words, shortest), words


class Counted(str):
    """A word that counts how often it is compared."""

    seen = 0

    def __eq__(self, other):
        Counted.seen += 1
        return str.__eq__(self, other)

    def __lt__(self, other):
        Counted.seen += 1
        return str.__lt__(self, other)

    def __ne__(self, other):
        return not self == other

    __hash__ = str.__hash__


@pytest.mark.parametrize("kind", ["one", "two", "fibonacci", "thue", "nested", "random"])
def test_comparisons_are_linear(kind):
    n = 20_000
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    thue = "a"
    while len(thue) < n:
        thue += thue.translate(str.maketrans("ab", "ba"))
    nested = "a"
    for c in "bcdefghijklmn":
        nested += c + nested
    random.seed(5)
    text = {"one": "a" * n, "two": "ab" * (n // 2), "fibonacci": b, "thue": thue, "nested": nested, "random": "".join(random.choice("ab") for _ in range(n))}[kind][:n]
    words = [Counted(c) for c in text]
    for up in (True, False):
        Counted.seen = 0
        for _ in runs.lyndon_edges(words, up):
            pass
        assert Counted.seen < 7 * len(words)
    Counted.seen = 0
    runs.runs_of(words)
    assert Counted.seen < 24 * len(words)


def brute_report(doc_id, text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words, 12)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *head, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_report_matches_brute_force(spark):
    random.seed(3)
    rows = [(k, " ".join(random.choice(["a", "b", "ab", "é", "　x", "\x1c"]) for _ in range(random.randrange(120))), "z") for k in range(300)]
    rows += [(1000, None, "z"), (1001, "", "z"), (1002, " \t\n\x0b\x0c\r ", "z"), (1003, "a " * 30, "z"), (1003, "a " * 30, "z"), (-7, "x y " * 40, None)]
    got = runs.run_report(spark.createDataFrame(rows, "doc_id long, text string, runs string")).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:8] for r in got), key=key) == sorted((brute_report(d, t) for d, t, _ in rows), key=key)
    assert sum(r.n_runs > 0 for r in got) > 20
    none = runs.run_report(spark.createDataFrame([(None, "a b " * 10)], "doc_id long, text string")).collect()
    assert none[0].doc_id is None and (none[0].start, none[0].length, none[0].period) == (0, 20, 2)
    assert runs.run_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_of_a_very_long_text(spark):
    got = runs.run_report(spark.createDataFrame([(2, "p q r " * 100_000 + "s")], "doc_id long, text string")).collect()[0]
    assert (got.n_runs, got.start, got.length, got.period, got.exponent_milli) == (1, 0, 300_000, 3, 100_000_000)


def test_runs_on_the_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {tuple(r)[:8] for r in runs.run_report(docs).collect()}
    assert got == {brute_report(r.doc_id, r.text) for r in docs.collect() if len((r.text or "").split()) < 1500} | {x for x in got if x[0] in {r.doc_id for r in docs.collect() if len((r.text or "").split()) >= 1500}}
