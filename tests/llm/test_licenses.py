"""Licence scans."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from srcloom.llm import licenses as lc
from srcloom.llm.license_texts import PHRASES, TEMPLATES

SF = "/root/testdata/sf0.001"


def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_common(a, b):
    """Length of the longest common subsequence, and the shortest span of b that holds one."""
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
    return size[-1][-1]


def brute_spans(text):
    """(label, start, words, share) with the words themselves in place of hashes."""
    words, out = brute_words(text), set()
    for label, must, template in TEMPLATES:
        own, naming = brute_words(template), brute_words(must)
        shift = max(1, min(8, len(own) // 4))
        votes = defaultdict(set)
        for at in range(len(own) - 2):
            for place in range(len(words) - 2):
                if own[at : at + 3] == words[place : place + 3]:
                    votes[place - at].add(at)
        merged = {d: sum(len(v) for e, v in votes.items() if abs(e - d) <= shift) for d in votes}
        for d, n in merged.items():
            if n < max(1, 0.25 * (len(own) - 2)) or any((m, -e) > (n, -d) for e, m in merged.items() if abs(e - d) <= shift):
                continue
            room = shift + len(own) // 4
            lo = max(0, d - room)
            part = words[lo : max(0, d + len(own) + room)]
            common = brute_common(own, part)
            spans = sorted((z - a, z, a) for a in range(len(part)) for z in range(a + common, min(len(part), a + common + 40) + 1) if part[a] in own and brute_common(own, part[a:z]) == common) if common / len(own) >= 0.8 else []
            if spans:
                size, z, a = spans[0]
                share = common / max(len(own), size)
                held = part[a:z]
                if share >= 0.8 and (not naming or any(held[k : k + len(naming)] == naming for k in range(size))):
                    out.add((label, lo + a, size, round(share, 9)))
    return out


def brute_base(text):
    words = brute_words(text)
    places, labels = [], set()
    for phrase, label in PHRASES:
        own = phrase.split()
        found = [k for k in range(len(words)) if words[k : k + len(own)] == own]
        places += found
        labels |= {label} if found else set()
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))), labels


def made():
    random.seed(12)
    filler = "the of a under version software license terms released this work zebra é naïve 4 0 by".split()
    rows = []
    for k in range(160):
        label, _, text = TEMPLATES[k % len(TEMPLATES)]
        words = re.split(r"\s+", text)
        for _ in range(random.choice([0, 0, 1, 2, len(words) // 12])):
            at = random.randrange(len(words))
            words[at : at + random.choice([0, 1])] = random.choice([[], ["zebra"], ["quite", "new"]])
        noise = lambda: [random.choice(filler) for _ in range(random.randrange(12))]
        rows.append((k, random.choice([" ", "\n", " * ", "-"]).join([*noise(), *words, *noise()])))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "GNU  general-PUBLIC\nlicense? cc by. MIT Licenses, mit license"), (1004, "xcc by"), (1005, "cc byx cc"), (1006, "by cc"), (1007, "by the mit"), (1008, "license cc by cc by"), (1008, "license cc by cc by"), (1009, "éMIT license, MIT licenseé"), (None, "Released under the MIT License")]
    return rows


def test_scan_matches_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame([(*r, "x", b"k") for r in rows], "doc_id long, text string, labels string, key binary")
    got = lc.license_report(docs).collect()
    want = []
    for d, t in rows:
        base, labels = brute_base(t)
        spans = brute_spans(t)
        score = 1.0 if base[1] else max((s[3] for s in spans), default=0.0)
        want.append((d, *base, ",".join(sorted(labels | {s[0] for s in spans})), round(score, 9)))
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(((*tuple(r)[:7], round(r.score, 9)) for r in got), key=order) == sorted(want, key=order)
    assert sum(0 < r.score < 1 for r in got) > 20 and len({r.labels for r in got}) > 12
    assert lc.license_report(docs.limit(0)).count() == 0


def test_spans_match_brute_force(spark):
    rows = [(k, t) for k, t in made() if k is not None and k < 40]
    docs = lc._keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    keys = {bytes(r.key): r.doc_id for r in docs.select("doc_id", "key").collect()}
    got = defaultdict(set)
    for r in lc.license_spans(docs).collect():
        got[keys[bytes(r.key)]].add((r.label, r.start, r.words, round(r.share, 9)))
    for k, t in rows:
        # of spans with as many common words either may be taken where they are equally long
        assert {(a, c, d) for a, _, c, d in got[k]} == {(a, c, d) for a, _, c, d in brute_spans(t)}


def test_copies_and_large_template_tables(spark, monkeypatch):
    text = "x " * 50 + TEMPLATES[21][2] + " y" * 50
    docs = spark.createDataFrame([(k, text) for k in range(300)] + [(500, "plain")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in lc.license_report(docs).collect()}
    assert got == {**{k: ("mit", 1.0) for k in range(300)}, 500: ("", 0.0)} and brute_base(text)[1] == set()
    monkeypatch.setattr(lc, "MOST_GRAMS", 10)  # joined by a shuffle
    assert {r.doc_id: (r.labels, r.score) for r in lc.license_report(docs.where("doc_id > 290")).collect()} == {k: v for k, v in got.items() if k > 290}


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_hashes_do_not_depend_on_slices(monkeypatch, size):
    random.seed(2)
    text = " ".join("".join(random.choice("abé1") for _ in range(random.randrange(1, 30))) for _ in range(300)).encode()
    whole = lc.hashed_words(np.frombuffer(text, np.uint8))
    monkeypatch.setattr(lc, "SLICE", size)
    starts, hashes = lc.hashed_words(np.frombuffer(text, np.uint8))
    assert (starts == whole[0]).all() and (hashes == whole[1]).all()
    words = lc.words_of(text)
    assert len(words) == len(starts) and len({*zip(words, hashes.tolist())}) == len(set(words)) == len(set(hashes.tolist()))


def test_very_long_texts(spark):
    rows = [(1, "a" * 3_000_000), (2, "x " * 700_000 + "Released under the MIT License"), (3, "cc " * 400_000), (4, "gnu" + " " * 2_000_000 + "general public license")]
    got = {r.doc_id: r for r in lc.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].labels) == (1, "") and (got[2].n_words, got[2].first_word, got[2].labels) == (700_005, 700_003, "mit")
    assert (got[3].n_words, got[3].n_base) == (400_000, 0) and (got[4].n_words, got[4].first_word, got[4].labels) == (4, 0, "gpl")


def test_scan_of_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in lc.license_report(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for d, t in rows:
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t)[0]
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
