"""Near duplicates, decontamination, JPEG, HTML, urls, chats, pipeline."""

import hashlib
import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import srcloom.llm.jaccard_join as jj
from srcloom.llm import chat, components, decontaminate, jpeg, site_style, url_filter

SF = "/root/testdata/sf0.001"


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)] + [(500, k) for k in range(501, 560)] + [(900, 900), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert got == {x: find(x) for x in list(root)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_links(rows):
    sets = [(d, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else None) for d, t in rows]
    links, root = Counter(), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and len(a & b) / len(a | b) >= 0.8:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (d, _) in enumerate(sets):
        least[find(k)] = min([x for x in (least.get(find(k)), d) if x is not None], default=None)
    return Counter((d, least[find(k)], links[k]) for k, (d, _) in enumerate(sets))


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 16)  # several blocks in a class
    random.seed(4)
    words = [f"w{k}" for k in range(400)]
    base = [random.choice(words) for _ in range(60)]
    rows = [(k, " ".join(random.choice(words) for _ in range(random.randrange(1, 40)))) for k in range(60)]
    for k in range(60):  # a group of near copies, one word changed in each
        own = list(base)
        own[random.randrange(3)] = random.choice(words)
        rows.append((100 + k, " ".join(own)))
    rows += [(200 + k, rows[0][1]) for k in range(5)] + [(300, None), (301, ""), (302, "  "), (303, "One"), (304, "one"), (305, "one two"), (5, rows[5][1]), (None, rows[7][1])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, node int")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jj.near_duplicates(docs).collect())
    assert got == brute_links(rows)
    kept = [r.doc_id for r in jj.keep_one(docs).collect()]
    classes = {c for _, c, _ in got if c is not None}
    assert sorted(x for x in kept if x is not None) == sorted(classes)
    assert jj.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["star", "template"])
def test_large_groups_of_different_copies_match_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(jj, "SKETCH_BLOCK", 128)  # several blocks in a bucket
    random.seed(12)
    fresh = (f"w{k}" for k in range(10**6))
    new = lambda n: [next(fresh) for _ in range(n)]
    if kind == "star":  # leaves are near the centre (0.82), and at 0.68 to each other
        centre = new(104)
        texts = [centre] + [[*centre[:52], *new(5), *centre[52:]] if k % 2 else [*centre[:-10], *new(10)] for k in range(300)]
    else:  # pairs of near copies in one template, at 0.6 or less to the others
        shared = new(94)
        texts = []
        for _ in range(300):
            own = new(32)
            texts += [shared + own, shared + own[:-6] + new(6)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_links(rows)


def test_star_in_large_buckets_is_connected(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**32, jj.PLACES, dtype=np.uint32)
    sets = [centre]
    for _ in range(300):  # leaves agree with the centre at the threshold, and too little with each other
        own = centre.copy()
        own[rng.permutation(jj.PLACES)[:26]] = rng.integers(0, 2**32, 26, dtype=np.uint32)
        sets.append(own)
    tokens = np.array(sets)
    paths = jj.paths_of(tokens, jj.runs_needed())
    order = rng.permutation(301).tolist()  # the centre has any number
    rows = [(order[k], d, p.tolist()) for k, (d, p) in enumerate(zip(jj.digests(tokens), paths, strict=True))]
    nodes = spark.createDataFrame(rows, "num long, sketch binary, paths array<long>")
    roots = components.connected_components(jj.candidate_links(nodes)).collect()
    assert len(roots) == 301 and len({r.root for r in roots}) == 1


def test_measured_recall_at_the_threshold(spark):
    """The query itself, with production parameters, on pairs of similarity 0.8 exactly: 16 of 20 shingles, and 160 of 200."""
    random.seed(80)
    rows, pairs = [], 0
    for words, cut, n in ((22, 20, 500), (184, 164, 100)):
        for _ in range(n):
            text = [f"w{random.getrandbits(40):x}" for _ in range(words)]
            other = text[:cut] + [f"w{random.getrandbits(40):x}" for _ in range(words - cut)]
            rows += [(2 * pairs, " ".join(text)), (2 * pairs + 1, " ".join(other))]
            pairs += 1
    got = {r.doc_id: r.class_id for r in jj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(pairs)) >= 0.995 * pairs
    assert len(set(got.values())) >= pairs  # nothing else is linked


def test_runs_reach_the_recall():
    assert 10 <= jj.runs_needed() <= 20 < jj.runs_needed(recall=1 - 1e-9)


def test_index_finds_all_above_the_threshold():
    random.seed(6)
    words = [f"w{k}".encode() for k in range(80)]
    items = [(k, " ".join(w.decode() for w in random.choices(words, k=random.randrange(3, 30))) + ". last words here") for k in range(50)]
    index = decontaminate.ItemIndex(items)
    passages = [index.lookup(random.choices([*words, b"other"], k=60)) for _ in range(200)]
    got = {(p, k): s for p, k, s in index.search(passages, 0.5)}
    impact = np.zeros((len(index.term), len(index.ids)))
    for c, a in enumerate(index.start.tolist()):
        own = slice(a, a + int(index.length[c]))
        impact[index.cell[c] // index.blocks, index.item[own]] = index.impact[own]
        assert set(index.item[own] // index.block) == {index.cell[c] % index.blocks} and index.cell_most[c] == index.impact[own].max()
    assert np.allclose(impact.sum(axis=0), 1)
    want = {}
    for p, x in enumerate(passages):
        score = impact[np.unique(x[x >= 0])].sum(axis=0)
        want |= {(p, k): s for k, s in enumerate(score) if s >= 0.5}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_pivots_skip_blocks():
    items = [(k, " ".join(f"w{k}x{j}" for j in range(12)) + " the of") for k in range(800)]
    index = decontaminate.ItemIndex(items)
    seen = []
    whole, index.cell_most = index.cell_most, type("Counted", (), {"__getitem__": lambda self, at: seen.append(len(at)) or whole[at]})()
    words = [w.encode() for w in items[700][1].split()]
    assert [k for _, k, _ in index.search([index.lookup(words)], 0.5)] == [700]
    assert sum(seen) == 14  # the pivot's block alone, of the 50 in which "the" and "of" are


def test_scores_do_not_depend_on_shards(spark):
    bench = spark.createDataFrame([(k, f"question {k} of word{k % 3} and more text{k}. The answer a{k} b{k}") for k in range(30)] + [(None, "x y z"), (5, None)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"so: question {k} of word{k % 3} and more text{k}. The answer a{k} b{k} it is") for k in range(30)], "doc_id long, text string")
    found = [sorted((r.doc_id, r.item_id, r.start, round(r.score, 9)) for r in decontaminate.contaminated(docs, bench, shard_chars=c).collect()) for c in (10**6, 300)]
    assert len(found[0]) == 30 and found[0] == found[1]


def test_windows_hold_each_run_whole():
    for n in range(1, 40):
        parts = list(decontaminate.windows(np.arange(n), 4))
        for k in range(n - min(n, 4) + 1):
            run = list(range(k, k + min(n, 4)))
            assert any(run == list(w[k - a : k - a + len(run)]) for a, w in parts if k >= a)


@pytest.mark.parametrize("chars", [250_000, 2000])
def test_decontamination(spark, chars):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    some = items[0].split()
    some[len(some) // 2] = "changed"
    extra = [(10**6, f"before {items[3].upper()} after"), (10**6 + 1, " ".join(some)), (10**6 + 2, None), (10**6 + 3, ""), (10**6 + 4, items[2][: len(items[2]) // 3])]
    whole = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("item_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(whole, bench, shard_chars=chars).collect()}
    want = {(d.doc_id, i) for d in docs.collect() for i, t in items.items() if t in d.text}
    assert want and got == want | {(10**6, 3), (10**6 + 1, 0)}
    clean = decontaminate.decontaminated(whole, bench, shard_chars=chars)
    assert clean.columns == whole.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in whole.collect()} - {d for d, _ in got}
    assert decontaminate.contaminated(whole, bench.limit(0)).count() == 0 == decontaminate.contaminated(whole.limit(0), bench).count()


def test_jpeg_round_trip():
    rng = np.random.default_rng(2)
    payloads = [rng.integers(0, 256, 64 * k).astype(np.uint8) for k in (1, 2, 9, 50, jpeg.MOST_ROWS + 3)] + [np.zeros(64, np.uint8), np.full(128, 255, np.uint8)]
    for p, images in zip(payloads, jpeg.thumbnails(jpeg.payload_jpegs(payloads)), strict=True):
        assert np.concatenate([g for _, _, g in images]).tobytes() == p.tobytes()
        assert images[0][0] == 512 and sum(h for _, h, _ in images) == 8 * (len(p) // 64)


def colour_jpeg(luma, chroma, ac):
    """A 4:2:0 JPEG, one scan without restarts, bit by bit: DC levels of Y (2 x 2 a unit) and of two chroma parts."""
    bits = ""
    codes, table = jpeg.huffman_codes(jpeg.DC_COUNTS, jpeg.DC_SYMBOLS), jpeg.huffman_codes((0, 2, 1, *(0,) * 13), (0x00, 0x03, 0xF0))
    code = lambda c: format(c[0], f"0{c[1]}b")
    last = [0, 0, 0]
    for y, x in np.ndindex(luma.shape[0] // 2, luma.shape[1] // 2):
        for c, level in [(0, luma[2 * y + a, 2 * x + b]) for a in (0, 1) for b in (0, 1)] + [(1, chroma[y, x]), (2, chroma[y, x])]:
            d = int(level) - last[c]
            last[c] = int(level)
            n = abs(d).bit_length()
            bits += code(codes[n]) + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "")
            if ac:
                bits += code(table[0xF0]) + code(table[0x03]) + "101"
            bits += code(table[0x00])
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    h, w = luma.shape[0] * 8, luma.shape[1] * 8
    return b"".join([
        b"\xff\xd8", jpeg._marker(0xE0, b"JFIF\0"), jpeg._marker(0xDB, bytes([0, 4, *[1] * 63])), jpeg._marker(0xDB, bytes([1, 9, *[1] * 63])),
        jpeg._marker(0xC0, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])),
        jpeg._marker(0xC4, bytes([0x00, *jpeg.DC_COUNTS, *jpeg.DC_SYMBOLS]) + bytes([0x10, 0, 2, 1, *(0,) * 13, 0x00, 0x03, 0xF0])),
        jpeg._marker(0xDA, bytes([3, 1, 0x00, 2, 0x00, 3, 0x00, 0, 63, 0])), scan, b"\xff\xd9",
    ])


@pytest.mark.parametrize("ac", [False, True])
def test_colour_jpeg_with_subsampling(ac):
    rng = np.random.default_rng(3)
    luma, chroma = rng.integers(-200, 200, (4, 6)), rng.integers(-90, 90, (2, 3))
    ((w, h, grey),) = jpeg.thumbnails([colour_jpeg(luma, chroma, ac)])[0]
    assert (w, h) == (48, 32)
    assert np.array_equal(grey, np.clip(np.round(luma * 4 / 8 + 128), 0, 255).astype(np.uint8))


def test_bad_jpegs_raise():
    good = jpeg.payload_jpegs([np.arange(128, dtype=np.uint8)])[0]
    for bad in (b"no", good[:-2], good[:100], good.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            jpeg.thumbnails([bad])


def test_media_query(spark):
    rows = [(1, "aé" * 100), (2, None), (2, ""), (3, "x" * 64), (4, "x" * 65), (5, "long text " * 60000), (None, "aé" * 100)]
    got = jpeg.media_features(jpeg.store_media(spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, media int"))).collect()
    assert len(got) == len(rows)
    want = {}
    for d, t in rows:
        raw = (t or "").encode()
        whole = raw + bytes(-len(raw) % 64 if raw else 64)
        want[d, len(raw)] = (len(whole), hashlib.sha256(whole).hexdigest())
    assert {(r.doc_id, r.n_bytes): (r.payload_bytes, r.payload_sha256) for r in got} == want
    table = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, media int")
    assert sorted(map(repr, jpeg.media_features(jpeg.stored_media(table)).collect())) == sorted(map(repr, got))
    assert jpeg.media_features(jpeg.stored_media(table.limit(0))).count() == 0
    same = [r for r in got if r.n_bytes == 300]
    assert same[0].feature == same[1].feature and same[0].media_sha256 == same[1].media_sha256


def test_main_text(spark):
    page = lambda k, text: f"<html><head><title>t</title><style>p{{}}</style></head><body><div class='box{k}'>Same words everywhere</div><div class='body'><p>{text}<p>second &amp; {k}</div><footer>f</footer></body></html>"
    rows = [(k, f"http://h.example/{k}", page(k, f"Text  number\n{k}")) for k in range(20)]
    rows += [(50, "http://x/", None), (51, None, ""), (52, "nothing", "plain &lt;text&gt;"), (53, "http://y/", "<article><h1>T</h1><p><b>One<br><p>two<aside>no</aside></article><p>out"), (54, "http://z/", "<main>a<script>var t='</p>'</script><div id='comments'><p>bad</p></div>b</main>"), (55, "http://w/", "<p>open <div>inner</div> tail &middot;<ul><li>a<li>b</ul>")]
    got = {r.page_id: r.text for r in site_style.main_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")).collect()}
    assert all(got[k] == f"Text number {k}\nsecond & {k}" for k in range(20))
    assert [got[k] for k in range(50, 56)] == ["", "", "plain <text>", "T\nOne\ntwo", "a\nb", "open\ninner\ntail ·\na\nb"]
    assert site_style.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_tree(rows):
    """Importances by html tag paths, from pages of nested divs without attributes but class."""
    pages, seen = [], {}
    for _, url, html in rows:
        stack, own = [], {}
        for tag, text in re.findall(r"<([^>]*)>([^<]*)", html):
            if tag.startswith("/"):
                stack.pop()
            else:
                sign = re.sub(r"(\w+) class='?(\w+)'?", lambda m: f"{m[1]}.{re.sub('[0-9]+', '0', m[2])}", tag)
                if stack:
                    own[tuple(stack)][0].append(sign)
                stack.append(sign)
                own.setdefault(tuple(stack), ([], []))[0].append("|")
            if text.strip():
                own[tuple(stack)][1].append(" ".join(text.split()))
        pages.append((url.split("/")[2], max((" ".join(t) for _, t in own.values()), key=len, default=""), own))
    for host, body, own in pages:
        for path, (kids, text) in own.items():
            runs = [k for k, before in zip(kids, [None, *kids]) if k == "|" or k != before]
            seen.setdefault((host, path), set()).add((body, " ".join(runs), " ".join(text)))
    out = {}
    for (host, path), found in seen.items():
        n = len(found)
        share = [math.exp(-sum(c / n * math.log(c / n) for c in Counter(x[side] for x in found).values())) / n for side in (1, 2)]
        key = 0
        for sign in path:
            key = site_style.path_key(key, sign)
        out[host, key] = (n, *share)
    return out


def random_pages(n):
    random.seed(9)
    rows = []
    for k in range(n):
        menu = "".join(f"<div class='item{j}'>item {j}</div>" for j in range(random.randrange(3)))
        rows.append((k, f"http://{'ab'[k % 3 == 0]}.example/{k}", f"<body><div class='menu{k}'>{menu}</div><div>{'same' if k % 2 else k}</div><section><p>text {random.randrange(n)} of a page</p></section><div class='ad'>buy {k % 3}</div></body>"))
    return rows


def test_style_tree_matches_brute_force(spark):
    rows = random_pages(40)
    rows += [(99, "http://a.example/copy", rows[1][2]), (98, "http://a.example/q", "<body><div>q</div></body>")]
    got = {(r.host, r.path): (r.pages, r.presentation, r.content) for r in site_style.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = brute_tree(rows)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_the_tree_decides(spark):
    """Without the tree each of these would be wrong: the box and the advert would stay, the lead and the
    section that are named like adverts would go."""
    page = lambda k, body: f"<body><div class='x'>Rotated box {k % 3}</div><div class='promo'>advert {k % 9}</div><div class='banner'>lead of story {k}</div><div>{body}</div></body>"
    rows = [(k, f"https://big.example/{k}", page(k, f"story {k} has words of its own")) for k in range(120)]
    rows += [(200 + k, f"https://copies.example/{k}", page(k, "one story that is mirrored on every page of its host")) for k in range(120)]
    rows += [(400 + k, f"https://few.example/{k}", page(k, f"story {k}")) for k in range(5)]
    got = {r.page_id: r for r in site_style.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for k in range(120):
        assert got[k].text == f"lead of story {k}\nstory {k} has words of its own" and got[k].by_tree == 2
        assert got[200 + k].text.endswith("one story that is mirrored on every page of its host")
    for k in range(5):
        assert got[400 + k].text == f"Rotated box {k % 3}\nstory {k}" and got[400 + k].by_tree == 0
    alone = site_style.page_text(rows[0][2])[0]
    assert alone != got[0].text


def test_pages_of_any_shape(spark):
    text = site_style.page_text
    assert text("<article><p>a</p><span class='ad'>Buy <span>now</span> cheap</span> rest</article>")[0] == "a\nrest"
    assert text("<article><header><h1>T</h1></header><section class='related-work'>x</section><div class='related-posts'>no</div><div class='social-history'>y</div></article>")[0] == "T\nx\ny"
    assert text("<header>site</header><nav>n</nav><article class='comment'>c</article><div><p>main</p></div>")[0] == "main"
    assert text("<p>a<b>b<p>c</b><ul><li>d<li>e</ul><table><tr><td>f<td>g</table>")[0] == "ab\nc\nd\ne\nf\ng"
    deep = "<div>" * 20000
    assert text(deep + "x" + "<li>y" * 20000)[0].startswith("x\ny") and len(text("<p>" + "word " * 400_000)[0]) == 2_000_000 - 1
    odd = [(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (2, "http://h/", ""), (3, "http://h/", "</div></p><b>x")]
    got = site_style.main_text(spark.createDataFrame([(*r, "z") for r in odd], "page_id long, url string, html string, paths string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, "a", 1), (1, "a", 1), (2, "", 0), (3, "x", 1)]


def test_url_filter(spark):
    link = "<link rel='canonical' href='{}'>"
    rows = [
        (1, "https://A.example.net/en/x?q#f", None), (2, "https://b.net/", None), (3, "http://b.net", None), (4, "https://x.org/fr/1", None), (5, "http://de.example.com/de/1", None), (6, "https://notexample.net/en/", None),
        (7, None, None), (8, "no scheme", ""), (9, "", None), (10, "https://ok.example.com/a", link.format("https://b.net/p/")), (11, "https://www.ok.example.com/a/?utm_source=z", None),
        (12, "https://c.com/1", link.format("/2")), (13, "https://c.com/2", "<meta http-equiv='refresh' content='0; url=https://d.net/q'>"), (14, "https://d.net/q", None), (15, "https://c.com/3", None),
        (16, "https://e.com/1", link.format("https://f.org/fr/z")), (17, "https://g.net/a", link.format("https://e.com/1")), (2, "https://b.net/", None), (18, "https://ok.example.com/b://c.net/", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, rule int")).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("b.net", "/", "net/", "block")
    assert got[3] == ("b.net", "", None, "block")  # an alias of b.net/
    assert got[4][2:] == ("org/fr/", "allow") and got[5][2:] == ("example.com/de/", "block") and got[6][2:] == ("net/", "block")
    assert got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[10][3] == got[11][3] == "block"  # they name a blocked page, which the table doesn't hold
    assert got[12][3] == got[13][3] == "block" and got[14][3] == "block" and got[15][3] == "allow"
    assert got[16][3] == "allow" and got[17][2:] == ("net/", "block")
    assert got[18][:2] == ("ok.example.com", "/b://c.net/")
    many = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), *((f"h{k}.com", "/", "block") for k in range(url_filter.MOST_RULES))], "host string, path string, verdict string")
    joined = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), many).collect()}
    assert joined[1] == ("example.net/en/", "allow") and joined[2] == ("net/", "block") and joined[7] == (None, "allow")


def test_url_filter_follows_every_link_of_a_page(spark):
    own, refresh = "<link rel='canonical' href='{}'>", '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "https://a.com/1", own.format("https://a.com/1") + refresh.format("https://x.net/1")),
        (2, "https://a.com/2", own.format("https://a.com/2") + own.format("https://x.net/2")),
        (3, "https://a.com/3", refresh.format("/3") + refresh.format("https://x.net/3")),
        (4, "https://a.com/4", '<meta content="0; url=https://x.net/4" http-equiv="refresh">'),
        (5, "https://a.com/5", own.format("https://b.com/5?x=1&amp;y=2")), (6, "https://b.com/5?x=1&y=2", own.format("https://x.net/6")),
        (7, "https://a.com/7", own.format("https://a.com/7")), (8, "https://a.com/8", "no canonical link"),
    ]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "block" if k < 7 else "allow" for k in range(1, 9)}


def test_url_filter_matches_its_sql_on_pages_with_links(spark):
    import duckdb

    random.seed(14)
    urls = [f"http{random.choice(['', 's'])}://{random.choice(['', 'www.', 'm.'])}{h}.{t}/{p}{q}" for h in ("a", "b", "example") for t in ("com", "net", "org") for p in ("", "fr/1", "de/2", "en/3") for q in ("", "?ref=1", "?x=1&y=2", "/")]
    rows = []
    for k, url in enumerate(urls):
        target = random.choice(urls).replace("&", random.choice(["&", "&amp;"]))
        html = random.choice([None, "no link"]) if k % 3 else random.choice(["<link rel='canonical' href='{}'>", '<LINK href="{}" rel=canonical>', '<meta http-equiv="refresh" content="0; URL={}">', '<meta content="0;url={}" http-equiv=refresh>']).format(random.choice([target, target, "/fr/9", "next", "//c.net/"]))
        rows.append((k, url, html))
    rows += [(1000, None, None), (1001, "nothing", "<link rel=canonical href=/x>"), (3, *rows[3][1:])]
    got = Counter(tuple(r) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "host", "path", "rule", "verdict", "alias").collect())
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = Counter(db.execute(url_filter.SQL).fetchall())
    assert got == want and len({r[4] for r in want if r[3] is None}) == 2


def test_url_filter_resolves_dots(spark):
    rows = [(1, "https://a.com/x/y/z", "<link rel=canonical href='../../b'>"), (2, "https://a.com/b", "<link rel=canonical href='./../../c?q=1'>"), (3, "https://a.com/c?q=1", "<link rel=canonical href='https://x.net/1/../2'>"), (4, "https://a.com/d", None)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow"}


def test_url_filter_of_very_long_urls_and_pages(spark):
    n = 1_000_000
    link = "<link rel=canonical href='https://x.net/'>"
    rows = [
        (1, f"https://{'m.' * (n // 2)}x.com/", None), (2, f"https://{'a' * n}.com/", None), (3, "https://a.com/3", "<link rel=canonical " * (n // 20)), (4, "https://a.com/4", "<!-- canonical " * (n // 15) + link),
        (5, "https://a.com/5", "<link rel=canonical href=" + "x" * n), (6, "https://a.com/6", f"<link rel=canonical href='{'./../' * (n // 5)}q'>"), (7, "https://x.net/q", None), (8, "https://a.com/8", f"<link rel=canonical href='https://x.net/{'a/../' * (n // 5)}q'>"),
        (9, "https://a.com/9", "<link '" * (n // 7) + "canonical"), (10, "https://a.com/10", "canonical" + "<script>" * (n // 8)),
    ]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "block" if k in (7, 8) else "allow" for k in range(1, 11)}


def test_links_stand_in_markup_only(spark):
    link = "<link rel='canonical' href='https://x.net/{}'>"
    rows = [
        (1, "https://a.com/1", f"<!-- {link.format(1)} -->"), (2, "https://a.com/2", f"<script>'{link.format(2)}'</script>"), (3, "https://a.com/3", f"<!--> {link.format(3)} -->"), (4, "https://a.com/4", "<link title='a > b' rel='nofollow CANONICAL' href = \"https://x.net/4\" />"),
        (5, "https://a.com/5", "<link title=\"rel=canonical href='https://x.net/5'\">"), (6, "https://a.com/6", "<link rel='canonical' data-href='https://x.net/6'>"), (7, "https://a.com/7", "<link rel=canonical href=https://b.com/7 href=https://x.net/7>"), (8, "https://a.com/8", f"<textarea>{link.format(8)}</textarea><style>{link.format(8)}</style>"),
        (9, "https://a.com/9", f"<script>/* <!-- */</script>{link.format(9)}"), (10, "https://a.com/10", f"<!-- <script> -->{link.format(10)}"), (11, "https://a.com/11", "<meta http-equiv=Refresh content='5; URL = https://x.net/11'>"), (12, "https://a.com/12", "<link rel=canonical><link href=https://x.net/12>"),
    ]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k for k, v in got.items() if v == "block"} == {3, 4, 9, 10, 11}
    import duckdb

    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert {r[0]: r[4] for r in db.execute(url_filter.SQL).fetchall()} == got


def test_chats(spark):
    calls = spark.createDataFrame(
        [("c", "1", 0, "ask", '{"turn": 1, "text": "a\\"b"}', None), ("c", "2", 1, "ask", '{"text": 5}', "1"), ("c", "3", 2, "ask", "{bad", "2"), ("c", "4", 3, "other", "{}", "9"), ("c", "5", 4, "ask", '{"text":"é","turn":2,"x":{"b":1,"a":[2]}}', "6"), ("c", "6", 5, "ask", None, "5"), ("c", "1", 9, "ask", "{}", None), (None, "7", 1, "ask", "{}", None)],
        "conv_id string, call_id string, turn long, name string, arguments string, after string",
    )
    results = spark.createDataFrame([("c", "1", 1, "r1"), ("c", "1", 7, "late"), ("c", "2", 1, None), ("d", "3", 1, "x")], "conv_id string, call_id string, turn long, content string")
    found = chat.link_calls(calls, results).collect()
    assert sorted((r.conv_id, r.call_id, r.errors, r.json) for r in found if r.level is None) == [("c", "1", "repeated_result", '{"call_id":"1","result":"late"}'), ("d", "3", "no_call", '{"call_id":"3","result":"x"}')]
    got = {r.call_id: r for r in found if r.level is not None}
    assert len(got) == 6
    assert got["1"].json == '{"arguments":{"text":"a\\"b","turn":1},"call_id":"1","level":0,"name":"ask","result":"r1"}' and got["1"].errors == ""
    assert got["2"].errors == "type:text,missing:turn,result_before_call" and got["2"].level == 1 and json.loads(got["2"].json)["result"] is None
    assert got["3"].errors == "bad_json,no_result" and got["3"].level == 2
    assert got["4"].errors == "unknown_tool,no_result" and got["4"].level == 0
    assert got["5"].errors == "extra:x,no_result,cycle" and '"x":{"a":[2],"b":1}' in got["5"].json
    assert got["6"].level == -1 and got["6"].errors.startswith("bad_json")
    assert all(json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json for r in got.values())


def test_chat_tables(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", None), (1, 4, "assistant", '{"tool_calls":[{"id":"t1","name":"ask","arguments":"{\\"text\\":\\"q\\",\\"turn\\":4}"}]}'), (1, 5, "tool", '{"tool_call_id":"t1","content":"done"}'), (None, 1, "user", "x"), (2, None, "user", "y")]
    got = {r.call_id: r for r in chat.canonical_chats(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, level string")).collect()}
    assert set(got) == {"1:0", "1:1", "1:3", "t1"}
    assert [got[k].level for k in ("1:0", "1:1", "1:3", "t1")] == [0, 1, 2, 0]
    assert got["t1"].linked and got["t1"].errors == "" and got["1:1"].linked and not got["1:0"].linked
    assert chat.canonical_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_chats(rows):
    """(call_id, level, turn, name, linked, errors, result) of rows of plain turns."""
    rows = sorted({(str(c), t, r, x) for c, t, r, x in rows if c is not None and t is not None}, key=lambda x: (x[0], x[1], x[2] or "", x[3] is not None, x[3] or ""))
    calls, results, out = {}, {}, []
    for c, t, r, x in rows:
        before = [u for d, u, role, _ in rows if d == c and u < t and role in ("user", "system")]
        last = f"{c}:{max(before)}" if before else None
        if r in ("user", "system"):
            calls[f"{c}:{t}" if f"{c}:{t}" not in calls else f"{c}:{t}:{len(calls)}"] = (t, r, x, last)
        else:
            own = results.setdefault(last if r == "assistant" and last else f"{c}:{t}:result", [])
            own += [(t, x)] if (t, x) not in own else []  # results that agree in turn and text are one
    for k, (t, r, x, last) in calls.items():
        level, up = 0, last
        while up:
            level, up = level + 1, calls[up][3]
        first = min(results.get(k, []), key=lambda z: (z[0], z[1] is not None, z[1] or ""), default=None)
        errors = [*(["type:text"] if x is None else []), *([] if first else ["no_result"])]
        out.append((":".join(k.split(":")[:2]), level, t, "ask" if r == "user" else "configure", first is not None, ",".join(errors), first[1] if first else None))
    for k, found in results.items():
        found.sort(key=lambda z: (z[0], z[1] is not None, z[1] or ""))
        out += [(":".join(k.split(":")[:2]), None, t, None, False, "repeated_result" if k in calls else "no_call", x) for t, x in (found[1:] if k in calls else found)]
    return Counter(out)


def test_chats_match_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(chat, "STRETCH", 4)  # several stretches in a chat
    random.seed(15)
    rows = [(random.randrange(6), random.choice([None, *range(25)]), random.choice(["user", "assistant", "system", "user", "assistant", "critic", None]), random.choice([None, "a", "b", 'say "c"'])) for _ in range(260)]
    found = chat.canonical_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    got = Counter((":".join(r.call_id.split(":")[:2]), r.level, r.turn, r.name, r.linked, r.errors, json.loads(r.json)["result"]) for r in found)
    assert got == brute_chats(rows)


def test_long_chains_and_hot_conversations(spark):
    calls = spark.range(600).selectExpr("'c' AS conv_id", "cast(id AS string) AS call_id", "id AS turn", "'ask' AS name", "'{}' AS arguments", "cast(id - 1 AS string) AS after")
    assert {r.call_id: r.level for r in chat.levels(calls).collect()} == {str(k): k for k in range(600)}


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = {r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    rows = cp.run(spark, SF).collect()
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    classes = {(d, c) for d, c, _ in brute_links(texts)}
    want = {d for d, t in texts if (d, d) in classes and not any(b in t for b in bench) and any(ch.isalpha() for ch in t)}
    assert {r.doc_id for r in rows} == want and len(rows) == len(want)
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "One two", None, "s", 7), (3, "One two", None, "s", 7), *((k, f"three four five{k} six", "en", "s", 19) for k in range(4, 9))], docs.schema)
    for _, stage in cp.STAGES[:-1]:
        odd = stage(spark, odd, SF)
        assert odd.columns == docs.columns
    assert sorted(r.doc_id for r in cp.tokenize(spark, odd, SF).collect()) == [3, 4, 5, 6, 7, 8]
