"""Main text of pages by a site style tree.

Statistics.  The pages of a host are merged by the paths of their block elements (inline elements have
no part in a path; numbers in class names don't count; a path of any depth is known by a hash).  A path's
presentation is the sequence of its child blocks, runs counted once; its content is the text directly in
it.  The importance of each is its perplexity, the exponential of its entropy over the host's pages, as a
share of their number: 1 where all pages differ, and k / n where n pages rotate k variants evenly.  Pages
that agree in their largest content, such as mirrored articles, count once for each variant of a path, so
that copies don't make an article look like a template.

Extraction.  A branch's importance on a page is the largest in it.
- Branches without a mark go if it is below ``LEAST`` and their paths are on ``PAGES`` pages or more;
  what lies in an ``article`` or ``main`` stays, and so does the page's largest content, of those that
  aren't below ``LEAST`` if there are any.
- Branches with a mark (a ``header``, or a class or id that names adverts, notices, sidebars and the like)
  go if it is below ``MARKED``; where the path is on fewer than ``OVERRULE`` pages the mark alone decides,
  as variants seldom repeat on few pages.
- What the markup itself says to be no text of the article (``nav``, ``footer``, ``form``, ``script`` and
  others, roles, hidden elements), and readers' comments, goes always: it may differ on all pages.
A ``header`` in an article is part of it.  What stays is the text of ``article`` or ``main`` elements, or of
the body where the page has neither.  ``by_tree`` counts the text blocks that went on the tree's word.

Blocks are what block elements hold directly, between block tags; white space in a block becomes one
space, blocks are joined by one line feed.

Statistics are grouped counts with partial aggregation, keyed by host, path and value, so that a host with
a third of all pages is no hot group.  A host's judged paths are one row; it goes to the pages by broadcast
while the rows' size, which is measured, is below ``BROADCAST_PATHS``, and by a salted join beyond.

Defined results: null and empty html has the empty text; html without tags is one block; unclosed and
crossed tags are closed where a browser would (a block tag ends an open paragraph); a url without
``://`` belongs to the host ''; repeated rows are repeated; of equally large contents the first counts as the
largest; very long and deeply nested pages take time in proportion to their length; an empty table gives
no rows; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm.components import salted_join
from srcloom.llm.storage import materialize
from srcloom.llm.tasks import tidy
from srcloom.llm.url_filter import host_of

LEAST, MARKED, PAGES, OVERRULE, BROADCAST_PATHS = 0.25, 0.75, 8, 100, 200_000
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form script style noscript template head title button select option textarea iframe object svg canvas audio video dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words in a class or id that mark a branch as no part of the article; the tree may overrule them.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended toolbar widget".split())
#: The same for what readers write, which differs from page to page as articles do: no tree can tell it.
READERS = frozenset("comment comments commentlist commentary disqus discussion reply replies respond reactions".split())
#: Words that may stand beside those in one name; a name with any other word (related-work) isn't marked.
BESIDE = frozenset("area articles bar block bottom box btn button buttons column container content entry form foot group head holder icons inner item items left links list main module new outer page panel post posts right row section site slot stories text thread title top unit wrap wrapper".split())
#: Elements that end an open element of the same kind.
ENDS = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}


FREE, MARK, GONE = 0, 1, 2


@lru_cache(maxsize=4096)
def name_mark(name: str) -> int:
    """What one name of a class or id says."""
    words = [w for w in re.split(r"[^a-z]+", name.lower()) if w]
    if MARKS.isdisjoint(words) and READERS.isdisjoint(words) or any(len(w) > 2 and w not in MARKS | READERS | BESIDE for w in words):
        return FREE
    return MARK if READERS.isdisjoint(words) else GONE


def mark_of(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """Whether an element's name, class, id or role says that it is no part of the article."""
    if tag in DROPPED:
        return GONE
    out = MARK if tag == "header" else FREE
    for k, v in attrs:
        if k in ("class", "id") and v:
            out = max(out, *(name_mark(x) for x in v.split()), FREE)
        elif (k == "role" and (v or "").lower() in ROLES) or k == "hidden":
            return GONE
    return out


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


@lru_cache(maxsize=1 << 16)
def path_key(up: int, sign: str) -> int:
    return _digest(f"{up}>{sign}")


class Block:
    """A block element: its path's key, its place, its mark and child blocks."""

    __slots__ = ("children", "key", "mark", "sealed", "tag", "up")

    def __init__(self, tag: str, key: int, up: int, mark: int, sealed: bool):
        self.tag, self.key, self.up, self.mark, self.sealed = tag, key, up, mark, sealed
        self.children: list[str] = []


class PageParser(HTMLParser):
    """Blocks of a page in order, and its text runs with the block that holds each."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks = [Block("", 0, 0, FREE, False)]
        #: Places in blocks of the open elements (-1: an inline element in a marked one), and by tag where they are in it.
        self.stack = [(0, "")]
        self.open: dict[str, list[int]] = {}
        self.inline_marks = 0
        self.runs: list[tuple[int, list[str]]] = [(0, [])]

    def _top(self) -> int:
        return next(i for i, _ in reversed(self.stack) if i >= 0)

    def _break(self) -> None:
        self.runs.append((self._top(), []))

    def _close(self, at: int) -> None:
        for i, tag in self.stack[at:]:
            self.open[tag].pop()
            self.inline_marks -= i >= 0 and tag in INLINE
        del self.stack[at:]
        self._break()

    def _last(self, *tags: str) -> int:
        """Place in the stack of the last open element of these, or 0."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def _push(self, place: int, tag: str) -> None:
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((place, tag))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.runs[-1][1].append(" ")
        mark = mark_of(tag, attrs)
        if tag in INLINE and mark == FREE:
            if self.inline_marks and tag not in VOID:
                self._push(-1, tag)  # so that its end doesn't end the marked one
            return
        if tag in VOID:
            if tag == "hr":
                self._break()
            return
        if tag not in INLINE:
            at = self._last("p")
            if at and all(t == "p" or t in INLINE for _, t in self.stack[at:]):
                self._close(at)
            elif tag in ENDS:
                at = self._last(*ENDS[tag].split())
                if at > self._last("ul", "ol", "dl", "table", "select", "tbody", "thead", "tfoot"):
                    self._close(at)
        up = self._top()
        name = next((v for k, v in attrs if k in ("class", "id") and v), "")
        sign = tag + ("." + re.sub(r"\d+", "0", name.split()[0].lower()) if name.split() else "")
        sealed = self.blocks[up].sealed or tag in ("script", "style", "template", "noscript", "title")
        if tag in ("html", "body") or tag == "header" and mark == MARK and self._last("article", "main"):
            mark = FREE
        if not self.blocks[up].children or self.blocks[up].children[-1] != sign:
            self.blocks[up].children.append(sign)
        self._push(len(self.blocks), tag)
        self.inline_marks += tag in INLINE
        self.blocks.append(Block(tag, path_key(self.blocks[up].key, sign), up, mark, sealed))
        self._break()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        at = self._last(tag)
        if at:
            if self.stack[at][0] < 0:  # an inline element that is no block: nothing ends with it but others like it
                while len(self.stack) > at and all(i < 0 for i, _ in self.stack[at:]):
                    self.open[self.stack.pop()[1]].pop()
            else:
                self._close(at)
        elif tag in ("br", "p"):
            self._break()

    def handle_data(self, data: str) -> None:
        self.runs[-1][1].append(data)

    def texts(self) -> Iterator[tuple[int, str]]:
        """The text blocks, white space folded, each with the block element that holds it."""
        for k, run in self.runs:
            words = "".join(run).split()
            if words:
                yield k, " ".join(words)


def parse_page(html: str | None) -> PageParser:
    p = PageParser()
    p.feed(html or "")
    p.close()
    return p


def page_nodes(html: str | None) -> tuple[int, dict[int, tuple[int, int]]]:
    """Digest of the page's largest content, and of each path in the page digests of presentation and
    content (all its elements')."""
    p = parse_page(html)
    text: dict[int, list[str]] = {}
    kids: dict[int, list[str]] = {}
    for b in p.blocks[1:]:
        if not b.sealed:
            kids.setdefault(b.key, []).extend(["|", *b.children])
    for k, words in p.texts():
        b = p.blocks[k]
        if not b.sealed:
            text.setdefault(b.key, []).append(words)
    largest = max((" ".join(x) for x in text.values()), key=len, default="")
    return _digest(largest), {key: (_digest(" ".join(k)), _digest(" ".join(text.get(key, [])))) for key, k in kids.items()}


def page_text(html: str | None, judged: dict[int, tuple[float, int]] | None = None) -> tuple[str, int]:
    """The page's main text, and how many text blocks went on the tree's word.  judged: importance and number
    of pages of the host's paths."""
    p = parse_page(html)
    judged = judged or {}
    blocks, runs = p.blocks, list(p.texts())
    most, known = [], []  # of each branch: largest importance, least number of pages
    for b in blocks:
        importance, pages = judged.get(b.key, (1.0, 0))
        most.append(importance)
        known.append(pages)
    for k in range(len(blocks) - 1, 0, -1):
        up = blocks[k].up
        most[up] = max(most[up], most[k])
    size: dict[int, int] = {}
    for k, words in runs:
        if blocks[k].mark == FREE and not blocks[k].sealed:
            size[blocks[k].key] = size.get(blocks[k].key, 0) + len(words)
    body = max(size, key=lambda key: (judged.get(key, (1.0, 0))[0] >= LEAST, size[key]), default=None)
    main = {k for k, b in enumerate(blocks) if b.key == body}
    for k in range(len(blocks) - 1, 0, -1):
        if k in main:
            main.add(blocks[k].up)
    gone, inside, by_tree = [False], [False], [False]
    for k, b in enumerate(blocks[1:], 1):
        out, tree = gone[b.up], by_tree[b.up]
        within = inside[b.up] or b.tag in ("article", "main")
        if not out:
            if b.mark == GONE:
                out = True
            elif b.mark == MARK:
                tree = known[k] >= OVERRULE
                out = most[k] < MARKED or not tree
            elif not within and k not in main and most[k] < LEAST and known[k] >= PAGES:
                out = tree = True
        gone.append(out)
        by_tree.append(tree and out)
        inside.append(inside[b.up] or b.tag in ("article", "main") and not out)
    whole = any(inside)
    kept = [words for k, words in runs if not gone[k] and inside[k] == whole]
    return "\n".join(kept), sum(by_tree[k] for k, _ in runs)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, presentation, content): importances of each path of a host's merged pages."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                rows = []
                for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    body, nodes = page_nodes(html)
                    rows += [(host, path, body, *x) for path, x in nodes.items()]
                cols = [pa.array([r[i] for r in rows], pa.int64() if i else pa.string()) for i in range(5)]
                yield pa.RecordBatch.from_arrays(cols, ["host", "path", "body", "presentation", "content"])

    nodes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(tidy(run), "host string, path long, body long, presentation long, content long")
    sides = nodes.distinct().select("host", "path", F.explode(F.create_map(F.lit("presentation"), F.col("presentation"), F.lit("content"), F.col("content"))).alias("side", "value"))
    counts = sides.groupBy("host", "path", "side", "value").agg(F.count("*").alias("n"))
    sums = counts.groupBy("host", "path", "side").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("nlogn"))
    share = F.exp(-F.col("nlogn") / F.col("pages"))
    return sums.groupBy("host", "path").agg(F.max("pages").alias("pages"), F.max(F.when(F.col("side") == "presentation", share)).alias("presentation"), F.max(F.when(F.col("side") == "content", share)).alias("content"))


def judged_paths(tree: DataFrame, pages: int = PAGES) -> DataFrame:
    """(host, paths): importance and number of pages of a host's paths that are on so many pages."""
    return tree.where(F.col("pages") >= pages).groupBy("host").agg(F.collect_list(F.struct("path", F.greatest("presentation", "content").alias("importance"), "pages")).alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, by_tree of every row of pages (page_id, url, html)."""
    judged = materialize(judged_paths(style_tree(pages)), "judged")
    size = judged.agg(F.sum(F.size("paths"))).first()[0] or 0
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = rows.join(F.broadcast(judged), "host", "left") if size <= BROADCAST_PATHS else salted_join(rows, judged, "host", F.col("page_id"), "left")

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                out = []
                for html, host, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                    if host not in held:
                        if sum(map(len, held.values())) > BROADCAST_PATHS:
                            held.clear()
                        held[host] = {x["path"]: (x["importance"], x["pages"]) for x in own.as_py() or []}
                    out.append(page_text(html, held[host]))
                cols = [pa.array([t for t, _ in out], pa.string()), pa.array([len(t) for t, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["page_id", "url", "text", "n_chars", "by_tree"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "host", "paths").mapInArrow(tidy(run), f"page_id {kind}, url string, text string, n_chars long, by_tree long")
