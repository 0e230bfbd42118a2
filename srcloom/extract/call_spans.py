"""Calls with their arguments, and functions without a name of their own, by matched brackets over any number of lines."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.extract.lexer import blanked, files_of, in_batches
from srcloom.functions.identity import entity_id
from srcloom.sources.files import language_of

OPEN, CLOSE = "([{", ")]}"
#: Looked for once in each run of word characters, from its first that may begin a name on, so that a long run costs no square.
CALLED = re.compile(r"(?:(?<![\w$])(?:(?![A-Za-z_])\w)*+|(?=#))([A-Za-z_$#][\w$]*+)\s*(?:<[\w$.\s,\[\]|&]*>\s*)?(?:\?\.\s*)?\(")
ARROW = re.compile(r"=>|\bfunction\b\s*\*?\s*(?:\w+\s*)?(?:<[^<>()]*>\s*)?(?=\()")
DECLARATOR = re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;]*)?=(?![=>])")
NOT_CALLED = frozenset("if for while switch catch function return typeof super constructor async await new import void delete throw in of instanceof yield case do else with".split())
GENERICS = re.compile(r"(?<=\w)<[\w$.\s,\[\]|&]*>(?=\s*\()")
BRANCHES = re.compile(r"\b(?:if|else|for|while|do|switch|try|catch|finally)\b|\?(?![.?:])")
#: What a line may end with, or the next begin with, where a statement goes on.
GOES_ON, COMES_ON = re.compile(r"[-+*/%&|^=<>?:,.!~({\[]\s*$"), re.compile(r"\s*(?:[-+*/%&|^=<>?:,.)\]}]|\{|in\b|instanceof\b)")
SITES = "path string, line int, column int, callee string, argument_count int, argument_types array<string>, argument_names array<string>, conditional boolean"
LAMBDAS = "path string, name string, line int, end_line int, is_async boolean, is_exported boolean"


class Brackets:
    """A blanked text with each bracket's partner."""

    def __init__(self, content: str):
        self.content = content
        self.text = GENERICS.sub(lambda m: " " * len(m[0]), blanked(content))
        self.partner, self.around, self.opens, stack = {}, {}, [], []
        for m in re.finditer(r"[()\[\]{}]", self.text):
            if m[0] in OPEN:
                self.around[m.start()] = stack[-1] if stack else -1
                self.opens.append(m.start())
                stack.append(m.start())
            elif stack:
                self.partner[stack[-1]], self.partner[m.start()] = m.start(), stack[-1]
                stack.pop()
        self.feeds = [m.end() for m in re.finditer(r"\r\n|\n|\r", self.text)]

    def line(self, at: int) -> int:
        return bisect_right(self.feeds, at) + 1

    def column(self, at: int) -> int:
        k = bisect_right(self.feeds, at)
        return at - (self.feeds[k - 1] if k else 0)

    def branches(self, at: int) -> bool:
        """Whether a branch, loop, ``try`` or ``?`` is around a place or before it in its statement."""
        k = bisect_right(self.opens, at - 1) - 1
        own = self.opens[k] if k >= 0 else -1
        while True:
            while own >= 0 and self.partner.get(own, len(self.text)) < at:
                own = self.around[own]
            lead = re.split(r"[;{}]", self.text[max(own + 1, at - 500, 0) : at])[-1]
            if BRANCHES.search(lead):
                return True
            if own < 0:
                return False
            at, own = own, self.around[own]

    def before(self, at: int) -> int:
        """The place of the last character before ``at`` that is no white space; -1 where there is none."""
        at -= 1
        while at >= 0 and self.text[at].isspace():
            at -= 1
        return at

    def end(self, at: int, stops: str) -> int:
        """Where the expression from ``at`` on ends: at one of ``stops`` outside brackets, a closing one, or a line's end."""
        for m in re.compile(r"[()\[\]{}\n]|" + "|".join(map(re.escape, stops))).finditer(self.text, at):
            if m.start() < at:
                continue
            c = m[0]
            if c in OPEN:
                if m.start() not in self.partner:
                    return len(self.text)
                at = self.partner[m.start()] + 1
            elif c in CLOSE or c in stops:
                return m.start()
            elif self.text[at : m.start()].strip() or self.before(m.start()) >= 0:
                line = self.text[max(0, m.start() - 200) : m.start()]
                if not GOES_ON.search(line) and not COMES_ON.match(self.text, m.end()):
                    return m.start()
        return len(self.text)

    def arguments(self, at: int) -> list[tuple[int, int]]:
        """Spans of what stands between the parenthesis at ``at`` and its partner, parted by commas."""
        out, start, k, end = [], at + 1, at + 1, self.partner[at]
        for m in re.compile(r"[(\[{,]").finditer(self.text, at + 1, end):
            if m.start() < k:
                continue
            if m[0] == ",":
                out.append((start, m.start()))
                start = m.end()
            else:
                k = self.partner.get(m.start(), end)
        out.append((start, end))
        return [(a, z) for a, z in out if self.text[a:z].strip()]

    def callee(self, at: int, end: int) -> int:
        """Where the expression begins whose last name stands at ``at``: over dots, calls and brackets before it."""
        while (dot := self.before(at)) >= 0 and self.text[dot] == ".":
            k = self.before(dot - (self.text[dot - 1 : dot] == "?"))
            while k >= 0 and self.text[k] in ")]" and k in self.partner:
                k = self.partner[k]
                k = k - 1 if k and re.match(r"[\w$)\]]", self.text[k - 1]) else k
            m = re.search(r"[\w$#]+$|[(\[\"'`]$", self.text[max(0, k - 100) : k + 1])
            if not m:
                break
            at = k + 1 - len(m[0])
        return at


def literal_type(text: str, source: str) -> str:
    """The type that an argument's text says; ``any`` where it says none."""
    text, source = text.strip(), source.strip()
    if re.fullmatch(r"-?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)", text) or text in ("true", "false", "null", "undefined"):
        return text
    if re.fullmatch(r"\"_*\"|'_*'", text):
        return '"' + source[1:-1] + '"'
    if re.fullmatch(r"`[_\s]*`", text):
        return "string"
    if re.fullmatch(r"/_*/|/[_\s]*[a-z]", text):
        return "RegExp"
    if m := re.match(r"new\s+([\w$.]+)", text):
        return m[1]
    return "any"


def spans(content: str) -> tuple[list[tuple], list[tuple]]:
    """Calls (place, callee, spans of arguments) and functions without a name (place, name, first and last place, async, exported)."""
    b = Brackets(content)
    calls = called(b)
    return calls, _unnamed(b, calls)


def called(b: Brackets) -> list[tuple]:
    """Calls (place, parenthesis, callee, spans of arguments)."""
    calls = []
    for m in CALLED.finditer(b.text):
        at = m.end() - 1
        if m[1] in NOT_CALLED or at not in b.partner:
            continue
        start = b.callee(m.start(1), at)
        head = re.search(r"([\w$]+)\s*$", b.text[max(0, start - 40) : start])
        ahead = re.match(r"\s*(\{|:(?!:)|=>)", b.text[b.partner[at] + 1 : b.partner[at] + 200])
        prior = b.before(start)
        if head and head[1] in ("function", "new", "get", "set", "async") or ahead and (ahead[1] != ":" or prior < 0 or b.text[prior] in "{;}" or head and head[1] in ("public", "private", "protected", "static", "abstract")):
            continue  # a declaration, or new
        calls.append((start, at, b.content[start : m.end(1)], b.arguments(at)))
    return calls


def _unnamed(b: Brackets, calls: list[tuple]) -> list[tuple]:
    variables = []
    for m in DECLARATOR.finditer(b.text):
        exported = bool(re.search(r"\bexport\s+$", b.text[max(0, m.start() - 20) : m.start()]))
        variables.append((m.start(1), b.end(m.end(), ";,"), m[1], exported))
    found = []
    for m in ARROW.finditer(b.text):
        if m[0] == "=>":
            head = re.search(r"(?:\)|([\w$]+))\s*(:[^()=;{}]*)?$", b.text[max(0, m.start() - 300) : m.start()])
            if head is None:
                continue
            if head[1] is None:
                close = max(0, m.start() - 300) + head.start()
                if close not in b.partner:
                    continue
                start = b.partner[close]
            else:
                start = max(0, m.start() - 300) + head.start(1)
            body = re.compile(r"\s*").match(b.text, m.end()).end()
            end = b.partner.get(body, len(b.text)) + 1 if b.text[body : body + 1] == "{" else b.end(body, ";,")
        else:
            prior = b.before(m.start())
            word = re.search(r"([\w$]+)\s*$", b.text[max(0, m.start() - 20) : m.start()])
            if prior < 0 or b.text[prior] in ";{}" or b.text[prior] == ")" or word and word[1] in ("export", "default", "async", "declare") and re.search(r"(?:^|[\n;{}])\s*(?:(?:export|default|async|declare)\s+)+$", b.text[max(0, m.start() - 60) : m.start()]) or b.line(prior) < b.line(m.start()) and not GOES_ON.search(b.text[: m.start()][-200:]):
                continue  # a declaration
            start = m.start()
            body = b.text.find("{", b.partner.get(m.end(), m.end()))
            end = b.partner.get(body, len(b.text)) + 1 if body >= 0 else len(b.text)
        word = re.search(r"\basync\s*$", b.text[max(0, start - 20) : start])
        found.append((start - (len(word[0]) if word else 0), end, bool(word)))
    return _named(b, calls, variables, sorted(found))


def _named(b: Brackets, calls, variables, found) -> list[tuple]:
    """Each function's name and place: those of the innermost variable around it, else of the innermost call that it is
    in an argument of.  One sweep over all places with a stack for each kind."""
    marks = [(a, 0, z, ("v", a, z, name, exported)) for a, z, name, exported in variables] + [(at, 0, b.partner[at], ("c", at, b.partner[at], name, args)) for _, at, name, args in calls] + [(a, 1, z, is_async) for a, z, is_async in found]
    stacks: dict[str, list] = {"v": [], "c": []}
    out = []
    for at, role, end, what in sorted(marks, key=lambda m: (m[0], m[1])):
        for own in stacks.values():
            while own and own[-1][2] <= at:
                own.pop()
        if role == 0:
            stacks[what[0]].append(what)
        elif stacks["v"]:
            _, a, z, name, exported = stacks["v"][-1]
            out.append((name, a, z, what, exported))
        elif stacks["c"]:
            _, _, _, name, args = stacks["c"][-1]
            place = next((k for k, (a, z) in enumerate(args) if b.text[a:z].strip() and a <= at and end <= z and not b.text[a:at].strip() and not b.text[end:z].strip()), -1)
            out.append((f"callback_{re.sub(r'[^a-zA-Z0-9_]', '_', name)[:30]}_arg{place}", at, end, what, False))
        else:
            out.append(("anonymousLambda", at, end, what, False))
    return [(name, b.line(a), b.line(max(a, z - 1)), is_async, exported) for name, a, z, is_async, exported in out]


def _sites_of(path: str, content: str) -> Iterator[tuple]:
    b = Brackets(content)
    for start, _, callee, args in called(b):
        texts = [(b.text[a:z], b.content[a:z]) for a, z in args]
        yield path, b.line(start), b.column(start), re.sub(r"\s+", "", callee), len(args), [literal_type(*t) for t in texts], [t.strip() if re.fullmatch(r"\s*[A-Za-z_$][\w$]*\s*", t) else None for t, _ in texts], b.branches(start)


def _sites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_())
    return in_batches((row for path, content in files_of(batches) for row in _sites_of(path, content or "")), list(zip([x.split()[0] for x in SITES.split(", ")], kinds, strict=True)))


def _lambdas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
    return in_batches(((path, *own) for path, content in files_of(batches) for own in spans(content or "")[1]), list(zip([x.split()[0] for x in LAMBDAS.split(", ")], kinds, strict=True)))


def call_sites(files: DataFrame) -> DataFrame:
    """(path, line, column, callee, argument_count, argument_types, argument_names, conditional) of all calls of files (path, content).

    A type is what the argument's text says: a literal itself, ``string`` of a template, the class behind ``new``, else
    ``any``; a name is that of an argument that is one name, else null.
    """
    return files.select("path", "content").mapInArrow(_sites, SITES)


def lambda_nodes(files: DataFrame) -> DataFrame:
    """Function nodes of arrow functions and function expressions: named and placed by the nearest variable around
    them, so those below one variable are one node; else ``callback_<callee>_arg<i>`` by the nearest call (-1 where they
    are inside an argument), else ``anonymousLambda``."""
    rows = files.select("path", "content").mapInArrow(_lambdas, LAMBDAS)
    ident = entity_id("function", F.concat_ws(":", "path", "name", F.col("line").cast("string")))
    rows = rows.select(
        ident.alias("entityId"), F.lit("Function").alias("kind"), "name", F.col("path").alias("filePath"), F.col("line").alias("startLine"), F.col("end_line").alias("endLine"), (F.col("end_line") - F.col("line") + 1).cast("int").alias("loc"), language_of(F.col("path")).alias("language"),
        F.col("is_async").alias("isAsync"), F.col("is_exported").alias("isExported"),
    )
    return rows.groupBy("entityId").agg(F.min(F.struct(*(c for c in rows.columns if c != "entityId"))).alias("x")).select("entityId", "x.*")
