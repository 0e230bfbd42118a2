"""Splits source text into logical lines (strings and comments blanked, headers over several lines joined),
and SQL into statements.

One pass over a file's tokens, whatever a literal's length.  A parenthesis that is open at the end of a line
joins the next ones to it, as long as no brace opens in it, so that a header is one line; so does an import's
brace.  Line numbers stay: what is joined leaves empty lines behind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

LINES = {"path": "string", "line": "int", "text": "string", "clean": "string", "params": "array<string>", "inside": "int", "last": "int", "before": "int", "opener": "int", "closer": "int", "group": "string"}
TOKENS = re.compile(
    r'''(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))'''
    r'''|(?P<string>@"(?:[^"]|"")*+"?|"""[\s\S]*?(?:"""|\Z)|"(?:[^"\\\n]|\\[\s\S])*+"?|'(?:[^'\\\n]|\\[\s\S])*+'?|`(?:[^`\\$]|\\[\s\S]|\$\{(?:[^{}`]|`[^`]*`|\{[^{}`]*\})*+\}|\$)*+`?)'''
    r'''|(?P<slash>/)|(?P<newline>\r\n|\n|\r)|(?P<mark>[(){}])|(?P<rest>[^/"'`@\n\r(){}]++|.)'''
)
REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*")
#: A slash behind one of these begins a regular expression, not a division.
BEFORE_REGEX = frozenset("(,=:[!&|?{};+-*%~^<>")
#: What stands as it is in a line, and a string without escapes that ends on its line.
_BARE, _STRING = r"""[^/"'`@\n\r(){}]++""", r"""\"(?!\"\")[^"\\\n\r]*+\"|'[^'\\\n\r]*+'"""
#: A line without comments whose strings and parentheses close on it, with no brace in these: but for its strings it is as it stands.
PLAIN = re.compile(rf"""((?:{_BARE}|{_STRING}|[{{}}]|\((?:{_BARE}|{_STRING}|\((?:{_BARE}|{_STRING})*+\))*+\))*+)(?:\r\n|\n)""")
QUOTED = re.compile(r"""(["']).*?\1""")
#: Braces of an import or export that close on its line.
PAIR = re.compile(r"[^{}]*\{[^{}]*\}[^{}]*")
BRINGS = re.compile(r"\s*(?:import|export)\b")
#: Words whose parenthesis groups declarations, one on each line.
GROUPS = re.compile(r"^\s*(?:import|type|const|var)\s*$")


def logical_lines(content: str) -> list[tuple[str, str, int]]:
    """(text, clean, its last line) of each line."""
    out: list[tuple[str, str, int]] = [("", "", 1)]
    text, clean = [], []  # of the logical line that began last
    first, depth, importing, last, at = 0, 0, False, "", 0
    held: list[int] = []  # open parentheses around braces that may close on the same line

    def close(last_line: int) -> None:
        out[first] = ("".join(text), "".join(clean), last_line)

    plain, size = PLAIN.match, len(content)
    while at < size:
        if not text and (m := plain(content, at)):
            s = m[1]
            blank = QUOTED.sub(r"\1\1", s) if "'" in s or '"' in s else s
            if "{" not in blank or not BRINGS.match(blank) or PAIR.fullmatch(blank):
                out[first] = (s, blank, len(out))
                first, at = len(out), m.end()
                out.append(("", "", first + 1))
                last = bare[-1] if (bare := s.rstrip()) else last
                continue
        m = TOKENS.match(content, at)
        kind, s = m.lastgroup, m[0]
        if kind == "slash" and (not last or last in BEFORE_REGEX) and (r := REGEX.match(content, at)):
            kind, s = "string", r[0]
        at += len(s)
        if kind in ("comment", "string"):
            lines = re.split(r"\r\n|\n|\r", s)
            text.append(lines[0])
            if kind == "string":
                clean.append(s[0] * 2 if s[0] in "\"'`" else '""')
                last = '"'
            for line in lines[1:]:  # what follows on its last line belongs to that line
                joined = depth > 0 or kind == "string"
                out.append(("", "", len(out) + 1))
                if joined:
                    text.append(" " + line)
                else:
                    close(len(out) - 1)
                    first, text, clean = len(out) - 1, [line], []
            if kind == "comment":
                clean.append(" ")
        elif kind == "newline":
            out.append(("", "", len(out) + 1))
            held.clear()
            if depth > 0:
                text.append(" ")
                clean.append(" ")
            else:
                close(len(out) - 1)
                first, text, clean, importing = len(out) - 1, [], [], False
        else:
            text.append(s)
            if s == "(":
                depth += not (depth == 0 and len(clean) < 8 and GROUPS.match("".join(clean)))
            elif s == ")":
                depth = max(0, depth - 1)
            elif s == "{":
                importing = importing or len(clean) < 12 and bool(re.match(r"\s*(?:import|export)\s*(?:type\s*)?(?:\w+\s*,\s*)?$", "".join(clean)))
                if not importing:
                    held.append(depth)
                depth = depth + 1 if importing else 0
            elif s == "}":
                if importing:
                    depth, importing = max(0, depth - 1), False
                elif held:
                    depth = held.pop()
            clean.append(s)
            if s.strip():
                last = s.rstrip()[-1]
    close(len(out))
    return out


#: A parenthesis with nothing nested.
FLAT = re.compile(r"\(([^()\[\]{}<>]*+)\)")


def parameters(clean: str) -> list[str]:
    """What stands between the first parenthesis and its end, parted at commas that nothing nests."""
    at = clean.find("(")
    if at < 0:
        return []
    if m := FLAT.match(clean, at):
        return [p.strip() for p in m[1].split(",") if p.strip()]
    out, depth, start = [], 0, at + 1
    for k in range(at, len(clean)):
        c = clean[k]
        if c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and clean[k - 1] != "=":
            depth -= 1
            if depth == 0:
                out.append(clean[start:k])
                break
        elif c == "," and depth == 1:
            out.append(clean[start:k])
            start = k + 1
    return [p.strip() for p in out if p.strip()]


BRANCH = re.compile(r"\b(?:if|else|while|switch|do)\b[^{};]*$|\bfor\b[^{}]*$")
UNBRACED = re.compile(r"(?:^|[\s}])(?:(?:else\s+)?if|for|while)\s*\(.*\)\s*$|\b(?:else|do)\s*$")


def branches(clean: list[str]) -> list[int]:
    """How many blocks of branches and loops are open where each line begins; a line below a branch without a
    brace counts as in one more."""
    out, blocks, pending, unbraced, count = [], [], "", False, 0
    for line in clean:
        out.append(count + (unbraced and bool(line.strip())))
        at = 0
        for m in re.finditer(r"[{}]", line) if "{" in line or "}" in line else ():
            if m[0] == "{":
                blocks.append(bool(BRANCH.search(pending + line[at : m.start()])))
                count += blocks[-1]
            elif blocks:
                count -= blocks.pop()
            pending, at = "", m.end()
        if tail := line.rstrip():
            unbraced = tail.endswith((")", "else", "do")) and bool(UNBRACED.search(line))
            pending = line[at:] + " " if unbraced else ""
    return out


#: The word of a parenthesis that groups declarations, and what ends it.
GROUP = re.compile(r"\s*(?:(import|type|const|var)\s*\(|(\)))", re.A)


def braces(clean: list[str]) -> Iterator[tuple[int, int, int, str | None]]:
    """(open braces where it begins, where it ends, the least in it, the word of the group that it stands in) of each line."""
    after, group = 0, None
    for line in clean:
        before = after
        if "{" in line or "}" in line:
            after += line.count("{") - line.count("}")
            yield before, after, min(after, before - line.partition("{")[0].count("}")), group
        else:
            yield before, before, before, group
        if (group or "(" in line) and (m := GROUP.match(line)):
            group = m[1]


def blocks(clean: list[str]) -> tuple[list[int], list[int], list[int | None], list[str | None]]:
    """Of each line the open braces where it begins, the last line before it that opened a block of that depth by a
    brace behind other text (0: none), the first line from it on in which a block of that depth closes, and its group."""
    befores, opener, groups, opened, ends = [], [], [], {}, []
    for k, (line, (before, after, low, group)) in enumerate(zip(clean, braces(clean), strict=True)):
        befores.append(before)
        opener.append(opened.get(before, 0))
        groups.append(group)
        if before == after and "{" not in line and "}" not in line:
            continue
        opens = "{" in line
        if opens and line.strip(" \t\n\x0b\f\r") != "{":
            opened[before + 1] = k + 1
        if low < before:
            ends.append((k, range(low, before)))
        elif opens and after <= before:  # what opens and closes on the line closes at the line's own depth
            ends.append((k, (before,)))
    closer, closes, top = [None] * len(clean), {}, len(clean)
    for k, depths in reversed(ends):
        if closes:
            closer[k + 1 : top] = map(closes.get, befores[k + 1 : top])
        closes.update(dict.fromkeys(depths, k + 1))
        top = k + 1
    closer[:top] = map(closes.get, befores[:top])
    return befores, opener, closer, groups


def in_batches(rows: Iterator[tuple], columns: list[tuple[str, pa.DataType]], size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Rows of small files together, of large ones in parts."""
    part = []
    names, kinds = [c for c, _ in columns], [k for _, k in columns]
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield made()
            part.clear()
    if part:
        yield made()


_TEXT, _INT = pa.string(), pa.int32()
_KINDS = {"string": _TEXT, "int": _INT, "array<string>": pa.list_(_TEXT)}
_STATEMENT = [("path", _TEXT), ("text", _TEXT), ("line", _INT), ("column", _INT), ("endLine", _INT)]


def files_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


#: Lines that can't declare anything.
BARE = frozenset(("", "{", "}", "};", ")", "(", ");", "});"))


def lines(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], bare: bool = True, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Logical lines of files (path, content), with some columns of LINES; without ``bare`` only those that may declare something."""
    kinds = [_KINDS[LINES[c]] for c in columns]
    held: dict[str, list] = {c: [] for c in columns}

    def made() -> Iterator[pa.RecordBatch]:
        batch = pa.RecordBatch.from_arrays([pa.array(held[c], k) for c, k in zip(columns, kinds, strict=True)], list(columns))
        for c in columns:
            held[c] = []
        yield from (batch.slice(k, size) for k in range(0, batch.num_rows, size))

    for path, content in files_of(batches):
        found = logical_lines(content or "")
        clean = [c for _, c, _ in found]
        keep = [k for k, c in enumerate(clean) if bare or c.strip() not in BARE]
        own = {"text": [t for t, _, _ in found], "clean": clean, "last": [z for _, _, z in found]}
        if "inside" in held:
            own["inside"] = branches(clean)
        if "before" in held:
            own["before"], own["opener"], own["closer"], own["group"] = blocks(clean)
        for c, out in held.items():
            if c == "path":
                out.extend([path] * len(keep))
            elif c == "line":
                out.extend([k + 1 for k in keep])
            elif c == "params":
                out.extend([parameters(clean[k]) for k in keep])
            else:
                of = own[c]
                out.extend([of[k] for k in keep])
        if len(held[columns[0]]) >= size:
            yield from made()
    if held[columns[0]]:
        yield from made()


SQL_TOKENS = re.compile(r"(?P<comment>--[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>'(?:[^']|'')*+'?|\"[^\"]*+\"?)|(?P<end>;)|(?P<rest>[^'\";/-]++|.)", re.S)
STATEMENTS = "path string, text string, line int, column int, endLine int"
_BLANKS = " \t\n\x0b\f\r"


def sql_statements(content: str) -> list[tuple[str, int]]:
    """Statements and the number of line feeds before each; comments become white space, strings hide semicolons."""
    out, own, above, feeds = [], [], 0, 0
    for m in SQL_TOKENS.finditer(content):
        s = m[0]
        feeds += s.count("\n")
        if m.lastgroup == "end":
            out.append(("".join(own), above))
            own, above = [], feeds
        else:
            own.append("\n" * s.count("\n") if m.lastgroup == "comment" else s)
    return [*out, ("".join(own), above)]


def placed(content: str) -> Iterator[tuple[str, int, int, int]]:
    """(text, line, column, endLine) of statements that aren't blank, without the white space before them."""
    for whole, above in sql_statements(content):
        text = whole.lstrip(_BLANKS)
        if text:
            lead = whole[: len(whole) - len(text)]
            line = above + lead.count("\n") + 1
            yield text, line, len(lead) - lead.rfind("\n") - 1, line + text.rstrip(_BLANKS).count("\n")


def statements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SQL statements of files (path, content)."""
    return in_batches(((path, *own) for path, content in files_of(batches) for own in placed(content or "")), _STATEMENT)


def blanked(content: str) -> str:
    """The text at its length and in its lines, with comments as blanks and strings as their marks around ``_``."""
    out, last, at = [], "", 0
    while at < len(content):
        m = TOKENS.match(content, at)
        kind, s = m.lastgroup, m[0]
        if kind == "slash" and (not last or last in BEFORE_REGEX) and (r := REGEX.match(content, at)):
            kind, s = "string", r[0]
        at += len(s)
        if kind == "comment":
            out.append(re.sub(r"[^\r\n]", " ", s))
        elif kind == "string":
            out.append(s[0] + re.sub(r"[^\r\n]", "_", s[1:-1]) + s[-1] if len(s) > 1 else s)
            last = '"'
        else:
            out.append(s)
            last = s.rstrip()[-1] if s.strip() else last
    return "".join(out)
