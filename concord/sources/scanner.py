"""Imports and exports of script sources, read from the text alone.

A text is first masked: comments become blanks, and what stands in strings, templates and regular expressions
becomes filler of the same length, so that patterns over the masked text only ever meet code. Both steps are linear
in the text. A '/' after ')' is read as a division, and an exported variable statement lists its first plain name alone.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

NAME = "struct<name: string, shown: string, type_only: boolean>"
IMPORTS = f"kind string, reexport boolean, specifier string, literal boolean, line int, star boolean, names array<{NAME}>"
EXPORTS = "name string, line int, type_only boolean"

#: Words after which a '/' starts a regular expression.
BEFORE_EXPRESSION = {"return", "typeof", "case", "do", "else", "in", "of", "new", "delete", "void", "throw", "instanceof", "yield", "await"}
TOKEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^'\\\n]|\\.)*'?|"(?:[^"\\\n]|\\.)*"?|[A-Za-z0-9_$]+|\s+|.""", re.S)
FLAGS = re.compile("[a-z]*")
CHUNK = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)

STR = '("\x01*")'
WORD = r"(?<![\w$])(import|export|require)(?![\w$])"
LIST = r"\{([^{}]*)\}"
FROM = rf"(?<![\w$])from\s*{STR}"
STATIC = re.compile(rf"import(?:\s+(type)(?![\w$])(?!\s*from\s*\x22))?\s*(?:([A-Za-z_$][\w$]*)\s*,?\s*)?(?:(\*)\s*as\s+[\w$]+\s*|{LIST}\s*)?{FROM}")
BARE = re.compile(rf"import\s*{STR}")
EQUALS = re.compile(rf"import\s+(?:type\s+)?([\w$]+)\s*=\s*require\s*\(\s*{STR}\s*\)")
STAR = re.compile(rf"export(?:\s+(type))?\s*\*\s*(?:as\s+([\w$]+|{STR})\s*)?{FROM}")
LISTED = re.compile(rf"export(?:\s+(type))?\s*{LIST}(?:\s*{FROM})?")
DECLARED = re.compile(r"export\s+(?:declare\s+)?(?:(?:async|abstract)\s+)*(function\s*\*?|class|interface|type|enum|const\s+enum|namespace|module|const|let|var|import)\s*(?<![A-Za-z])([A-Za-z_$][\w$]*)")
DEFAULT = re.compile(r"export\s+default(?![\w$])")
CALL = re.compile(r"(?:import|require)\s*\(\s*")
ARGUMENT = re.compile(rf"{STR}\s*[,)]")
PATTERN = re.compile(r"(?<![\w$])(?:const|let|var)\s*(?=\{)")
TAKEN = re.compile(r"\s*=\s*(?:await(?![\w$])\s*)?(?=(?:import|require)\s*\()")
THEN = re.compile(r"\s*(?:\?\s*)?\.\s*then\s*\(\s*(?:async(?![\w$])\s*)?(?:function(?![\w$])\s*(?:[A-Za-z_$][\w$]*\s*)?)?\(\s*(?=\{)")
CHAINED = re.compile(r"\s*[.?\[]")
KEY = re.compile(r'"\x01*"|[^\W]+|\$[\w$]*|\.\.\.|\S')
WITH = re.compile(r"\s*(?:(?:with|assert)\s*\{[^{}]*\}\s*)?;?")
CODE = re.compile(r'"\x01*"|\x02+|[\w$]+|[^\s;]')
ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|.))", re.S)
SHORT = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}


def _unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        digits = m[1] or m[2] or m[3]
        return chr(int(digits, 16)) if digits and int(digits, 16) < 0x110000 else SHORT.get(m[4], m[4] or "")

    return ESCAPE.sub(one, s) if "\\" in s else s


class _Expressions:
    """Finds where regular expressions end. Places from which none does are remembered, so all searches together are linear."""

    def __init__(self, text: str) -> None:
        self.text, self.dead = text, (set(), set())

    def end(self, at: int) -> int | None:
        text, i, inside, seen = self.text, at + 1, False, []
        while i < len(text) and text[i] != "\n" and i not in self.dead[inside]:
            seen.append((i, inside))
            c = text[i]
            if c == "/" and not inside:
                return FLAGS.match(text, i + 1).end()
            i += 1
            if c == "\\":
                i += text[i : i + 1] != "\n"
            elif c == ("]" if inside else "["):
                inside = not inside
        for i, inside in seen:
            self.dead[inside].add(i)
        return None


def mask(text: str) -> tuple[str, list[int]]:
    """The text with only code left, as long as it was; and after which places code at the top ends and begins again, in turn."""
    out, pos, depth, tops, before, dotted = [], 0, 0, [], "", False
    templates: list[int] = []  # depths at which code within a template began
    expressions = _Expressions(text)

    def template(at: int, first: bool) -> int:
        end = CHUNK.match(text, at).end()
        if text.startswith("${", end):
            out.append("\x02" * (end - at) + "  ")
            if not depth and not templates:
                tops.append(end + 2)
            templates.append(depth)
            return end + 2
        if first and end < len(text):  # a template without code is a string
            out[-1] = '"'
            out.append("\x01" * (end - at) + '"')
        else:
            out.append("\x02" * (min(end + 1, len(text)) - at))
        return min(end + 1, len(text))

    if text.startswith("#!"):
        pos = (text + "\n").index("\n")
        out.append(" " * pos)
    while pos < len(text):
        c = text[pos]
        if c == "`":
            out.append("\x02")
            pos, before = template(pos + 1, True), ")"
            continue
        if c == "}" and templates and templates[-1] == depth:
            templates.pop()
            if not depth and not templates:
                tops.append(pos + 1)
            out.append("\x02")
            pos, before = template(pos + 1, False), ")"
            continue
        if c == "/" and text[pos : pos + 2] not in ("//", "/*"):
            word = before[:1].isalnum() or before[:1] in ("_", "$")
            end = expressions.end(pos) if (before in BEFORE_EXPRESSION and not dotted) or not (word or before in (")", "]", '"')) else None
            if end is not None:
                out.append("\x02" * (end - pos))
                pos, before = end, ")"
                continue
        t = TOKEN.match(text, pos)[0]
        pos += len(t)
        if t[:2] in ("//", "/*"):
            out.append(re.sub(r"[^\n]", " ", t))
        elif t.isspace():
            out.append(t)
        elif c in "'\"":
            closed = len(t) > 1 and t[-1] == c
            out.append('"' + "\x01" * (len(t) - 2) + '"' if closed else "\x02" * len(t))
            before = '"'
        else:
            if c in "{}":
                was, depth = depth, max(depth + (1 if c == "{" else -1), 0)
                if min(was, depth) == 0 and was != depth and not templates:
                    tops.append(pos)
            out.append(t)
            dotted, before = before == ".", t
    return "".join(out), tops


def _listed(items: str, all_types: bool, at: int, text: str) -> list[dict]:
    """Names in the braces of an import or export; at: where the items stand in the text."""
    out = []
    for m in re.finditer("[^,]+", items):
        w = [text[at + m.start() + x.start() + 1 : at + m.start() + x.end() - 1] if x[0][0] == '"' else x[0] for x in re.finditer(r'"[^"]*"|\S+', m[0])]
        typed = len(w) in (2, 4) and w[0] == "type"
        w = w[typed:]
        if w:
            out.append({"name": w[0], "shown": w[2] if len(w) == 3 else w[0], "type_only": all_types or typed})
    return out


def _keys(code: str, text: str, at: int, ends: dict[int, tuple[int, int]]) -> list[dict]:
    """The keys of the pattern whose brace opens at a place; none where one of them has no name, as of a rest or in brackets."""
    if at not in ends:
        return []
    out, pos, stop, expected = [], at + 1, ends[at][1] - 1, True
    while (m := KEY.search(code, pos, stop)) is not None:
        t, pos = m[0], m.end()
        if expected and t in ("...", "["):
            return []
        if t in "([{":
            expected, pos = False, ends.get(m.start(), (0, pos))[1]
        elif t == ",":
            expected = True
        elif expected:
            name = text[m.start() : pos]
            out.append(_unescape(name[1:-1]) if t[0] == '"' else name)
            expected = False
    return [{"name": n, "shown": n, "type_only": False} for n in out]


def _brackets(code: str) -> dict[int, tuple[int, int]]:
    """For each bracket that is closed: where its first part ends, by a comma or the closing one, and what follows the whole."""
    ends, within = {}, []
    for x in re.finditer(r"[()\[\]{},]", code):
        if x[0] in "([{":
            within.append([x.start(), None])
        elif within and x[0] == ",":
            within[-1][1] = within[-1][1] or x.start()
        elif within:
            start, comma = within.pop()
            ends[start] = comma or x.start(), x.end()
    return ends


def _code_lines(code: str, tops: list[int], reexports: list[tuple[int, int]], line) -> list[int]:
    """Lines at the top that hold anything but re-exports and ';'. A brace that closes belongs to the top, one that opens does not."""
    edges = [0, *(x - 1 for x in tops), len(code)]
    out: list[int] = []
    skip = iter([*reexports, (len(code), len(code))])
    a, z = next(skip)
    for start, stop in zip(edges[::2], edges[1::2], strict=False):
        for m in CODE.finditer(code, start, stop):
            while m.start() >= z and a < len(code):
                a, z = next(skip)
            if m.start() < a and (not out or out[-1] != line(m.start())):
                out.append(line(m.start()))
    return out


def scan(text: str | None) -> tuple[list[dict], list[dict], list[int]]:
    """Imports and exports of a text, in its order, and its lines of code at the top; none of a null or empty one."""
    if not text:
        return [], [], []
    code, tops = mask(text)
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(breaks, at) + 1
    content = lambda m, k: _unescape(text[m.start(k) + 1 : m.end(k) - 1])
    ends = _brackets(code)
    taken = {m.end(): p.end() for p in PATTERN.finditer(code) if p.end() in ends and (m := TAKEN.match(code, ends[p.end()][1]))}
    imports: list[dict] = []
    exports: list[dict] = []
    reexports: list[tuple[int, int]] = []
    done = 0

    def found(at, kind, specifier, names=(), star=False, reexport=False, literal=True):
        imports.append({"kind": kind, "reexport": reexport, "specifier": specifier, "literal": literal, "line": line(at), "star": star, "names": list(names)})

    def passed_on(at, end):
        if bisect_right(tops, at) % 2 == 0:
            reexports.append((at, WITH.match(code, end).end()))

    def shown(at, name, types=False):
        if bisect_right(tops, at) % 2 == 0:
            exports.append({"name": name, "line": line(at), "type_only": types})

    for word in re.finditer(WORD, code):
        at = word.start()
        if at < done or (code[at - 1 : at] == "." and code[max(at - 3, 0) : at] != "..."):
            continue
        if word[1] == "export":
            if m := STAR.match(code, at):
                found(at, "static", content(m, m.lastindex), star=True, reexport=True)
                passed_on(at, m.end())
                if m[2]:
                    shown(at, content(m, 2) if m[2][0] == '"' else m[2], bool(m[1]))
            elif m := LISTED.match(code, at):
                names = _listed(m[2], bool(m[1]), m.start(2), text)
                if m[3]:
                    found(at, "static", content(m, 3), names, reexport=True)
                    passed_on(at, m.end())
                for n in names:
                    shown(at, n["shown"], n["type_only"])
            elif DEFAULT.match(code, at):
                shown(at, "default")
            elif m := DECLARED.match(code, at):
                shown(at, m[2], m[1] in ("interface", "type"))
            continue
        if word[1] == "import":
            if m := EQUALS.match(code, at):
                found(at, "require", content(m, 2), star=True)
                done = m.end()
                continue
            if m := BARE.match(code, at):
                found(at, "static", content(m, 1))
                continue
            if m := STATIC.match(code, at):
                names = [{"name": "default", "shown": m[2], "type_only": bool(m[1])}] if m[2] else []
                found(at, "static", content(m, 5), [] if m[3] else names + (_listed(m[4], bool(m[1]), m.start(4), text) if m[4] is not None else []), star=bool(m[3]))
                continue
        if not (call := CALL.match(code, at)):
            continue
        end = call.end()
        if (opened := code.index("(", at)) not in ends:  # never closed
            continue
        stop, done_at = ends[opened]
        m = ARGUMENT.match(code, end)
        argument = text[end:stop].strip()
        if not argument:
            continue
        kind = "dynamic" if word[1] == "import" else "require"
        # what follows the call takes its names from it, and a pattern from what follows
        pattern = taken.get(at)
        if CHAINED.match(code, done_at):
            then = THEN.match(code, done_at) if kind == "dynamic" else None
            pattern = then.end() if then else None
        names = [] if pattern is None else _keys(code, text, pattern, ends)
        found(at, kind, content(m, 1) if m else argument, names, star=not names, literal=bool(m))
    return imports, exports, _code_lines(code, tops, reexports, line)


#: What scan_files gives a row for, in the order of scan's results.
SIDES = {"imports": IMPORTS, "exports": EXPORTS, "code": "line int"}


def scan_files(files: DataFrame, side: str = "imports") -> DataFrame:
    """files(path, text) -> path and a row for each import, each export, or each line of code; texts pass through in Arrow batches, each on its own.

    Texts of a table are dealt anew by path and content: reading them takes far longer than moving them, and a table that
    is one small file, or one row group, would leave them all to one task. Those of a stream stay where they are.
    """
    schema, k = SIDES[side], list(SIDES).index(side)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", *(x.split()[0] for x in re.sub("<[^>]*>", "", schema).split(", "))]
        for b in batches:
            found = ((p, x) for p, t in zip(b["path"], b["text"], strict=True) for x in scan(t)[k])
            yield pd.DataFrame([{"path": p, **(x if isinstance(x, dict) else {"line": x})} for p, x in found], columns=columns)

    texts = files.select("path", "text")
    if not files.isStreaming:
        texts = texts.repartition(F.xxhash64("path", "text"))
    return texts.mapInPandas(rows, f"path string, {schema}")


def register(spark: SparkSession) -> None:
    """Makes scan_imports(text) a table function of the session: SELECT ... FROM files, LATERAL scan_imports(text)."""

    @udtf(returnType=IMPORTS)
    class ScanImports:
        def eval(self, text: str):
            for x in scan(text)[0]:
                yield x["kind"], x["reexport"], x["specifier"], x["literal"], x["line"], x["star"], [(n["name"], n["shown"], n["type_only"]) for n in x["names"]]

    spark.udtf.register("scan_imports", ScanImports)
