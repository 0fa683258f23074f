"""Globs as regular expressions and as ordered tables.

'*' and '?' stay within a folder; '**' crosses folders wherever it stands, and as a whole part
before '/' may match no folder at all; '{a,b}' are alternatives, which may hold wildcards and
'/' but no braces; '[ab]' and '[!ab]' are classes. An unclosed brace or bracket is itself.
"""

from __future__ import annotations

#: Limits that keep a glob's expression cheap to match.
MOST_GLOBSTARS, MOST_ALTERNATIVES = 8, 64
#: Wildcards from which an expression is written so that it cannot backtrack across them.
MANY = 3
_WILD = ("star", "any", "folders")


def plain(glob: str) -> str:
    """Without the marks at its beginning."""
    return glob.removeprefix("!").removeprefix("./")


def static_prefix(glob: str) -> str:
    """The folders before the first part with a wildcard."""
    parts = plain(glob).split("/")
    at = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[{")), len(parts) - 1)
    return "/".join(parts[:at])


def literal_segments(glob: str) -> int:
    return sum(not any(c in p for c in "*?[{") for p in plain(glob).split("/"))


def alternatives(glob: str) -> list[str]:
    """The globs without braces that a glob stands for."""
    out, rest = [""], glob
    while rest:
        at = rest.find("{")
        end = rest.find("}", at) if at >= 0 else -1
        if end < 0:
            return [x + rest for x in out]
        parts = rest[at + 1 : end].split(",")
        if len(out) * len(parts) > MOST_ALTERNATIVES:
            raise ValueError(f"more than {MOST_ALTERNATIVES} alternatives in {glob}")
        out = [x + rest[:at] + p for x in out for p in parts]
        rest = rest[end + 1 :]
    return out


def _class(body: str) -> str:
    negated, body = body[:1] in ("!", "^") and body != "", body[1:] if body[:1] in ("!", "^") else body
    body = "".join("\\" + x if x in "[]&^\\~" else x for x in body)
    return (f"[^{body}]" if negated else f"[{body}]") if body else ("[\\s\\S]" if negated else "[^\\s\\S]")


def _tokens(glob: str) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(glob):
        c, end = glob[i], i + 1
        if c == "*":
            while glob[end : end + 1] == "*":
                end += 1
            start = i == 0 or glob[i - 1] == "/"
            if end - i == 2 and start and glob[end : end + 1] == "/":
                out.append(("folders", "(?:.*/)?"))
                end += 1
            else:
                out.append(("any", ".*") if end - i > 1 else ("star", "[^/]*"))
        elif c == "?":
            out.append(("one", "[^/]"))
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1) + 1
            out.append(("one", _class(glob[i + 1 : end - 1])))
        else:
            out.append(("text", "\\" + c if c in ".*+?()|^$[]{}\\" else c))
        i = end
    return out


def _expression(tokens: list[tuple[str, str]]) -> str:
    """One alternative. With many wildcards, what stands between two that cross folders is taken where it ends first
    and kept: a later end could not help what follows, which may begin anywhere after it."""
    if sum(kind in _WILD for kind, _ in tokens) < MANY:
        return "".join(x for _, x in tokens)
    cross = [i for i, (kind, _) in enumerate(tokens) if kind in ("any", "folders")]
    lazy = lambda part: "".join(x + "?" if kind == "star" else x for kind, x in part)
    if not cross:
        return _within(tokens)
    out = lazy(tokens[: cross[0]])
    for at, to in zip(cross[:-1], cross[1:], strict=True):
        out += f"(?>{'.*?' if tokens[at][0] == 'any' else '(?:.*?/)??'}{lazy(tokens[at + 1 : to])})"
    return out + tokens[cross[-1]][1] + _within(tokens[cross[-1] + 1 :])


def _within(tokens: list[tuple[str, str]]) -> str:
    """Parts of a path apart from each other; within a part, what stands between two stars is taken where it ends first."""
    out, part = "", []
    for token in [*tokens, ("end", "")]:
        if token[1] in ("/", "") and token[0] in ("text", "end"):
            stars = [i for i, (kind, _) in enumerate(part) if kind == "star"]
            text = lambda a, z: "".join(x for _, x in part[a:z])  # noqa: B023, E731
            if len(stars) < 2:
                out += text(0, len(part))
            else:
                out += text(0, stars[0]) + "".join(f"(?>[^/]*?{text(a + 1, z)})" for a, z in zip(stars[:-1], stars[1:], strict=True)) + text(stars[-1], len(part))
            out, part = out + token[1], []
        else:
            part.append(token)
    return out


def to_regex(glob: str) -> str:
    """An anchored Java expression."""
    glob = plain(glob)
    if glob.count("**") > MOST_GLOBSTARS:
        raise ValueError(f"more than {MOST_GLOBSTARS} '**' in {glob}")
    every = [_expression(_tokens(x)) for x in alternatives(glob)]
    return f"(?s)^(?:{'|'.join(every)})$"
