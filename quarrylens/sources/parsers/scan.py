"""What the scanners share: blanked copies of a source, nesting depths, spans and records."""

from __future__ import annotations

import re
from bisect import bisect_right


def result() -> dict:
    return {"symbols": [], "imports": [], "exports": [], "relationships": [], "rust_uses": [], "mods": []}


def symbol(name, kind, line, col, line_end, exported=False, default=False, visibility="private", trait_impl=None, decorators=(), children=()):
    return {"name": name, "kind": kind, "line": line, "col": col, "line_end": line_end, "is_exported": exported, "is_default": default, "visibility": visibility, "trait_impl": trait_impl, "decorators": list(decorators), "children": list(children)}


def decorator(name, args=None):
    head, _, attribute = name.rpartition(".")
    return {"name": name, "object": head or None, "attribute": attribute if head else None, "args_raw": args, "framework": None}


def specifier(name, alias=None, default=False, namespace=False):
    return {"name": name, "alias": alias, "is_default": default, "is_namespace": namespace}


def imported(kind, module, specifiers=(), line=0, level=0):
    return {"kind": kind, "level": level, "module_path": module, "specifiers": list(specifiers), "line": line}


class Source:
    """A source with `code`: the same length, comments and the insides of strings replaced by spaces."""

    def __init__(self, text: str, lang: str):
        self.text = text
        self.code = blank(text, lang)
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]
        self.depth = [0] * (len(text) + 1)
        self.match: dict[int, int] = {}
        open_: list[int] = []
        for i, c in enumerate(self.code):
            if c in "{([":
                self.depth[i] = len(open_)
                open_.append(i)
            elif c in "})]":
                if open_:
                    self.match[open_.pop()] = i
                self.depth[i] = len(open_)
            else:
                self.depth[i] = len(open_)

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def col(self, at: int) -> int:
        return at - self.starts[self.line(at) - 1]

    def close(self, at: int) -> int:
        """The bracket that closes the one at `at`; the end of the text if none does."""
        return self.match.get(at, len(self.text) - 1)

    def body(self, at: int, stop: str = ";") -> tuple[int, int]:
        """(opening brace or -1, end) of a declaration that goes on at `at`."""
        d = self.depth[at]
        for i in range(at, len(self.code)):
            if self.depth[i] == d:
                if self.code[i] == "{":
                    return i, self.close(i)
                if self.code[i] in stop:
                    return -1, i
            elif self.depth[i] < d:
                return -1, i - 1
        return -1, len(self.code) - 1


def blank(text: str, lang: str) -> str:
    out, i, n = list(text), 0, len(text)

    def wipe(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    before = ""  # last significant character: tells a regular expression from a division
    while i < n:
        c = text[i]
        if text.startswith("//", i):
            j = text.find("\n", i)
            j = n if j < 0 else j
            wipe(i, j)
            i = j
            continue
        if text.startswith("/*", i):
            depth, j = 1, i + 2
            while j < n and depth:
                if lang == "rust" and text.startswith("/*", j):
                    depth, j = depth + 1, j + 2
                elif text.startswith("*/", j):
                    depth, j = depth - 1, j + 2
                else:
                    j += 1
            wipe(i, j)
            i = j
            continue
        if lang == "rust" and (m := re.compile(r'b?r(#*)"').match(text, i)) and not (i and (text[i - 1].isalnum() or text[i - 1] == "_")):
            j = text.find('"' + m[1], m.end())
            j = n if j < 0 else j + 1 + len(m[1])
            wipe(m.end(), j - 1 - len(m[1]))
            i = j
            before = '"'
            continue
        if lang == "rust" and c == "'":
            m = re.compile(r"'(?:\\.[^']*|[^'\\])'").match(text, i)
            if m:
                wipe(i + 1, m.end() - 1)
                i = m.end()
            else:
                i += 1  # a lifetime
            continue
        if c in "\"'`":
            j = i + 1
            while j < n and text[j] != c:
                if text[j] == "\\" and not (c == "`" and lang == "go"):
                    j += 1
                elif text[j] == "\n" and c != "`":
                    if lang != "rust":
                        break
                j += 1
            wipe(i + 1, j)
            i = j + 1
            before = '"'
            continue
        if c == "/" and lang == "ts" and (not before or before in "(,=:[!&|?{};+-*%~^<>"):
            m = re.compile(r"/(?![*/\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*").match(text, i)
            if m:
                wipe(i, m.end())
                i, before = m.end(), '"'
                continue
        if not c.isspace():
            before = c
        i += 1
    return "".join(out)
