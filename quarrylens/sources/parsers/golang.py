"""Go files: functions, methods, types, constants, variables, struct tags, directives, embedding and imports."""

from __future__ import annotations

import re

from .scan import Source, decorator, imported, result, specifier, symbol

EMBEDDED = "__embedded__"
DECL = re.compile(r"(?m)^(func|type|const|var|import)\b")


def _directives(text: str, at: int) -> list[dict]:
    """//go: lines right above a declaration."""
    out = []
    for line in reversed(text[:at].splitlines()):
        line = line.strip()
        if not line.startswith("//"):
            break
        if m := re.match(r"//(go:\w+)\s*(.*)", line):
            out.append(decorator(m[1], m[2] or None))
            out[-1]["object"] = out[-1]["attribute"] = None
    return out[::-1]


def _lines(s: Source, a: int, b: int):
    """(start, end) of the entries between two brackets, one a line or semicolon at the bracket's own depth."""
    d = s.depth[a] + 1
    start = a + 1
    for i in range(a + 1, b + 1):
        if i == b or s.code[i] in "\n;" and s.depth[i] == d:
            if s.code[start:i].strip():
                lead = len(s.code[start:i]) - len(s.code[start:i].lstrip())
                yield start + lead, i
            start = i + 1


def parse(text: str, ext: str = "go") -> dict:
    s, out = Source(text, "go"), result()
    code = s.code

    def add(name, kind, at, end, **more):
        up = name[:1].isupper()
        return out["symbols"].append(symbol(name, kind, s.line(at), s.col(at), s.line(end), up, visibility="pub" if up else "private", **more))

    def type_spec(a: int, b: int, deco: list[dict], whole: int) -> None:
        m = re.compile(r"(\w+)(\s*\[[^\]]*\])?\s*(=)?\s*(struct|interface)?\b").match(code, a)
        if not m:
            return
        name, kids, deco = m[1], [], list(deco)
        brace = code.find("{", m.end()) if m[4] else -1
        end = s.close(brace) if brace >= 0 else b - 1
        if m[4] == "struct" and brace >= 0:
            embedded = []
            for x, y in _lines(s, brace, end):
                field = re.match(r"\s*(\*?[\w.]+)\s*$", code[x:y].split("`")[0])
                if field:
                    embedded.append(field[1].lstrip("*"))
                tag = re.search(r"`([^`]*)`", text[x:y])
                for key in re.findall(r'(\w+):"', tag[1]) if tag else []:
                    deco.append(decorator(key, tag[1]))
            deco += [decorator(EMBEDDED, e) for e in embedded]
        elif m[4] == "interface" and brace >= 0:
            for x, y in _lines(s, brace, end):
                if f := re.match(r"(\w+)\s*\(", code[x:y]):
                    up = f[1][:1].isupper()
                    kids.append(symbol(f[1], "method", s.line(x), s.col(x), s.line(max(x, y - 1)), up, visibility="pub" if up else "private"))
        add(name, m[4] or "type", a, end, decorators=deco, children=kids)

    def names(a: int, b: int, kind: str, deco: list[dict]) -> None:
        head = re.match(r"\s*(\w+(?:\s*,\s*\w+)*)", code[a:b])
        if head:
            for n in re.split(r"\s*,\s*", head[1].strip()):
                if n != "_":
                    add(n, kind, a, b - 1 if b > a else a, decorators=deco)

    def import_spec(a: int, b: int) -> None:
        m = re.match(r'\s*([\w.]+)?\s*["`]([^"`]+)["`]', text[a:b])
        if m:
            alias = m[1]
            kind = "GoBlank" if alias == "_" else "GoDot" if alias == "." else "GoAbsolute"
            spec = [specifier(alias or m[2].rpartition("/")[2], m[2] if alias else None)] if kind == "GoAbsolute" else []
            out["imports"].append(imported(kind, m[2], spec, s.line(a)))

    for m in DECL.finditer(code):
        at, word = m.start(), m[1]
        if s.depth[at]:
            continue
        rest = re.compile(r"\s*").match(code, m.end()).end()
        deco = _directives(text, at)
        if word == "func":
            receiver = None
            if code[rest : rest + 1] == "(":
                close = s.close(rest)
                receiver = re.sub(r"\[.*", "", code[rest + 1 : close].replace("*", " ").split()[-1]) if code[rest + 1 : close].split() else None
                rest = close + 1
            n = re.compile(r"\s*(\w+)").match(code, rest)
            if n:
                start, end = s.body(n.end(), "\n")
                add(n[1], "method" if receiver else "function", at, end, trait_impl=receiver, decorators=deco)
            continue
        group = code[rest : rest + 1] == "("
        if group:
            entries = [(a, b, _directives(text, a)) for a, b in _lines(s, rest, s.close(rest))]
        else:
            _, end = s.body(rest, "\n;") if word != "type" else (0, 0)
            if word == "type":
                start, end = s.body(rest, "\n")
                end += 1
            entries = [(rest, end if end > rest else rest + 1, deco)]
        for a, b, d in entries:
            if word == "import":
                import_spec(a, b)
            elif word == "type":
                type_spec(a, b, d or deco, at)
            else:
                names(a, b, "const" if word == "const" else "variable", d)
    return out
