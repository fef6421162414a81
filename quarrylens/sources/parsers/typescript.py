"""TypeScript and JavaScript files: symbols, decorators, imports, exports and relationships."""

from __future__ import annotations

import re

from .scan import Source, decorator, imported, result, specifier, symbol

DECL = re.compile(
    r"(?P<export>\bexport\s+)?(?P<default>default\s+)?(?:(?:declare|abstract|async)\s+)*\b(?:(?P<word>function|class|interface|type|enum|namespace)\b\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)?|(?:const\s+)(?P<cenum>enum)\s+(?P<ename>\w+)|(?P<var>const|let|var)\s+(?P<vname>[A-Za-z_$][\w$]*))"
)
METHOD = re.compile(r"(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set)\s+)*\*?\s*(#?[A-Za-z_$][\w$]*)\s*(?:<[^({]*>)?\s*\(")
KEYWORDS = frozenset("if for while switch catch return function typeof new await import require super constructor with throw delete void in of do else case yield".split())
JSX = re.compile(r"(?:return|=>|\(|&&|\?|:)\s*\(?\s*<(?:[A-Za-z][\w.]*[\s/>]|>)")


def _decorators(s: Source, start: int) -> list[dict]:
    """@name(args) entries right before a position."""
    out, at = [], start
    while True:
        head = s.code[:at].rstrip()
        end = len(head)
        args = None
        if head.endswith(")"):
            open_ = next((o for o, c in s.match.items() if c == end - 1), None)
            if open_ is None:
                return out
            args, end = s.text[open_:end], open_
        m = re.search(r"@([A-Za-z_$][\w$.]*)\s*$", s.code[:end])
        if not m:
            return out
        out.insert(0, decorator(m[1], args))
        at = m.start()


def _has_jsx(s: Source, a: int, b: int, ext: str) -> bool:
    return ext in ("tsx", "jsx") and bool(JSX.search(s.code, a, b + 1))


def _members(s: Source, brace: int) -> list[tuple[int, int]]:
    """Starts and ends of a body's entries at its own depth."""
    d, end = s.depth[brace] + 1, s.close(brace)
    out, start, i = [], brace + 1, brace + 1
    while i <= end:
        if i == end or s.depth[i] == d and s.code[i] in ";,\n":
            if s.code[start:i].strip():
                lead = len(s.code[start:i]) - len(s.code[start:i].lstrip())
                out.append((start + lead, i - 1))
            start = i + 1
        elif s.depth[i] == d and s.code[i] == "{" and ")" in s.code[start:i]:
            i = s.close(i)
            lead = len(s.code[start:i]) - len(s.code[start:i].lstrip())
            out.append((start + lead, i))
            start = i + 1
        i += 1
    return out


def parse(text: str, ext: str = "ts") -> dict:
    s, out = Source(text, "ts"), result()
    code, seen, heads = s.code, set(), set()

    def add(name, kind, at, end, export, default, children=(), deco=()):
        line = s.line(at)
        if (name, line) not in seen:
            seen.add((name, line))
            out["symbols"].append(symbol(name, kind, line, s.col(at), s.line(end), bool(export), bool(default), visibility="pub" if export else "private", decorators=deco, children=children))

    for m in DECL.finditer(code):
        at = m.start()
        if s.depth[at] or at and (code[at - 1].isalnum() or code[at - 1] in "_$."):
            continue
        export, default = m["export"], m["default"]
        word = m["word"] or ("enum" if m["cenum"] else None)
        name = m["name"] or m["ename"] or m["vname"]
        if m["var"]:
            eq = re.compile(r"\s*(?::[^=;]+?)?=\s*(?!=)").match(code, m.end())
            value = eq.end() if eq else m.end()
            end = s.body(m.end(), ";")[1] if not eq else _statement_end(s, value)
            arrow = re.compile(r"(?:async\s+)?(?:function\b|(?:<[^>]*>\s*)?\([^)]*\)\s*(?::[^=]+?)?=>|[A-Za-z_$][\w$]*\s*=>)").match(code, value) if eq else None
            if arrow:
                add(name, "component" if _has_jsx(s, value, end, ext) else "function", m.start("vname"), end, export, default)
            elif export:
                add(name, "variable", m.start("vname"), end, export, default)
            continue
        if word == "namespace":
            continue
        if not name:
            if not default:
                continue
            name = "default"
        if word == "type":
            if not re.compile(r"\s*(?:<[^=]*>)?\s*=").match(code, m.end()):
                continue
            end = _statement_end(s, m.end())
            add(name, "type", at, end, export, default)
            continue
        start, end = s.body(m.end())
        kids = []
        if word == "class" and start >= 0:
            for a, b in _members(s, start):
                f = METHOD.match(code, re.compile(r"(?:@[\w$.]+(?:\([^)]*\))?\s*)*").match(code, a).end())
                if f and f.start() <= b and f[1] not in KEYWORDS - {"constructor"}:
                    heads.add(f.start(1))
                    kids.append(symbol(f[1], "method", s.line(f.start()), s.col(f.start()), s.line(b), decorators=_decorators(s, f.start())))
        elif word == "interface" and start >= 0:
            for a, b in _members(s, start):
                if f := re.compile(r"(?:readonly\s+)?([A-Za-z_$][\w$]*)\??\s*[(:<]").match(code, a):
                    heads.add(f.start(1))
                    kids.append(symbol(f[1], "property", s.line(a), s.col(a), s.line(b)))
        kind = "component" if word == "function" and start >= 0 and _has_jsx(s, start, end, ext) else word
        add(name, kind, at, end, export, default, kids, _decorators(s, at) if word == "class" else ())
    _imports(s, out)
    _exports(s, out)
    _relationships(s, out, heads)
    return out


def _statement_end(s: Source, at: int) -> int:
    d = s.depth[at]
    i = at
    while i < len(s.code):
        if s.depth[i] == d and (s.code[i] == ";" or s.code[i] == "\n" and s.code[at:i].strip() and not re.match(r"\s*[.?:|&=+\-*/,)]", s.code[i + 1 :]) and s.code[at:i].rstrip()[-1] not in "=,(|&+-*/?:>"):
            return i
        if s.depth[i] < d:
            return i - 1
        i += 1
    return len(s.code) - 1


def _names(raw: str) -> list[tuple[str, str | None]]:
    """(local, original or None) of a list like `a, b as c`."""
    out = []
    for part in raw.split(","):
        m = re.match(r"\s*(?:type\s+)?([\w$]+)(?:\s+as\s+([\w$]+))?\s*$", part)
        if m:
            out.append((m[2] or m[1], m[1] if m[2] else None))
    return out


def _imports(s: Source, out: dict) -> None:
    for m in re.finditer(r"\bimport\b(?!\s*[(.])", s.code):
        if s.depth[m.start()]:
            continue
        x = re.compile(r"import\s+(?:type\s+)?(?:(?P<what>[^'\";]*?)\s*from\s*)?(['\"])(?P<module>[^'\"]*)\2").match(s.text, m.start())
        if not x:
            continue
        specs, what = [], (x["what"] or "").strip()
        if star := re.search(r"\*\s*as\s+([\w$]+)", what):
            specs.append(specifier(star[1], namespace=True))
        if braces := re.search(r"\{([^}]*)\}", what):
            specs += [specifier(a, b) for a, b in _names(braces[1])]
        if head := re.match(r"([A-Za-z_$][\w$]*)\s*(?:,|$)", what):
            specs.insert(0, specifier(head[1], default=True))
        out["imports"].append(imported("Esm", x["module"], specs, s.line(m.start())))
    for m in re.finditer(r"(?:\b(?:const|let|var)\s+(?P<what>[\w$]+|\{[^}]*\})\s*=\s*)?\brequire\s*\(", s.code):
        x = re.compile(r"\s*(['\"])([^'\"]*)\1").match(s.text, m.end())
        if x:
            what = m["what"] or ""
            specs = [specifier(a, b) for a, b in _names(what[1:-1].replace(":", " as "))] if what.startswith("{") else [specifier(what, default=True)] if what else []
            out["imports"].append(imported("Cjs", x[2], specs, s.line(m.start())))
    for m in re.finditer(r"\bimport\s*\(", s.code):
        if x := re.compile(r"\s*(['\"`])([^'\"`]*)\1").match(s.text, m.end()):
            out["imports"].append(imported("Dynamic", x[2], [], s.line(m.start())))


def _exports(s: Source, out: dict) -> None:
    """Export clauses by the names that their source gives them, star and default exports; exported declarations are symbols, not exports."""
    for m in re.finditer(r"\bexport\b", s.code):
        if s.depth[m.start()]:
            continue
        if x := re.compile(r"export\s+(?:type\s+)?\*\s*from\s*(['\"])([^'\"]*)\1").match(s.text, m.start()):
            out["exports"].append({"kind": "ReExportAll", "names": [], "source": x[2]})
        elif x := re.compile(r"export\s+(?:type\s+)?\{([^}]*)\}\s*(?:from\s*(['\"])([^'\"]*)\2)?").match(s.text, m.start()):
            out["exports"].append({"kind": "ReExport" if x[3] else "Named", "names": [original or local for local, original in _names(x[1])], "source": x[3]})
        elif re.compile(r"export\s+default\b").match(s.text, m.start()):
            out["exports"].append({"kind": "Default", "names": [], "source": None})


def _relationships(s: Source, out: dict, heads: set[int]) -> None:
    seen = set()

    def add(source, name, kind, at):
        key = (name, s.line(at), kind)
        if key not in seen:
            seen.add(key)
            out["relationships"].append({"from_name": source, "to_name": name, "kind": kind, "line": s.line(at)})

    for m in re.finditer(r"\b(class|interface)\s+([\w$]+)([^{]*)\{", s.code):
        base = re.sub(r"<[^<>]*(?:<[^<>]*>)?[^<>]*>", "", m[3])
        for word, names in re.findall(r"\b(extends|implements)\s+([^{]*?)(?=\b(?:extends|implements)\b|$)", base, re.S):
            kind = "Implements" if word == "implements" else "InterfaceExtends" if m[1] == "interface" else "Extends"
            for n in names.split(","):
                if n.strip():
                    add(m[2], n.strip().rpartition(".")[2], kind, m.start())
    for m in re.finditer(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*(?:<[\w$\s,.\[\]]*>)?\(", s.code):
        before = s.code[: m.start()].rstrip()
        if m[1] in KEYWORDS or m.start() in heads or re.search(r"\b(?:function|new|class|interface|get|set)\s*\*?$", before):
            continue
        add(None, m[1], "Calls", m.start())
    for m in re.finditer(r"(?:\?\.|\.)\s*([A-Za-z_$][\w$]*)\s*\(", s.code):
        add(None, m[1], "MethodCall", m.start())
    for m in re.finditer(r"(?:[\w$)\]?]\s*:|\bas|<|\|)\s*([A-Z][\w$]*)\b(?!\s*[:=(])", s.code):
        add(None, m[1], "TypeReference", m.start(1))
