"""Python files, by the language's own parser; statements with syntax errors are left out."""

from __future__ import annotations

import ast
import re

from .scan import decorator, imported, result, specifier, symbol


def _dotted(node: ast.expr) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else None
    return None


def _decorators(node, text: str) -> list[dict]:
    out = []
    for d in node.decorator_list:
        call = d if isinstance(d, ast.Call) else None
        name = _dotted(call.func if call else d)
        if name:
            args = None
            if call:
                whole = ast.get_source_segment(text, call) or ""
                head = ast.get_source_segment(text, call.func) or ""
                args = whole[len(head) :].strip() or None
            out.append(decorator(name, args))
    return out


def _all_names(tree: ast.Module) -> set[str] | None:
    for s in tree.body:
        targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, (ast.AugAssign, ast.AnnAssign)) else []
        if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets) and isinstance(s.value, (ast.List, ast.Tuple)):
            return {e.value for e in s.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)}
    return None


BLANK = re.compile(r"[^\n]")


def _tree(text: str) -> ast.Module:
    """The module; of one with syntax errors, the top-level statements that parse, at their own lines."""
    try:
        return ast.parse(text)
    except SyntaxError as e:
        fault = e  # the name of the handler ends with it
    lines = text.splitlines(keepends=True)
    # a statement begins at an unindented line that does not go on with the one before
    starts = [i for i, x in enumerate(lines) if x.strip() and not x[0].isspace() and not re.match(r"(?:else|elif|except|finally)\b|[)\]}#]", x)]
    body: list[ast.stmt] = []
    held = 0  # decorators belong to the statement below them
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(lines)])):
        if lines[a].startswith("@") and i + 1 < len(starts):
            held = held or a + 1
            continue
        first, held = (held - 1 if held else a), 0
        try:
            body += ast.parse(BLANK.sub("", "".join(lines[:first])) + "".join(lines[first:b])).body
        except SyntaxError:
            continue
    if not body:
        raise fault
    return ast.Module(body, [])


def parse(text: str, ext: str = "py") -> dict:
    tree, out = _tree(text), result()
    exported = _all_names(tree)
    shown = lambda name: name in exported if exported is not None else not name.startswith("_")

    def make(node, kind: str, children=()) -> dict:
        first = node.lineno
        return symbol(node.name, kind, first, node.col_offset, node.end_lineno, shown(node.name), visibility="pub" if shown(node.name) else "private", decorators=_decorators(node, text), children=children)

    def class_(node: ast.ClassDef) -> dict:
        kids = []
        for s in node.body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kids.append(make(s, "method"))
                functions(s.body)
            elif isinstance(s, ast.ClassDef):
                inner = class_(s)
                kids.append({**inner, "children": []})
        for b in node.bases:
            if name := _dotted(b):
                out["relationships"].append({"from_name": node.name, "to_name": name.rpartition(".")[2], "kind": "Extends", "line": node.lineno})
        return make(node, "class", kids)

    def functions(body: list[ast.stmt]) -> None:
        """Functions and classes at any depth of nesting in statements and functions."""
        for s in body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out["symbols"].append(make(s, "function"))
                functions(s.body)
            elif isinstance(s, ast.ClassDef):
                out["symbols"].append(class_(s))
            else:
                for inner in ("body", "orelse", "finalbody"):
                    if isinstance(getattr(s, inner, None), list):
                        functions(getattr(s, inner))
                for h in getattr(s, "handlers", []):
                    functions(h.body)

    functions(tree.body)
    for s in tree.body:
        names = []
        if isinstance(s, ast.Assign):
            names = [t.id for t in s.targets if isinstance(t, ast.Name)]
        elif isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
            names = [s.target.id]
        elif isinstance(s, ast.TypeAlias):
            out["symbols"].append(symbol(s.name.id, "type", s.lineno, s.col_offset, s.end_lineno, shown(s.name.id), visibility="pub" if shown(s.name.id) else "private"))
        for n in names:
            out["symbols"].append(symbol(n, "variable", s.lineno, s.col_offset, s.end_lineno, shown(n), visibility="pub" if shown(n) else "private"))

    def imports(s: ast.stmt, conditional: bool) -> None:
        kind = "PythonConditional" if conditional else "PythonAbsolute"
        if isinstance(s, ast.Import):
            for a in s.names:
                out["imports"].append(imported(kind, a.name, [specifier(a.asname or a.name, a.name if a.asname else None)], s.lineno))
        elif isinstance(s, ast.ImportFrom):
            specs = [specifier(a.asname or a.name, a.name if a.asname else None, namespace=a.name == "*") for a in s.names]
            out["imports"].append(imported("PythonRelative" if s.level and not conditional else kind, s.module or "", specs, s.lineno, s.level))

    for s in tree.body:
        imports(s, False)
        if isinstance(s, ast.Try):
            for part in [s.body, s.orelse, s.finalbody, *[h.body for h in s.handlers]]:
                for inner in part:
                    imports(inner, True)
    out["exports"] = [{"kind": "All", "names": sorted(exported), "source": None}] if exported is not None else []
    out["symbols"].sort(key=lambda x: (x["line"], x["col"]))
    return out
