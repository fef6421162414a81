"""Rust files: items at any depth, methods of impl blocks and traits, uses, modules and attributes."""

from __future__ import annotations

import re

from .scan import Source, decorator, result, symbol

VIS = r"(?P<vis>pub(?:\s*\([^)]*\))?\s+)?"
ITEM = re.compile(
    rf"\b{VIS}(?:(?:default|const|async|unsafe|extern(?:\s*\"[^\"]*\")?)\s+)*(?P<word>fn|struct|enum|trait|type|const|static|union|mod|impl)\b(?:\s+mut\b)?\s*(?P<name>[A-Za-z_]\w*)?|\bmacro_rules!\s*(?P<macro>\w+)"
)
KINDS = {"fn": "function", "struct": "struct", "union": "struct", "enum": "enum", "trait": "trait", "type": "type", "const": "const", "static": "static"}
ATTR = re.compile(r"#\s*!?\s*\[")


def _visibility(vis: str | None) -> str:
    if not vis:
        return "private"
    return "pub" if vis.strip() == "pub" else "pub(crate)"


def _type_name(text: str) -> str:
    """The bare name of a type: no references, paths, generics or lifetimes."""
    text = re.sub(r"<.*", "", text, flags=re.S)
    text = re.sub(r"^\s*(?:&\s*)?(?:'\w+\s+)?(?:mut\s+|dyn\s+)*", "", text)
    return text.strip().rpartition("::")[2].strip()


def parse(text: str, ext: str = "rs") -> dict:
    s, out = Source(text, "rust"), result()
    code = s.code
    attributes = []  # (position, container, decorator)
    blocks: list[tuple[int, int, str, str | None]] = []  # open, close, kind, name

    def container(at: int) -> int:
        """The innermost brace around a position, -1 at the top."""
        best = -1
        for o, c in braces:
            if o < at < c:
                best = o
            if o > at:
                break
        return best

    braces = sorted((o, c) for o, c in s.match.items() if code[o] == "{")
    for m in ATTR.finditer(code):
        if "!" in m[0]:
            continue
        end = s.close(m.end() - 1)
        inner = re.match(r"\s*([\w:]+)\s*(.*)", text[m.end() : end], re.S)
        if inner:
            name = inner[1]
            d = decorator(name, inner[2].strip() or None)
            if "::" in name:
                d["object"], _, d["attribute"] = name.rpartition("::")
            attributes.append((m.start(), container(m.start()), d))
    methods: dict[int, list[dict]] = {}
    found = []
    skip_to = 0
    for m in ITEM.finditer(code):
        if m.start() < skip_to or m.start() and (code[m.start() - 1].isalnum() or code[m.start() - 1] in "_'#"):
            continue
        at = m.start()
        name, word = m["name"] or m["macro"], m["word"]
        if word == "impl":
            if s.depth[at] and container(at) >= 0 and not any(k == "mod" and o == container(at) for o, _, k, _ in blocks):
                continue
            start, end = s.body(m.start("word") + 4)
            if start < 0:
                continue
            head = code[m.start("word") + 4 : start].split(" where ")[0].strip()
            if head.startswith("<"):
                d = 0
                for i, c in enumerate(head):
                    d += (c == "<") - (c == ">" and head[i - 1] not in "-=")
                    if not d:
                        head = head[i + 1 :]
                        break
            trait, for_, kind = head.partition(" for ")
            blocks.append((start, end, "impl", (_type_name(kind if for_ else trait), _type_name(trait) if for_ else None)))
            continue
        if not name or word == "const" and name == "_" or word == "fn" and not name:
            continue
        if word in ("type", "const") and m["vis"] is None and s.depth[at] and code[max(0, at - 1)] in "<,(":
            continue
        start, end = s.body(m.end(), ";")
        if word == "mod":
            if start < 0:
                if not s.depth[at]:
                    out["mods"].append(name)
            else:
                blocks.append((start, end, "mod", name))
            continue
        if word == "trait":
            blocks.append((start, end, "trait", name))
        if word is None:
            skip_to = end  # a macro's arms are patterns, not items
        found.append((at, name, word, start, end, _visibility(m["vis"])))
    own = {o: (k, n) for o, _, k, n in blocks}
    traits: dict[int, dict] = {}
    for at, name, word, start, end, vis in found:
        home = container(at)
        kind, label = own.get(home, (None, None))
        deco = [d for p, c, d in attributes if p < at and c == home]
        line, col = s.line(at), s.col(at)
        if kind == "impl":
            if word == "fn":
                type_, trait = label
                out["symbols"].append(symbol(f"{type_}::{name}", "impl_method", line, col, s.line(end), vis != "private", visibility=vis, trait_impl=trait, decorators=deco))
            continue
        if kind == "trait":
            if word == "fn" and home in traits:
                traits[home]["children"].append(symbol(f"{label}::{name}", "method", line, col, s.line(end), decorators=deco))
            continue
        row = symbol(name, "macro" if word is None else KINDS[word], line, col, s.line(end), vis != "private", visibility=vis, decorators=deco)
        if word == "trait":
            traits[start] = row
        out["symbols"].append(row)
    for m in re.finditer(r"(?m)^\s*(pub(?:\s*\([^)]*\))?\s+)?use\s+([^;]+);", code):
        if not s.depth[m.start(2)]:
            out["rust_uses"].append({"path": re.sub(r"\s+", " ", text[m.start(2) : m.end(2)]).strip(), "is_pub_use": bool(m[1])})
    return out
