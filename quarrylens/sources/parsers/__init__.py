"""Parsers of single source files. Each gives symbols (with children), imports, exports, relationships and Rust uses.

They are scanners of our own (Python's uses the language's own parser): declarations are found at their nesting depth
in a copy of the text whose comments and strings are blanked out. Files that cannot be read are left out."""

from __future__ import annotations

from . import golang, python, rust, typescript
from .scan import result

BY_EXTENSION = {"ts": typescript.parse, "tsx": typescript.parse, "js": typescript.parse, "jsx": typescript.parse, "rs": rust.parse, "py": python.parse, "go": golang.parse}


def parse_file(path: str, source: bytes) -> dict | None:
    """The parse of a file by its extension; None for other files, bytes that are no UTF-8 and sources that do not parse."""
    ext = path.rsplit("/", 1)[-1].rpartition(".")[2]
    parse = BY_EXTENSION.get(ext)
    if parse is None:
        return None
    try:
        return parse(source.decode("utf-8"), ext)
    except (UnicodeDecodeError, SyntaxError, ValueError, RecursionError):
        return None


__all__ = ["parse_file", "result"]
