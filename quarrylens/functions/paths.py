"""Path expressions, component-wise: `src` holds `src/x` but not `src2/x`."""

from __future__ import annotations

import re

from pyspark.sql import functions as F


def under(path: str, prefix: str | None) -> F.Column:
    """Whether a path is prefix or lies below it; no prefix: always."""
    if not prefix or prefix == ".":
        return F.lit(True)
    prefix = prefix.rstrip("/")
    return (F.col(path) == prefix) | F.col(path).startswith(prefix + "/")


def file_name(path: str) -> F.Column:
    return F.element_at(F.split(F.col(path), "/"), -1)


def directory(path: str) -> F.Column:
    """All but the last component; empty at the root."""
    return F.regexp_replace(F.col(path), "/?[^/]*$", "")


def extension(path: str) -> F.Column:
    """Text after the last dot of the file name; empty for none and for names that only start with a dot."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def components(path: str) -> F.Column:
    """Array of components: the order of paths."""
    return F.split(F.col(path), "/")


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression; `*` stays within a component, `**` does not."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", r"\\") + "]", end + 1
        elif c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(x)[1:-1] for x in pattern[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def _matches(regex: str):
    return lambda c: c.rlike(regex)


def excluded(path: str, patterns: list[str]) -> F.Column:
    """Whether a glob matches the whole path or any one component."""
    out = F.lit(False)
    for p in patterns:
        r = glob_regex(p)
        out = out | F.col(path).rlike(r) | F.exists(components(path), _matches(r))
    return out


# File kinds by directory, extension and name.
CI_DIRS = [".github", ".gitlab", ".circleci"]
SOURCE_EXT = ["ts", "tsx", "js", "jsx", "rs", "py", "go"]
DOC_EXT = ["md", "txt", "rst", "adoc"]
CONFIG_EXT = ["toml", "yaml", "yml", "json", "ini", "env", "cfg", "conf", "properties", "xml"]
ASSET_EXT = ["png", "jpg", "jpeg", "gif", "svg", "ico", "woff", "woff2", "ttf", "eot", "mp3", "mp4", "webm", "pdf"]
CONFIG_NAMES = ["Dockerfile", "Makefile", "Jenkinsfile", "Procfile", ".env", ".env.local", ".env.production", ".env.development"]
CI_NAMES = [".gitlab-ci.yml"]
LANGUAGES = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "rs": "rust", "py": "python", "go": "go"}


def file_kind(path: str) -> F.Column:
    """Source, Doc, Config, Ci, Asset or Other; directories first, then extension, then name."""
    ext, name = extension(path), file_name(path)
    return (
        F.when(F.arrays_overlap(components(path), F.array(*map(F.lit, CI_DIRS))), "Ci")
        .when(ext.isin(SOURCE_EXT), "Source")
        .when(ext.isin(DOC_EXT), "Doc")
        .when(ext.isin(CONFIG_EXT), "Config")
        .when(ext.isin(ASSET_EXT), "Asset")
        .when(name.isin(CONFIG_NAMES), "Config")
        .when(name.isin(CI_NAMES), "Ci")
        .otherwise("Other")
    )


def language(path: str) -> F.Column:
    out = F.lit(None).cast("string")
    for ext, name in LANGUAGES.items():
        out = F.when(extension(path) == ext, name).otherwise(out)
    return out


# Names of languages that filters accept.
LANGUAGE_ALIASES = {"rust": "rust", "rs": "rust", "typescript": "typescript", "ts": "typescript", "javascript": "javascript", "js": "javascript", "python": "python", "py": "python", "go": "go", "golang": "go"}
LANGUAGE_EXT = {"rust": ["rs"], "typescript": ["ts", "tsx"], "javascript": ["js", "jsx"], "python": ["py"], "go": ["go"]}


def parse_language(name: str | None) -> str | None:
    """A filter's language by any of its names; an unknown name is an error."""
    if name is None:
        return None
    try:
        return LANGUAGE_ALIASES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown language {name!r}; one of {', '.join(sorted(set(LANGUAGE_ALIASES.values())))}") from None


def of_language(path: str, name: str | None) -> F.Column:
    """Whether a path's extension belongs to a language (typescript takes tsx in); none: always."""
    lang = parse_language(name)
    return F.lit(True) if lang is None else extension(path).isin(LANGUAGE_EXT[lang])
