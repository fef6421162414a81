"""Reading a project: its files, manifests and configuration as tables."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import SOURCE_EXT, components, excluded, extension, file_kind, file_name, language

# Project markers and what languages' configuration files are called.
MARKERS = [".git", "Cargo.toml", "package.json", "go.mod", "pyproject.toml", "setup.py"]
LANGUAGE_FILES = {"Cargo.toml": "rust", "tsconfig.json": "typescript", "package.json": "javascript", "go.mod": "go", "go.work": "go", "pyproject.toml": "python", "setup.py": "python", "setup.cfg": "python", "requirements.txt": "python"}
HARD_EXCLUDES = ["node_modules"]


@dataclass
class Options:
    """What a project's configuration sets."""

    exclude: list[str] = field(default_factory=list)
    high_threshold: int = 20
    medium_threshold: int = 5

    @staticmethod
    def from_toml(content: str) -> Options:
        """Options of a configuration text; what cannot be read leaves the defaults."""
        try:
            t = tomllib.loads(content)
        except tomllib.TOMLDecodeError:
            return Options()
        impact = t.get("impact", {})
        return Options(list(t.get("exclude", [])), int(impact.get("high_threshold", 20)), int(impact.get("medium_threshold", 5)))


OPTIONS_FILE = "quarrylens.toml"


def _root_text(files: DataFrame, name: str) -> str | None:
    """The text of one file at the root; such files are small."""
    row = files.where(F.col("path") == name).select(F.col("content").cast("string").alias("c")).first()
    return row.c if row else None


def project_options(files: DataFrame) -> Options:
    """What the configuration file at the root sets."""
    text = _root_text(files, OPTIONS_FILE)
    return Options.from_toml(text) if text else Options()


def typescript_paths(files: DataFrame) -> dict[str, str]:
    """Path patterns of the tsconfig.json at the root with the first folder each stands for; comments and spare commas are allowed."""
    text = _root_text(files, "tsconfig.json")
    if not text:
        return {}
    bare = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    try:
        options = json.loads(re.sub(r",(\s*[}\]])", r"\1", bare)).get("compilerOptions", {})
    except (ValueError, AttributeError):
        return {}
    base = str(PurePosixPath(options.get("baseUrl", ".")))
    base = "" if base == "." else base + "/"
    return {k: base + re.sub(r"^(?:\./)+", "", v[0]) for k, v in options.get("paths", {}).items() if v}


def _glob(pattern: str) -> str:
    """A pattern over folders as a regular expression; stars stay within a folder, two stars do not."""
    parts = re.split(r"(\*\*/?|\*|\?)", re.sub(r"^(?:\./)+|/+$", "", pattern))
    return "^" + "".join({"*": "[^/]*", "?": "[^/]", "**": ".*", "**/": "(?:.*/)?"}.get(x, re.escape(x)) for x in parts) + "$"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime, content) of all files below root, paths relative to it."""
    root = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = "^.*?" + re.escape(re.sub(r"^[a-z0-9]+:/*", "/", root)) + "/"
    return rows.select(F.regexp_replace("path", prefix, "").alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), "content")


class Ignore:
    """Rules of ignore files: the last rule that matches a path or one of its folders decides; deeper files come later."""

    def __init__(self, files: list[tuple[str, str]]):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for path, content in sorted(files, key=lambda x: x[0].count("/")):
            base = path.rpartition("/")[0]
            for line in content.splitlines():
                line = line.rstrip()
                if not line or line.startswith("#"):
                    continue
                negate = line.startswith("!")
                line = line[1:] if negate else line
                only_dir = line.endswith("/")
                line = line.rstrip("/")
                anchored = "/" in line
                body = "".join(".*/" if t == "**/" else "/.*" if t == "/**" else ".*" if t == "**" else "[^/]*" if t == "*" else "[^/]" if t == "?" else t if t.startswith("[") else re.escape(t) for t in re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\]|.", line.lstrip("/")))
                body = body.replace(".*/", "(?:.*/)?")
                start = re.escape(base + "/") if base else ""
                self.rules.append((re.compile("^" + start + ("" if anchored else "(?:.*/)?") + body + "$"), negate, only_dir))

    def ignored(self, path: str) -> bool:
        parts = path.split("/")
        for i in range(1, len(parts) + 1):
            sub, is_dir, out = "/".join(parts[:i]), i < len(parts), False
            for rule, negate, only_dir in self.rules:
                if (is_dir or not only_dir) and rule.match(sub):
                    out = not negate
            if out:
                return True
        return False


def visible(files: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """files without ignored and excluded ones. The ignore files of one project are read to the driver: text of its rules only."""
    kept = files.where(~F.arrays_overlap(components("path"), F.array(*map(F.lit, HARD_EXCLUDES))))
    if exclude:
        kept = kept.where(~excluded("path", exclude))
    rules = [(r.path, r.content) for r in kept.where(file_name("path") == ".gitignore").select("path", F.col("content").cast("string").alias("content")).collect()]
    if rules:
        ignore = Ignore(rules)

        @F.pandas_udf("boolean")
        def hidden(p: pd.Series) -> pd.Series:
            return p.map(ignore.ignored)

        kept = kept.where(~hidden("path"))
    return kept


def source_files(files: DataFrame, exclude: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """Files that the parsers read, of the languages asked for."""
    out = visible(files, exclude).where(extension("path").isin(SOURCE_EXT))
    return out.where(language("path").isin(languages)) if languages else out


def other_files(files: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    return visible(files, exclude).where(~extension("path").isin(SOURCE_EXT))


def file_table(files: DataFrame) -> DataFrame:
    """The graph's files: path, language, crate_name, kind, n_lines."""
    text = F.col("content").cast("string")
    return files.select("path", language("path").alias("language"), F.lit(None).cast("string").alias("crate_name"), file_kind("path").alias("kind"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("n_lines"))


def detect_languages(files: DataFrame) -> DataFrame:
    """(language) by configuration files at the root or one folder down; a tsconfig.json hides javascript."""
    c = F.col("path")
    top = files.where(F.size(F.split(c, "/")) <= 2)
    out = F.lit(None).cast("string")
    for name, lang in LANGUAGE_FILES.items():
        out = F.when(file_name("path") == name, lang).otherwise(out)
    found = top.select(out.alias("language")).where("language IS NOT NULL").distinct()
    ts = found.agg(F.bool_or(F.col("language") == "typescript").alias("ts"))
    return found.join(ts, F.lit(True)).where(~((F.col("language") == "javascript") & F.col("ts"))).select("language")


def node_workspaces(files: DataFrame) -> DataFrame:
    """(name, dir) of workspace packages: those that package.json or pnpm-workspace.yaml patterns at the root take in; src/ is preferred."""
    dir_ = F.regexp_replace("path", "/?[^/]*$", "")
    packs = files.where(file_name("path") == "package.json").select(dir_.alias("dir"), F.get_json_object(F.col("content").cast("string"), "$.name").alias("name"))
    root = files.where(F.col("path").isin("package.json", "pnpm-workspace.yaml")).select("path", F.col("content").cast("string").alias("c")).collect()
    patterns: list[str] = []
    for r in root:
        if r.path == "package.json":
            try:
                w = json.loads(r.c).get("workspaces", [])
            except ValueError:
                continue
            patterns += w.get("packages", []) if isinstance(w, dict) else w
        else:
            patterns += re.findall(r"^\s*-\s*['\"]?([^'\"\s]+)", r.c, re.M)
    keep = F.lit(False)
    for p in patterns:
        keep = keep | F.col("dir").rlike(_glob(p))
    has_src = files.where(F.col("path").rlike("/src/")).select(F.regexp_extract("path", "^(.*?)/src/", 1).alias("dir"), F.lit(True).alias("src")).distinct()
    return packs.where(F.col("name").isNotNull() & (F.col("dir") != "") & keep).join(has_src, "dir", "left").select("name", F.when(F.col("src"), F.concat("dir", F.lit("/src"))).otherwise(F.col("dir")).alias("dir"))


def cargo_crates(files: DataFrame) -> DataFrame:
    """(crate_name, root): each package, dashes as underscores, and its root file ([lib] path, src/lib.rs, src/main.rs).

    Packages are those of the manifest at the root and of the members its workspace names; without one, every manifest's."""
    members = None
    if text := _root_text(files, "Cargo.toml"):
        try:
            members = tomllib.loads(text).get("workspace", {}).get("members", [])
        except tomllib.TOMLDecodeError:
            members = []

    def run(frames):
        for f in frames:
            rows = []
            for path, content in zip(f.path, f.content):
                try:
                    t = tomllib.loads(bytes(content).decode())
                except (ValueError, UnicodeDecodeError):
                    continue
                if name := t.get("package", {}).get("name"):
                    base = str(PurePosixPath(path).parent)
                    base = "" if base == "." else base + "/"
                    for i, root in enumerate([t.get("lib", {}).get("path"), "src/lib.rs", "src/main.rs"]):
                        if root:
                            rows.append((name.replace("-", "_"), base + root, i))
            yield pd.DataFrame(rows, columns=["crate_name", "root", "i"])

    manifests = files.where(file_name("path") == "Cargo.toml")
    if members is not None:
        wanted = F.col("path") == "Cargo.toml"
        for m in members:
            wanted = wanted | F.regexp_replace("path", "/?Cargo[.]toml$", "").rlike(_glob(m))
        manifests = manifests.where(wanted)
    found = manifests.select("path", "content").mapInPandas(run, "crate_name string, root string, i int")
    there = found.join(files.select(F.col("path").alias("root")), "root", "left_semi")
    return there.groupBy("crate_name").agg(F.min_by("root", "i").alias("root"))


def go_modules(files: DataFrame) -> DataFrame:
    """(module, dir) of go.mod files, with their local replacements: with a go.work, those at the root and in the folders it uses, else all."""
    text = F.col("content").cast("string")
    if not files.where("path = 'go.work'").isEmpty():
        used = go_work_dirs(files).withColumnRenamed("dir", "used")
        at = F.regexp_replace("path", "/?[^/]*$", "")
        files = files.where(file_name("path") == "go.mod")
        files = files.where("path = 'go.mod'").unionByName(files.where("path <> 'go.mod'").join(used, at == F.col("used"), "left_semi"))
    mods = files.where(file_name("path") == "go.mod").select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), text.alias("t"))
    own = mods.select(F.regexp_extract("t", r"(?m)^\s*module\s+(\S+)", 1).alias("module"), "dir")
    swap = mods.select("dir", F.explode(F.regexp_extract_all("t", F.lit(r"(?m)^\s*(?:replace\s+)?(\S+(?:\s+v\S+)?\s+=>\s+\.{1,2}/\S+)"), 1)).alias("r"))
    swap = swap.select(F.regexp_extract("r", r"^(\S+)", 1).alias("module"), normalise(F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), F.regexp_extract("r", r"=>\s+(\S+)", 1))).alias("dir"))
    return own.where("module <> ''").unionByName(swap)


def go_work_dirs(files: DataFrame) -> DataFrame:
    """(dir) that go.work uses."""
    text = F.col("content").cast("string")
    w = files.where(file_name("path") == "go.work").select(F.explode(F.regexp_extract_all(F.regexp_replace(text, r"(?s)use\s*\((.*?)\)", "use $1"), F.lit(r"(?m)^\s*(?:use\s+)?(\.{1,2}(?:/\S*)?)\s*$"), 1)).alias("d"))
    return w.select(normalise(F.col("d")).alias("dir")).distinct()


def normalise(path: F.Column) -> F.Column:
    """A path without `.` and `..` components; one that leaves the root becomes null."""
    start = F.array().cast("array<string>")
    step = lambda acc, x: F.when((x == "") | (x == "."), acc).when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.lit(None).cast("array<string>"))
    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")


def project_root(path: str, exists) -> str:
    """The nearest folder at or above path that holds a marker (exists: path -> bool); path itself if none does."""
    p = PurePosixPath(path)
    for folder in (p, *p.parents):
        if any(exists(str(folder / m)) for m in MARKERS):
            return str(folder)
    return path
