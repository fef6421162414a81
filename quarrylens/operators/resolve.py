"""Resolution of names across files: imports of four languages, re-exports, inheritance, calls and interfaces.

Every rule is candidate generation, an equi-join and a choice by priority. "First" candidates are the least by
(path, line, column); rules that take all candidates, or only a unique one, are kept as they are."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import directory, extension, file_name
from ..plans.lineage import cut
from ..schema import CodeGraph, join_sparse, null_string, symbol_node

# The order in which a specifier's file is tried, and what the runtimes bring along.
TS_EXT = [".ts", ".tsx", ".mts", ".js", ".jsx", ".mjs", ".json", ".node"]
NODE_BUILTINS = "assert async_hooks buffer child_process cluster console constants crypto dgram dns domain events fs http http2 https inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder timers tls tty url util v8 vm wasi worker_threads zlib".split()
RUST_BUILTINS = ["std", "core", "alloc"]


@dataclass
class Manifests:
    workspaces: DataFrame  # name, dir
    crates: DataFrame  # crate_name, root
    modules: DataFrame  # module, dir
    ts_paths: dict[str, str]  # prefix -> directory


def package_name(c: F.Column) -> F.Column:
    """The package of a bare specifier: its first segment, two if it is scoped."""
    parts = F.split(c, "/")
    return F.when(c.startswith("@") & (F.size(parts) > 1), F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0])


def is_external(c: F.Column) -> F.Column:
    return ~c.startswith(".") & ~c.startswith("/")


def _normalise(c: F.Column) -> F.Column:
    from ..sources.walk import normalise

    return normalise(c)


def _joined(folder: F.Column, rest: F.Column) -> F.Column:
    return _normalise(F.concat_ws("/", F.when(folder != "", folder), rest))


def _pick(wanted: DataFrame, candidates: F.Column, files: DataFrame, key: str = "rid") -> DataFrame:
    """wanted with target: the first of its candidate paths that is a file."""
    tries = wanted.select(key, F.posexplode(candidates).alias("rank", "target")).join(files.select(F.col("path").alias("target")), "target", "left_semi")
    best = tries.groupBy(key).agg(F.min_by("target", "rank").alias("target"))
    return wanted.join(best, key, "left")


def _ts_candidates(base: F.Column) -> F.Column:
    stem = F.regexp_replace(base, r"\.(js|jsx|mjs)$", "")
    swapped = F.when(base.rlike(r"\.(js|jsx|mjs)$"), F.array(*[F.concat(stem, F.lit(e)) for e in (".ts", ".tsx")])).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(base), swapped, F.array(*[F.concat(base, F.lit(e)) for e in TS_EXT]), F.array(*[F.concat(base, F.lit(f"/index{e}")) for e in TS_EXT]))


def edge(df: DataFrame, kind: str, src="src", dst="dst", spec="specifier") -> DataFrame:
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind"), F.col(spec).alias("specifier") if spec else null_string().alias("specifier"), F.col("seq").cast("long").alias("seq") if "seq" in df.columns else F.lit(0).cast("long").alias("seq"))


def _language(parsed: DataFrame, exts: tuple[str, ...]) -> DataFrame:
    return parsed.where(extension("path").isin(*exts))


def ts_imports(parsed: DataFrame, files: DataFrame, m: Manifests) -> DataFrame:
    """(src, dst, specifier, seq, unresolved): imports of TypeScript and JavaScript files."""
    ts = _language(parsed, ("ts", "tsx", "js", "jsx"))
    i = ts.select(F.col("path").alias("src"), F.posexplode("imports").alias("seq", "i")).select("src", "seq", F.col("i.module_path").alias("specifier"))
    i = i.withColumn("rid", F.xxhash64("src", "seq"))
    own = _joined(directory("src"), F.col("specifier"))
    for prefix, folder in m.ts_paths.items():
        head = prefix.rstrip("*")
        own = F.when(F.col("specifier").startswith(head), _normalise(F.concat(F.lit(folder.rstrip("*").rstrip("/") + "/"), F.substring(F.col("specifier"), F.lit(len(head) + 1), F.length("specifier"))))).otherwise(own)
    w = m.workspaces.select(F.col("name").alias("pack"), F.col("dir"))
    i = i.withColumn("pack", package_name(F.col("specifier"))).join(w, "pack", "left")
    rest = F.substring(F.col("specifier"), F.length("pack") + 2, F.length("specifier"))
    aliased = F.lit(False)
    for prefix in m.ts_paths:
        aliased = aliased | F.col("specifier").startswith(prefix.rstrip("*"))
    local = ~is_external(F.col("specifier")) | aliased
    base = F.when(local, own).when(F.col("dir").isNotNull(), F.concat_ws("/", "dir", F.when(rest != "", rest)))
    found = _pick(i.withColumn("base", base), F.when(F.col("base").isNotNull(), _ts_candidates(F.col("base"))).otherwise(F.array().cast("array<string>")), files)
    bare = F.regexp_replace("specifier", "^node:", "")
    builtin = is_external(F.col("specifier")) & (F.col("specifier").startswith("node:") | package_name(bare).isin(NODE_BUILTINS))
    dst = F.when(F.col("target").isNotNull(), F.col("target")).when(builtin, F.concat(F.lit("builtin:"), package_name(bare))).when(~local, F.concat(F.lit("pkg:"), F.col("pack")))
    return found.select("src", dst.alias("dst"), "specifier", "seq", F.when(dst.isNull(), "not found").alias("reason"))


def barrels(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, specifier): `export * from` relative files."""
    x = parsed.select(F.col("path").alias("src"), F.posexplode("exports").alias("seq", "x")).where("x.kind = 'ReExportAll' AND x.source LIKE '.%'").select("src", "seq", F.col("x.source").alias("specifier"))
    x = x.withColumn("rid", F.xxhash64("src", "seq"))
    return _pick(x, _ts_candidates(_joined(directory("src"), F.col("specifier"))), files).where("target IS NOT NULL").select("src", F.col("target").alias("dst"), "specifier", "seq")


def named_reexports(parsed: DataFrame, files: DataFrame, linked: DataFrame) -> DataFrame:
    """(src, dst, specifier): from an importer of a name to the file behind its chain of re-exports, where not linked yet.

    linked: (src, dst, specifier) of resolved imports. A chain that comes back to itself gives no edge."""
    named = parsed.select(F.col("path").alias("file"), F.posexplode("exports").alias("k", "x")).where("x.kind = 'ReExport' AND x.source IS NOT NULL").select("file", "k", F.explode("x.names").alias("name"), F.col("x.source").alias("source"))
    named = named.withColumn("rid", F.xxhash64("file", "k", "name"))
    named = _pick(named, _ts_candidates(_joined(directory("file"), F.col("source"))), files).where("target IS NOT NULL").groupBy("file", "name").agg(F.min_by("target", "k").alias("next"))
    named = cut(named)
    specs = parsed.select(F.col("path").alias("src"), F.explode("imports").alias("i")).select("src", F.col("i.module_path").alias("specifier"), F.explode("i.specifiers").alias("s"))
    walk = specs.join(linked.select("src", "specifier", F.col("dst").alias("file")).distinct(), ["src", "specifier"]).select("src", "specifier", F.coalesce("s.alias", "s.name").alias("name"), "file", F.array("file").alias("seen"), F.lit(False).alias("moved"))
    ended = walk.limit(0)
    for hop in count(1):  # a chain never holds a file twice, so it ends
        step = walk.join(named, ["file", "name"], "left")
        ended = ended.unionByName(step.where("next IS NULL AND moved").select(ended.columns))
        if hop % 16 == 0:
            ended = cut(ended)
        walk = cut(step.where("next IS NOT NULL AND NOT array_contains(seen, next)").select("src", "specifier", "name", F.col("next").alias("file"), F.concat("seen", F.array("next")).alias("seen"), F.lit(True).alias("moved")))
        if walk.isEmpty():
            break
    out = ended.where("src <> file").select("src", F.col("file").alias("dst"), "specifier").distinct()
    return out.join(linked.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def _symbols(g: CodeGraph) -> DataFrame:
    parents = g.symbols.select(F.col("symbol_id").alias("parent_id"), F.col("file").alias("pf"))
    return join_sparse(g.symbols, parents, "parent_id", F.col("symbol_id")).select("symbol_id", "name", "kind", "line", "col", "file", F.coalesce("file", "pf").alias("home"), "parent_id", "trait_impl", "decorators")


def inheritance(g: CodeGraph, parsed: DataFrame) -> DataFrame:
    """(src, dst, kind): from the symbol of that name in the file, else the first anywhere, to those in the file, else all."""
    r = parsed.select("path", F.explode("relationships").alias("r")).where("r.kind IN ('Extends', 'Implements', 'InterfaceExtends') AND r.from_name IS NOT NULL").select("path", "r.*")
    r = r.withColumn("rid", F.xxhash64("path", "from_name", "to_name", "kind", "line"))
    s = _symbols(g).select("symbol_id", "name", "file", "home", "line", "col")
    a = r.join(s.withColumnRenamed("name", "from_name").drop("line"), "from_name")
    first = Window.partitionBy("rid").orderBy(F.coalesce(F.col("file") == F.col("path"), F.lit(False)).desc(), "home", "col", "symbol_id")
    a = a.withColumn("n", F.row_number().over(first)).where("n = 1").select("rid", "path", "kind", "to_name", symbol_node("symbol_id").alias("src"))
    b = a.join(s.withColumnRenamed("name", "to_name"), "to_name").withColumn("same", F.coalesce(F.col("file") == F.col("path"), F.lit(False)))
    b = b.withColumn("any", F.max("same").over(Window.partitionBy("rid"))).where("same OR NOT any")
    kind = F.when(F.col("kind") == "Implements", "Implements").otherwise("Extends")
    return b.select("src", symbol_node("symbol_id").alias("dst"), kind.alias("kind"))


def unique_calls(g: CodeGraph, parsed: DataFrame) -> DataFrame:
    """(src, dst): from a file to the only definition of a name it calls or mentions as a type."""
    r = parsed.select(F.col("path").alias("src"), F.explode("relationships").alias("r")).where("r.kind IN ('Calls', 'MethodCall', 'TypeReference')").select("src", F.col("r.to_name").alias("name"))
    one = g.symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("symbol_id").alias("symbol_id")).where("n = 1")
    return r.join(one, "name").select("src", symbol_node("symbol_id").alias("dst"))


# Rust


def module_tree(parsed: DataFrame, files: DataFrame, crates: DataFrame) -> DataFrame:
    """(crate_name, path, module): files of each crate's tree of `mod x;`, by their module paths.

    mod.rs, lib.rs and main.rs keep their modules beside them, others in a folder of their name."""
    rs = parsed.where(extension("path") == "rs").select("path", F.explode("mods").alias("mod"))
    owner = file_name("path").isin("mod.rs", "lib.rs", "main.rs")
    folder = F.when(owner, directory("path")).otherwise(F.regexp_replace("path", r"\.rs$", ""))
    base = F.concat_ws("/", F.when(folder != "", folder), F.col("mod"))
    rs = rs.withColumn("rid", F.xxhash64("path", "mod"))
    steps = cut(_pick(rs, F.array(F.concat(base, F.lit(".rs")), F.concat(base, F.lit("/mod.rs"))), files).where("target IS NOT NULL").select("path", "mod", "target"))
    level = cut(crates.join(files.select(F.col("path").alias("root")), "root", "left_semi").select("crate_name", F.col("root").alias("path"), F.lit("crate").alias("module")))
    tree = level
    while True:  # a file enters a crate's tree once, so it ends
        level = level.join(steps, "path").select("crate_name", F.col("target").alias("path"), F.concat_ws("::", "module", "mod").alias("module"))
        level = cut(level.join(tree.select("crate_name", "path"), ["crate_name", "path"], "left_anti").dropDuplicates(["crate_name", "path"]))
        if level.isEmpty():
            return tree
        tree = cut(tree.unionByName(level))


def rust_imports(parsed: DataFrame, tree: DataFrame, crates: DataFrame) -> DataFrame:
    """(src, dst, specifier, seq, reason): uses, by the longest prefix of their path that is a module of the tree."""
    u = parsed.where(extension("path") == "rs").select(F.col("path").alias("src"), F.posexplode("rust_uses").alias("seq", "u")).select("src", "seq", F.col("u.path").alias("specifier"))
    where = tree.groupBy(F.col("path").alias("src")).agg(F.min(F.struct("crate_name", "module")).alias("o")).select("src", F.col("o.crate_name").alias("own"), F.col("o.module").alias("module"))
    u = u.join(where, "src", "left").withColumn("rid", F.xxhash64("src", "seq"))
    p = F.regexp_replace(F.regexp_replace("specifier", r"(::)?\{.*$", ""), r"::\*$", "")
    p = F.regexp_replace(p, r"\s+as\s+\w+$", "")
    head = F.regexp_replace(F.split(F.col("specifier"), "::")[0], "-", "_")
    supers = F.floor((F.length(F.regexp_extract(p, r"^((?:super(?:::|$))*)", 1)) + 2) / 7).cast("int")
    mods = F.split("module", "::")
    up = F.when(supers <= F.size(mods) - 1, F.concat_ws("::", F.slice(mods, F.lit(1), F.greatest(F.size(mods) - supers, F.lit(1))), F.when(F.regexp_replace(p, "^(super(::|$))+", "") != "", F.regexp_replace(p, "^(super(::|$))+", ""))))
    names = crates.select(F.col("crate_name").alias("other"))
    u = u.withColumn("p", p).withColumn("head", head).withColumn("up", up).join(names, F.col("head") == F.col("other"), "left")
    full = F.when(F.col("head") == "crate", F.col("p")).when(F.col("head") == "self", F.regexp_replace(F.concat_ws("::", "module", F.regexp_replace("p", "^self(::|$)", "")), "::$", "")).when(F.col("head") == "super", F.col("up")).when(F.col("other").isNotNull(), F.regexp_replace("p", "^[^:]+", "crate"))
    u = u.withColumn("full", full).withColumn("crate_name", F.coalesce("other", "own"))
    parts = F.split("full", "::")
    tries = u.where("full IS NOT NULL").select("rid", "crate_name", F.explode(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "::"))).alias("module"))
    best = tries.join(tree, ["crate_name", "module"]).groupBy("rid").agg(F.max_by("path", F.length("module")).alias("target"))
    u = u.join(best, "rid", "left")
    builtin = F.col("head").isin(RUST_BUILTINS)
    inner = F.col("head").isin("crate", "self", "super") | F.col("other").isNotNull()
    dst = F.when(builtin, F.concat(F.lit("builtin:"), "head")).when(inner, F.col("target")).otherwise(F.concat(F.lit("pkg:"), "head"))
    return u.select("src", dst.alias("dst"), "specifier", "seq", F.when(dst.isNull(), "no such module").alias("reason"))


# Python


def python_imports(parsed: DataFrame, files: DataFrame, max_hops: int = 10) -> DataFrame:
    """(src, dst, specifier, seq, reason, kind): one row a name; names behind a package's __init__ are chased there."""
    py = _language(parsed, ("py",))
    i = py.select(F.col("path").alias("src"), F.posexplode("imports").alias("seq", "i"))
    i = i.select("src", "seq", F.col("i.kind").alias("how"), F.col("i.level").alias("level"), F.col("i.module_path").alias("module"), F.explode_outer("i.specifiers").alias("s"))
    name = F.coalesce("s.alias", "s.name")
    plain = ~F.coalesce("s.is_namespace", F.lit(False)) & (F.coalesce("s.alias", "s.name") == F.col("module"))  # `import a.b`
    i = i.withColumn("name", F.when(plain, F.lit(None)).otherwise(name)).withColumn("rid", F.xxhash64("src", "seq", "name"))
    folders = F.split(directory("src"), "/")
    up = F.when(F.col("level") <= 1, directory("src")).otherwise(F.array_join(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - F.col("level") + 1, F.lit(0))), "/"))
    rel = F.regexp_replace("module", r"\.", "/")
    base = F.when(F.col("level") > 0, F.concat_ws("/", F.when(up != "", up), F.when(rel != "", rel))).otherwise(rel)
    near = F.concat_ws("/", F.when(directory("src") != "", directory("src")), rel)
    i = i.withColumn("base", base).withColumn("near", near)
    files_of = lambda b: F.array(F.concat(b, F.lit(".py")), F.concat(b, F.lit("/__init__.py")))
    sub = F.when(F.col("name").isNotNull(), files_of(F.concat_ws("/", F.when(F.col("base") != "", F.col("base")), "name"))).otherwise(F.array().cast("array<string>"))
    own = F.when(F.col("base") != "", files_of(F.col("base"))).otherwise(F.array(F.lit("__init__.py")))
    # a name that is itself a module below the package wins over the package
    cand = F.concat(sub, own, F.when(F.col("level") == 0, files_of(F.concat(F.lit("src/"), F.col("base")))).otherwise(F.array().cast("array<string>")))
    found = cut(_pick(i, cand, files))
    # names that an __init__ imports from elsewhere are followed to where they are defined
    again = found.where("target IS NOT NULL").where("name IS NOT NULL").select(F.col("src").alias("file"), F.coalesce("s.name", "name").alias("local"), "name", F.col("target").alias("next"))
    again = cut(again.where(file_name("file") == "__init__.py").groupBy("file", "local").agg(F.min("next").alias("next"), F.min("name").alias("orig")))
    walk = found.where("target IS NOT NULL AND name IS NOT NULL").where(file_name("target") == "__init__.py").select("rid", "name", F.col("target").alias("file"), F.col("target").alias("at"))
    ended = walk.limit(0).select("rid", F.col("at").alias("end"))
    for _ in range(max_hops):
        step = walk.join(again.select("file", F.col("local").alias("name"), "next", "orig"), ["file", "name"], "left")
        ended = ended.unionByName(step.where("next IS NULL OR next = file").select("rid", F.col("file").alias("end")))
        walk = cut(step.where("next IS NOT NULL AND next <> file").select("rid", F.col("orig").alias("name"), F.col("next").alias("file"), F.col("next").alias("at")))
        if walk.isEmpty():
            break
    ended = ended.unionByName(walk.select("rid", F.col("file").alias("end"))).dropDuplicates(["rid"])
    found = found.join(ended, "rid", "left").withColumn("target", F.coalesce("end", "target"))
    head = F.split("module", r"\.")[0]
    std = (F.col("level") == 0) & head.isin(sorted(sys.stdlib_module_names))
    # the standard library comes first: a project file of such a name does not hide it
    dst = F.when(std, F.concat(F.lit("pkg:"), head)).when(F.col("target").isNotNull(), F.col("target")).when((F.col("level") == 0) & (head != ""), F.concat(F.lit("pkg:"), head))
    spec = F.concat(F.repeat(F.lit("."), F.col("level").cast("int")), "module")
    kind = F.when(F.col("how") == "PythonConditional", "ConditionalImport").otherwise("ResolvedImport")
    return found.select("src", dst.alias("dst"), spec.alias("specifier"), "seq", F.when(dst.isNull(), "not found").alias("reason"), kind.alias("kind"))


def python_wildcards(parsed: DataFrame, g: CodeGraph, resolved: DataFrame) -> DataFrame:
    """(src, dst): symbols that `from m import *` brings in: those of __all__, else those without an underscore."""
    star = parsed.select(F.col("path").alias("src"), F.posexplode("imports").alias("seq", "i")).where("exists(i.specifiers, s -> s.is_namespace)").select("src", "seq")
    into = star.join(resolved.select("src", "seq", F.col("dst").alias("file")).distinct(), ["src", "seq"])
    return into.join(g.symbols.where("parent_id IS NULL AND is_exported").select("file", "symbol_id"), "file").select("src", symbol_node("symbol_id").alias("dst")).distinct()


# Go


def go_imports(parsed: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, dst, specifier, seq, reason, kind): an import goes to every file of the folder it names."""
    go = _language(parsed, ("go",))
    i = go.select(F.col("path").alias("src"), F.posexplode("imports").alias("seq", "i")).select("src", "seq", F.col("i.kind").alias("how"), F.col("i.module_path").alias("specifier"))
    i = i.withColumn("rid", F.xxhash64("src", "seq"))
    parts = F.split("specifier", "/")
    heads = i.select("rid", "specifier", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("module"))
    best = heads.join(modules, "module").groupBy("rid", "specifier").agg(F.max_by(F.struct("module", "dir"), F.length("module")).alias("m"))
    rest = F.substring(F.col("specifier"), F.length("m.module") + 2, F.length("specifier"))
    local = best.select("rid", F.concat_ws("/", F.when(F.col("m.dir") != "", F.col("m.dir")), F.when(rest != "", rest)).alias("folder"))
    gofiles = files.where(extension("path") == "go").select(F.col("path").alias("target"), directory("path").alias("folder"))
    vendor = i.select("rid", F.concat(F.lit("vendor/"), F.col("specifier")).alias("folder")).join(gofiles.select("folder").distinct(), "folder", "left_semi")
    chosen = vendor.unionByName(local.join(vendor.select("rid"), "rid", "left_anti"))
    hits = i.join(chosen, "rid", "left").join(gofiles, "folder", "left")
    std = ~F.contains(parts[0], F.lit("."))
    dst = F.when(F.col("target").isNotNull(), F.col("target")).when(F.col("folder").isNull(), F.concat(F.lit("pkg:"), "specifier"))
    kind = F.when(F.col("target").isNull(), "ResolvedImport").when(F.col("how") == "GoBlank", "SideEffectImport").when(F.col("how") == "GoDot", "DotImport").otherwise("ResolvedImport")
    return hits.where(dst.isNull() | ~F.coalesce(F.col("target") == F.col("src"), F.lit(False))).select("src", dst.alias("dst"), "specifier", "seq", F.when(dst.isNull() & ~std, "no such package").when(dst.isNull(), "not found").alias("reason"), kind.alias("kind"))


def go_receivers(g: CodeGraph) -> DataFrame:
    """(symbol_id, parent_id): Go methods and the first struct of their receiver's name in the same file, else folder."""
    s = _symbols(g).where(extension("home") == "go")
    m = s.where("kind = 'method' AND trait_impl IS NOT NULL AND parent_id IS NULL").select("symbol_id", F.col("trait_impl").alias("name"), F.col("home").alias("mf"))
    t = s.where("kind = 'struct'").select("name", F.col("symbol_id").alias("sid"), "home", "line")
    own = m.join(t, "name").where((F.col("mf") == F.col("home")) | (directory("mf") == directory("home")))
    first = Window.partitionBy("symbol_id").orderBy((F.col("mf") == F.col("home")).desc(), "home", "line")
    return own.withColumn("n", F.row_number().over(first)).where("n = 1").select("symbol_id", F.col("sid").alias("parent_id"))


def go_embeds(g: CodeGraph) -> DataFrame:
    """(src, dst): structs and the first type of each embedded name that is not themselves."""
    s = _symbols(g).where(extension("home") == "go")
    e = s.where("kind = 'struct'").select("symbol_id", F.explode("decorators").alias("d")).where("d.name = '__embedded__'").select("symbol_id", F.element_at(F.split(F.col("d.args_raw"), r"\."), -1).alias("name"))
    t = s.where("kind IN ('struct', 'interface', 'type')").select("name", F.col("symbol_id").alias("to"), "home", "line")
    first = Window.partitionBy("symbol_id", "name").orderBy("home", "line")
    return e.join(t, "name").where("to <> symbol_id").withColumn("n", F.row_number().over(first)).where("n = 1").select(symbol_node("symbol_id").alias("src"), symbol_node("to").alias("dst"))


def implicit_interfaces(has: DataFrame, wants: DataFrame) -> DataFrame:
    """(struct_id, iface_id) where a struct's methods (struct_id, method) include all of an interface's (iface_id, method).

    Relational division by counting; interfaces without methods have no rows and match nothing."""
    size = wants.groupBy("iface_id").agg(F.countDistinct("method").alias("size"))
    met = has.distinct().join(wants.distinct(), "method").groupBy("struct_id", "iface_id").agg(F.count("*").alias("n"))
    return met.join(size, "iface_id").where("n = size").select("struct_id", "iface_id")


def go_implements(g: CodeGraph) -> DataFrame:
    s = _symbols(g)
    methods = s.where("kind = 'method'").select(F.col("parent_id"), F.col("name").alias("method"))
    structs = s.where((extension("home") == "go") & (F.col("kind") == "struct")).select(F.col("symbol_id").alias("parent_id"))
    ifaces = s.where((extension("home") == "go") & (F.col("kind") == "interface")).select(F.col("symbol_id").alias("parent_id"))
    has = methods.join(structs, "parent_id", "left_semi").select(F.col("parent_id").alias("struct_id"), "method")
    wants = methods.join(ifaces, "parent_id", "left_semi").select(F.col("parent_id").alias("iface_id"), "method")
    return implicit_interfaces(has, wants).select(symbol_node("struct_id").alias("src"), symbol_node("iface_id").alias("dst"))


def resolve(g: CodeGraph, parsed: DataFrame, m: Manifests) -> CodeGraph:
    """The graph with all edges, packages, builtins and unresolved imports of its parse results."""
    files = g.files
    tree = module_tree(parsed, files, m.crates)
    per_file = tree.groupBy("path").agg(F.min("crate_name").alias("c"))
    files = cut(files.join(per_file, "path", "left").withColumn("crate_name", F.coalesce("crate_name", "c")).drop("c"))
    g = g.with_(files=files)
    links = g.child_of().limit(0)
    up = go_receivers(g).withColumnRenamed("parent_id", "new_parent")
    symbols = g.symbols.join(up, "symbol_id", "left")
    # a receiver's methods are nested in their struct and keep their own file
    symbols = cut(symbols.withColumn("parent_id", F.coalesce("parent_id", "new_parent")).drop("new_parent"))
    g = g.with_(symbols=symbols)
    kinds = lambda df: df if "kind" in df.columns else df.withColumn("kind", F.lit("ResolvedImport"))
    cols = ["src", "dst", "specifier", "seq", "reason", "kind"]
    py = python_imports(parsed, files)
    imports = kinds(ts_imports(parsed, files, m)).select(cols)
    for df in (rust_imports(parsed, tree, m.crates), py, go_imports(parsed, files, m.modules)):
        imports = imports.unionByName(kinds(df).select(cols))
    imports = cut(imports)
    uid = F.xxhash64("src", "seq", "specifier")
    dst = F.coalesce("dst", F.concat(F.lit("unresolved:"), uid.cast("string")))
    good = imports.where("dst IS NOT NULL")
    edges = imports.select("src", dst.alias("dst"), "kind", "specifier", F.col("seq").cast("long").alias("seq"))
    edges = edges.unionByName(edge(barrels(parsed, files), "BarrelReExportAll")).unionByName(edge(named_reexports(parsed, files, good.where("kind = 'ResolvedImport'")), "ResolvedImport"))
    family = inheritance(g, parsed)
    more = [family.select("src", "dst", "kind", null_string().alias("specifier"), F.lit(0).cast("long").alias("seq")), edge(unique_calls(g, parsed), "Calls", spec=None), edge(go_embeds(g), "Embeds", spec=None), edge(go_implements(g), "Implements", spec=None), edge(python_wildcards(parsed, g, py.where("dst IS NOT NULL")), "ResolvedImport", spec=None)]
    for df in more:
        edges = edges.unionByName(df)
    own = lambda prefix: good.where(F.col("dst").startswith(prefix)).select(F.substring(F.col("dst"), F.lit(len(prefix) + 1), F.length("dst")).alias("name")).distinct()
    return g.with_(
        edges=cut(links.unionByName(edges)), packages=own("pkg:").withColumn("version", null_string()), builtins=own("builtin:"),
        unresolved=imports.where("dst IS NULL").select(uid.alias("uid"), "specifier", "reason"),
    )
