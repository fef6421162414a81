"""The operators on small hand-built graphs."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrylens.functions import paths, text
from quarrylens.operators import aggregates, decorators, export, graphjson, lookup, retrieval, search, snapshots, traverse
from quarrylens.plans.kernels import bfs, scc
from quarrylens.schema import EDGES, FILES, SYMBOLS, CodeGraph
from quarrylens.sources import store
from quarrylens.sources.walk import Ignore, Options, detect_languages, go_modules, go_work_dirs, project_root


def graph(spark, files, symbols=(), edges=(), packages=(), builtins=()):
    """files: path or (path, kind, language, crate, lines); symbols: dicts; edges: (src, dst, kind[, specifier])."""
    lang = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "rs": "rust", "py": "python", "go": "go"}
    rows = []
    for f in files:
        f = f if isinstance(f, tuple) else (f,)
        path, kind, language, crate, lines = (*f, *[None] * (5 - len(f)))
        rows.append((path, language or lang.get(path.rpartition(".")[2]), crate, kind or "Source", lines or 0))
    base = {"parent_id": None, "kind": "variable", "line": 0, "col": 0, "line_end": 0, "is_exported": False, "is_default": False, "visibility": "private", "trait_impl": None, "decorators": []}
    cols = [c.split()[0] for c in SYMBOLS.split(", ")[:12]] + ["decorators"]
    syms = []
    for i, s in enumerate(symbols, 1):
        r = {**base, "symbol_id": i, **s}
        r["decorators"] = [(d, None, None, None, None) if isinstance(d, str) else d for d in r["decorators"]]
        syms.append(tuple(r[c] for c in cols))
    e = [(x[0], x[1], x[2], x[3] if len(x) > 3 else x[1], i) for i, x in enumerate(edges)]
    g = CodeGraph.empty(spark)
    return g.with_(files=spark.createDataFrame(rows, FILES), symbols=spark.createDataFrame(syms, SYMBOLS), edges=spark.createDataFrame(e, EDGES), packages=spark.createDataFrame([(p, None) for p in packages], "name string, version string"), builtins=spark.createDataFrame([(b,) for b in builtins], "name string"))


def named(g, name):
    return g.symbols.where(F.col("name") == name).select("symbol_id")


R = "ResolvedImport"


def test_impact_follows_imports_only(spark):
    g = graph(spark, ["a.ts", "b.ts", "c.ts", "d.ts", "e.ts", "caller.ts", "other.ts"], [{"name": "foo", "file": "a.ts"}], [("b.ts", "a.ts", R), ("c.ts", "b.ts", R), ("d.ts", "c.ts", R), ("e.ts", "d.ts", R), ("caller.ts", "s:1", "Calls"), ("c.ts", "s:1", "Calls"), ("a.ts", "c.ts", R)])
    got = {r.file_path: (r.depth, r.confidence) for r in traverse.impact(g, named(g, "foo")).collect()}
    assert got == {"b.ts": (1, "High"), "c.ts": (2, "High"), "d.ts": (3, "Medium"), "e.ts": (4, "Low")}
    assert traverse.impact(g, named(g, "nothing")).count() == 0


def test_confidence_and_risk(spark):
    df = spark.createDataFrame([(1, False), (2, False), (3, False), (4, False), (3, True)], "depth int, direct boolean").select(traverse.confidence().alias("c"), traverse.basis().alias("b"))
    assert [r.c for r in df.collect()] == ["High", "Medium", "Medium", "Low", "High"]
    assert [r.b for r in df.collect()][3] == "deep transitive dependency at depth 4"
    n = spark.createDataFrame([(21,), (20,), (5,), (4,)], "n int")
    assert [r.r for r in n.select(traverse.risk("n").alias("r")).collect()] == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]
    assert [r.r for r in n.select(traverse.risk("n", 3, 2).alias("r")).collect()] == ["HIGH"] * 4


def test_diff_impact(spark):
    edges = [(f"x{i}.ts", "hub.ts", R) for i in range(6)] + [("y.ts", "leaf.ts", R)]
    g = graph(spark, ["hub.ts", "leaf.ts", "empty.ts", "y.ts", *[f"x{i}.ts" for i in range(6)]], [{"name": "h", "file": "hub.ts"}, {"name": "l", "file": "leaf.ts"}], edges)
    report, rows = traverse.diff_impact(g, spark.createDataFrame([("leaf.ts",), ("hub.ts",), ("empty.ts",), ("gone.ts",)], "path string"))
    assert [tuple(r) for r in report.collect()] == [("hub.ts", 6, "MEDIUM"), ("leaf.ts", 1, "LOW"), ("empty.ts", 0, "LOW")]
    assert rows.count() == 7


def find_graph(spark):
    return graph(spark, ["src/user.ts", "src/auth.ts", "src2/x.tsx"], [{"name": "UserService", "kind": "class", "file": "src/user.ts", "line": 10}, {"name": "AuthService", "kind": "class", "file": "src/auth.ts", "line": 3}, {"name": "login", "kind": "method", "parent_id": 2, "file": None, "line": 5}, {"name": "authHandler", "kind": "function", "file": "src2/x.tsx", "line": 1}])


def test_find(spark):
    g = find_graph(spark)
    names = lambda *a, **k: [r.symbol_name for r in lookup.find(g, *a, **k).collect()]
    assert names("^UserService$") == ["UserService"] and names("Service$") == ["AuthService", "UserService"]
    assert names("userservice") == [] and names("userservice", True) == ["UserService"]
    assert names(".", kinds=["method"]) == ["login"] and lookup.find(g, "login").first().file_path == "src/auth.ts"
    assert names(".", file_prefix="src") == ["AuthService", "login", "UserService"]
    assert names(".", language="typescript") == ["AuthService", "login", "UserService"]
    with pytest.raises(ValueError):
        lookup.find(g, "(")
    with pytest.raises(ValueError):
        lookup.find(g, ".", language="cobol")
    assert [(r.name, r.ids) for r in lookup.match_symbols(g, "Service").collect()] == [("AuthService", [2]), ("UserService", [1])]


def test_search(spark):
    g = find_graph(spark)
    docs = search.documents(g)
    assert search.trigram_search(docs, "authHandlr").first().symbol_name == "authHandler"
    assert search.bm25_search(docs, "auth handler").first().symbol_name == "authHandler"
    assert search.bm25_search(docs, "zzz").count() == 0 and search.trigram_search(docs, "ab").count() == 0
    assert search.search(g, "authservice").first().symbol_name == "AuthService"
    assert search.search(g, "authHandlr").first().symbol_name == "authHandler"
    assert search.search(g, "((").count() == 0
    a = spark.createDataFrame([("alpha", "f", 1, 1), ("beta", "f", 2, 2)], "symbol_name string, file_path string, line int, rank int")
    b = spark.createDataFrame([("beta", "f", 2, 1), ("gamma", "f", 3, 2)], "symbol_name string, file_path string, line int, rank int")
    assert [r.symbol_name for r in search.fuse(a, b).collect()] == ["beta", "alpha", "gamma"]
    pairs = search.trigram_pairs(docs, spark.createDataFrame([("authHandlr",)], "query string"))
    assert {r.symbol_name for r in pairs.collect()} >= {"authHandler"}


def test_text(spark):
    df = spark.createDataFrame([("authHandler",), ("parse_token",), ("main",), ("HTTPServer",), ("_x__yZ",)], "s string").select(text.split_identifier(F.col("s")).alias("o"))
    assert [r.o for r in df.collect()] == ["authHandler auth handler", "parse_token parse token", "main main", "HTTPServer h t t p server", "_x__yZ x y z"]
    one = lambda c: spark.range(1).select(c.alias("o")).first().o
    assert one(text.trigrams(F.lit("ab"))) == [] and sorted(one(text.trigrams(F.lit("ABAB")))) == ["aba", "bab"]
    assert one(text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    stems = {"queries": "query", "languages": "language", "programming": "programm", "handlers": "handler", "is": "is", "used": "used", "ties": "tie"}
    assert {w: one(text.stem(F.lit(w))) for w in stems} == stems
    assert retrieval.pattern_of("Where is the authHandlers function", spark) == "authhandler" and retrieval.pattern_of("how is it?", spark) == r"it\?"
    assert [retrieval.classify(q, spark) for q in ("Where is x", "how does y", "x y z", " FIND it")] == ["Structural", "Conceptual", "Hybrid", "Structural"]


def test_cycles(spark):
    g = graph(spark, [f"{c}.ts" for c in "abcdefgh"], (), [("a.ts", "b.ts", R), ("b.ts", "a.ts", R), ("c.ts", "d.ts", R), ("d.ts", "e.ts", R), ("e.ts", "c.ts", R), ("e.ts", "a.ts", R), ("f.ts", "g.ts", R), ("f.ts", "f.ts", R), ("g.ts", "h.ts", "BarrelReExportAll"), ("h.ts", "g.ts", "BarrelReExportAll"), ("f.ts", "pkg:x", R)])
    assert [r.files for r in traverse.circular(g).collect()] == [["a.ts", "b.ts", "a.ts"], ["c.ts", "d.ts", "e.ts", "c.ts"]]
    assert traverse.circular(g, "rust").count() == 0
    assert scc(g.file_imports().where("false")).count() == 0


def test_scc_against_closure(spark):
    import random

    rnd = random.Random(7)
    edges = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(55)}
    reach = {i: {i} for i in range(40)}
    for _ in range(40):
        for a, b in edges:
            reach[a] |= reach[b]
    name = lambda i: f"n{i:02}"
    want = {name(i): min(name(j) for j in range(40) if j in reach[i] and i in reach[j]) for i in range(40)}
    sizes = pd.Series(want).value_counts()
    want = {k: v for k, v in want.items() if sizes[v] > 1}
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "src string, dst string")
    assert {r.node: r.component for r in scc(df).collect()} == want


def test_refs_context_rename(spark):
    g = graph(spark, ["a.ts", "b.ts", "c.ts", "d.ts"], [{"name": "foo", "file": "a.ts", "line": 1, "kind": "function"}, {"name": "bar", "file": "b.ts", "line": 4, "kind": "function"}, {"name": "Base", "file": "a.ts", "line": 9, "kind": "class"}, {"name": "Kid", "file": "c.ts", "line": 2, "kind": "class"}], [("b.ts", "a.ts", R), ("b.ts", "a.ts", R), ("s:2", "s:1", "Calls"), ("d.ts", "s:1", "Calls"), ("s:4", "s:3", "Extends"), ("s:4", "s:1", "Implements"), ("a.ts", "s:2", "Calls")])
    got = [tuple(r) for r in lookup.refs(g, named(g, "foo")).collect()]
    assert got == [("b.ts", "Call", "bar", 4), ("b.ts", "Import", None, None), ("d.ts", "Call", None, None)]
    assert lookup.refs(g, named(g, "foo"), kind="Import").count() == 1
    ctx = {(r.section, r.symbol_name) for r in lookup.context(g, named(g, "foo")).collect() if r.symbol_name}
    assert ctx == {("definitions", "foo"), ("references", "bar"), ("callees", "bar"), ("callers", "bar"), ("implemented_by", "Kid")}
    assert {(r.section, r.symbol_name) for r in lookup.context(g, named(g, "Kid"), ("extends", "implements")).collect()} == {("extends", "Base"), ("implements", "foo")}
    assert lookup.context(g, named(g, "zzz")).count() == 0
    plan = [(r.file_path, r.line, r.note is None) for r in lookup.plan_rename(g, "foo", "foo2").collect()]
    assert plan == [("a.ts", 1, True), ("b.ts", 0, False), ("b.ts", 4, True), ("d.ts", 0, False)]
    assert lookup.plan_rename(g, "zzz", "x").count() == 0


def test_dead_code(spark):
    syms = [{"name": "dead", "file": "src/x.ts"}, {"name": "used", "file": "src/x.ts"}, {"name": "main", "kind": "function", "file": "src/m.rs"}, {"name": "p", "file": "src/m.rs", "visibility": "pub(crate)"}, {"name": "priv", "file": "src/m.rs", "is_exported": True}, {"name": "shown", "file": "src/x.ts", "is_exported": True}, {"name": "t", "file": "src/x.ts", "trait_impl": "T"}, {"name": "test_a", "file": "src/x.ts"}, {"name": "in_test", "file": "src/tests/y.ts"}]
    g = graph(spark, ["src/x.ts", "src/m.rs", "src/tests/y.ts", "src/used.ts", "index.ts", "a.test.ts", ("doc.md", "Doc")], syms, [("src/x.ts", "src/used.ts", R), ("src/x.ts", "s:2", "Calls")])
    assert [r.path for r in aggregates.unreachable_files(g).collect()] == ["src/m.rs", "src/x.ts"]
    assert [r.path for r in aggregates.unreachable_files(g, "sr").collect()] == []
    assert [r.name for r in aggregates.unreferenced_symbols(g).collect()] == ["priv", "dead"]


def test_clones(spark):
    s = [{"name": n, "kind": "function", "file": f, "line": 1, "line_end": e, "decorators": d} for n, f, e, d in (("a", "a/x.ts", 5, []), ("b", "a/x.ts", 5, []), ("c", "b/y.ts", 5, []), ("d", "b/y.ts", 9, []), ("e", "b/y.ts", 5, ["X"]))]
    g = graph(spark, ["a/x.ts", "b/y.ts"], s)
    rows = aggregates.clones(g).collect()
    assert [(r.name, r.group_size) for r in rows] == [("a", 3), ("b", 3), ("c", 3)] and len({r.hash for r in rows}) == 1
    h = 0xCBF29CE484222325
    for v in (1, 4, 0, 1, 0):
        h = (h ^ v) * 0x100000001B3 % 2**64
    assert int(rows[0].hash) == h
    assert aggregates.clones(g, min_group=4).count() == 0 and aggregates.clones(g, scope="a").count() == 2


def test_clusters_and_labels(spark):
    g = graph(spark, ["src/auth/auth.rs", "src/api/routes.rs", "src/main.rs"], [{"name": "authenticate", "file": "src/auth/auth.rs"}, {"name": "authorize", "file": "src/auth/auth.rs"}, {"name": "get_users", "file": "src/api/routes.rs"}, {"name": "m", "file": "src/main.rs"}], [("s:1", "s:2", "Calls"), ("s:4", "s:3", "Calls"), ("s:4", "s:3", "Calls")])
    got = {r.label: (r.member_count, r.top_symbols) for r in traverse.clusters(g, rounds=1).collect()}
    assert got["auth"] == (2, ["authorize", "authenticate"]) and got["core"] == (1, ["get_users"]) and got["api"] == (1, ["m"])
    df = spark.createDataFrame([("main.rs",), ("src/main.rs",), ("src/auth/a.rs",), ("lib/src/x/y/z.rs",), ("app/a.rs",)], "path string")
    assert [r.l for r in df.select(traverse.directory_label("path").alias("l")).collect()] == ["core", "core", "auth", "x", "app"]


def test_flow(spark):
    s = [{"name": n, "file": "f.ts"} for n in "ABCDEX"]
    g = graph(spark, ["f.ts", "lib/shared.ts"], s, [("s:1", "s:2", "Calls"), ("s:2", "s:3", "Calls"), ("s:1", "s:4", "Calls"), ("s:4", "s:3", "Calls"), ("s:3", "s:1", "Calls"), ("s:5", "lib/shared.ts", R), ("s:6", "lib/shared.ts", R)])
    assert [(r.hops, r.depth) for r in traverse.trace_flow(g, "A", "C").collect()] == [(["A", "B", "C"], 2), (["A", "D", "C"], 2)]
    assert traverse.trace_flow(g, "A", "C", max_paths=1).count() == 1
    assert traverse.trace_flow(g, "A", "C", max_depth=1).where("size(hops) > 0").count() == 0
    assert [r.shared_dependency for r in traverse.trace_flow(g, "E", "X").collect()] == ["shared.ts"]
    assert traverse.trace_flow(g, "zzz", "C").count() == 0


def test_snapshots(spark, tmp_path):
    a = graph(spark, ["a.ts", "b.ts"], [{"name": "f", "file": "a.ts", "line": 1}, {"name": "g", "file": "a.ts", "line": 2}, {"name": "h", "file": "b.ts"}], [("b.ts", "a.ts", R)])
    b = graph(spark, ["a.ts", "c.ts"], [{"name": "f", "file": "a.ts", "line": 5, "kind": "function"}, {"name": "n", "file": "a.ts"}], [("c.ts", "s:1", "Calls")])
    x, y = snapshots.snapshot(a, "x", 1), snapshots.snapshot(b, "y", 2)
    assert [tuple(r) for r in snapshots.diff(x, y).collect()] == [("added_file", "c.ts", None, None), ("added_symbol", "a.ts", "n", None), ("modified_symbol", "a.ts", "f", "kind variable → function; line 1 → 5; callers 0 → 1"), ("removed_file", "b.ts", None, None), ("removed_symbol", "a.ts", "g", None)]
    assert snapshots.diff(x, x).count() == 0
    s = snapshots.SnapshotStore(spark, f"{tmp_path}/snaps")
    assert s.list() == []
    for i in range(12):
        s.create(a, f"s{i}", created_at=i)
    assert [n for n, _ in s.list()] == [f"s{i}" for i in range(11, 1, -1)]
    assert snapshots.diff(s.load("s5"), y).count() == 5
    s.delete("s5")
    for bad in ("a/b", "", "x" * 65):
        with pytest.raises(ValueError):
            s.create(a, bad)
    with pytest.raises(ValueError):
        s.load("s5")


def test_decorators(spark):
    assert decorators.lookup_framework("Controller", "typescript") == "nestjs" and decorators.lookup_framework("get", "rust") == "actix" and decorators.lookup_framework("json", "python") == "encoding/json" and decorators.lookup_framework("zzz", "go") is None
    g = graph(spark, ["a.ts", "b.py"], [{"name": "C", "file": "a.ts", "decorators": ["Controller", "__own"]}, {"name": "f", "file": "b.py", "decorators": ["app.route"]}])
    got = [(r.symbol_name, r.decorator_name, r.framework) for r in lookup.find_by_decorator(g, ".").collect()]
    assert got == [("C", "Controller", "nestjs"), ("f", "app.route", "flask")]
    assert lookup.find_by_decorator(g, "controller").count() == 1 and lookup.find_by_decorator(g, ".", language="py").count() == 1 and lookup.find_by_decorator(g, ".", framework="flask").count() == 1 and lookup.find_by_decorator(g, ".", limit=1).count() == 1
    assert g.has_decorator().count() == 3


def test_imports_summary_structure(spark):
    files = [("src/a.ts", None, None, "one"), ("src/b.ts", None, None, "one"), ("x/c.ts", None, None, "two"), ("main.rs", None, None, "k"), ("conf.toml", "Config"), ("src/types.ts",), ("src/a.test.ts",)]
    g = graph(spark, files, [{"name": "T", "kind": "interface", "file": "src/types.ts", "is_exported": True}, {"name": "F", "kind": "function", "file": "src/a.ts"}], [("src/a.ts", "src/b.ts", R, "./b"), ("src/a.ts", "x/c.ts", R, "c"), ("src/a.ts", "pkg:react", R, "react"), ("src/a.ts", "builtin:fs", R, "fs"), ("src/a.ts", "unresolved:1", R, "?"), ("src/a.ts", "src/b.ts", "BarrelReExportAll", "./b"), ("main.rs", "main.rs", "RustImport", "std::io"), ("main.rs", "main.rs", "RustImport", "k::x"), ("main.rs", "main.rs", "RustImport", "serde::S"), ("main.rs", "main.rs", "ReExport", "crate::y")])
    assert [tuple(r)[:3] for r in lookup.imports_of(g, "src/a.ts").collect()] == [("./b", "Internal", False), ("c", "Workspace", False), ("react", "External", False), ("fs", "Builtin", False), ("src/b.ts", "Internal", True)]
    assert [r.category for r in lookup.imports_of(g, "main.rs").collect()] == ["Builtin", "Internal", "External", "Internal"]
    with pytest.raises(ValueError):
        lookup.imports_of(g, "no.ts")
    roles = {r.relative_path: r.role for r in lookup.file_summaries(g).collect()}
    assert roles == {"src/a.ts": "Utility", "src/b.ts": "Utility", "x/c.ts": "Utility", "main.rs": "EntryPoint", "conf.toml": "Config", "src/types.ts": "Types", "src/a.test.ts": "Test"}
    one = lookup.file_summary(g, "src/a.ts").first()
    assert (one.import_count, one.importer_count, one.graph_label, one.symbol_kinds) == (4 + 1, 0, "Leaf", {"function": 1})
    rows = [(r.parent, r.node_type, r.name, r["count"]) for r in lookup.structure(g, None, 1).collect()]
    assert rows == [("", "Dir", "src", None), ("", "Dir", "x", None), ("", "NonParsedFile", "conf.toml", None), ("", "SourceFile", "main.rs", None), ("src", "Truncated", "", 4), ("x", "Truncated", "", 1)]
    assert [r.name for r in lookup.structure(g, "src", 2).collect()] == ["a.test.ts", "a.ts", "b.ts", "types.ts"]


def test_paths(spark):
    df = spark.createDataFrame([("src/x",), ("src2/x",), ("src",)], "path string")
    assert [r.u for r in df.select(paths.under("path", "src/").alias("u")).collect()] == [True, False, True]
    kinds = {".github/x.ts": "Ci", "a.ts": "Source", "a.md": "Doc", "a.toml": "Config", "a.png": "Asset", "Dockerfile": "Config", ".env": "Config", "x": "Other", ".gitlab-ci.yml": "Config"}
    got = spark.createDataFrame([(k,) for k in kinds], "path string").select("path", paths.file_kind("path").alias("k")).collect()
    assert {r.path: r.k for r in got} == kinds
    ig = Ignore([(".gitignore", "*.log\n/build\n!keep.log\ndocs/**/x\n"), ("sub/.gitignore", "only\n")])
    assert [ig.ignored(p) for p in ("a.log", "d/keep.log", "build/x", "s/build/x", "docs/a/b/x", "sub/only/f", "only/f")] == [True, False, True, False, True, True, False]
    assert Options.from_toml("exclude = ['a']\n[impact]\nhigh_threshold = 9\n") == Options(["a"], 9, 5)
    assert project_root("/a/b/c", lambda p: p == "/a/go.mod") == "/a" and project_root("/q", lambda p: False) == "/q"
    m = spark.createDataFrame([("go.mod", bytearray(b"module m.x/a\nreplace m.x/b => ./lib/b\n")), ("go.work", bytearray(b"go 1.21\nuse (\n\t./one\n\t./two\n)\n")), ("w/package.json", bytearray(b"{}")), ("tsconfig.json", bytearray(b"{}"))], "path string, content binary")
    assert {tuple(r) for r in go_modules(m).collect()} == {("m.x/a", ""), ("m.x/b", "lib/b")}
    assert {r.dir for r in go_work_dirs(m).collect()} == {"one", "two"}
    assert {r.language for r in detect_languages(m).collect()} == {"go", "typescript"}


def test_folders_and_graph_views(spark):
    g = graph(spark, ["root.ts", "a/b/c/x.ts", "a/b/c/y.ts", "p/q.ts", "p/r/s.ts"], [{"name": "f", "file": "p/q.ts", "line": 3}, {"name": "m", "file": None, "parent_id": 1, "line": 4, "kind": "method"}], [("root.ts", "p/q.ts", R), ("p/q.ts", "root.ts", "ConditionalImport"), ("p/q.ts", "root.ts", R), ("a/b/c/x.ts", "p/q.ts", R)])
    tree = {(r.folder, r.label, r.parent) for r in traverse.folders(g)[0].collect()}
    assert tree == {("a/b/c", "a/b/c", None), ("p", "p", None), ("p/r", "r", "p")}
    nodes, edges = graphjson.file_graph(g)
    n = {r.key: r for r in nodes.collect()}
    assert n["folder:a/b/c"].size == pytest.approx(5 + 3 * 2**0.5) and n["root.ts"].is_circular and not n["a/b/c/x.ts"].is_circular
    e = {(r.source, r.target): (r.edge_type, r.is_circular, r.weight) for r in edges.collect()}
    assert e["root.ts", "p/q.ts"] == ("Imports", True, 2.0) and e["a/b/c/x.ts", "p/q.ts"] == ("Imports", False, 1.0) and e["folder:p", "folder:p/r"] == ("Contains", False, 0.5)
    nodes, edges = graphjson.symbol_graph(g)
    assert {"p/q.ts::f::3", "::m::4"} <= {r.key for r in nodes.collect()} and ("::m::4", "p/q.ts::f::3", "ChildOf") in {(r.source, r.target, r.edge_type) for r in edges.collect()}


def test_export(spark, tmp_path):
    g = graph(spark, ["src/a/x.ts", "src/b/y.ts", "z.ts"], [{"name": "f<T>", "file": "src/a/x.ts", "kind": "function"}, {"name": "E", "file": "src/b/y.ts", "kind": "enum"}], [("src/a/x.ts", "src/b/y.ts", R), ("src/a/x.ts", "src/b/y.ts", R), ("s:1", "s:2", "Calls")])
    line = lambda p, m=False: [r.line for r in (export.mermaid_lines if m else export.dot_lines)(g, p).collect()]
    dot = line(export.Export("file"))
    assert dot[0].startswith("digraph") and dot[-1] == "}" and any('label="2 imports"' in x for x in dot)
    assert any('"f<T> (fn)" fillcolor="#AED6F1"' in x for x in line(export.Export("symbol"))) and any("color=blue" in x for x in line(export.Export("symbol")))
    assert sum("subgraph cluster_" in x for x in line(export.Export("package"))) == 3
    assert any("f&lt;T&gt; (fn)" in x for x in line(export.Export("symbol"), True)) and any("-->|2 imports|" in x for x in line(export.Export("file"), True)) and any("a -->|2| b" in x for x in line(export.Export("package"), True))
    assert tuple(export.counts(g, export.Export("file", exclude=["z.ts"])).first()) == (2, 1, [])
    assert tuple(export.counts(g, export.Export("file", root="src/a")).first())[:2] == (1, 0)
    assert tuple(export.counts(g, export.Export("symbol", symbol="E", depth=0)).first())[:2] == (1, 0)
    export.write_text(export.dot_lines(g, export.Export("file")), f"{tmp_path}/dot")
    assert spark.read.text(f"{tmp_path}/dot").count() == len(dot)
    ids = spark.createDataFrame([("a-b",), ("1x",), ("",)], "s string").select(export.dot_id(F.col("s")).alias("i"))
    assert [r.i for r in ids.collect()] == ["a_b", "n1x", "node"]
    assert export.compact(aggregates.symbols_by_kind(g), "kind").count() == 2 and export.as_json(aggregates.symbols_by_kind(g)).count() == 2


def test_retrieval(spark):
    g = find_graph(spark)
    sources = spark.createDataFrame([("src/user.ts", "\n".join(f"l{i}" for i in range(1, 80)))], "path string, content string")
    vectors = retrieval.symbol_vectors(g)
    cited, row = retrieval.retrieve(g, vectors, sources, "Where is the UserServices class")
    assert [(r.symbol_name, r.snippet.split("\n")[0], len(r.snippet.split("\n"))) for r in cited.collect()] == [("UserService", "l10", 40)]
    assert row.first().tools_used == ["find_symbol"] and row.first().context_text.startswith("[1] UserService")
    hybrid = retrieval.retrieve(g, vectors, sources, "authHandler things")[0].collect()
    assert hybrid[0].symbol_name == "authHandler" and [r["index"] for r in hybrid] == list(range(1, len(hybrid) + 1)) and len(hybrid) <= 5
    empty = CodeGraph.empty(spark)
    assert retrieval.structural(empty, "find x").count() == 0
    out = retrieval.ask(g, vectors, sources, "Where is UserService", [("user", "hi")], lambda m: f"{len(m)} messages")
    assert out["answer"] == "3 messages" and out["citations"][0]["symbol_name"] == "UserService"
    assert retrieval.user_prompt("q", "") == "q"
    changed = spark.createDataFrame([(99, "src/user.ts", "Renamed", 10, "class")], "key long, file_path string, symbol_name string, line_start int, kind string")
    after = {r.symbol_name for r in retrieval.re_embed(vectors, changed).collect()}
    assert "Renamed" in after and "UserService" not in after and "AuthService" in after


def test_vectors(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.7, 0.7]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "key long, vec array<float>")
    assert [r.key for r in retrieval.nearest(v, [1.0, 0.1], 3).collect()] == [1, 2, 3]
    store.save_vectors(v, f"{tmp_path}/v")
    assert store.load_vectors(spark, f"{tmp_path}/v", 2).count() == 4
    for bad in ((f"{tmp_path}/none", 2), (f"{tmp_path}/v", 3)):
        with pytest.raises(ValueError):
            store.load_vectors(spark, *bad)


def test_registry_and_graph_store(spark, tmp_path):
    r = store.Registry(spark, f"{tmp_path}/reg")
    assert r.list() == []
    r.add("one", "/p")
    for bad in (("one", "/q"), ("two", "/p"), ("a b", "/z")):
        with pytest.raises(ValueError):
            r.add(*bad)
    r.add("two", "/q")
    assert r.get("two") == "/q"
    r.remove("one")
    assert r.list() == [("two", "/q")]
    with pytest.raises(ValueError):
        r.remove("one")
    g = find_graph(spark)
    assert store.load_graph(spark, f"{tmp_path}/g") is None
    store.save_graph(g, f"{tmp_path}/g")
    store.save_graph(g, f"{tmp_path}/g")
    again, state = store.load_graph(spark, f"{tmp_path}/g")
    assert again.symbols.count() == 4 and state.count() == 0


def test_stats(spark):
    g = graph(spark, ["a.rs", "b.py", "c.go", ("d.md", "Doc")], [{"name": "f", "kind": "function", "file": "a.rs"}, {"name": "C", "kind": "class", "file": "b.py"}, {"name": "m", "kind": "method", "file": None, "parent_id": 2}, {"name": "I", "kind": "interface", "file": "c.go"}, {"name": "M", "kind": "method", "file": None, "parent_id": 4}], [("a.rs", "builtin:std", R), ("b.py", "pkg:os", R)], ["os"], ["std"])
    s = aggregates.project_stats(g).first().asDict()
    assert (s["file_count"], s["symbol_count"], s["rust_fns"], s["python_methods"], s["go_methods"], s["go_symbol_count"], s["python_symbol_count"], s["doc_files"], s["builtin_usage_count"], s["external_usage_count"], s["external_packages"], s["builtin_count"]) == (4, 5, 1, 1, 1, 2, 2, 1, 1, 1, 1, 1)
    assert aggregates.crate_stats(g).count() == 0
    two = g.with_(files=g.files.withColumn("crate_name", F.when(F.col("path") == "a.rs", "x")).unionByName(spark.createDataFrame([("z.rs", "rust", "y", "Source", 0)], "path string, language string, crate_name string, kind string, n_lines long")))
    assert {(r.crate_name, r.file_count, r.fn_count) for r in aggregates.crate_stats(two).collect()} == {("x", 1, 1), ("y", 1, 0)}


def test_bfs_keeps_searches_apart(spark):
    seeds = spark.createDataFrame([("p", "a"), ("q", "b")], "who string, node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    got = {(r.who, r.node): r.depth for r in bfs(seeds, edges, 2, "who").collect()}
    assert got == {("p", "a"): 0, ("p", "b"): 1, ("p", "c"): 2, ("q", "b"): 0, ("q", "c"): 1, ("q", "a"): 2}


def test_labels_spread_until_nothing_changes(spark, monkeypatch):
    from quarrylens import queries

    # links thin out along the line, so each node takes the label of the one before it, one step a round
    n = 8
    symbols = [{"name": f"f{i}", "file": f"{'a' if i == 1 else f'z{i}'}/x.py"} for i in range(1, n + 1)]
    links = [(f"s:{i}", f"s:{i + 1}", "Calls") for i in range(1, n) for _ in range(4 * (n - i))] + [("s:1", "s:1", "Calls")] * 200
    g = graph(spark, [s["file"] for s in symbols], symbols, links)
    monkeypatch.setattr(queries, "code_graph", lambda *_: g)
    assert {r.label for r in queries.QUERIES["i6_clusters"](spark, "").collect()} == {"a"}
    assert [(r.label, r.member_count) for r in queries.QUERIES["i6_cluster_report"](spark, "").collect()] == [("a", n)]


def test_long_chains_are_followed_to_their_end(spark):
    from quarrylens.operators import resolve

    n = 36
    exports = "array<struct<kind: string, source: string, names: array<string>>>"
    imports = "array<struct<module_path: string, specifiers: array<struct<name: string, alias: string>>>>"
    rows = [("use.ts", [], [("./c0", [("f", None)])])] + [(f"c{i}.ts", [("ReExport", f"./c{i + 1}", ["f"])], []) for i in range(n)] + [(f"c{n}.ts", [], [])]
    parsed = spark.createDataFrame(rows, f"path string, exports {exports}, imports {imports}").coalesce(1)
    linked = spark.createDataFrame([("use.ts", "c0.ts", "./c0")], "src string, dst string, specifier string")
    assert [tuple(r) for r in resolve.named_reexports(parsed, parsed.select("path"), linked).collect()] == [("use.ts", f"c{n}.ts", "./c0")]


def test_deep_module_trees_are_walked_to_their_end(spark):
    from quarrylens.operators import resolve

    paths = ["lib.rs"]
    for i in range(67):
        paths.append(f"{paths[-1].removesuffix('.rs')}/m.rs" if i else "m.rs")
    parsed = spark.createDataFrame([(p, ["m"]) for p in paths], "path string, mods array<string>").coalesce(1)
    tree = resolve.module_tree(parsed, parsed.select("path"), spark.createDataFrame([("k", "lib.rs")], "crate_name string, root string"))
    assert {r.path for r in tree.collect()} == set(paths)


def test_kernels_in_one_task_and_in_rounds_give_the_same_rows(spark, monkeypatch):
    import random

    from quarrylens.plans import kernels, local

    rnd = random.Random(6)
    e = spark.createDataFrame([(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(110)] + [("x", "y"), ("y", "x")], "src string, dst string")
    seeds = spark.createDataFrame([("a", "n1"), ("b", "n2"), ("b", "n3"), ("c", "alone"), (None, "n4")], "q string, node string")
    labels = spark.createDataFrame([(f"n{i}", f"l{i % 7}") for i in range(60)] + [("z", "l1")], "node string, label string")

    def all_three():
        rows = lambda df: sorted(map(str, df.collect()))
        out = [rows(kernels.bfs(seeds, e, None, "q").orderBy("q", "node").select("q", "node", "depth")), rows(kernels.bfs(seeds, e, 2)), rows(kernels.bfs(seeds.limit(0), e)), rows(kernels.scc(e)), rows(kernels.scc(e.limit(0)))]
        return out + [rows(kernels.label_propagation(labels, e, r)) for r in (1, 4)]

    quick = all_three()
    monkeypatch.setattr(local, "LOCAL_EDGES", -1)
    assert all_three() == quick


def test_nearest_of_questions_and_recall_of_the_approximate_search(spark):
    import numpy as np
    import pandas as pd

    from quarrylens.operators import retrieval

    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16))
    x[300:] = x[:300] + rng.normal(size=(300, 16)) * 0.2
    df = spark.createDataFrame([(i, [float(u) for u in v]) for i, v in enumerate(x)], "key long, vec array<float>").cache()
    f = x.astype(np.float32).astype(float)
    hits = 0
    for i in (3, 77, 150):
        distance = 1 - f @ f[i] / np.sqrt((f * f).sum(axis=1) * (f[i] @ f[i]))
        want = sorted(range(600), key=lambda j: (distance[j], j))[:10]
        assert [r.key for r in retrieval.nearest(df, list(f[i]), 10).collect()] == want
        hits += len(set(want) & {r.key for r in retrieval.nearest_approx(df, list(f[i]), 10).collect()})
    assert hits >= 27
    # a question's citations are the nearest texts by the same embedder, computed apart
    names = [f"find{a}{b}" for a in ("User", "Order", "Index") for b in range(20)]
    rows = [(i, f"src/{n}.ts", n, i + 1, "function") for i, n in enumerate(names)]
    vectors = retrieval.embed_symbols(spark.createDataFrame(rows, "key long, file_path string, symbol_name string, line_start int, kind string"))
    embed = retrieval.hashing_embedder()
    own = np.array(embed(pd.Series([f"{n} in {p}:{line}" for _, p, n, line, _ in rows])).tolist())
    q = np.array(embed(pd.Series(["how does findOrder7 work"])).iloc[0])
    best = sorted(range(len(rows)), key=lambda i: (round(1 - own[i] @ q / np.linalg.norm(own[i]) / np.linalg.norm(q), 9), i))[:5]
    assert [r.symbol_name for r in retrieval.conceptual(vectors, "how does findOrder7 work").orderBy("index").collect()] == [names[i] for i in best]


def test_citations_without_carried_vectors_and_the_embedder_in_arrays(spark):
    import hashlib

    import numpy as np

    def vector(t, dimensions=384):
        v, s = np.zeros(dimensions, np.float32), f"  {(t or '').lower()} "
        for i in range(len(s) - 2):
            h = int.from_bytes(hashlib.blake2b(s[i : i + 3].encode(), digest_size=8).digest(), "big")
            v[h % dimensions] += 1 if h >> 63 else -1
        n = float(np.linalg.norm(v))
        return (v / n if n else v).tolist()

    texts = ["parseUser in src/a.ts:1", "", None, "ÄÖ Σ ΟΔΟΣ \U0001f600", "x" * 3000, "aaaa"]
    assert retrieval.hashing_embedder()(pd.Series(texts, dtype=object)).tolist() == [vector(t) for t in texts]
    names = [f"{v}{n}{i % 7}" for i, (v, n) in enumerate((v, n) for v in ("find", "load", "parse") for n in ("User", "Order", "Index") for _ in range(40))]
    g = graph(spark, ["a.ts"], [{"name": n, "file": "a.ts", "line": i // 3} for i, n in enumerate(names)])
    symbols = retrieval.symbol_texts(g)
    # rows are few bytes and long work: they go to more tasks than adaptive execution would leave
    assert symbols.select(F.spark_partition_id().alias("p")).distinct().count() >= 8
    q = vector("how does findOrder3 work")
    want = retrieval.nearest(retrieval.embed_symbols(symbols), q, 7).select("key", "symbol_name", "distance").collect()
    assert retrieval.nearest_symbols(symbols, q, 7).select("key", "symbol_name", "distance").collect() == want
    odd = lambda t: pd.Series([None if "User" in x else [1.0, float(len(x))] if "3" in x else [1.0] for x in t])
    want = retrieval.nearest(retrieval.embed_symbols(symbols, odd), [1.0, 2.0], 90).select("key", "distance").collect()
    assert retrieval.nearest_symbols(symbols, [1.0, 2.0], 90, odd).select("key", "distance").collect() == want


def test_fused_search_where_one_list_is_empty(spark):
    g = graph(spark, ["a.ts", "b.ts"], [{"name": "saveUserAccountRecord", "file": "a.ts", "line": 3}, {"name": "saveUserAccountRecord", "file": "b.ts", "line": 3}])
    found = lambda df: [(r.symbol_name, r.file_path) for r in df.collect()]
    assert found(search.fused(g, "qq user")) == [("saveUserAccountRecord", "a.ts")]  # one name and line: one row
    assert found(search.search(g, "qq user")) == [("saveUserAccountRecord", "a.ts"), ("saveUserAccountRecord", "b.ts")]  # a single list stays as it is
    assert search.fused(g, "zz yy").count() == 0


def test_epoch_text_of_long_years(spark):
    shown = spark.sql("SELECT explode(array(0L, 253402300799L, 253402300800L, 520104067200L)) AS s").select(text.epoch_text(F.col("s")).alias("t"))
    assert [r.t for r in shown.collect()] == ["1970-01-01 00:00:00 UTC", "9999-12-31 23:59:59 UTC", "10000-01-01 00:00:00 UTC", "18451-06-11 00:00:00 UTC"]


def test_symbols_without_a_parent_are_dealt_out(spark):
    """In a plain left join their null keys all go to one task."""
    g = graph(spark, ["a.ts"], [{"name": "up", "file": "a.ts"}, {"name": "in", "file": None, "parent_id": 1}] + [{"name": f"s{i}", "file": "a.ts"} for i in range(400)])
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = lookup.placed(g).select("symbol_id", "file_path", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(rows) == 402 and {r.file_path for r in rows} == {"a.ts"}
    assert max(sum(r.p == p for r in rows) for p in range(4)) < 201


def test_rename_and_decorators_join_only_the_symbols_asked_for(spark):
    g = graph(spark, ["a.py"], [{"name": "up", "file": "a.py", "line": 1, "decorators": ["app.get", "x"]}, {"name": "in", "file": None, "parent_id": 1, "line": 2, "decorators": ["get"]}, {"name": "no", "file": "a.py", "decorators": ["y"]}, {"name": "own", "file": "a.py", "decorators": ["__get"]}])
    assert [(r.symbol_name, r.file_path, r.decorator_name) for r in lookup.find_by_decorator(g, "GET").collect()] == [("up", "a.py", "app.get"), ("in", "a.py", "get")]
    assert [(r.file_path, r.line) for r in lookup.plan_rename(g, "in", "new").collect()] == [("a.py", 2)]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    # the wide side of the join holds what the filter left
    below = lambda df, what: what in plan(df)[plan(df).index("Join LeftOuter") :]
    assert below(lookup.find_by_decorator(g, "GET"), "exists(")


def test_scc_of_a_graph_in_parts(spark, monkeypatch):
    """Small parts in tasks, large ones in rounds, and a part of more edges than a batch."""
    import random

    from quarrylens.plans import kernels, local

    rnd = random.Random(8)
    small = [(f"p{p}n{rnd.randrange(7)}", f"p{p}n{rnd.randrange(7)}") for p in range(12) for _ in range(10)]
    big = [(f"big{rnd.randrange(12)}", f"big{rnd.randrange(12)}") for _ in range(22)]
    frame = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    found = lambda df: sorted(map(tuple, df.collect()))
    want, of_small = found(kernels.scc(frame(small + big))), found(kernels.scc(frame(small)))
    weak = {r.node: r.component for r in kernels.weak_components(spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 6), (7, 7)], "u long, v long")).collect()}
    assert weak == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5}
    rounds, own = [], kernels._scc_in_rounds
    monkeypatch.setattr(kernels, "_scc_in_rounds", lambda df: rounds.append({r.src[:3] for r in df.collect()}) or own(df))
    monkeypatch.setattr(local, "LOCAL_EDGES", 16)
    assert found(kernels.scc(frame(small + big))) == want
    assert rounds == [{"big"}]  # all else was small
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("3", "25"):  # parts begin and end within batches
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            parts = frame(small).where("src <> dst").distinct().withColumn("component", F.regexp_extract("src", "p([0-9]+)", 1).cast("long"))
            assert found(kernels._scc_of_parts(parts, 8)) == of_small
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_rounds_with_small_and_with_large_frontiers_give_the_same_rows(spark, monkeypatch):
    import random

    from quarrylens.plans import kernels, local

    rnd = random.Random(9)
    e = spark.createDataFrame([(f"n{rnd.randrange(50)}", f"n{rnd.randrange(50)}") for _ in range(90)], "src string, dst string")
    node = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    found = lambda: (sorted(map(str, kernels.bfs(node("n1", "n2"), e, 3).collect())), [tuple(r.hops) for r in kernels.simple_paths(node("n3", "n9"), node("n4", "n5", "n6"), e, 4, 40).collect()])
    want = found()
    assert want[0] and want[1]
    monkeypatch.setattr(local, "LOCAL_EDGES", -1)
    assert found() == want
    monkeypatch.setattr(kernels, "SMALL", -1)
    assert found() == want
