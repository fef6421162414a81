"""Ingest as queries: projects generated from the suppliers, with the rows that parsing and resolving them must give.

Each supplier has a folder of its own in which `~` stands for its key. Expected rows are written out by hand beside the
sources and turned into SQL over `supplier`, so that the check does not go through the code that it checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import epoch_text
from .operators import aggregates, graphjson, lookup, resolve
from .plans.lineage import cut, shared_folder
from .plans.views import table
from .queries import query
from .schema import CodeGraph, join_sparse, symbol_of
from .session import spread
from .sources import walk
from .sources.ingest import build, parse_sources, symbol_table
from .sources.store import load_graph, save_graph

# One file of each language with what its parser knows; rows below name its lines.
SINGLES = {
    "q~/ui.tsx": """import React, { useState as useS, memo } from 'react';
import * as ns from './ns~';
import './side~';
const cfg = require('./cfg~');
const { a, b: c } = require('pkg~');
@Injectable()
export class Svc~ extends Base~ implements Face~ {
  @Get('/u/~')
  async find~(id: Id~) { return this.repo.load~(id); }
}
export default function App~() { return <div/>; }
export interface Face~ { name: string; run(): void }
type Al~ = string;
export enum E~ { A, B }
export const fn~ = (x) => go~(x);
export const v~ = 1;
const hidden~ = 2;
export * from './all~';
export { p~, q~ as r~ } from './some~';
export { fn~ as g~ };
import('./dyn~');
""",
    "q~/lib.rs": """use std::fmt;
pub use crate::a::{B, C};
#[derive(Debug)]
pub struct S~ { x: u8 }
#[test]
pub(crate) enum E~ { A }
pub trait T~ { fn m(&self); }
impl T~ for S~ { fn m(&self) {} }
impl S~ { pub fn new~() {} }
fn free~() { struct Inner~; }
type Al~ = u8;
const K~: u8 = 1;
static G~: u8 = 2;
macro_rules! mac~ { () => {} }
mod sub~;
mod inline~ { pub fn deep~() {} }
""",
    "q~/m.py": """from __future__ import annotations
import os, a.b as ab
from . import sib~
from ..up import X as Y, Z
from star~ import *
try:
    import fast~
except ImportError:
    from slow~ import fast
__all__ = ['f~', 'K~']
K~ = 1
@app.route('/~')
def f~():
    def inner~(): pass
class C~(Base~):
    x = 1
    @property
    def p~(self): pass
    class D~: pass
type T~ = int
""",
    "q~/broken.py": """def ok~(): pass
def broken~(:
    pass
class Fine~: pass
""",
    "q~/x.go": """package q
import (
	"fmt"
	al "ex.com/al~"
	_ "ex.com/blank~"
	. "ex.com/dot~"
)
//go:noinline
func Do~() {}
type S~ struct {
	Base~
	*pkg.Other~
	A int `json:"a" yaml:"b"`
}
func (s *S~) Run~() {}
type I~ interface { Walk~() }
type Al~ = string
const X~, y~ = 1, 2
var V~ int
""",
    "q~/notes.txt": "no source\n",
}

# A project whose names resolve across files.
PROJECT = {
    "p~/util/package.json": '{"name": "@org/util~"}',
    "p~/util/src/index.ts": "export * from './deep';\nexport function helper~() {}\n",
    "p~/util/src/deep.ts": "export const deep~ = () => 1;\n",
    "shared/alias~.ts": "export const aliased~ = 1;\n",
    "p~/web/app.ts": """import { helper~ } from '@org/util~';
import { A~ as B } from './barrel';
import { loop~ } from './ring';
import fs from 'node:fs';
import path from 'path';
import lo from 'lodash/merge';
import sc from '@scope/pack/x';
import gone from './missing~';
import { aliased~ } from '@lib/alias~.js';
class C~ extends Base~ implements I~ {}
interface I~ { m(): void }
export const run~ = () => only~(twice());
""",
    "p~/web/barrel.ts": "export { A~ } from './hop';\n",
    "p~/web/hop.ts": "export { A~ } from './a';\n",
    "p~/web/a.ts": "export class A~ {}\nexport class Base~ {}\nexport function only~() {}\nexport function twice() {}\n",
    "p~/web/ring.ts": "export { loop~ } from './ring2';\n",
    "p~/web/ring2.ts": "export { loop~ } from './ring';\n",
    "p~/web/gone.skip.ts": "export const skipped~ = 1;\n",
    "p~/web/node_modules/x.ts": "export const vendored~ = 1;\n",
    "left/out~.ts": "export const excluded~ = 1;\n",
    "p~/crates/one/Cargo.toml": '[package]\nname = "one-~"\n',
    "p~/crates/one/src/lib.rs": "mod a;\npub mod b;\nuse std::io;\nuse crate::a::inner::Thing;\nuse serde::Serialize;\nuse two_~::thing;\nuse crate::nowhere::X;\n",
    "p~/crates/one/src/a/mod.rs": "mod inner;\nuse super::b::f;\n",
    "p~/crates/one/src/a/inner.rs": "pub struct Thing;\nuse self::x;\nuse super::super::b::*;\n",
    "p~/crates/one/src/b.rs": "pub fn f() {}\n",
    "p~/crates/two/Cargo.toml": '[package]\nname = "two-~"\n[lib]\npath = "src/root.rs"\n',
    "p~/crates/two/src/root.rs": "pub fn thing() {}\n",
    "p~/other/Cargo.toml": '[package]\nname = "stray-~"\n',
    "p~/other/src/lib.rs": "pub fn stray() {}\n",
    "p~/py/pkg/__init__.py": "from .impl import Real~ as Shown~\n",
    "p~/py/pkg/impl.py": "class Real~: pass\n",
    "p~/py/pkg/many.py": "__all__ = ['In~']\nclass In~: pass\nclass Out~: pass\n",
    "p~/py/logging.py": "own~ = 1\n",
    "p~/py/main.py": """import os.path
import logging
from .pkg import Shown~
from .pkg import impl
from .nothing import z
from .pkg.many import *
import requests.api
try:
    from .pkg import impl
except ImportError:
    pass
""",
    "p~/go/go.mod": "module example.com/app~\nreplace example.com/old~ => ./side\n",
    "p~/go/main.go": 'package main\nimport (\n\t"fmt"\n\t"example.com/app~/handlers"\n\t_ "example.com/app~/side"\n\t. "example.com/old~"\n\t"github.com/x/y"\n\t"example.com/app~/none"\n)\nfunc main() { fmt.Println() }\n',
    "p~/go/handlers/h.go": "package handlers\ntype Root~ struct {}\ntype H~ struct {\n\tRoot~\n}\nfunc (h *H~) Go~() {}\ntype Runner~ interface { Go~(); Stop~() }\ntype Empty~ interface {}\n",
    "p~/go/handlers/more.go": "package handlers\nfunc (h *H~) Stop~() {}\nfunc (s *Root~) Stop~() {}\n",
    "p~/go/side/s.go": "package side\n",
    "p~/unused/go.mod": "module example.com/unused~\n",
    "p~/README.md": "# hi\n",
}
ROOT = {
    "package.json": '{"name": "root", "workspaces": ["*/util"]}',
    "tsconfig.json": '{\n  // aliases\n  "compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["./shared/*"],}},\n}\n',
    "Cargo.toml": '[workspace]\nmembers = ["p*/crates/*"]\n',
    ".gitignore": "*.skip.ts\n",
    "quarrylens.toml": 'exclude = ["left"]\n[impact]\nhigh_threshold = 9\n',
}


def _files(spark: SparkSession, sf: str, templates: dict[str, str], root: dict[str, str] | None = None) -> DataFrame:
    """(path, size, mtime, content) of the templates of every supplier, and of the files at the root."""
    texts = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in templates.items()])
    own = spread(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("k")), "k").select("k", F.explode(texts).alias("f"))
    rows = own.select(F.replace("f.path", F.lit("~"), F.col("k")).alias("path"), F.replace("f.content", F.lit("~"), F.col("k")).alias("content"))
    if root:
        rows = rows.unionByName(spark.createDataFrame(list(root.items()), "path string, content string"))
        work = table(spark, sf, "supplier").select(F.concat(F.lit("use ./p"), F.col("s_suppkey").cast("string"), F.lit("/go")).alias("line")).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("content"))
        rows = rows.unionByName(work.select(F.lit("go.work").alias("path"), F.concat(F.lit("go 1.22\n"), "content", F.lit("\n")).alias("content")))
    return rows.select("path", F.length("content").cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), F.col("content").cast("binary").alias("content"))


def _singles(spark, sf, ext: str = "") -> DataFrame:
    """Parse results of the single files of an ending; others are not parsed, as a file's results are its own."""
    return parse_sources(_files(spark, sf, SINGLES).where(F.col("path").endswith(ext)))


def _project(spark, sf) -> DataFrame:
    return _files(spark, sf, PROJECT, ROOT)


_BUILT: dict[tuple[str, str], str] = {}


def built(spark: SparkSession, sf: str) -> CodeGraph:
    """The project's graph, built and stored once a session, and read from there."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILT:
        path = shared_folder(spark, f"project_{len(_BUILT)}")
        files = _project(spark, sf)
        save_graph(build(files)[0], path, files)
        _BUILT[key] = path
    return load_graph(spark, _BUILT[key])[0]


def expected(columns: str, rows: list[tuple], once: list[tuple] = ()) -> str:
    """SQL that gives the rows for every supplier (~ stands for its key), and those of once a single time."""
    names = columns.split()

    def value(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    def shown(i: int, n: str) -> str:
        kinds = {type(r[i]) for r in [*rows, *once] if r[i] is not None}
        return f"replace({n}, '~', k) AS {n}" if kinds <= {str} else n

    values = lambda some: ", ".join("(" + ", ".join(map(value, r)) + ")" for r in some)
    out = f"SELECT {', '.join(shown(i, n) for i, n in enumerate(names))} FROM (SELECT CAST(s_suppkey AS VARCHAR) AS k FROM supplier) s, (VALUES {values(rows)}) AS v({', '.join(names)})"
    return out + (f" UNION ALL SELECT * FROM (VALUES {values(once)}) AS o({', '.join(names)})" if once else "")


def _symbols(spark, sf, ext: str) -> DataFrame:
    s = cut(symbol_table(_singles(spark, sf, ext)))
    up = s.select(F.col("symbol_id").alias("parent_id"), F.col("name").alias("parent"))
    return join_sparse(s, up, "parent_id", F.col("symbol_id"))


@query("p2_typescript_symbols", expected("parent name kind line is_exported is_default", [
    (None, "Svc~", "class", 7, True, False), ("Svc~", "find~", "method", 9, False, False), (None, "App~", "component", 11, True, True), (None, "Face~", "interface", 12, True, False),
    ("Face~", "name", "property", 12, False, False), ("Face~", "run", "property", 12, False, False), (None, "Al~", "type", 13, False, False), (None, "E~", "enum", 14, True, False),
    (None, "fn~", "function", 15, True, False), (None, "v~", "variable", 16, True, False),
]), view=False)
def p2(spark, sf):
    return _symbols(spark, sf, ".tsx").select("parent", "name", "kind", "line", "is_exported", "is_default")


def _decorators(spark, sf, ext: str) -> DataFrame:
    return _symbols(spark, sf, ext).select(F.col("name").alias("symbol_name"), F.explode("decorators").alias("d")).select("symbol_name", "d.name", "d.object", "d.attribute", "d.args_raw")


@query("p3_typescript_decorators", expected("symbol_name name object attribute args_raw", [("Svc~", "Injectable", None, None, "()"), ("find~", "Get", None, None, "('/u/~')")]), view=False)
def p3(spark, sf):
    return _decorators(spark, sf, ".tsx").withColumn("object", F.col("object").cast("string"))


@query("p4_rust_symbols", expected("parent name kind line visibility trait_impl", [
    (None, "S~", "struct", 4, "pub", None), (None, "E~", "enum", 6, "pub(crate)", None), (None, "T~", "trait", 7, "pub", None), ("T~", "T~::m", "method", 7, "private", None),
    (None, "S~::m", "impl_method", 8, "private", "T~"), (None, "S~::new~", "impl_method", 9, "pub", None), (None, "free~", "function", 10, "private", None), (None, "Inner~", "struct", 10, "private", None),
    (None, "Al~", "type", 11, "private", None), (None, "K~", "const", 12, "private", None), (None, "G~", "static", 13, "private", None), (None, "mac~", "macro", 14, "private", None), (None, "deep~", "function", 16, "pub", None),
]), view=False)
def p4(spark, sf):
    return _symbols(spark, sf, ".rs").select("parent", "name", "kind", "line", "visibility", "trait_impl")


@query("p5_rust_attributes", expected("symbol_name name args_raw", [
    *[(s, "derive", "(Debug)") for s in ("S~", "E~", "T~", "free~", "Al~", "K~", "G~", "mac~")], *[(s, "test", None) for s in ("E~", "T~", "free~", "Al~", "K~", "G~", "mac~")],
]), view=False)
def p5(spark, sf):
    return _decorators(spark, sf, ".rs").select("symbol_name", "name", "args_raw")


@query("p6_python_symbols", expected("parent name kind line is_exported", [
    (None, "__all__", "variable", 10, False), (None, "K~", "variable", 11, True), (None, "f~", "function", 13, True), (None, "inner~", "function", 14, False), (None, "C~", "class", 15, False),
    ("C~", "p~", "method", 18, False), ("C~", "D~", "class", 19, False), (None, "T~", "type", 20, False),
    (None, "ok~", "function", 1, True), (None, "Fine~", "class", 4, True),
]), view=False)
def p6(spark, sf):
    return _symbols(spark, sf, ".py").select("parent", "name", "kind", "line", "is_exported")


@query("p7_go_symbols", expected("parent name kind line is_exported trait_impl decorators", [
    (None, "Do~", "function", 9, True, None, "go:noinline"), (None, "S~", "struct", 10, True, None, "json yaml __embedded__=Base~ __embedded__=pkg.Other~"), (None, "Run~", "method", 15, True, "S~", ""),
    (None, "I~", "interface", 16, True, None, ""), ("I~", "Walk~", "method", 16, True, None, ""), (None, "Al~", "type", 17, True, None, ""), (None, "X~", "const", 18, True, None, ""),
    (None, "y~", "const", 18, False, None, ""), (None, "V~", "variable", 19, True, None, ""),
]), view=False)
def p7(spark, sf):
    shown = F.transform("decorators", lambda d: F.when(d["name"] == "__embedded__", F.concat(d["name"], F.lit("="), d["args_raw"])).otherwise(d["name"]))
    return _symbols(spark, sf, ".go").select("parent", "name", "kind", "line", "is_exported", "trait_impl", F.array_join(shown, " ").alias("decorators"))


def _imports(spark, sf, ext: str) -> DataFrame:
    one = lambda s: F.concat_ws(" ", s["name"], F.concat(F.lit("< "), s["alias"]), F.when(s["is_default"], "default"), F.when(s["is_namespace"], "all"))
    i = _singles(spark, sf, ext).select(F.explode("imports").alias("i")).select("i.*")
    return i.select("kind", "level", "module_path", "line", F.array_join(F.transform("specifiers", one), ", ").alias("specifiers"))


@query("p8_typescript_imports", expected("kind module_path line specifiers", [
    ("Esm", "react", 1, "React default, useS < useState, memo"), ("Esm", "./ns~", 2, "ns all"), ("Esm", "./side~", 3, ""), ("Cjs", "./cfg~", 4, "cfg default"), ("Cjs", "pkg~", 5, "a, c < b"), ("Dynamic", "./dyn~", 21, ""),
]), view=False)
def p8(spark, sf):
    return _imports(spark, sf, ".tsx").drop("level")


@query("p9_typescript_exports", expected("kind names source", [("Default", "", None), ("ReExportAll", "", "./all~"), ("ReExport", "p~,q~", "./some~"), ("Named", "fn~", None)]), view=False)
def p9(spark, sf):
    return _singles(spark, sf, ".tsx").select(F.explode("exports").alias("x")).select("x.kind", F.array_join("x.names", ",").alias("names"), "x.source")


@query("p10_rust_uses", expected("path is_pub_use", [("std::fmt", False), ("crate::a::{B, C}", True)]), view=False)
def p10(spark, sf):
    return _singles(spark, sf, ".rs").select(F.explode("rust_uses").alias("u")).select("u.path", "u.is_pub_use")


@query("p11_python_imports", expected("kind level module_path line specifiers", [
    ("PythonAbsolute", 0, "__future__", 1, "annotations"), ("PythonAbsolute", 0, "os", 2, "os"), ("PythonAbsolute", 0, "a.b", 2, "ab < a.b"), ("PythonRelative", 1, "", 3, "sib~"), ("PythonRelative", 2, "up", 4, "Y < X, Z"),
    ("PythonAbsolute", 0, "star~", 5, "* all"), ("PythonConditional", 0, "fast~", 7, "fast~"), ("PythonConditional", 0, "slow~", 9, "fast"),
]), view=False)
def p11(spark, sf):
    return _imports(spark, sf, "/m.py")


@query("p12_go_imports", expected("kind module_path line specifiers", [("GoAbsolute", "fmt", 3, "fmt"), ("GoAbsolute", "ex.com/al~", 4, "al < ex.com/al~"), ("GoBlank", "ex.com/blank~", 5, ""), ("GoDot", "ex.com/dot~", 6, "")]), view=False)
def p12(spark, sf):
    return _imports(spark, sf, ".go").drop("level")


@query("p13_relationships", expected("from_name to_name kind line", [
    ("Svc~", "Base~", "Extends", 7), ("Svc~", "Face~", "Implements", 7), (None, "Id~", "TypeReference", 9), (None, "load~", "MethodCall", 9), (None, "go~", "Calls", 15), (None, "Injectable", "Calls", 6), (None, "Get", "Calls", 8),
]), view=False)
def p13(spark, sf):
    return _singles(spark, sf, ".tsx").select(F.explode("relationships").alias("r")).select("r.from_name", "r.to_name", "r.kind", "r.line")


@query("p15_module_tree", expected("crate_name path module", [
    ("one_~", "p~/crates/one/src/lib.rs", "crate"), ("one_~", "p~/crates/one/src/a/mod.rs", "crate::a"), ("one_~", "p~/crates/one/src/a/inner.rs", "crate::a::inner"), ("one_~", "p~/crates/one/src/b.rs", "crate::b"), ("two_~", "p~/crates/two/src/root.rs", "crate"),
]), view=False)
def p15(spark, sf):
    files = _project(spark, sf)
    return resolve.module_tree(parse_sources(files.where("path LIKE '%.rs'")), walk.file_table(files), walk.cargo_crates(files))


def _edges(spark, sf, like: str, *kinds: str) -> DataFrame:
    """(src, dst, specifier) of edges from files like a pattern; symbols by their names."""
    g = built(spark, sf)
    e = g.edges.where(F.col("kind").isin(*kinds))
    name = g.symbols.select("symbol_id", "name")
    for end in ("src", "dst"):
        e = join_sparse(e.withColumn("symbol_id", symbol_of(end)), name, "symbol_id", F.xxhash64("src", "dst", "specifier")).withColumn(end, F.when(F.col("symbol_id").isNotNull(), F.concat(F.lit("s:"), "name")).when(F.col(end).startswith("unresolved:"), "unresolved").otherwise(F.col(end))).drop("name", "symbol_id")
    return e.where(F.col("src").like(like)).select("src", "dst", "specifier", "kind")


APP, ONE, MAIN, GO = "p~/web/app.ts", "p~/crates/one/src/", "p~/py/main.py", "p~/go/main.go"


@query("j1_typescript_imports", expected("src dst specifier", [
    (APP, "p~/util/src/index.ts", "@org/util~"), (APP, "p~/web/barrel.ts", "./barrel"), (APP, "p~/web/ring.ts", "./ring"), (APP, "builtin:fs", "node:fs"), (APP, "builtin:path", "path"), (APP, "pkg:lodash", "lodash/merge"),
    (APP, "pkg:@scope/pack", "@scope/pack/x"), (APP, "unresolved", "./missing~"), (APP, "shared/alias~.ts", "@lib/alias~.js"), (APP, "p~/web/a.ts", "./barrel"),
]), view=False)
def j1(spark, sf):
    """With the edge that a named re-export adds (J4): to the file behind two hops; a ring of re-exports adds none."""
    return _edges(spark, sf, "p%/web/app.ts", "ResolvedImport").drop("kind")


@query("j3_barrels", expected("src dst specifier", [("p~/util/src/index.ts", "p~/util/src/deep.ts", "./deep")]), view=False)
def j3(spark, sf):
    return _edges(spark, sf, "%", "BarrelReExportAll").drop("kind")


@query("j4_named_reexports", expected("src dst specifier", [(APP, "p~/web/a.ts", "./barrel")]), view=False)
def j4(spark, sf):
    files = _project(spark, sf)
    parsed = cut(parse_sources(files.where("path LIKE 'p%/web/%.ts'")))
    linked = built(spark, sf).edges.where("kind = 'ResolvedImport' AND src LIKE '%/app.ts' AND specifier LIKE './%' AND dst NOT LIKE '%/a.ts'")
    return resolve.named_reexports(parsed, walk.file_table(files), linked.select("src", "dst", "specifier")).select("src", "dst", "specifier")


@query("j5_inheritance", expected("src dst kind", [("s:C~", "s:Base~", "Extends"), ("s:C~", "s:I~", "Implements")]), view=False)
def j5(spark, sf):
    return _edges(spark, sf, "s:C%", "Extends", "Implements").drop("specifier")


@query("j7_rust_imports", expected("src dst specifier", [
    (ONE + "lib.rs", "builtin:std", "std::io"), (ONE + "lib.rs", ONE + "a/inner.rs", "crate::a::inner::Thing"), (ONE + "lib.rs", "pkg:serde", "serde::Serialize"), (ONE + "lib.rs", "p~/crates/two/src/root.rs", "two_~::thing"),
    (ONE + "lib.rs", ONE + "lib.rs", "crate::nowhere::X"), (ONE + "a/mod.rs", ONE + "b.rs", "super::b::f"), (ONE + "a/inner.rs", ONE + "a/inner.rs", "self::x"), (ONE + "a/inner.rs", ONE + "b.rs", "super::super::b::*"),
]), view=False)
def j7(spark, sf):
    return _edges(spark, sf, "p%.rs", "ResolvedImport").drop("kind")


@query("j8_python_imports", expected("src dst specifier kind", [
    (MAIN, "pkg:os", "os.path", "ResolvedImport"), (MAIN, "pkg:logging", "logging", "ResolvedImport"), (MAIN, "p~/py/pkg/impl.py", ".pkg", "ResolvedImport"), (MAIN, "p~/py/pkg/impl.py", ".pkg", "ResolvedImport"),
    (MAIN, "unresolved", ".nothing", "ResolvedImport"), (MAIN, "p~/py/pkg/many.py", ".pkg.many", "ResolvedImport"), (MAIN, "s:In~", None, "ResolvedImport"), (MAIN, "pkg:requests", "requests.api", "ResolvedImport"),
    (MAIN, "p~/py/pkg/impl.py", ".pkg", "ConditionalImport"),
]), view=False)
def j8(spark, sf):
    """The standard library comes first, so the project's logging.py is not what `import logging` means."""
    return _edges(spark, sf, "p%/py/main.py", "ResolvedImport", "ConditionalImport")


@query("j9_go_imports", expected("src dst specifier kind", [
    (GO, "pkg:fmt", "fmt", "ResolvedImport"), (GO, "p~/go/handlers/h.go", "example.com/app~/handlers", "ResolvedImport"), (GO, "p~/go/handlers/more.go", "example.com/app~/handlers", "ResolvedImport"),
    (GO, "p~/go/side/s.go", "example.com/app~/side", "SideEffectImport"), (GO, "p~/go/side/s.go", "example.com/old~", "DotImport"), (GO, "pkg:github.com/x/y", "github.com/x/y", "ResolvedImport"), (GO, "unresolved", "example.com/app~/none", "ResolvedImport"),
]), view=False)
def j9(spark, sf):
    return _edges(spark, sf, "p%/go/main.go", "ResolvedImport", "SideEffectImport", "DotImport")


@query("j10_go_receivers", expected("name parent", [("Go~", "H~"), ("Stop~", "H~"), ("Stop~", "Root~"), ("Go~", "Runner~"), ("Stop~", "Runner~")]), view=False)
def j10(spark, sf):
    g = built(spark, sf)
    s = g.symbols.where("name LIKE 'Go%' OR name LIKE 'Stop%'").select("name", "parent_id")
    return s.join(g.symbols.select(F.col("symbol_id").alias("parent_id"), F.col("name").alias("parent")), "parent_id").select("name", "parent")


@query("j11_go_embeds", expected("src dst", [("s:H~", "s:Root~")]), view=False)
def j11(spark, sf):
    return _edges(spark, sf, "s:%", "Embeds").select("src", "dst")


@query("j13_crate_names", expected("path crate_name", [
    (ONE + "lib.rs", "one_~"), (ONE + "a/mod.rs", "one_~"), (ONE + "a/inner.rs", "one_~"), (ONE + "b.rs", "one_~"), ("p~/crates/two/src/root.rs", "two_~"), ("p~/other/src/lib.rs", None),
]), view=False)
def j13(spark, sf):
    return built(spark, sf).files.where("path LIKE '%.rs'").select("path", "crate_name")


SOURCES = [p for p in PROJECT if p.rpartition(".")[2] in ("ts", "rs", "py", "go") and "node_modules" not in p and ".skip." not in p and not p.startswith("left/")]


# The graph of the whole project, seen through lookups and aggregates. Unlike the rows above, these were printed by the
# engine first and then held against the sources and rules by reading.


@query("a3_crate_symbols", expected("crate_name file_count symbol_count fn_count struct_count enum_count", [("one_~", 4, 2, 1, 1, 0), ("two_~", 1, 1, 1, 0, 0)]), view=False)
def a3p(spark, sf):
    return aggregates.crate_stats(built(spark, sf)).select("crate_name", "file_count", "symbol_count", "fn_count", "struct_count", "enum_count")


@query("d2_project_symbols", expected("path name kind line", [
    ("p~/py/pkg/many.py", "Out~", "class", 3), ("p~/py/pkg/many.py", "__all__", "variable", 1), ("p~/web/app.ts", "C~", "class", 10), ("p~/web/app.ts", "I~", "interface", 11),
]), view=False)
def d2p(spark, sf):
    return aggregates.unreferenced_symbols(built(spark, sf))


@query("f4_context_types", expected("section symbol_name kind file_path line", [
    ("definitions", "C~", "class", APP, 10), ("definitions", "I~", "interface", APP, 11), ("definitions", "Base~", "class", "p~/web/a.ts", 2),
    ("definitions", "Root~", "struct", "p~/go/handlers/h.go", 2), ("definitions", "H~", "struct", "p~/go/handlers/h.go", 3), ("callees", "only~", "function", "p~/web/a.ts", 3),
    ("extends", "Base~", "class", "p~/web/a.ts", 2), ("extended_by", "C~", "class", APP, 10), ("implements", "I~", "interface", APP, 11), ("implements", "Runner~", "interface", "p~/go/handlers/h.go", 7),
    ("implemented_by", "C~", "class", APP, 10), ("references", None, "Import", "p~/go/main.go", None),
]), view=False)
def f4p(spark, sf):
    """All sections, for classes, structs and interfaces."""
    g = built(spark, sf)
    return lookup.context(g, g.symbols.where("name RLIKE '^(C|I|Base|Root|H)[0-9]+$'").select("symbol_id")).select("section", "symbol_name", "kind", "file_path", "line")


@query("f5_import_categories", expected("file_path specifier category is_reexport", [
    ("p~/crates/one/src/a/inner.rs", "self::x", "Internal", False), ("p~/crates/one/src/a/inner.rs", "super::super::b::*", "Internal", False), ("p~/crates/one/src/a/mod.rs", "super::b::f", "Internal", False),
    *[("p~/crates/one/src/lib.rs", s, c, False) for s, c in (("crate::a::inner::Thing", "Internal"), ("crate::nowhere::X", "Internal"), ("serde::Serialize", "External"), ("std::io", "Builtin"), ("two_~::thing", "Workspace"))],
    *[("p~/go/main.go", s, c, False) for s, c in (("example.com/app~/handlers", "Internal"), ("example.com/app~/handlers", "Internal"), ("fmt", "External"), ("github.com/x/y", "External"))],
    *[("p~/py/main.py", s, c, False) for s, c in ((".pkg", "Internal"), (".pkg", "Internal"), (".pkg.many", "Internal"), ("logging", "External"), ("os.path", "External"), ("requests.api", "External"))],
    ("p~/py/pkg/__init__.py", ".impl", "Internal", False), ("p~/util/src/index.ts", "p~/util/src/deep.ts", "Internal", True),
    *[(APP, s, c, False) for s, c in (("./barrel", "Internal"), ("./barrel", "Internal"), ("./ring", "Internal"), ("@lib/alias~.js", "Internal"), ("@org/util~", "Internal"), ("@scope/pack/x", "External"), ("lodash/merge", "External"), ("node:fs", "Builtin"), ("path", "Builtin"))],
]), view=False)
def f5p(spark, sf):
    return lookup.file_imports(built(spark, sf)).drop("seq")


@query("f10_roles", expected("relative_path role", [
    *[(f"p~/{p}", "Config") for p in ("crates/one/Cargo.toml", "crates/two/Cargo.toml", "other/Cargo.toml", "util/package.json")],
    *[(f"p~/{p}", "LibraryRoot") for p in ("crates/one/src/lib.rs", "crates/one/src/a/mod.rs", "other/src/lib.rs")],
    *[(f"p~/{p}", "Types") for p in ("crates/one/src/a/inner.rs", "go/handlers/h.go")],
]), view=False)
def f10p(spark, sf):
    return lookup.file_summaries(built(spark, sf)).where("role <> 'Utility' AND relative_path LIKE 'p%/%'").select("relative_path", "role")


@query("s1_source_files", expected("path language", [(p, {"ts": "typescript", "rs": "rust", "py": "python", "go": "go"}[p.rpartition(".")[2]]) for p in SOURCES]), view=False)
def s1(spark, sf):
    return built(spark, sf).files.where("kind = 'Source'").select("path", "language")


@query("s2_other_files", expected("path kind", [
    *[(p, "Config") for p in PROJECT if p.endswith((".toml", ".json"))], *[(p, "Other") for p in PROJECT if p.endswith("go.mod")], ("p~/README.md", "Doc"),
], [*[(p, "Config") for p in ROOT if p.endswith((".toml", ".json"))], (".gitignore", "Other"), ("go.work", "Other")]), view=False)
def s2(spark, sf):
    return built(spark, sf).files.where("kind <> 'Source'").select("path", "kind")


@query("s4_detect_languages", "SELECT * FROM (VALUES ('typescript'), ('rust'), ('go')) v(language)", view=False)
def s4(spark, sf):
    return walk.detect_languages(_project(spark, sf))


@query("s6_workspaces", expected("name dir", [("@org/util~", "p~/util/src")]), view=False)
def s6(spark, sf):
    return walk.node_workspaces(_project(spark, sf))


@query("s7_cargo_crates", expected("crate_name root", [("one_~", "p~/crates/one/src/lib.rs"), ("two_~", "p~/crates/two/src/root.rs")]), view=False)
def s7(spark, sf):
    return walk.cargo_crates(_project(spark, sf))


@query("s8_go_modules", expected("module dir", [("example.com/app~", "p~/go"), ("example.com/old~", "p~/go/side")]), view=False)
def s8(spark, sf):
    return walk.go_modules(_project(spark, sf))


@query("s9_options", "SELECT 'left' AS exclude, 9 AS high_threshold, 5 AS medium_threshold, '@lib/*=shared/*' AS aliases", view=False)
def s9(spark, sf):
    files = _project(spark, sf)
    o, paths = walk.project_options(files), walk.typescript_paths(files)
    row = (",".join(o.exclude), o.high_threshold, o.medium_threshold, ",".join(f"{k}={v}" for k, v in paths.items()))
    return spark.createDataFrame([row], "exclude string, high_threshold int, medium_threshold int, aliases string")


@query("s10_stored_state", f"SELECT path, CAST(length(content) AS BIGINT) AS size, CAST(1 AS BIGINT) AS mtime FROM ({expected('path content', list(PROJECT.items()), [x for x in ROOT.items()])}) UNION ALL SELECT 'go.work', 8 + sum(length('use ./p' || s_suppkey || '/go') + 1), 1 FROM supplier", view=False)
def s10(spark, sf):
    """The states of files that a stored graph keeps for later comparisons."""
    built(spark, sf)
    return load_graph(spark, _BUILT[spark.sparkContext.applicationId, sf])[1]


KINDS = "project package module folder file class struct interface trait enum component function method impl_method type macro variable const static property".split()


@query("g4_mass_and_size", f"""WITH k AS (SELECT unnest({KINDS}) AS kind), n AS (SELECT DISTINCT o_orderkey AS nodes FROM orders)
SELECT kind, nodes, CASE kind WHEN 'project' THEN 50 WHEN 'package' THEN 30 WHEN 'module' THEN 20 WHEN 'folder' THEN 15 WHEN 'file' THEN 3 WHEN 'type' THEN 1.5 WHEN 'macro' THEN 1.5 ELSE CASE WHEN kind IN ('class', 'interface', 'struct', 'trait') THEN 5 WHEN kind IN ('function', 'method', 'impl_method', 'enum', 'component') THEN 2 ELSE 1 END END::DOUBLE * CASE WHEN nodes >= 5000 THEN 2 WHEN nodes >= 1000 THEN 1.5 ELSE 1 END AS mass,
round(greatest(b * CASE WHEN nodes > 50000 THEN 0.4 WHEN nodes > 20000 THEN 0.5 WHEN nodes > 5000 THEN 0.65 WHEN nodes > 1000 THEN 0.8 ELSE 1 END, CASE WHEN nodes > 50000 THEN 1 WHEN nodes > 20000 THEN 1.5 WHEN nodes > 5000 THEN 2 WHEN nodes > 1000 THEN 2.5 ELSE b END), 6)::DOUBLE AS size
FROM (SELECT *, CASE kind WHEN 'project' THEN 20 WHEN 'package' THEN 18 WHEN 'module' THEN 16 WHEN 'folder' THEN 15 WHEN 'file' THEN 7 WHEN 'enum' THEN 4.5 WHEN 'component' THEN 4.5 WHEN 'type' THEN 3.5 WHEN 'macro' THEN 3.5 ELSE CASE WHEN kind IN ('class', 'struct', 'interface', 'trait') THEN 5 WHEN kind IN ('function', 'method', 'impl_method') THEN 4 ELSE 3 END END AS b FROM k, n)""", view=False)
def g4(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("nodes")).distinct().select(F.explode(F.array(*map(F.lit, KINDS))).alias("kind"), "nodes")
    return rows.select("kind", "nodes", graphjson.node_mass(F.col("kind"), F.col("nodes")).alias("mass"), F.round(graphjson.scaled_size(F.col("kind"), F.col("nodes")), 6).alias("size"))


@query("epoch_text", "SELECT event_id, strftime(make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000 + event_id * 86400000000), '%Y-%m-%d %H:%M:%S UTC') AS shown FROM events", view=False)
def epochs(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", "unix_seconds(cast(ts AS timestamp)) + event_id * 86400 AS s")
    return e.select("event_id", epoch_text(F.col("s")).alias("shown"))
