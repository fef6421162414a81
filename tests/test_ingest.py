import os

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import lookup, resolve, traverse
from quarrylens.sources import walk
from quarrylens.sources.ingest import build
from quarrylens.sources.parsers import parse_file

FILES = {
    "package.json": '{"name": "root", "workspaces": ["packages/*"]}',
    "packages/util/package.json": '{"name": "@org/util"}',
    "packages/util/src/index.ts": "export * from './deep';\nexport function helper() {}\n",
    "packages/util/src/deep.ts": "export const deep = () => 1;\n",
    "web/app.ts": "import { helper } from '@org/util';\nimport { A as B } from './barrel';\nimport fs from 'fs';\nimport lo from 'lodash/merge';\nimport x from './missing';\nclass C extends Base {}\nexport const run = () => onlyHere();\n",
    "web/barrel.ts": "export { A } from './a';\n",
    "web/a.ts": "export class A {}\nexport class Base {}\nexport function onlyHere() {}\n",
    "web/node_modules/x.ts": "export const no = 1;\n",
    "crates/one/Cargo.toml": '[package]\nname = "one-crate"\n',
    "crates/one/src/lib.rs": "mod a;\npub mod b;\nuse std::io;\nuse crate::a::inner::Thing;\nuse serde::Serialize;\nuse two::thing;\n",
    "crates/one/src/a/mod.rs": "mod inner;\nuse super::b::f;\n",
    "crates/one/src/a/inner.rs": "pub struct Thing;\nuse self::x;\n",
    "crates/one/src/b.rs": "pub fn f() {}\n",
    "crates/two/Cargo.toml": '[package]\nname = "two"\n',
    "crates/two/src/lib.rs": "pub fn thing() {}\n",
    "py/pkg/__init__.py": "from .impl import Real as Shown\n",
    "py/pkg/impl.py": "class Real: pass\n",
    "py/main.py": "import os\nfrom .pkg import Shown\nfrom .pkg import impl\nfrom .nothing import z\ntry:\n    from .pkg import impl\nexcept ImportError:\n    pass\n",
    "go/go.mod": "module example.com/app\n",
    "go/main.go": 'package main\nimport (\n\t"fmt"\n\t"example.com/app/handlers"\n\t_ "example.com/app/side"\n\t"github.com/x/y"\n)\nfunc main() { fmt.Println() }\n',
    "go/handlers/h.go": "package handlers\ntype Base struct {}\ntype H struct {\n\tBase\n}\nfunc (h *H) Run() {}\nfunc (h *H) Stop() {}\ntype Runner interface { Run(); Stop() }\ntype Empty interface {}\n",
    "go/side/s.go": "package side\n",
    "README.md": "# hi\n",
    ".gitignore": "*.skip.ts\nbuild/\n",
    "web/gone.skip.ts": "export const a = 1;\n",
    "build/out.ts": "export const b = 1;\n",
}


@pytest.fixture(scope="module")
def graph(spark):
    files = spark.createDataFrame([(p, len(c), 1, bytearray(c.encode())) for p, c in FILES.items()], "path string, size long, mtime long, content binary")
    return build(files)[0]


def edges(g, kind):
    return {(r.src, r.dst) for r in g.edges.where(F.col("kind") == kind).collect()}


def names(g):
    return {f"s:{r.symbol_id}": r.name for r in g.symbols.collect()}


def test_files_and_ignores(graph):
    paths = {r.path for r in graph.files.collect()}
    assert {"web/app.ts", "README.md", "py/main.py"} <= paths
    assert not {"web/node_modules/x.ts", "web/gone.skip.ts", "build/out.ts"} & paths


def test_typescript(graph):
    e = edges(graph, "ResolvedImport")
    assert ("web/app.ts", "packages/util/src/index.ts") in e and ("web/app.ts", "web/barrel.ts") in e and ("web/app.ts", "web/a.ts") in e
    assert ("web/app.ts", "builtin:fs") in e and ("web/app.ts", "pkg:lodash") in e
    assert [r.specifier for r in graph.unresolved.where("specifier = './missing'").collect()] == ["./missing"]
    assert edges(graph, "BarrelReExportAll") == {("packages/util/src/index.ts", "packages/util/src/deep.ts")}
    n = names(graph)
    assert ("C", "Base") in {(n[a], n[b]) for a, b in edges(graph, "Extends")}
    assert ("web/app.ts", "onlyHere") in {(a, n[b]) for a, b in edges(graph, "Calls")}


def test_rust(graph):
    e = edges(graph, "ResolvedImport")
    one = "crates/one/src/"
    assert (one + "lib.rs", one + "a/inner.rs") in e and (one + "lib.rs", "builtin:std") in e and (one + "lib.rs", "pkg:serde") in e
    assert (one + "lib.rs", "crates/two/src/lib.rs") in e and (one + "a/mod.rs", one + "b.rs") in e
    crates = {r.path: r.crate_name for r in graph.files.where("crate_name IS NOT NULL").collect()}
    assert crates[one + "a/inner.rs"] == "one_crate" and crates["crates/two/src/lib.rs"] == "two"


def test_python(graph):
    e = edges(graph, "ResolvedImport")
    assert ("py/main.py", "pkg:os") in e and ("py/main.py", "py/pkg/impl.py") in e
    assert ("py/main.py", "py/pkg/impl.py") in edges(graph, "ConditionalImport")
    assert graph.unresolved.where("specifier = '.nothing'").count() == 1


def test_go(graph):
    e, n = edges(graph, "ResolvedImport"), names(graph)
    assert ("go/main.go", "go/handlers/h.go") in e and ("go/main.go", "pkg:fmt") in e and ("go/main.go", "pkg:github.com/x/y") in e
    assert edges(graph, "SideEffectImport") == {("go/main.go", "go/side/s.go")}
    assert {(n[a], n[b]) for a, b in edges(graph, "Embeds")} == {("H", "Base")}
    assert {(n[a], n[b]) for a, b in edges(graph, "Implements")} == {("H", "Runner")}
    assert {n[a] for a, b in {(r.src, r.dst) for r in graph.child_of().collect()} if n[b] == "H"} == {"Run", "Stop"}


def test_questions_over_a_built_graph(graph):
    hit = lookup.find(graph, "^onlyHere$").first()
    assert (hit.file_path, hit.kind) == ("web/a.ts", "function")
    reach = traverse.impact(graph, graph.symbols.where("name = 'deep'").select("symbol_id"))
    assert [r.file_path for r in reach.collect()] == []  # barrels are no imports
    assert [(r.file_path, r.confidence) for r in traverse.impact(graph, graph.symbols.where("name = 'onlyHere'").select("symbol_id")).collect()] == [("web/app.ts", "High")]


def test_division_and_packages(spark):
    has = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "struct_id long, method string")
    wants = spark.createDataFrame([(10, "a"), (10, "b"), (11, "a"), (12, "z")], "iface_id long, method string")
    assert {tuple(r) for r in resolve.implicit_interfaces(has, wants).collect()} == {(1, 10), (1, 11), (2, 11)}
    p = spark.createDataFrame([("react",), ("@org/u/x",), ("lodash/merge",), ("@org",)], "s string").select(resolve.package_name(F.col("s")).alias("p"))
    assert [r.p for r in p.collect()] == ["react", "@org/u", "lodash", "@org"]


def test_parsers():
    ts = parse_file("a.tsx", b"export const App = () => { return <div/>; };\nexport interface P { a: string; f(): void }\n@Injectable()\nexport class S { @Get('/u')\n async find() { return go(); } }\n")
    assert [(s["name"], s["kind"], [c["name"] for c in s["children"]], [d["name"] for d in s["decorators"]]) for s in ts["symbols"]] == [("App", "component", [], []), ("P", "interface", ["a", "f"], []), ("S", "class", ["find"], ["Injectable"])]
    assert ("go", "Calls") in {(r["to_name"], r["kind"]) for r in ts["relationships"]}
    rs = parse_file("a.rs", b'#[derive(Debug)]\npub struct A;\nimpl fmt::Display for A { fn fmt(&self) { let s = "}"; } }\npub(crate) trait T { fn m(&self); }\nuse a::{b, c};\nmod x;\n')
    assert [(s["name"], s["kind"], s["visibility"], s["trait_impl"]) for s in rs["symbols"]] == [("A", "struct", "pub", None), ("A::fmt", "impl_method", "private", "Display"), ("T", "trait", "pub(crate)", None)]
    assert rs["rust_uses"] == [{"path": "a::{b, c}", "is_pub_use": False}] and rs["mods"] == ["x"]
    go = parse_file("a.go", b'package p\n//go:generate x\ntype T struct {\n\tA int `json:"a"`\n}\nconst X, y = 1, 2\nfunc (t *T) M() {}\n')
    assert [(s["name"], s["kind"], s["is_exported"], s["trait_impl"], [d["name"] for d in s["decorators"]]) for s in go["symbols"]] == [("T", "struct", True, None, ["go:generate", "json"]), ("X", "const", True, None, []), ("y", "const", False, None, []), ("M", "method", True, "T", [])]
    py = parse_file("a.py", b"__all__ = ['f']\n@app.route('/x')\ndef f(): pass\nclass C:\n    def m(self): pass\nfrom ..a import b as c\n")
    assert [(s["name"], s["kind"], s["is_exported"]) for s in py["symbols"]] == [("__all__", "variable", False), ("f", "function", True), ("C", "class", False)]
    assert py["symbols"][1]["decorators"][0] == {"name": "app.route", "object": "app", "attribute": "route", "args_raw": "('/x')", "framework": None}
    py = parse_file("a.py", b"import os\n@deco\ndef f(): pass\ndef broken(:\n    pass\nclass C:\n  def m(self): pass\n")
    assert [(s["name"], s["line"], len(s["decorators"])) for s in py["symbols"]] == [("f", 3, 1), ("C", 6, 0)] and [i["module_path"] for i in py["imports"]] == ["os"]
    assert parse_file("a.py", b"def (") is None and parse_file("a.txt", b"") is None and parse_file("a.ts", b"\xff") is None


def test_configuration_of_the_root(spark):
    rows = {
        "tsconfig.json": '{"compilerOptions": {"baseUrl": "./web", /* of the app */ "paths": {"@a/*": ["./x/*", "y/*"], "b": ["c"]}}, "note": "// kept",}',
        "quarrylens.toml": 'exclude = ["d"]\n[impact]\nmedium_threshold = 2\n',
        "Cargo.toml": '[package]\nname = "top"\n[workspace]\nmembers = ["in/*"]\n',
        "src/lib.rs": "", "in/a/Cargo.toml": '[package]\nname = "in-a"\n', "in/a/src/main.rs": "", "in/a/b/Cargo.toml": '[package]\nname = "deeper"\n', "in/a/b/src/lib.rs": "",
        "go.mod": "module top.io/m\n", "go.work": "use (\n\t./used\n)\n", "used/go.mod": "module used.io/m\n", "spare/go.mod": "module spare.io/m\n",
    }
    files = spark.createDataFrame([(p, bytearray(c.encode())) for p, c in rows.items()], "path string, content binary")
    assert walk.typescript_paths(files) == {"@a/*": "web/x/*", "b": "web/c"}
    assert walk.project_options(files) == walk.Options(["d"], 20, 2) and walk.project_options(files.limit(0)) == walk.Options()
    assert walk.Options.from_toml("= broken") == walk.Options()
    assert {tuple(r) for r in walk.cargo_crates(files).collect()} == {("top", "src/lib.rs"), ("in_a", "in/a/src/main.rs")}
    assert {r.module for r in walk.go_modules(files).collect()} == {"top.io/m", "used.io/m"}
    assert {r.module for r in walk.go_modules(files.where("path <> 'go.work'")).collect()} == {"top.io/m", "used.io/m", "spare.io/m"}


def test_generated_files_are_dealt_out_and_only_those_asked_for_are_parsed(spark):
    from quarrylens import project_queries as q

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data here")
    for files in (q._project(spark, data).where("path LIKE 'p%/web/app.ts'"), q._files(spark, data, q.SINGLES)):
        assert files.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    plan = q._singles(spark, data, ".go")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("EndsWith(") and "EndsWith(" not in plan[: plan.index("MapInArrow")]
