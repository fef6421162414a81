from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarrylens.operators.resolve import Manifests
from quarrylens.sources.ingest import build
from quarrylens.sources.store import load_graph, save_graph, staleness
from quarrylens.streaming import watch


def files_of(spark, files):
    return spark.createDataFrame([(p, len(c), 1, bytearray(c.encode())) for p, c in files.items()], "path string, size long, mtime long, content binary")


BEFORE = {"a.ts": "import { f } from './b';\nimport { g } from './c';\nexport const x = () => f();\n", "b.ts": "export function f() {}\n", "go.go": "package p\ntype S struct {}\nfunc (s *S) M() {}\n", "old.py": "def gone(): pass\n", "use.py": "from old import gone\n"}
AFTER = {"a.ts": BEFORE["a.ts"], "b.ts": "export function f2() {}\n", "c.ts": "@Get('/x')\nexport class g {}\n", "go.go": BEFORE["go.go"], "use.py": BEFORE["use.py"]}


def content(g):
    names = {f"s:{r.symbol_id}": (r.name, r.kind, r.parent_id is None) for r in g.symbols.collect()}
    e = sorted((str(names.get(r.src, r.src)), str(names.get(r.dst, r.dst)), r.kind, r.specifier or "") for r in g.edges.collect())
    return sorted(r.path for r in g.files.collect()), sorted(map(str, names.values())), e, sorted(r.specifier for r in g.unresolved.collect())


def manifests(spark):
    none = lambda s: spark.createDataFrame([], s)
    return Manifests(none("name string, dir string"), none("crate_name string, root string"), none("module string, dir string"), {})


def test_incremental_equals_rebuild(spark):
    g, parsed = build(files_of(spark, BEFORE))
    changed = {p: c for p, c in AFTER.items() if BEFORE.get(p) != c}
    gone = spark.createDataFrame([("old.py",)], "path string")
    now, _ = watch.apply_changes(g, parsed, files_of(spark, changed).select("path", "content"), gone, manifests(spark))
    assert content(now) == content(build(files_of(spark, AFTER))[0])


def test_deleting_leaves_unresolved_imports(spark):
    g, _ = build(files_of(spark, BEFORE))
    out = watch.delete_files(g, spark.createDataFrame([("old.py",)], "path string"))
    assert [(r.specifier, r.reason) for r in out.unresolved.where("reason = 'target file deleted'").collect()] == [("old", "target file deleted")]
    assert out.symbols.where("name = 'gone'").count() == 0 and out.edges.where("src = 'old.py' OR dst = 'old.py'").count() == 0


def test_stream_drained_equals_rebuild(spark, tmp_path):
    root = str(tmp_path)
    g, parsed = build(files_of(spark, BEFORE))
    save_graph(g, f"{root}/store/graph", parsed=parsed)
    t = datetime(2024, 1, 1)
    events = [("b.ts", t, True), ("b.ts", t + timedelta(milliseconds=20), True), ("c.ts", t, False), ("c.ts", t + timedelta(milliseconds=30), True), ("old.py", t, False), ("notes.txt", t, True), ("node_modules/x.ts", t, True)]
    spark.createDataFrame(events, "path string, ts timestamp, exists boolean").write.parquet(f"{root}/events")
    stream = spark.readStream.schema("path string, ts timestamp, exists boolean").parquet(f"{root}/events")
    after, seen = files_of(spark, AFTER).select("path", "content"), []
    q = watch.run_watcher(stream, lambda paths: after.join(paths, "path", "left_semi"), f"{root}/store", f"{root}/cp", manifests(spark), seen.append, {"availableNow": True})
    q.awaitTermination(120)
    assert q.exception() is None
    assert content(load_graph(spark, f"{root}/store/graph")[0]) == content(build(files_of(spark, AFTER))[0])
    assert seen == ['{"type": "graph_updated"}']


def test_debounce_stream_equals_batch(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(f"f{i % 3}.ts", t + timedelta(milliseconds=40 * i + (500 if i > 20 else 0)), i % 2 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "path string, ts timestamp, exists boolean")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    want = sorted(map(tuple, watch.debounce(df).collect()))
    stream = watch.debounce(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    spark.createDataFrame([("end.ts", t + timedelta(hours=1), True)], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = stream.writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("debounced").where("path <> 'end.ts'").collect())) == want


def test_classification(spark):
    rows = [("src/a.ts", True), ("src/a.ts", False), ("Cargo.toml", True), ("x/mod.rs", False), ("package.json", True), ("node_modules/a.ts", True), ("a.md", True), ("p/__init__.py", True)]
    got = spark.createDataFrame(rows, "path string, exists boolean").select(watch.classify().alias("e")).collect()
    assert [r.e for r in got] == ["Modified", "Deleted", "CrateRootChanged", "CrateRootChanged", "ConfigChanged", None, None, "ConfigChanged"]


def test_staleness(spark):
    s = "path string, size long, mtime long"
    old = spark.createDataFrame([(f"f{i}", 1, 1) for i in range(20)], s)
    new = spark.createDataFrame([(f"f{i}", 1, 1 + (i == 3)) for i in range(19)], s)
    changes, rebuild = staleness(old, new)
    assert {tuple(r) for r in changes.collect()} == {("f3", "modified"), ("f19", "deleted")} and rebuild
    assert not staleness(old, old.where("path <> 'f1'"))[1]
    assert old.where(F.lit(False)).count() == 0


def test_session_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = stream.groupBy("conv_id").transformWithStateInPandas(watch.Sessions(), "conv_id long, turn long, messages long", "append", "none")
    q = out.writeStream.format("memory").queryName("sessions").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert sorted(map(tuple, spark.table("sessions").collect())) == [(1, 0, 1), (1, 1, 2), (2, 0, 1)]


def test_drained_query_gives_the_last_bursts_too(spark, tmp_path):
    from quarrylens.queries import QUERIES

    t = datetime(2024, 1, 1)
    rows = [(i, t + timedelta(minutes=47 * i * (i % 7)), i % 4, ["view", "error"][i % 3 == 0]) for i in range(200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/e")
    next(tmp_path.glob("e/*.parquet")).rename(tmp_path / "events.parquet")
    got, want = (sorted(map(tuple, QUERIES[n](spark, str(tmp_path)).select("path", "us", "exists").collect())) for n in ("w1_debounce_stream", "w1_debounce"))
    assert got == want


def test_a_replacement_cut_short_keeps_the_graph(spark, tmp_path):
    g, parsed = build(files_of(spark, BEFORE))
    path = tmp_path / "graph"
    save_graph(g, str(path), parsed=parsed)
    path.rename(tmp_path / "graph.old")  # as after the first of the two moves
    (tmp_path / "graph.new").mkdir()
    assert content(load_graph(spark, str(path))[0]) == content(g)
    save_graph(g.with_(files=g.files.limit(0)), str(path))
    assert load_graph(spark, str(path))[0].files.count() == 0 and sorted(p.name for p in tmp_path.iterdir()) == ["graph"]
