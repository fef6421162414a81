"""Live updates: file events, debounced and classified as a stream, applied to a stored graph batch by batch."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.paths import SOURCE_EXT, components, extension, file_name
from ..operators.decorators import with_frameworks
from ..operators.lookup import located
from ..operators.resolve import Manifests, resolve
from ..plans.lineage import cut
from ..schema import CodeGraph, is_file, null_string
from ..sources.ingest import PARSED, parse_sources, symbol_table
from ..sources.store import load_graph, load_parsed, save_graph
from ..sources.walk import file_table

# Files whose change calls for a rebuild, and those among them that are roots of crates.
REBUILD_FILES = ["tsconfig.json", "package.json", "pnpm-workspace.yaml", "Cargo.toml", "lib.rs", "main.rs", "mod.rs", "__init__.py", "go.mod", "go.work"]
CRATE_FILES = ["Cargo.toml", "lib.rs", "main.rs", "mod.rs"]
SKIPPED = ["node_modules", ".quarrylens"]
DEBOUNCE = "75 milliseconds"


def classify(path: str = "path", exists: str = "exists", ignored: F.Column | None = None) -> F.Column:
    """CrateRootChanged, ConfigChanged, Modified or Deleted; null for events that do not matter."""
    skip = F.arrays_overlap(components(path), F.array(*map(F.lit, SKIPPED)))
    if ignored is not None:
        skip = skip | ignored
    return (
        F.when(skip, None)
        .when(file_name(path).isin(CRATE_FILES), "CrateRootChanged")
        .when(file_name(path).isin(REBUILD_FILES), "ConfigChanged")
        .when(~extension(path).isin(SOURCE_EXT), None)
        .when(F.col(exists), "Modified")
        .otherwise("Deleted")
    )


def debounce(events: DataFrame, gap: str = DEBOUNCE, late: str = "1 second") -> DataFrame:
    """(path, ts, exists): the last event of each burst on a path; bursts end with a gap. Works on streams and tables.

    Events later than the watermark are left out of bursts that are closed; the state holds open bursts only."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    burst = source.groupBy(F.session_window("ts", gap).alias("w"), "path").agg(F.max(F.struct("ts", "exists")).alias("last"))
    return burst.select("path", F.col("last.ts").alias("ts"), F.col("last.exists").alias("exists"))


def without_files(g: CodeGraph, gone: DataFrame) -> CodeGraph:
    """The graph without files (path), their symbols with what is nested in them, and every edge that touches either."""
    own = located(g).join(gone.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("symbol_id")
    dead = cut(gone.select(F.col("path").alias("id")).unionByName(own.select(F.concat(F.lit("s:"), F.col("symbol_id").cast("string")).alias("id"))).distinct())
    edges = g.edges.join(dead.withColumnRenamed("id", "src"), "src", "left_anti").join(dead.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return g.with_(files=g.files.join(gone.select("path"), "path", "left_anti"), symbols=g.symbols.join(own, "symbol_id", "left_anti"), edges=edges.select("src", "dst", "kind", "specifier", "seq"))


def delete_files(g: CodeGraph, gone: DataFrame) -> CodeGraph:
    """without_files, with the importers' edges turned into unresolved imports."""
    into = g.edges.where(F.col("kind").isin("ResolvedImport", "ConditionalImport", "BarrelReExportAll", "SideEffectImport", "DotImport")).where(is_file("src")).join(gone.select(F.col("path").alias("dst")), "dst", "left_semi").join(gone.select(F.col("path").alias("src")), "src", "left_anti")
    uid = F.xxhash64("src", "seq", "specifier")
    lost = cut(into.select("src", F.concat(F.lit("unresolved:"), uid.cast("string")).alias("dst"), F.lit("ResolvedImport").alias("kind"), "specifier", "seq", uid.alias("uid")))
    out = without_files(g, gone)
    return out.with_(edges=out.edges.unionByName(lost.drop("uid")), unresolved=out.unresolved.unionByName(lost.select("uid", "specifier", F.lit("target file deleted").alias("reason"))))


def apply_changes(g: CodeGraph, parsed: DataFrame, changed: DataFrame, deleted: DataFrame, m: Manifests) -> tuple[CodeGraph, DataFrame]:
    """(graph, parse results) after files changed (path, content) and went (path): equal to a rebuild of the final state.

    Only changed files are parsed; files, symbols and parse results are merged by anti join and union, and edges follow
    from the merged parse results, as one changed definition may turn others' calls."""
    touched = cut(changed.select("path").unionByName(deleted.select("path")).distinct())
    fresh = cut(parse_sources(changed))
    results = cut(parsed.join(touched, "path", "left_anti").unionByName(fresh))
    rows = file_table(changed).join(fresh.select("path"), "path", "left_semi")
    files = cut(g.files.withColumn("crate_name", null_string()).join(touched, "path", "left_anti").unionByName(rows))
    kept = located(g).join(touched.withColumnRenamed("path", "file_path"), "file_path", "left_anti").select("symbol_id")
    # receivers are nested again by the resolver, so their own nesting is not carried over
    old = g.symbols.join(kept, "symbol_id", "left_semi").withColumn("parent_id", F.when(F.col("file").isNull(), F.col("parent_id")))
    base = CodeGraph.empty(g.spark).with_(files=files, symbols=cut(old.unionByName(symbol_table(fresh))))
    out = resolve(base, results, m)
    langs = located(out).select("symbol_id", "language")
    return out.with_(symbols=with_frameworks(out.symbols.join(langs, "symbol_id", "left")).drop("language")), results


def run_watcher(events: DataFrame, read: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, m: Manifests, on_update: Callable[[str], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Keep the graph stored at path/graph (its parse results with it) up to date with a stream of events (path, ts, exists).

    read: gives (path, content) of paths. A batch that holds a rebuild event re-parses all files of the graph.
    on_update gets a JSON message after each batch that changed something; trigger defaults to one second."""
    spark = events.sparkSession

    def apply(batch: DataFrame, _: int) -> None:
        batch = cut(debounce(batch).withColumn("event", classify()).where("event IS NOT NULL"))
        if batch.isEmpty():
            return
        loaded = load_graph(spark, f"{path}/graph")
        g, state = loaded if loaded else (CodeGraph.empty(spark), spark.createDataFrame([], "path string, size long, mtime long"))
        parsed = load_parsed(spark, f"{path}/graph")
        if parsed is None:
            parsed = spark.createDataFrame([], PARSED)
        rebuild = not batch.where(F.col("event").isin("CrateRootChanged", "ConfigChanged")).isEmpty()
        gone = batch.where("event = 'Deleted' OR NOT exists").select("path")
        now = batch.where("exists").where(extension("path").isin(SOURCE_EXT)).select("path")
        if rebuild:
            now = now.unionByName(g.files.where("kind = 'Source'").select("path")).distinct().join(gone, "path", "left_anti")
        new, results = apply_changes(g, parsed, cut(read(now)), gone, m)
        results = cut(results)
        save_graph(new, f"{path}/graph", state, results)
        if on_update:
            on_update(json.dumps({"type": "graph_updated"}))

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


class Sessions(StatefulProcessor):
    """Per conversation: the running history of its messages; each input row gives the history so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("history", "messages array<string>, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else ([], 0)
        messages, last = list(old[0]), old[1]
        out = []
        for frame in rows:
            for turn, role, text in sorted(zip(frame.turn, frame.role, frame.text)):
                messages.append(f"{role}: {text}")
                last = max(last, int(turn))
                out.append((key[0], int(turn), len(messages)))
        self.state.update((messages, last))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "messages"])

    def close(self) -> None:
        pass
