"""Graph kernels as bounded iterations of joins: every round is one plan, its result a new table.

Graphs of a checked size (LOCAL_EDGES) are solved in one task over arrays instead, with the same rows (local.py).
Only row counts come to the driver. A round's frontier is distinct before it is joined, visited nodes leave by an
anti join, and joins are equi-joins that adaptive execution may split or broadcast by their measured size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import prepare
from . import local
from .lineage import cut


SMALL = 100_000  # rows that are sent to all tasks, so that the edges stay where they are


def _sent(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL else df


def bfs(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None, by: str | None = None, ready: bool = False) -> DataFrame:
    """(by, node, depth): nodes reached from seeds (node) along edges (src, dst), with the least number of hops.

    by: a column of seeds that keeps searches apart; seeds have depth 0. ready: edges are distinct and cut already.
    A small frontier goes to the edges and to the nodes seen; these are neither dealt out nor written anew each round."""
    keys = [by, "node"] if by else ["node"]
    edges = edges if ready else cut(edges.select("src", "dst").distinct())
    frontier = cut(seeds.select(*keys).distinct())
    n = frontier.count()
    if (size := edges.count()) <= local.LOCAL_EDGES and n <= local.LOCAL_EDGES and (size + n) * (n if by else 1) <= local.LOCAL_STEPS:
        return _bfs_locally(frontier, edges, max_depth, by)
    seen = frontier.withColumn("depth", F.lit(0))
    depth = 0
    same = F.col("node") == F.col("been")
    same = same & F.col(by).eqNullSafe(F.col("been_by")) if by else same  # a null search is one of its own
    while max_depth is None or depth < max_depth:
        depth += 1
        step = cut(edges.join(_sent(frontier, n), F.col("node") == F.col("src")).select(*([by] if by else []), F.col("dst").alias("node")).distinct())
        n = step.count()
        been = seen.select(F.col("node").alias("been"), *([F.col(by).alias("been_by")] if by else []))
        if n <= SMALL:
            been = F.broadcast(been.join(F.broadcast(step), same, "left_semi"))  # no more rows than step
        frontier = cut(step.join(been, same, "left_anti"))
        if not (n := frontier.count()):
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
        if depth % 16 == 0:
            seen = cut(seen)
    return seen


def _bfs_locally(seeds: DataFrame, edges: DataFrame, max_depth: int | None, by: str | None) -> DataFrame:
    prepare(edges.sparkSession)
    kind = seeds.schema["node"].dataType.simpleString()
    key = f"`{by}` {seeds.schema[by].dataType.simpleString()}, " if by else ""
    by_of = F.col(by) if by else F.lit(0)
    rows = edges.select("src", "dst", by_of_none(seeds, by).alias("by"), F.lit(False).alias("seed")).unionByName(seeds.select(F.col("node").alias("src"), F.col("node").alias("dst"), by_of.alias("by"), F.lit(True).alias("seed")))

    def solve(f: pd.DataFrame):
        at = f.seed.to_numpy(bool)
        g = local.Csr(f.src[~at], f.dst[~at], f.src[at])
        search, names = pd.factorize(f.by[at], use_na_sentinel=False)
        most = max(1, 4_000_000 // max(1, g.n))  # searches that go together
        for low in range(0, len(names), most):
            own = (search >= low) & (search < low + most)
            for s, node, depth in local.levels(g, search[own] - low, g.more[own], max_depth):
                out = {by: names[s + low]} if by else {}
                yield pd.DataFrame({**out, "node": g.names[node], "depth": np.full(len(node), depth, np.int32)})

    return cut(local.in_one_task(rows, solve, f"{key}node {kind}, depth int"))


def by_of_none(seeds: DataFrame, by: str | None) -> F.Column:
    return F.lit(None).cast(seeds.schema[by].dataType if by else "int")


def _spread(labels: DataFrame, edges: DataFrame, along: tuple[str, str], within: bool) -> DataFrame:
    """The least label that reaches each node along edges, to a fixpoint; within: only between nodes of one colour."""
    src, dst = along
    while True:
        near = labels.select(F.col("node").alias(src), F.col("label").alias("l"), *([F.col("colour").alias("c")] if within else []))
        step = edges.join(near, src).select(F.col(dst).alias("node"), "l", *(["c"] if within else []))
        if within:
            step = step.join(labels.select("node", "colour"), "node").where("c = colour")
        low = step.groupBy("node").agg(F.min("l").alias("l"))
        now = labels.join(low, "node", "left").withColumn("new", F.least("label", F.coalesce("l", "label")))
        now = cut(now.select("node", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("moved"), *(["colour"] if within else [])))
        labels = now.drop("moved")
        if now.where("moved").isEmpty():
            return labels


HOT = 1_024


def _met(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """rows (u, v), n in all, with m of least (u, m, n: how many rows hold u): the few keys that hold over a HOTth of all rows by broadcast, the others by shuffle."""
    most = max(1, n // HOT)
    hot = least.where(F.col("n") > most).drop("n").limit(HOT)
    cold = rows.join(F.broadcast(hot.select("u")), "u", "left_anti")
    return rows.join(F.broadcast(hot), "u").unionByName(cold.join(least.where(F.col("n") <= most).drop("n"), "u"))


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (u, v), taken both ways: component is the least node.

    A round hangs the neighbours of each node on the least of them (large stars, then small ones), so rounds grow with the
    logarithm of the longest way."""
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sums = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now, seen = sums(e), None
    while now != seen:
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        large = cut(_met(both, least, 2 * seen[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _met(large, least, seen[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = sums(e)
    root = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return root.unionByName(root.select(F.col("component").alias("node"), "component").distinct())


def scc(edges: DataFrame) -> DataFrame:
    """(node, component) of strongly connected components of two nodes or more; component is the least member.

    A graph over LOCAL_EDGES is parted into what hangs together at all, which is cheap over hashes of the nodes (two parts
    that meet by a hash are solved as one). Parts of up to LOCAL_EDGES edges are solved in tasks over arrays, larger ones
    in rounds."""
    edges = cut(edges.where("src <> dst").select("src", "dst").distinct())
    n = edges.count()
    if n <= max(0, local.LOCAL_EDGES):
        return _scc_locally(edges)
    parts = weak_components(edges.select(F.xxhash64("src").alias("u"), F.xxhash64("dst").alias("v")))
    edges = cut(edges.withColumn("node", F.xxhash64("src")).join(parts, "node").select("src", "dst", "component"))
    large = F.broadcast(edges.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > local.LOCAL_EDGES).select("component").limit(n // max(1, local.LOCAL_EDGES)))
    found = _scc_of_parts(edges.join(large, "component", "left_anti"), n)
    rest = cut(edges.join(large, "component", "left_semi").select("src", "dst"))
    return found if rest.isEmpty() else found.unionByName(_scc_in_rounds(rest))


def _scc_of_parts(edges: DataFrame, n: int) -> DataFrame:
    """Components of edges (src, dst, component) whose parts are whole and small: a task takes parts one after the other, as many at once as fit."""
    spark = edges.sparkSession
    prepare(spark)
    kind = edges.schema["src"].dataType.simpleString()
    most = max(1, local.LOCAL_EDGES // 4)

    def run(frames):
        held, size = [], 0
        for f in frames:
            while len(f):
                if size + len(f) < most:
                    held.append(f)
                    size += len(f)
                    break
                part = f["component"].to_numpy()
                last = held[-1]["component"].iloc[-1] if held else part[0]
                ends = np.flatnonzero(np.append(part[1:] != part[:-1], False)) + 1  # where another part begins
                starts = ends if part[0] == last else np.append(0, ends)
                starts = starts[starts + size >= most] if len(starts) else starts
                if not len(starts):
                    held.append(f)
                    size += len(f)
                    break
                held.append(f.iloc[: starts[0]])
                yield from _components(pd.concat(held))
                f, held, size = f.iloc[starts[0] :], [], 0
        if size:
            yield from _components(pd.concat(held))

    dealt = edges.repartition(max(2 * spark.sparkContext.defaultParallelism, 1 + n // most), "component").sortWithinPartitions("component")
    return cut(dealt.mapInPandas(run, f"node {kind}, component {kind}"))


def _scc_in_rounds(edges: DataFrame) -> DataFrame:
    """Nodes without edges in both directions are trimmed; then every node takes the least node that reaches it as its
    colour, and a node belongs to its colour's component if it also reaches that node within the colour."""
    found = edges.limit(0).select(F.col("src").alias("node"), F.col("src").alias("component"))
    while True:
        while True:
            n = edges.count()
            if n <= local.LOCAL_EDGES:  # what is left of a larger graph, or a small one
                return _of_two(found).unionByName(_scc_locally(edges))
            edges = cut(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
            if edges.count() == n:
                break
        if not n:
            return _of_two(found)
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        forward = _spread(nodes.withColumn("label", F.col("node")), edges, ("src", "dst"), False)
        # backward from each colour's own node: label '0' spreads against the edges
        start = forward.select("node", F.col("label").alias("colour"), F.when(F.col("node") == F.col("label"), "0").otherwise("1").alias("label"))
        back = _spread(start, edges, ("dst", "src"), True)
        done = cut(back.where("label = '0'").select("node", F.col("colour").alias("component")))
        found = cut(found.unionByName(done))
        gone = done.select("node")
        edges = cut(edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
        if edges.isEmpty():
            return _of_two(found)


def _of_two(found: DataFrame) -> DataFrame:
    """Without the nodes that a round found to be components of their own."""
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(sizes.select("component"), "component", "left_semi").select("node", "component")


def _components(f: pd.DataFrame):
    g = local.Csr(f.src, f.dst)
    comp = local.strong_components(g)
    own = np.bincount(comp, minlength=g.n)[comp] > 1 if g.n else np.zeros(0, bool)
    yield pd.DataFrame({"node": g.names[np.flatnonzero(own)], "component": g.names[comp[own]]})


def _scc_locally(edges: DataFrame) -> DataFrame:
    prepare(edges.sparkSession)
    kind = edges.schema["src"].dataType.simpleString()
    return cut(local.in_one_task(edges, _components, f"node {kind}, component {kind}"))


def label_propagation(labels: DataFrame, links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, label) after synchronous rounds: each node takes its neighbours' commonest label, the least of ties.

    links (src, dst) are followed both ways and counted as often as they occur; a node without links keeps its label."""
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = cut(both.groupBy("src", "dst").agg(F.count("*").alias("w")))
    labels = cut(labels.select("node", "label"))
    if both.count() <= local.LOCAL_EDGES and labels.count() <= local.LOCAL_EDGES:
        return _labels_locally(labels, both, rounds)
    best = Window.partitionBy("node").orderBy(F.desc("n"), "l")
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("dst"), F.col("label").alias("l")), "dst").groupBy(F.col("src").alias("node"), "l").agg(F.sum("w").alias("n"))
        won = votes.withColumn("r", F.row_number().over(best)).where("r = 1").select("node", "l")
        now = cut(labels.join(won, "node", "left").select("node", F.coalesce("l", "label").alias("label"), (F.coalesce("l", "label") != F.col("label")).alias("moved")))
        labels = now.drop("moved")
        if now.where("moved").isEmpty():
            break
    return labels


def _labels_locally(labels: DataFrame, both: DataFrame, rounds: int) -> DataFrame:
    prepare(labels.sparkSession)
    rows = both.select("src", F.col("dst").alias("to"), F.col("w").alias("w")).unionByName(labels.select(F.col("node").alias("src"), F.col("label").alias("to"), F.lit(None).cast("long").alias("w")))

    def solve(f: pd.DataFrame):
        own = f.w.isna().to_numpy()
        nodes = f.src[own].to_numpy(object)
        label, names = pd.factorize(f.to[own], sort=True)
        place = pd.Index(nodes)
        src, dst = place.get_indexer(f.src[~own]), place.get_indexer(f.to[~own])
        live = (src >= 0) & (dst >= 0)
        got = local.propagate(src[live].astype(np.int64), dst[live].astype(np.int64), f.w[~own].to_numpy(float)[live], label.astype(np.int64), rounds) if len(nodes) else label
        yield pd.DataFrame({"node": nodes, "label": np.asarray(names, object)[got]})

    return cut(local.in_one_task(rows, solve, f"node {labels.schema['node'].dataType.simpleString()}, label {labels.schema['label'].dataType.simpleString()}"))


def simple_paths(entries: DataFrame, targets: DataFrame, edges: DataFrame, max_depth: int, max_paths: int, ready: bool = False) -> DataFrame:
    """(hops, depth): up to max_paths simple paths from entries to targets, shortest first, then by their hops.

    A path stops at its first target; expansion stops once the paths wanted are complete, as later ones are longer.
    Only nodes from which a target is within the hops left are stepped on; few entries first leave only what they reach.
    ready: edges are distinct and cut already."""
    edges = edges if ready else cut(edges.select("src", "dst").distinct())
    starts = cut(entries.select("node").distinct())
    if starts.count() <= SMALL:
        reach = bfs(starts, edges, max_depth, ready=True).select("node")
        reach = _sent(reach, reach.count())
        edges = cut(edges.join(reach.withColumnRenamed("node", "src"), "src", "left_semi"))
        targets = cut(targets.join(reach, "node", "left_semi"))
    left = bfs(targets, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), max_depth, ready=True).select(F.col("node").alias("dst"), F.col("depth").alias("left"))
    edges = cut(edges.join(left, "dst"))
    marks = targets.select(F.col("node").alias("dst"), F.lit(True).alias("hit")).distinct()
    frontier = entries.select(F.array("node").alias("hops"), F.col("node").alias("at"))
    frontier = cut(frontier.join(targets.select(F.col("node").alias("at")), "at", "left_anti"))
    found = frontier.limit(0).select("hops", F.lit(0).alias("depth"))
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, F.col("at") == F.col("src")).where(~F.expr("array_contains(hops, dst)") & (F.col("left") <= max_depth - depth))
        step = cut(step.join(marks, "dst", "left").select(F.concat("hops", F.array("dst")).alias("hops"), F.col("dst").alias("at"), F.coalesce("hit", F.lit(False)).alias("hit")))
        found = cut(found.unionByName(step.where("hit").select("hops", F.lit(depth).alias("depth"))).orderBy("depth", "hops").limit(max_paths))
        frontier = step.where("NOT hit").select("hops", "at")
        if frontier.isEmpty() or found.count() >= max_paths:
            break
    return found
