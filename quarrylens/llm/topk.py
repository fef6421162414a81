"""Exact top-k inner products: a ball tree per shard, searched by branch and bound, k-th scores shared between shards.

PILOT rows of least hash give up to CELLS centres; each row joins its nearest, so a cell is a ball of known radius, and
cells of over SHARD_ROWS rows are split into shards at random (a vector or id that repeats is spread likewise). What is
broadcast is one entry a cell, whatever the table's size. The search has two waves. First each query goes to one shard of
the cell with the largest bound q.c + |q| r; the k-th score it finds there, or against the pilot if that is larger, goes
with it into the second: all other shards whose cells' bounds reach it. Shards that no bound reaches are never met.

In a shard, equal vectors keep the rows of least ids that can be among the k best of some query (k rows besides
those of any one id), the rest make a ball tree. Queries go down together, in blocks: nodes wait in a heap by their
largest bound, a popped node keeps the queries whose bound still reaches their current k-th score (ties: whose least id
could win), leaves are scored by one matrix product and raise the k-th scores that all later nodes are held against.
The k best of each shard are then merged by query.

Components are integers floor(scale * x); scores are exact: double products below 2**53; beyond, doubles with an error
bound choose the rows that Python integers decide between.

Defined cases: vectors that are null, empty or hold null, NaN or infinite components take no part; vectors of
different lengths are not compared; rows without an id take no part; a query's own id is no candidate, whichever
row holds it; repeated rows of one query id count as one query (the least vector), repeated candidate rows are
candidates each; scores outside a long's range count as its nearest end; fewer than k candidates give fewer rows; an
empty table gives none."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare

LEAF = 64
CELL_ROWS = 16_384
CELLS = 512
SHARD_ROWS = 50_000
BLOCK_QUERIES = 20_000
PILOT = 1_024
EXACT = 2.0**52
LONG = 2**63 - 1


class BallTree:
    """Nodes over the rows of x (double, n x d): centre, radius, least id and children or rows."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.centre, self.span, self.radius, self.least, self.left, self.right, self.rows = [], [], [], [], [], [], []
        stack = [(np.arange(len(x)), -1, False)]
        while stack:
            own, parent, right = stack.pop()
            node = len(self.left)
            if parent >= 0:
                (self.right if right else self.left)[parent] = node
            part = x[own]
            c = part.mean(axis=0)
            far = np.sqrt(((part - c) ** 2).sum(axis=1))
            self.centre.append(c)
            self.span.append(float(np.sqrt(c @ c)))
            self.radius.append(float(far.max()))
            self.least.append(int(ids[own].min()))
            self.left.append(-1)
            self.right.append(-1)
            self.rows.append(None)
            if len(own) <= LEAF or far.max() == 0:
                self.rows[node] = own
                continue
            a = part[far.argmax()]
            b = part[((part - a) ** 2).sum(axis=1).argmax()]
            side = part @ (b - a)
            half = np.argsort(side, kind="stable")
            cut = int(np.searchsorted(side[half], (side[half[0]] + side[half[-1]]) / 2))
            cut = min(max(cut, len(own) // 8, 1), len(own) - max(len(own) // 8, 1))  # keeps the depth logarithmic
            stack += [(own[half[:cut]], node, False), (own[half[cut:]], node, True)]


def upper_bound(product, norm, span, radius):
    """No row of a ball scores over this: q.c + |q| r, and what doubles may have lost of it."""
    return product + norm * radius + 1e-12 * norm * (span + radius) + 1e-6


def _merge(scores, ids, new_scores, new_ids, k):
    """Row-wise k best of (scores, ids) and new columns, by score, then by the smaller id."""
    s = np.concatenate([scores, new_scores], axis=1)
    i = np.concatenate([ids, np.broadcast_to(new_ids, (len(s), len(new_ids)))], axis=1)
    if s.shape[1] > 4 * k:  # a coarse cut first: everything at or over the k-th score
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, [-k]]
        width = int((s >= kth).sum(axis=1).max())
        if width < s.shape[1]:
            pick = np.argsort(-(s >= kth).astype(np.int8), axis=1, kind="stable")[:, :width]
            s, i = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
    order = np.lexsort((i, -s), axis=-1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


NONE = np.iinfo(np.int64).max


def search(tree: BallTree, q: np.ndarray, q_ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (m, k) of the best rows of the tree; -inf where there are fewer. floor: known k-th scores."""
    m = len(q)
    scores, ids = np.full((m, k), -np.inf), np.full((m, k), NONE)
    norm = np.sqrt((q * q).sum(axis=1))

    def bound(node: int, own: np.ndarray) -> np.ndarray:
        return upper_bound(q[own] @ tree.centre[node], norm[own], tree.span[node], tree.radius[node])

    def reach(node: int, own: np.ndarray, b: np.ndarray) -> np.ndarray:
        kth, most = scores[own, -1], np.floor(b)  # scores are integers
        return (most >= kth) & (most >= floor[own]) & ~((most == kth) & (tree.least[node] > ids[own, -1]))

    every = np.arange(m)
    heap = [(0.0, 0, every, bound(0, every))]
    while heap:
        _, node, own, b = heapq.heappop(heap)
        ok = reach(node, own, b)
        own, b = own[ok], b[ok]
        if not len(own):
            continue
        rows = tree.rows[node]
        if rows is not None:
            for i in range(0, len(rows), 4 * LEAF):
                part = rows[i : i + 4 * LEAF]
                got = q[own] @ tree.x[part].T
                got[q_ids[own][:, None] == tree.ids[part][None, :]] = -np.inf
                scores[own], ids[own] = _merge(scores[own], ids[own], got, tree.ids[part], k)
            continue
        for child in (tree.left[node], tree.right[node]):
            cb = bound(child, own)
            ok = reach(child, own, cb)
            if ok.any():
                heapq.heappush(heap, (-float(cb[ok].max()), child, own[ok], cb[ok]))
    ids[np.isneginf(scores)] = NONE
    return scores, ids


def least_ids(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows to keep: of equal vectors, those that are among the k least ids once the rows of any other id are left out."""
    order = np.lexsort((ids, *x.T[::-1]))
    s, i = x[order], ids[order]
    at = np.arange(len(order))
    new = np.append(True, (s[1:] != s[:-1]).any(axis=1))
    group = np.maximum.accumulate(np.where(new, at, 0))
    run = np.flatnonzero(new | np.append(True, i[1:] != i[:-1]))  # where the rows of one id and vector begin
    rows = np.diff(np.append(run, len(order)))
    # the most rows that one id before has in the group: group numbers lift the running maximum past earlier groups
    lift = np.cumsum(new)[run] * (len(order) + 1)
    most = np.append(0, np.maximum.accumulate(lift + rows)[:-1]) - lift
    before = np.repeat(np.maximum(most, 0), rows)
    return order[at - group - before < k]


def exact_large(x, ids, q, q_ids, k) -> list[tuple[int, int, int]]:
    """(query, id, score) where doubles are not exact: they choose the rows that could be among the k best, integers decide."""
    out = []
    lost = 2.0**-51 * x.shape[1]
    size = np.sqrt((x * x).sum(axis=1))
    for row, i in zip(q, q_ids.tolist()):
        other = ids != i
        got, err = x @ row, lost * size * np.sqrt(row @ row)
        low = np.where(other, got - err, -np.inf)
        kth = np.partition(low, len(low) - k)[-k] if len(low) > k else -np.inf
        kth = min(kth, 2.0**63) if kth > -(2.0**63) else -np.inf  # beyond a long's range all are equal
        w = [int(v) for v in row]
        some = np.flatnonzero(other & (got + err >= kth))
        exact = ((max(-LONG - 1, min(LONG, sum(a * int(b) for a, b in zip(w, x[r])))), int(ids[r])) for r in some.tolist())
        out += [(i, j, -s) for s, j in heapq.nsmallest(k, ((-s, j) for s, j in exact))]
    return out


def valid_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x array<double>) of the vectors that take part."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return table.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & fine)


class Cells:
    """The centres by vector length: (numbers, centres, their norms), and all pilot rows by length: (ids, vectors)."""

    def __init__(self, pilot: list[tuple[int, list[float]]], count: int):
        lengths = {len(v) for _, v in pilot}
        self.pilot = {d: (np.array([i for i, v in pilot if len(v) == d], np.int64), np.array([v for _, v in pilot if len(v) == d])) for d in lengths}
        self.of, self.count = {}, 0
        chosen = pilot[:count]
        for d in sorted({len(v) for _, v in chosen}):
            c = np.unique(np.array([v for _, v in chosen if len(v) == d]), axis=0)
            self.of[d] = (self.count + np.arange(len(c)), c, np.sqrt((c * c).sum(axis=1)))
            self.count += len(c)


LOST = -1  # the cell of lengths that no centre has: never pruned


def _by_length(batch: pa.RecordBatch):
    """Of the vectors x of a batch: (d, row numbers, matrix) for each length d."""
    x = batch.column(batch.schema.get_field_index("x"))
    off = x.offsets.to_numpy()
    flat, size = x.values.to_numpy(), np.diff(off)
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield d, at, flat[off[at][:, None] + np.arange(d)]


def _add(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns.values())], [*batch.schema.names, *columns])


def _assign(sent):
    """Adds each row's cell and its distance from the centre."""

    def run(batches):
        cells = sent.value
        for batch in batches:
            cell, far = np.full(batch.num_rows, LOST, np.int32), np.zeros(batch.num_rows)
            for d, at, x in _by_length(batch):
                if d in cells.of:
                    number, c, span = cells.of[d]
                    near = (span * span - 2 * (x @ c.T)).argmin(axis=1)
                    cell[at], far[at] = number[near], np.sqrt(((x - c[near]) ** 2).sum(axis=1))
            yield _add(batch, cell=cell, far=far)

    return run


def _route(sent, radius: dict[int, float], k: int):
    """Adds each query's k-th score against the pilot, the cell of its largest bound, and with a floor given all cells that reach it."""

    def run(batches):
        cells = sent.value
        for batch in batches:
            n = batch.num_rows
            known = "floor" in batch.schema.names
            floor = batch.column("floor").to_numpy().copy() if known else np.full(n, -np.inf)
            first, reached = np.full(n, LOST, np.int32), [[LOST] if LOST in radius else []] * n
            ids = batch.column("id").to_numpy()
            for d, at, q in _by_length(batch):
                norm = np.sqrt((q * q).sum(axis=1))
                if not known and d in cells.pilot:
                    p_ids, p = cells.pilot[d]
                    got = q @ p.T
                    got[ids[at][:, None] == p_ids[None, :]] = -np.inf
                    if len(p_ids) > k:
                        kth = np.partition(got, len(p_ids) - k, axis=1)[:, -k]
                        floor[at] = kth - 1e-12 * norm * np.sqrt((p * p).sum(axis=1).max())
                if d in cells.of:
                    number, c, span = cells.of[d]
                    held = np.array([m in radius for m in number.tolist()])
                    if not held.any():
                        continue
                    number, c, span = number[held], c[held], span[held]
                    b = upper_bound(q @ c.T, norm[:, None], span, np.array([radius[m] for m in number.tolist()]))
                    first[at] = number[b.argmax(axis=1)]
                    if known:
                        for r, ok in zip(at.tolist(), np.floor(b) >= floor[at][:, None]):
                            reached[r] = number[ok].tolist()
            yield _add(batch, reached=pa.array(reached, pa.list_(pa.int32()))) if known else _add(batch, floor=floor, cell=first)

    return run


def _search_group(k: int):
    def task(frame: pd.DataFrame) -> pd.DataFrame:
        is_q = frame.floor.notna().to_numpy()
        none = pd.DataFrame({"query_id": [], "id": [], "score": []})
        if is_q.all() or not is_q.any():
            return none
        x = np.stack(frame.x.to_numpy())
        ids, floor = frame.id.to_numpy(), frame.floor.to_numpy()[is_q]
        q, q_ids, x, ids = x[is_q], ids[is_q], x[~is_q], ids[~is_q]
        keep = least_ids(x, ids, k)
        x, ids = x[keep], ids[keep]
        if np.abs(x).max() * np.abs(q).max() * x.shape[1] >= EXACT:
            found = exact_large(x, ids, q, q_ids, k)
            return pd.DataFrame(found, columns=["query_id", "id", "score"]) if found else none
        scores, best = search(BallTree(x, ids), q, q_ids, k, floor)
        ok = (best != NONE) & (scores >= floor[:, None])
        return pd.DataFrame({"query_id": np.repeat(q_ids, ok.sum(axis=1)), "id": best[ok], "score": scores[ok].astype(np.int64)})

    return task


def _wave(rows: DataFrame, queries: DataFrame, parts: dict[int, int], asked: dict[int, int], k: int) -> DataFrame:
    """Search queries (id, x, floor, cell, part) in their shards; asked: how many there are for a shard of each cell."""
    spark = rows.sparkSession
    # one entry a cell, CELLS at most
    plan = F.broadcast(spark.createDataFrame([(c, parts[c], -(-n // BLOCK_QUERIES)) for c, n in asked.items()], "cell int, parts int, blocks int"))
    left = rows.join(plan, "cell").select("cell", F.pmod("u", "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "x", F.lit(None).cast("double").alias("floor"))
    right = queries.join(plan, "cell").select("cell", "part", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int").alias("block"), "id", "x", "floor")
    return left.unionByName(right).groupBy(F.size("x").alias("d"), "cell", "part", "block").applyInPandas(_search_group(k), "query_id long, id long, score long")


def top_k(table: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): each query's k best rows. is_query: a condition on `id`."""
    spark = table.sparkSession
    prepare(spark)
    rows = valid_vectors(table, id_col, vec_col).select("id", F.transform("x", lambda v: F.floor(v * scale).cast("double")).alias("x"))
    pilot = rows.orderBy(F.xxhash64("id", "x"), "id").limit(PILOT).collect()  # at most that many rows
    cells = Cells([(r.id, r.x) for r in pilot], min(CELLS, max(1, -(-table.count() // CELL_ROWS))))
    sent = spark.sparkContext.broadcast(cells)
    dealt = rows.mapInArrow(_assign(sent), "id long, x array<double>, cell int, far double")
    rows = materialize(dealt.withColumn("u", F.xxhash64(F.monotonically_increasing_id())), "topk-rows")
    held = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row a cell
    parts = {r.cell: -(-r.n // SHARD_ROWS) for r in held}
    radius = {r.cell: r.far for r in held}

    queries = rows.where(is_query).groupBy("id").agg(F.min("x").alias("x"))
    queries = queries.mapInArrow(_route(sent, radius, k), "id long, x array<double>, floor double, cell int")
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.element_at(F.create_map(*[F.lit(v) for c in (parts or {LOST: 1}).items() for v in c]), F.col("cell"))).cast("int")
    queries = materialize(queries.withColumn("part", F.coalesce(part, F.lit(0))), "topk-queries")
    # cells that hold no rows of the table have no shard; a query of an unknown length goes to LOST
    asked = {r.cell: r.n for r in queries.groupBy("cell", "part").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max("n").alias("n")).collect()}
    found = materialize(_wave(rows, queries, parts, {c: n for c, n in asked.items() if c in parts}, k), "topk-first")
    if sum(parts.values()) > 1:
        kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("kth")).where(F.col("n") == k)
        kth = kth.select(F.col("query_id").alias("id"), F.expr("CASE WHEN kth > -9e18 THEN kth - abs(kth) * 1e-12 END").alias("kth"))  # a double may round it up
        raised = queries.join(kth, "id", "left").select("id", "x", F.greatest("floor", "kth").alias("floor"), F.col("cell").alias("own"), F.col("part").alias("met"))
        raised = materialize(raised.mapInArrow(_route(sent, radius, k), "id long, x array<double>, floor double, own int, met int, reached array<int>"), "topk-raised")
        asked = {r.cell: r.n for r in raised.select(F.explode("reached").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
        every = F.broadcast(spark.createDataFrame(list(parts.items()), "cell int, shards int"))
        again = raised.withColumn("cell", F.explode("reached")).join(every, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        again = again.where(~((F.col("cell") == F.col("own")) & (F.col("part") == F.col("met")))).select("id", "x", "floor", "cell", "part")
        if asked:
            found = found.unionByName(_wave(rows, again, parts, asked, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op7(table: DataFrame) -> DataFrame:
    return top_k(table, F.col("id") % 50 == 0).withColumnRenamed("id", "vec_id")


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
