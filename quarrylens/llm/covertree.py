"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Equal vectors of a label become one class by a partial aggregate. Classes of a label are put into cells around
pivots (at most PIVOTS in all, by least hash) and cells are cut into blocks of about BLOCK rows; the pairs of cells
whose centres are within both radii and the threshold make the tasks. In a task, each block gets a cover tree: levels
with halving radii, each node's point being its own child below. Node pairs are pruned when their centres are
farther apart than the threshold and both covering radii, counted whole when even the farthest points are within it,
and else opened; single points are compared by their cosine in double precision.

A task returns no pairs: it returns the number of vectors each class links to, and for each class the least one that
links of the task lead to. Counts are summed by class, the latter joined into components.

Defined cases: null, zero, empty or non-finite vectors and rows without a label or id link with nothing (n_links 0,
a component of their own); vectors of different lengths do not link; repeated rows are vectors of their own and link
with each other; an empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, prepare
from .components import components

PIVOTS = 2_048
BLOCK = 4_096
FRONTIER = 40_000
BATCH = 64
DENSE = 4_096
ROWS = 512
SLACK = 1e-9
DEALT = 20_000


class CoverTree:
    """A cover tree over unit vectors: nodes with a point, a covering radius, a range of `order` and children."""

    def __init__(self, x: np.ndarray):
        self.x = x
        point, radius, lo, hi, first, last = [], [], [], [], [], []
        order: list[np.ndarray] = []
        kids: list[list[int]] = []
        self.point, self.radius, self.lo, self.hi = point, radius, lo, hi

        def add(p: int, own: np.ndarray, at: int) -> int:
            point.append(p)
            radius.append(float(np.sqrt(((x[own] - x[p]) ** 2).sum(axis=1).max())) if len(own) > 1 else 0.0)
            lo.append(at)
            hi.append(at + len(own))
            kids.append([])
            return len(point) - 1

        perm = np.arange(len(x))
        root = add(0, perm, 0)
        stack = [root]
        while stack:
            node = stack.pop()
            if hi[node] - lo[node] == 1:
                continue
            own = perm[lo[node] : hi[node]].copy()
            if radius[node] == 0.0:  # equal points: one level of leaves
                groups = [(int(p), np.array([p])) for p in own]
            else:
                groups = _cover(x, np.concatenate([[point[node]], own[own != point[node]]]), radius[node] / 2)
            at = lo[node]
            for p, part in groups:
                perm[at : at + len(part)] = part
                kid = add(p, part, at)
                kids[node].append(kid)
                stack.append(kid)
                at += len(part)
        self.order = perm
        sizes = np.array([len(k) for k in kids], np.int64)
        self.kid_at = np.cumsum(sizes) - sizes
        self.kid_n = sizes
        self.kids = np.array([k for own in kids for k in own], np.int64)
        self.point, self.radius = np.array(point, np.int64), np.array(radius)
        self.lo, self.hi = np.array(lo, np.int64), np.array(hi, np.int64)


def _cover(x: np.ndarray, own: np.ndarray, half: float) -> list[tuple[int, np.ndarray]]:
    """Centres farther apart than half, the first of own among them, each with the points within half that it takes.

    Candidates come in batches, so that distances are matrix products."""
    groups: list[tuple[int, np.ndarray]] = []
    left = own
    while len(left):
        few = left[:BATCH]
        close = 2 - 2 * (x[left] @ x[few].T) <= half * half
        centre: list[int] = []
        shut = np.zeros(len(few), bool)
        for i in range(len(few)):
            if not shut[i]:
                centre.append(i)
                shut |= close[: len(few), i]
        near = close[:, centre]
        near[centre, range(len(centre))] = True
        taken = near.any(axis=1)
        first = near.argmax(axis=1)
        first[centre] = range(len(centre))
        own, first = left[taken], first[taken]
        order = np.argsort(first, kind="stable")
        edge = np.searchsorted(first[order], range(len(centre) + 1))
        own = own[order]
        groups += [(int(few[i]), own[edge[c] : edge[c + 1]]) for c, i in enumerate(centre)]
        left = left[~taken]
    return groups


def _open(tree: CoverTree, nodes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node's children, beside its partner."""
    n = tree.kid_n[nodes]
    at = np.repeat(tree.kid_at[nodes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return tree.kids[at], np.repeat(others, n)


def _open_both(a: CoverTree, p: int, b: CoverTree, q: int, t: float, same: bool):
    """Pairs of the children of two nodes that may hold links: all their centres' distances by matrix products."""
    kids_p = a.kids[a.kid_at[p] : a.kid_at[p] + a.kid_n[p]] if a.kid_n[p] else np.array([p])
    kids_q = b.kids[b.kid_at[q] : b.kid_at[q] + b.kid_n[q]] if b.kid_n[q] else np.array([q])
    y = b.x[b.point[kids_q]]
    for i in range(0, len(kids_p), ROWS):
        own = kids_p[i : i + ROWS]
        reach = t + a.radius[own][:, None] + b.radius[kids_q][None, :] + SLACK
        live = 2 - 2 * (a.x[a.point[own]] @ y.T) <= reach * reach + SLACK
        if same:  # one of each two mirrored pairs
            live &= a.lo[own][:, None] <= b.lo[kids_q][None, :]
        r, s = np.nonzero(live)
        for k in range(0, len(r), FRONTIER):
            yield own[r[k : k + FRONTIER]], kids_q[s[k : k + FRONTIER]]


class Forest:
    """Components of numbered points: every point knows the least point of its own."""

    def __init__(self, n: int):
        self.least = np.arange(n)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        """Add links; those within a component cost one look-up."""
        while True:
            a, b = self.least[u], self.least[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.least, np.maximum(a, b), np.minimum(a, b))
            while ((up := self.least[self.least]) != self.least).any():
                self.least = up

    def edges(self) -> np.ndarray:
        """(point, least of its component) of the points that are not the least themselves."""
        own = np.flatnonzero(self.least != np.arange(len(self.least)))
        return np.column_stack([own, self.least[own]])


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number of the ranges lo to hi - 1: which range it is of, and itself."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)


def dual(a: CoverTree, b: CoverTree, cos: float, count_a: np.ndarray, count_b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked vectors of each point of a, and of b, and pairs that hold the same components together as the links (points of b numbered after those of a).

    same: both are one tree; its points do not link to themselves, and only the first counts are meant."""
    t = float(np.sqrt(max(0.0, 2 - 2 * cos)))
    na, nb = len(a.x), len(b.x)
    got_a, got_b = np.zeros(na + 1), np.zeros(nb + 1)  # differences along the trees' orders
    sum_a = np.concatenate([[0], np.cumsum(count_a[a.order])])
    sum_b = np.concatenate([[0], np.cumsum(count_b[b.order])])
    forest = Forest(na if same else na + nb)
    shift = 0 if same else na
    stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        p, q = stack.pop()
        if len(p) > FRONTIER:
            stack += [(p[:FRONTIER], q[:FRONTIER]), (p[FRONTIER:], q[FRONTIER:])]
            p, q = stack.pop()
        if same:
            keep = a.lo[p] <= b.lo[q]  # one of each two mirrored pairs
            inside = (a.lo[q] >= a.lo[p]) & (a.hi[q] <= a.hi[p]) | (a.lo[p] >= a.lo[q]) & (a.hi[p] <= a.hi[q])
            keep |= inside
            p, q = p[keep], q[keep]
        x, y = a.x[a.point[p]], b.x[b.point[q]]
        d = np.sqrt(np.maximum(0, ((x - y) ** 2).sum(axis=1)))
        reach = a.radius[p] + b.radius[q]
        live = d <= t + reach + SLACK
        whole = d + reach < t - SLACK
        single = (a.hi[p] - a.lo[p] == 1) & (b.hi[q] - b.lo[q] == 1)
        if same:
            overlap = (a.lo[q] < a.hi[p]) & (a.lo[p] < a.hi[q])
            whole &= ~overlap | (single & (p == q))
        near = live & single & ~whole
        if near.any():
            i = np.flatnonzero(near)
            c = (x[i] * y[i]).sum(axis=1)
            whole[i[c >= cos]] = True
        if same:
            whole &= ~(single & (a.point[p] == b.point[q]))
        hit = np.flatnonzero(whole)
        if len(hit):
            pl, ph, ql, qh = a.lo[p[hit]], a.hi[p[hit]], b.lo[q[hit]], b.hi[q[hit]]
            w = sum_b[qh] - sum_b[ql]
            np.add.at(got_a, pl, w)
            np.add.at(got_a, ph, -w)
            w = sum_a[ph] - sum_a[pl]
            to = got_a if same else got_b
            np.add.at(to, ql, w)
            np.add.at(to, qh, -w)
            which, at = _ranges(ql, qh)  # the first point of p with all of q, all of p with the first of q
            forest.join(a.order[pl[which]], shift + b.order[at])
            which, at = _ranges(pl, ph)
            forest.join(a.order[at], shift + b.order[ql[which]])
        rest = np.flatnonzero(live & ~whole & ~single)
        if len(rest):
            p, q = p[rest], q[rest]
            many = np.maximum(a.kid_n[p], 1) * np.maximum(b.kid_n[q], 1) >= DENSE
            for r, s in zip(p[many].tolist(), q[many].tolist()):
                stack += list(_open_both(a, r, b, s, t, same and r == s))
            p, q = p[~many], q[~many]
            wide = (a.radius[p] >= b.radius[q]) & (a.kid_n[p] > 0) | (b.kid_n[q] == 0)
            if same:
                # an equal pair opens into the pairs of its children
                both = p == q
                one, two = _open(a, p[both], p[both])
                one, two = _open(b, two, one)[::-1] if len(one) else (one, two)
                if len(one):
                    stack.append((one, two))
                p, q, wide = p[~both], q[~both], wide[~both]
            kid, other = _open(a, p[wide], q[wide])
            if len(kid):
                stack.append((kid, other))
            kid, other = _open(b, q[~wide], p[~wide])
            if len(kid):
                stack.append((other, kid))
    out_a, out_b = np.zeros(na), np.zeros(nb)
    out_a[a.order] = np.cumsum(got_a)[:na]
    out_b[b.order] = np.cumsum(got_b)[:nb]
    return out_a.round().astype(np.int64), out_b.round().astype(np.int64), forest.edges()


def _classes(table: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, x): the rows that can link."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), x.alias("x"))
    # -0.0 and 0.0 are one value
    return rows.where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(fine).withColumn("x", F.transform("x", lambda v: v + 0.0))


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def links(table: DataFrame, cos: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: id, label, x), (classes: label, x, rep, links) and (edges u, v between reps)."""
    spark = table.sparkSession
    prepare(spark)
    rows = _classes(table, id_col, vec_col, label_col)
    classes = materialize(rows.groupBy("label", "x").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vectors")
    classes = classes.withColumn("d", F.size("x"))
    sizes = {(r.label, r.d): r.n for r in classes.groupBy("label", "d").agg(F.count("*").alias("n")).orderBy(F.desc("n")).collect()}
    total = sum(sizes.values())
    # cells of a label in proportion to its rows; a label of one cell needs no pivot
    cells = {k: max(1, min(-(-n // BLOCK), PIVOTS * n // max(1, total))) for k, n in sizes.items()}
    many = {k: c for k, c in cells.items() if c > 1}
    pivots: dict[tuple[str, int], np.ndarray] = {}
    if many:
        want = F.create_map(*[v for (label, d), c in many.items() for v in (F.lit(f"{d}:{label}"), F.lit(min(1.0, 3.0 * (c + 20) / sizes[label, d])))])
        share = want[F.concat_ws(":", "d", "label")]
        some = classes.where((F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) / float(1 << 20)) < share).orderBy(F.xxhash64("rep"), "rep").limit(4 * (PIVOTS + 20 * len(many))).select("label", "d", "x").collect()
        for k, c in many.items():
            own = [r.x for r in some if (r.label, r.d) == k][:c]
            if len(own) > 1:
                pivots[k] = _unit(np.array(own))
    sent = spark.sparkContext.broadcast(pivots)

    @F.pandas_udf("struct<cell: int, far: double>")
    def place(label: pd.Series, d: pd.Series, x: pd.Series) -> pd.DataFrame:
        cell, far = np.zeros(len(label), np.int32), np.full(len(label), 2.0)
        for k, at in pd.DataFrame({"l": label, "d": d}).groupby(["l", "d"], sort=False).indices.items():
            p = sent.value.get((k[0], int(k[1])))
            if p is not None:
                u = _unit(np.stack(x.iloc[at].to_numpy()))
                dot = u @ p.T
                cell[at] = dot.argmax(axis=1)
                far[at] = np.sqrt(np.maximum(0, ((u - p[cell[at]]) ** 2).sum(axis=1)))
        return pd.DataFrame({"cell": cell, "far": far})

    placed = classes.withColumn("p", place("label", "d", "x")).select("label", "d", "x", "rep", "n", "p.cell", "p.far")
    stats = {(r.label, r.d, r.cell): (r.n, r.far) for r in placed.groupBy("label", "d", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    t = float(np.sqrt(max(0.0, 2 - 2 * cos)))
    blocks = {k: -(-n // BLOCK) for k, (n, _) in stats.items()}
    # a row of cell c goes to (c, own block) x (o, every block of o), c <= o, and the other way round
    route: dict[tuple[str, int, int], list[tuple[int, int]]] = {k: [] for k in stats}
    for (label, d) in sizes:
        own = sorted(k[2] for k in stats if k[0] == label and k[1] == d)
        p = pivots.get((label, d))
        for i in own:
            for j in own:
                apart = 0.0 if p is None or i == j else float(np.sqrt(max(0.0, ((p[i] - p[j]) ** 2).sum())))
                if apart <= t + stats[label, d, i][1] + stats[label, d, j][1] + SLACK:
                    route[label, d, i].append((j, blocks[label, d, j]))
    sent_routes = spark.sparkContext.broadcast((route, blocks))

    def deal(frames):
        table, count = sent_routes.value
        targets = {k: np.array([(j, b) for j, n in own for b in range(n)], np.int64).reshape(-1, 2) for k, own in table.items()}
        for f in frames:
            for k, at in f.groupby(["label", "d", "cell"], sort=False).indices.items():
                k = (k[0], int(k[1]), int(k[2]))
                to = targets[k]
                own = (mix64(f.rep.to_numpy()[at].astype(np.int64).view(np.uint64)) % np.uint64(count[k])).astype(np.int64)
                for i in range(0, len(at), max(1, DEALT // max(1, len(to)))):
                    rows, mine = at[i : i + max(1, DEALT // max(1, len(to)))], own[i : i + max(1, DEALT // max(1, len(to)))]
                    r, t = np.repeat(np.arange(len(rows)), len(to)), np.tile(np.arange(len(to)), len(rows))
                    c, b, j, o = k[2], mine[r], to[t, 0], to[t, 1]
                    first = (c < j) | (c == j) & (b <= o)  # the lower of two blocks comes first
                    g = f.iloc[rows[r]][["label", "d", "x", "rep", "n"]].reset_index(drop=True)
                    g["c1"], g["b1"] = np.where(first, c, j), np.where(first, b, o)
                    g["c2"], g["b2"] = np.where(first, j, c), np.where(first, o, b)
                    g["second"] = ~first
                    yield g

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame[~frame.second].sort_values("rep")
        second = frame[frame.second].sort_values("rep")
        row = frame.iloc[0]
        same = (row.c1, row.b1) == (row.c2, row.b2)
        none = pd.DataFrame({"rep": [], "links": [], "u": [], "v": []})
        if not len(first) or not same and not len(second):
            return none
        a = CoverTree(_unit(np.stack(first.x.to_numpy())))
        b = a if same else CoverTree(_unit(np.stack(second.x.to_numpy())))
        na, nb = first.n.to_numpy(), (first if same else second).n.to_numpy()
        got_a, got_b, edges = dual(a, b, cos, na, nb, same)
        reps = np.concatenate([first.rep.to_numpy(), second.rep.to_numpy()]) if not same else first.rep.to_numpy()
        got = got_a if same else np.concatenate([got_a, got_b])
        own = got > 0
        e = edges
        out = pd.DataFrame({"rep": pd.array(reps[own], "Int64"), "links": pd.array(got[own], "Int64"), "u": pd.array([pd.NA] * own.sum(), "Int64"), "v": pd.array([pd.NA] * own.sum(), "Int64")})
        forest = pd.DataFrame({"rep": pd.array([pd.NA] * len(e), "Int64"), "links": pd.array([pd.NA] * len(e), "Int64"), "u": pd.array(reps[e[:, 0]], "Int64"), "v": pd.array(reps[e[:, 1]], "Int64")})
        return pd.concat([out, forest], ignore_index=True)

    dealt = placed.select("label", "d", "x", "rep", "n", "cell").mapInPandas(deal, "label string, d int, x array<double>, rep long, n long, c1 int, b1 int, c2 int, b2 int, second boolean")
    found = materialize(dealt.groupBy("label", "d", "c1", "b1", "c2", "b2").applyInPandas(task, "rep long, links long, u long, v long"), "links")
    counts = found.where("rep IS NOT NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    classes = classes.join(counts, "rep", "left").select("label", "x", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    return rows, classes, found.where("u IS NOT NULL").select("u", "v")


def near_duplicates(table: DataFrame, cos: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component, kept) per row."""
    rows, classes, edges = links(table, cos, id_col, vec_col, label_col)
    comp = components(edges)
    classes = classes.join(comp, F.col("rep") == F.col("node"), "left").select("label", "x", "links", F.coalesce("component", "rep").alias("component"))
    classes = materialize(classes, "classes")
    linked = rows.join(classes, ["label", "x"]).select("id", F.col("links").alias("n_links"), "component")
    x = F.col(vec_col).cast("array<double>")
    bad = F.col(id_col).isNull() | F.col(label_col).isNull() | x.isNull() | ~F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    alone = table.where(bad).select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def op8(table: DataFrame) -> DataFrame:
    return near_duplicates(table).select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c ON e.vec_id = c.u LEFT JOIN n ON e.vec_id = n.u
"""
