import numpy as np

from quarrylens.llm import covertree


def brute(rows, cos=0.93):
    ok = [i for i, (d, v, g) in enumerate(rows) if d is not None and g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, root = {i: 0 for i in range(len(rows))}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= cos:
                    n[a] += 1
                    n[b] += 1
                    root[find(a)] = find(b)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, _, _) in enumerate(rows):
        c = least.get(find(i)) if d is not None else None
        out.append((d, n[i], c, True if d is None else d == c))
    return sorted(out, key=str)


def data():
    rng = np.random.default_rng(5)
    rows = []
    centres = rng.normal(size=(12, 16))
    for i in range(500):
        v = centres[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.2, 0.35])
        rows.append((i, [float(np.float32(x)) for x in v], 0 if i % 3 else i % 4))
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(60)]
    rows += [(2000, [2 * x for x in rows[3][1]], rows[3][2]), (2001, None, 0), (2002, [0.0] * 16, 0), (2003, [], 0), (2004, [float("nan")] * 16, 0), (2005, [1.0, None], 0), (2006, rows[3][1], None), (None, rows[3][1], 0), (2007, [1.0, 1.0], 0), (2008, [1.0, 1.01], 0)]
    return rows


def test_against_all_pairs(spark, monkeypatch):
    rows = data()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS x", "3 AS rep", "4 AS n").repartition(3)
    want = brute(rows)
    take = lambda: sorted([tuple(r) for r in covertree.op8(df).select("vec_id", "n_links", "component_id", "kept").collect()], key=str)
    assert take() == want
    assert covertree.op8(df.limit(0)).count() == 0
    monkeypatch.setattr(covertree, "BLOCK", 40)
    monkeypatch.setattr(covertree, "PIVOTS", 9)
    monkeypatch.setattr(covertree, "FRONTIER", 50)
    assert take() == want


def test_levels_cover_their_points():
    rng = np.random.default_rng(2)
    x = covertree._unit(np.concatenate([rng.normal(size=(200, 5)), rng.normal(size=(1, 5)).repeat(5, axis=0)]))
    t = covertree.CoverTree(x)
    assert sorted(t.order.tolist()) == list(range(205))
    for i in range(len(t.point)):
        own = t.order[t.lo[i] : t.hi[i]]
        assert t.point[i] in own and np.sqrt(((x[own] - x[t.point[i]]) ** 2).sum(axis=1)).max() <= t.radius[i] + 1e-12
        kids = t.kids[t.kid_at[i] : t.kid_at[i] + t.kid_n[i]]
        if len(kids):
            assert t.point[i] in t.point[kids] and (t.radius[kids] <= t.radius[i] / 2 + 1e-12).all()
            assert sum(t.hi[k] - t.lo[k] for k in kids) == len(own)
