import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quarrylens.llm import topk


def data():
    rng = np.random.default_rng(3)
    rows = []
    centres = rng.normal(size=(5, 8))
    for i in range(700):
        v = centres[i % 5] + rng.normal(size=8) * 0.05 if i % 3 else np.round(rng.normal(size=8), 1)
        rows.append((i, [float(np.float32(x)) for x in v], 0))
    rows += [(1000 + i, rows[10][1], 0) for i in range(90)]
    rows += [(2000, None, 0), (2050, [1.0, None] * 4, 0), (2100, [float("nan")] * 8, 0), (2150, [float("inf")] * 8, 0), (2200, [], 0), (2250, [1.0, 2.0], 0), (2251, [2.0, -1.0], 0), (None, [1.0] * 8, 0)]
    return rows


def test_against_sql(spark, monkeypatch):
    rows = data()
    schema = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS id", "2 AS x", "3 AS rank").repartition(3)
    sql = duckdb.connect()
    sql.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT)")
    sql.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [r for r in rows if r[0] is not None])
    want = sorted(sql.execute(topk.ORACLE).fetchall())
    take = lambda: sorted(tuple(r) for r in topk.op7(df).select("query_id", "rank", "vec_id", "score").collect())
    assert take() == want
    monkeypatch.setattr(topk, "SHARD_ROWS", 200)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(topk, "PILOT", 3)
    assert take() == want
    monkeypatch.setattr(topk, "PILOT", 40)  # many cells, whose shards the second wave prunes
    monkeypatch.setattr(topk, "CELL_ROWS", 30)
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    assert take() == want
    assert topk.op7(df.limit(0)).count() == 0


def test_tree_search_equals_all_products():
    rng = random.Random(1)
    gen = np.random.default_rng(rng.randrange(99))
    x = np.floor(256 * np.concatenate([gen.normal(size=(3, 6))[gen.integers(0, 3, 3000)] + gen.normal(size=(3000, 6)) * 0.02, gen.normal(size=(500, 6))]))
    ids = gen.permutation(len(x)).astype(np.int64)
    q, q_ids = x[:80], ids[:80]
    s, i = topk.search(topk.BallTree(x, ids), q, q_ids, 5, np.full(80, -np.inf))
    for a in range(80):
        best = sorted((-int(x[b] @ q[a]), int(ids[b])) for b in range(len(x)) if ids[b] != q_ids[a])[:5]
        assert [(-int(p), int(j)) for p, j in zip(s[a], i[a])] == best


def test_large_components_use_integers():
    x = np.array([[1e15, 1.0], [1e15, 2.0], [3.0, 4.0]])
    found = topk.exact_large(x, np.array([1, 2, 3]), x[:1], np.array([1]), 2)
    assert found == [(1, 2, topk.LONG), (1, 3, 3 * 10**15 + 4)]
    gen = np.random.default_rng(4)
    x = np.floor(gen.normal(size=(400, 3)) * 1e9)
    x[200:] = x[:200] + gen.integers(-1, 2, size=(200, 3))  # scores that doubles cannot tell apart
    ids = gen.permutation(400).astype(np.int64)
    found = topk.exact_large(x, ids, x[:30], ids[:30], 5)
    for a in range(30):
        clamp = lambda s: max(-topk.LONG - 1, min(topk.LONG, s))
        best = sorted((-clamp(sum(int(u) * int(v) for u, v in zip(x[a], x[b]))), int(ids[b])) for b in range(400) if b != a)[:5]
        assert [(-s, j) for i, j, s in found if i == ids[a]] == best


def test_repeated_rows_of_the_query_leave_k_others():
    ids = np.array([50, 50, 51, 52, 53, 54, 55, 56, 7, 9, 9, 9, 8, 8, 8])
    x = np.array([[1.0, 2.0]] * 8 + [[0.0, 3.0]] * 7)
    kept = topk.least_ids(x, ids, 5)
    assert sorted(ids[kept]) == [7, 8, 8, 8, 9, 9, 9, 50, 50, 51, 52, 53, 54, 55]
    rng = random.Random(8)
    for _ in range(200):
        ids = np.array([rng.randrange(9) for _ in range(rng.randrange(1, 40))])
        x = np.array([[float(rng.randrange(3))] for _ in ids])
        kept = topk.least_ids(x, ids, 3)
        for v in range(3):
            for own in range(-1, 9):
                best = lambda at: sorted(int(ids[r]) for r in at if x[r, 0] == v and ids[r] != own)[:3]  # noqa: B023, E731
                assert best(kept) == best(range(len(ids)))


def test_repeated_query_rows_against_sql(spark):
    rows = [(i, [4.0, 4.0]) for i in (50, 50, 51, 52, 53, 54, 55)] + [(60 + i, [1.0, float(i % 3)]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.op7(df).select("query_id", "rank", "vec_id").collect())
    assert got == [(50, i + 1, 51 + i) for i in range(5)]
