from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from quarrylens.llm import simhash


def brute(rows, shingle=3, distance=2):
    fp = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) > shingle else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fp.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)].append(d)
    return sorted(((d, f"{fp[i]:016x}", min(ids[find(i)], default=None)) for i, (d, _) in enumerate(rows)), key=str)


def similar(rows, shingle=5, least=0.8):
    """The smallest id of each group of documents linked by the Jaccard similarity of their shingles."""
    rows = sorted({d: t for d, t in reversed(rows) if d is not None}.items())
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[find(i)][0] for i in range(len(rows))}


def test_similar_documents_against_all_pairs(spark):
    import random

    rnd = random.Random(11)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for g in range(25):
        base = rnd.choices(words, k=rnd.randrange(60, 300))
        for _ in range(rnd.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 2, 8, 30])):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000 + i, " ".join(words[:200][: i % 5] + ["zz"] + words[i % 5 : 200])) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(similar(rows))
    few = simhash.similar_groups(df, crowd=3)
    assert {r.component for r in few.collect()} == similar(rows)


def test_star_of_copies_around_a_base_of_middle_id(spark):
    import random

    rnd = random.Random(23)
    words = [f"w{i}" for i in range(5000)]
    base = rnd.choices(words, k=300)
    rows = []
    for i in range(400):
        copy = list(base)
        for at in rnd.sample(range(8, 290), 5):
            copy[at] = f"own{i}x{at}"
        rows.append((i if i < 200 else i + 1, " ".join(copy)))
    rows.append((200, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert similar(rows) == {0}
    assert {r.component for r in simhash.similar_groups(df).collect()} == similar(rows)
    rows = [r for r in rows if r[0] != 200]  # without the base the copies are only as close as chance has it
    kept = {r.component for r in simhash.similar_groups(df.where("doc_id <> 200")).collect()}
    assert kept == similar(rows) and len(kept) > 100


def test_documents_against_all_pairs(spark):
    rows = [(1, "a b c d e f g h"), (2, "A B\tC d e f g h"), (3, None), (4, ""), (5, "x"), (6, "x y"), (7, "ü ö ß word"), (5, "x"), (None, "x y"), (8, "z " * 9000), (9, "Z " * 9001)]
    rows += [(100 + i, " ".join(f"w{j}" for j in range(300) if j != i)) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS fp", "3 AS component")
    got = sorted([tuple(r) for r in simhash.op2(df).collect()], key=str)
    assert got == brute(rows)
    assert simhash.op2(df.limit(0)).count() == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(similar(rows))


def test_crowded_blocks_find_the_same_links(spark):
    import random

    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4))) & (2**64 - 1) for b in base for _ in range(40)}
    signed = sorted(x - (1 << 64) if x >= 1 << 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")

    def comps(edges):
        root = {x: x for x in signed}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for u, v in edges:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
        return {x: find(x) for x in signed}

    true = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    for crowd in (64, 3):
        got = [tuple(r) for r in simhash.close_pairs(df, 2, crowd).collect()]
        assert {tuple(sorted(x)) for x in got} <= {tuple(sorted(x)) for x in true}
        assert comps(got) == comps(true)
    got = {r.node: r.component for r in simhash.components(simhash.close_pairs(df, 2, 3)).collect()}
    assert {x: got.get(x, x) for x in signed} == comps(true)


def test_rows_are_judged_by_text_not_by_id(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a, "x"), (2, a, "y"), (2, b, "z"), (3, b, "v"), (4, "own words only here now", "r"), (4, "own words only here now", "r"), (None, a, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string").withColumn("__tag", F.col("__id"))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted([tuple(r)[:3] for r in kept.collect()], key=str) == sorted([rows[0], rows[2], rows[4], rows[6]], key=str)


def test_a_hot_key_meets_by_broadcast(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(40)], "u long, v long")
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(3000)} | {5000 + i: 5000 for i in range(41)}
