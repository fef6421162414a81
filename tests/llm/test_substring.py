import hashlib
import random

from quarrylens.llm import substring


def brute(rows, window=13):
    least = {}
    for i, t in rows:
        w = (t or "").encode().split()
        if i is not None:
            for j in range(len(w) - window + 1):
                k = tuple(w[j : j + window])
                least[k] = min(i, least.get(k, i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        if i is not None:
            for j in range(len(w) - window + 1):
                if least[tuple(w[j : j + window])] < i:
                    gone.update(range(j, j + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(3)
    words = [f"w{i}ü" for i in range(400)]
    passage = " ".join(rnd.choices(words, k=40))
    rows = [(None, passage), (1, None), (2, ""), (3, " \t\n"), (4, "x " * 3000), (5, "x " * 20), (6, "a b c"), (7, passage.replace(" ", "\n")), (7, passage)]
    for i in range(10, 120):
        t = rnd.choices(words, k=rnd.randrange(5, 80))
        if i % 3 == 0:
            at = rnd.randrange(len(t))
            t[at:at] = passage.split()[: rnd.choice([12, 13, 40])]
        if i % 7 == 0:
            t += t
        rows.append((i, rnd.choice([" ", "  ", "\t"]).join(t)))
    rows += [(200, rows[30][1]), (201, rows[30][1]), (201, rows[31][1])]
    rnd.shuffle(rows)
    return rows


def test_against_all_windows(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS tag", "3 AS lo").repartition(3)
    want = brute(rows)
    assert sorted([tuple(r) for r in substring.op5(df).collect()], key=str) == want
    assert substring.op5(df.limit(0)).count() == 0
    heavy = substring.crowded_minimisers
    monkeypatch.setattr(substring, "HEAVY_MIN", 5)
    slim = df.where("doc_id is not null").selectExpr("doc_id AS id", "xxhash64(text) AS tag", "cast(text AS binary) AS text")
    assert len(heavy(slim, 13, 4)) > 0
    monkeypatch.setattr(substring, "SORT_ENTRIES", 7)
    assert sorted([tuple(r) for r in substring.op5(df).collect()], key=str) == want


def test_texts_keep_everything_else(spark):
    p = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"head {p}", 0), (2, f"  my own\n{p}\tand tail ", 0), (3, p, 0), (4, "", 0), (5, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in substring.remove_repeats(df, length_col="n_chars").collect()}
    assert out == {1: (rows[0][1], 0), 2: ("  my own\nand tail ", 18), 4: ("", 0), 5: (None, 0)}


def ranges(found):
    gone = {}
    for i, t, lo, hi in found:
        gone.setdefault((i, t), set()).update(range(lo, hi))
    return gone


def test_overfull_buckets_give_the_same_ranges(spark):
    rows = corpus()
    rnd = random.Random(9)
    passage = " ".join(f"everywhere{i}" for i in range(30))
    rows += [(1000 + i, f"own{i} " * 3 + passage + f" end{i} of{rnd.randrange(9)} it") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = ranges([tuple(r) for r in substring.repeated_ranges(df).collect()])
    assert {i for i, _ in want if i >= 1001} == set(range(1001, 1150))
    for held in (0, 3000):
        assert ranges([tuple(r) for r in substring.repeated_ranges(df, held_bytes=held).collect()]) == want


def test_slices_of_one_task_send_a_passage_few_times():
    import numpy as np

    passage = " ".join(f"p{i}" for i in range(25)).encode()
    memory, sent, found = substring.Memory(), 0, []
    bucket = substring.Bucket(13)
    docs = list(range(40))
    random.Random(1).shuffle(docs)
    for d in docs:
        text = b"a%d b%d c%d " % (d, d, d) + passage
        joined, starts, ends, counts = substring.words_of([text])
        for _, blob in substring._pack(joined, starts, ends, counts, [d], [d], 13, 3, np.zeros(0, np.uint64), 1, memory):
            sent += len(blob)
            found += bucket.add(blob)
    found += bucket.finish()
    assert memory.least and len(bucket.got) == 0
    assert ranges([r[:4] for r in found]) == {(d, d): set(range(3, 28)) for d in range(1, 40)}


def test_counts_fall_short_by_a_known_share():
    import numpy as np

    rnd = np.random.default_rng(2)
    every = np.minimum(rnd.zipf(1.3, 30_000), 10**6).astype(np.uint64)
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for part in np.array_split(every, 30):
        keys, counts = substring.add_counts(keys, counts, *np.unique(part, return_counts=True), 100)
        assert len(keys) <= 100
    true = dict(zip(*np.unique(every, return_counts=True)))
    got = dict(zip(keys.tolist(), counts.tolist()))
    assert all(true[k] - got.get(int(k), 0) <= len(every) / 100 for k in true) and all(got[k] <= true[np.uint64(k)] for k in got)
