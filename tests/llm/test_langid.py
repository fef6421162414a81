import random
import zlib

import numpy as np

from quarrylens.llm import langid


def rows():
    rnd = random.Random(2)
    voc = {"xx": ["alpha", "beta", "gamma", "delta"], "yy": ["ützel", "brützel", "mützel"], "zz": ["кот", "дом", "лес"]}
    out = [(i, " ".join(rnd.choices(voc[k], k=rnd.randrange(2, 30))), k) for i, k in enumerate(rnd.choices(list(voc), k=300))]
    return out + [(1000, None, "xx"), (1001, "", None), (1002, "12 !! 34", "yy"), (1003, "Alpha BETA " * 20000, None), (None, "кот", None), (0, out[0][1], out[0][2])]


def test_held_out_rows_and_edges(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS lang_pred").repartition(3)
    got = langid.op10(df).collect()
    assert len(got) == len(data)
    want = {d: (t, k) for d, t, k in data}
    for r in got:
        t, k = want[r.doc_id]
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if t is None or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id == 1003:
            assert r.lang_pred == "xx"
        else:
            assert r.lang_pred == (k or "zz")
    kept = langid.accept(df)
    assert kept.columns == df.columns and kept.count() == len(data) - 3
    assert langid.op10(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.op10(df.withColumn("lang", df.lang.substr(9, 1)).where("false").unionByName(df.selectExpr("doc_id", "text", "cast(null AS string) lang", "score", "lang_pred"))).collect()} == {"und"}


def test_sliced_filter_equals_sets_and_corrects():
    rnd = np.random.default_rng(1)
    for n in (3, 11, 70):
        names = [f"l{i:02}" for i in range(n)]
        grams = {k: rnd.integers(0, 2**63, 3000).astype(np.uint64) for k in names}
        f = langid.Filter(names, grams)
        for b, k in enumerate(names):
            mask = f.masks[b // 64]
            hit = np.full(3000, ~mask.dtype.type(0))
            for p in langid.places(grams[k]):
                hit &= mask[p]
            assert ((hit >> mask.dtype.type(b % 64)) & mask.dtype.type(1)).all()
        assert (f.rate < 0.01).all()


def test_counts_against_exact_sets():
    """Predictions and corrected popcounts against look-ups in exact sets."""
    import numpy as np

    train = {"aa": [f"lorem ipsum dolor number {i} sit" for i in range(40)], "bb": [f"quick brown foxes {i} over lazy dogs" for i in range(40)], "cc": ["один два три четыре пять"] * 40}
    tables = {k: langid.gram_table(v) for k, v in train.items()}
    model = langid.Filter(sorted(tables), {k: h for k, (h, _) in tables.items()})
    texts = ["ipsum dolor", "lazy foxes over", "два три", "ipsum foxes четыре", "12 34", None]
    found, total, has = model.counts(texts)
    h, doc, _ = langid.ngrams(texts)
    exact = np.array([[np.isin(h[doc == d], tables[k][0]).sum() for k in sorted(tables)] for d in range(len(texts))])
    assert (np.abs(found - exact) <= 1 + 0.01 * total[:, None]).all() and not has[4] and not has[5]
    assert model.predict(texts)[0][:3] == ["aa", "bb", "cc"] and model.predict(texts)[0][4:] == ["und", "und"]
