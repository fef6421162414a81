import itertools
import random
import zlib

import numpy as np

from quarrylens.llm import toxicity


def test_scan_equals_enumeration():
    rng = np.random.default_rng(0)
    start, trans = rng.normal(size=2), rng.normal(size=(2, 2))
    sizes = [1, 2, 7, 1, 9, 4]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    e = rng.normal(size=len(doc)) * 2
    got = toxicity.marginals(e, doc, start, trans)
    at = 0
    for n in sizes:
        own = e[at : at + n]
        total, on = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            s = start[y[0]] + sum(own[i] for i in range(n) if y[i]) + sum(trans[y[i], y[i + 1]] for i in range(n - 1))
            total += np.exp(s)
            on += np.exp(s) * np.array(y)
        assert np.allclose(got[at : at + n], on / total)
        at += n


def test_a_long_text_in_blocks_equals_a_loop():
    rng = np.random.default_rng(1)
    n = 3 * toxicity.BLOCK**2 + 17
    e, doc = rng.normal(size=n), np.zeros(n, int)
    start, trans = np.array([0.1, -2.0]), np.array([[0.5, -3.0], [-0.4, -2.0]])
    alpha, beta, m = toxicity.forward_backward(e, doc, start, trans)
    a = np.exp(start) * np.array([1, np.exp(e[0])])
    for t in range(n):
        if t:
            a = a @ m[t]
        a = a / a.sum()
        assert np.allclose(a, alpha[t])
    b = np.ones(2)
    for t in range(n - 1, -1, -1):
        b = b / b.sum()
        assert np.allclose(b, beta[t])
        b = m[t] @ b


def test_held_out_documents_and_edges(spark):
    rnd = random.Random(4)
    plain, bad = [f"word{i}" for i in range(60)], ["grukk", "zonkel", "snarf"]
    rows, labels = [], []
    for i in range(600):
        words = rnd.choices(plain, k=rnd.randrange(5, 60))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad) + rnd.choice(["", "!", ","]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "grukk snarf"), (0, rows[0][1]), (1002, "word1 " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "0 AS toxic", "7 AS h").repartition(3)
    marks = spark.createDataFrame([*labels, (5000, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.op6(docs, marks).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    right = [r.predicted == (r.doc_id % 5 == 0) for r in got if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert np.mean(right) > 0.97
    assert all(r.predicted == 0 for r in got if r.doc_id in (1000, 1001, 1002))
    model = toxicity.fit(docs, marks)
    spans = toxicity.score(docs.where("doc_id = 5"), model, ["doc_id"], spans=True).first().spans
    text = dict(rows)[5]
    assert spans and all(any(b in text[s.start : s.end] for b in bad) for s in spans)
    assert {r.score for r in toxicity.op6(docs, marks.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.op6(docs.limit(0), marks).count() == 0


def test_offsets_are_places_of_the_text():
    text = "İẞ K Abc ÉÜ Σ"
    assert len(toxicity.lower_in_place(text).encode()) == len(text.encode()) and toxicity.lower_in_place(text)[-7:-4] == "bc "[:3]
    bad = "İİİ ẞoo Zurk rest of é text"
    texts = [f"word{i} plain text here" for i in range(60)] + [f"word{i} zurk text" for i in range(60)]
    model = toxicity.Model.learn(texts, np.arange(120) >= 60)
    _, runs = model.judge([bad, "", "plain"])
    assert [bad[a:b] for a, b, _ in runs[0]] == ["Zurk"] and runs[1:] == [[], []]
