import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from quarrylens.llm import pieces

TEXTS = ["", " ", "  two  spaces ", "plain words here", "ü▁ß\n\t\x00 end", "汉字 и кот 🙂🙂", "a" * 3000, "x" * 40 + " y", "tail ", "\n", "the the the the"]


@pytest.fixture(scope="module")
def vocab():
    return pieces.Vocabulary()


def segmentations(vocab, raw):
    """All segmentations of a chunk of bytes with their probabilities."""
    index = {vocab.spell[i]: i for i in range(len(vocab.spell)) if vocab.spell[i] and i not in set(vocab.byte_id.tolist())}
    out = {}

    def walk(at, ids, w):
        if at == len(raw):
            out[tuple(ids)] = w
            return
        n = pieces._char_sizes(np.frombuffer(raw[at : at + 1], np.uint8))[0]
        for length in range(1, len(raw) - at + 1):
            i = index.get(raw[at : at + length])
            if i is not None:
                walk(at + length, [*ids, i], w * np.exp(vocab.log_weight[i]))
        if raw[at : at + n] not in index:
            own = [int(vocab.byte_id[b]) for b in raw[at : at + n]]
            walk(at + n, [*ids, *own], w * np.exp(vocab.log_weight[own].sum()))

    walk(0, [], 1.0)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_samples_follow_the_lattice(vocab):
    for text in ("hello", "é▁x", "  a"):
        want = segmentations(vocab, (" " + text).encode())
        n = 20_000
        ids, counts = pieces.encode(vocab, [text.encode()] * n, np.arange(n, dtype=np.uint64), 1.0)
        edge = np.concatenate([[0], np.cumsum(counts)])
        got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(edge[:-1], edge[1:]))
        assert set(got) <= set(want)
        assert sum(abs(got[k] / n - p) for k, p in want.items()) < 0.12


def test_lossless_and_the_same_in_any_batch(vocab):
    raw = [t.encode() for t in TEXTS]
    seeds = np.arange(len(raw), dtype=np.uint64) * np.uint64(77)
    ids, counts = pieces.encode(vocab, raw, seeds, 0.7)
    edge = np.concatenate([[0], np.cumsum(counts)])
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for i, t in enumerate(raw):
        own = ids[edge[i] : edge[i + 1]]
        one, n = pieces.encode(vocab, [t], seeds[i : i + 1], 0.7)
        assert one.tolist() == own.tolist() and n[0] == len(own)
        assert pieces.decode(vocab, own, np.array([len(own)]))[0].tobytes() == t
        assert model.decode(own.tolist()) == TEXTS[i]
    assert counts[0] == 0


def test_query_and_decoding(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (None, "plain words here"), (3, TEXTS[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_ids").repartition(3)
    got = pieces.op3(df)
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in got.collect()) == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert all(r.n_ids == len(r.ids) for r in got.collect())
    assert len({tuple(r.ids) for r in got.where("doc_id = 3").collect()}) == 1
    back = {(r.doc_id, r.text) for r in pieces.detokenize(got, ["doc_id"]).collect()}
    assert back == {(i, t or "") for i, t in rows}
    assert pieces.op3(df.limit(0)).count() == 0
    assert sorted(map(str, got.collect())) == sorted(map(str, pieces.op3(df.repartition(1)).collect()))
