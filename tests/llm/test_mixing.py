import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import mixing


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 2, "c": 4}, {"a": 0.9999, "b": 0.0001}, {f"s{i}": i + 1 for i in range(300)}])
def test_every_prefix_is_less_than_a_block_off(weights):
    share = mixing.shares(weights, 1000)
    period = sum(share.values())
    assert min(share.values()) >= 1 and period == max(1000, 4 * len(weights))
    slots = mixing.period_slots(share)
    assert sorted(np.concatenate(list(slots.values()))) == list(range(period))
    for k, own in slots.items():
        got = np.searchsorted(own, np.arange(period + 1))
        assert np.abs(got - np.arange(period + 1) * share[k] / period).max() < 1


def test_phases_use_each_slot_once():
    rnd = random.Random(1)
    blocks = {f"s{i}": rnd.choice([1, 7, 300, 5000]) for i in range(9)}
    s = mixing.Schedule(blocks, {k: rnd.random() + 0.01 for k in blocks}, 50)
    every = np.concatenate([s.slot(k, np.arange(n)) for k, n in blocks.items()])
    assert sorted(every) == list(range(sum(blocks.values()))) and s.slots == sum(blocks.values())
    for k, n in blocks.items():
        assert (np.diff(s.slot(k, np.arange(n))) > 0).all()


def test_documents(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["hot"] * 8 + ["b", "c", None]), "x" * rnd.randrange(0, 400)) for i in range(900)]
    rows += [(5000, "b", None), (5001, "b", "y" * 20_000), (None, "c", "z"), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS slot", "2 AS block").repartition(3)
    out, n = mixing.interleave(df, {"hot": 0.5, "b": 0.3, "c": 0.1, "missing": 5}, block_chars=1000, period=10)
    got = out.collect()
    assert sorted([(r.doc_id, r.source, r.text) for r in got], key=str) == sorted(rows, key=str)
    # a brute-force walk along each source gives the same blocks
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        at = 0
        last = max(0, -(-sum(len(r.text or "") for r in own) // 1000) - 1)
        for r in sorted(own, key=lambda r: (r["__shuffle"], str(r.doc_id), len(r.text or ""))):
            assert r["__source_block"] == min(at // 1000, last)
            at += len(r.text or "")
    owner = {}
    for r in got:
        assert 0 <= r["__slot"] < n
        assert owner.setdefault(r["__slot"], r.source) == r.source
    order = mixing.mixed(df, block_chars=1000)
    assert order.columns == df.columns
    assert Counter(order.collect()) == Counter(df.collect())
    assert mixing.op1(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


def test_a_source_of_over_a_million_rows(spark):
    n = 1_060_000  # 1,029 ranges, whose products with keys of 53 bits reach beyond a long
    df = spark.range(n).selectExpr("id AS doc_id", "if(id < 5, 'small', 'hot') AS source", "'0123456789' AS text")
    got = mixing.op1(df).toPandas()
    assert len(got) == n and got.doc_id.nunique() == n
    for _, own in got.groupby("source"):
        # a walk along the source in order of its keys gives the same blocks, and blocks follow their slots
        own = own.sort_values(["order_in_slot", "doc_id"])
        at = np.arange(len(own)) * 10
        assert (own.block.to_numpy() == np.minimum(at // 65_536, max(0, -(-10 * len(own) // 65_536) - 1))).all()
        assert (np.diff(own.slot.to_numpy()) >= 0).all()
    placed = mixing.mixed(df).select("doc_id", F.spark_partition_id().alias("part")).toPandas()
    assert len(placed) == n and placed.doc_id.nunique() == n
    both = placed.merge(got, on="doc_id")
    assert (both.groupby("part").slot.min().to_numpy()[1:] >= both.groupby("part").slot.max().to_numpy()[:-1]).all()
