"""Mixing sources to target weights by Pfair scheduling.

A source is cut into blocks of `block_chars` characters in an order shuffled by row key. Block j of a source with
weight w may go out from slot floor(j / w) on and must by slot ceil((j + 1) / w); the earliest deadline goes first.
With weights that sum to one every deadline is met, so at every slot each source is less than one block off its
share. Weights are rounded to shares of a period of `period` slots (at least one each), and one period's schedule
serves all blocks: block j stands at period j // share. When a source ends, the rest go on with their weights
rescaled; nothing is dropped or repeated.

A row's block follows from the characters before it in its source: rows are dealt by (source, range of the shuffle
key), about the square root of a source's rows to a range; only sums of ranges are added up along a source. The
driver holds one row a source.

Defined cases: null and empty texts take no room and stand with the row after them; null is a source of its own;
sources without a target get the least target of all, targets without rows are ignored; repeated rows keep all
copies, side by side; a text of more than block_chars characters stays whole: its block is longer by what it has beyond
that, and slots count blocks; an empty table gives no rows."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

NO_SOURCE = "\0"


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole shares of a period of at least `period` slots, by largest remainders, one at least."""
    period = max(period, 4 * len(weights))
    total = math.fsum(weights.values())
    exact = {k: w / total * period for k, w in weights.items()}
    out = {k: max(1, math.floor(x)) for k, x in exact.items()}
    order = sorted(weights, key=lambda k: (out[k] - exact[k], k))
    while (left := period - sum(out.values())) != 0:
        if left > 0:
            for k in order[:left]:
                out[k] += 1
        else:
            for k in sorted(out, key=lambda k: (exact[k] - out[k], k)):
                if left < 0 and out[k] > 1:
                    out[k] -= 1
                    left += 1
    return out


def period_slots(share: dict[str, int]) -> dict[str, np.ndarray]:
    """The slots of each source in one period, earliest deadline first among released blocks."""
    period = sum(share.values())
    waiting = [(0, k, 0) for k in sorted(share)]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # deadline, source, block
    out: dict[str, list[int]] = {k: [] for k in share}
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // share[k]), k, j))
        deadline, k, j = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a deadline was missed")
        out[k].append(slot)
        if j + 1 < share[k]:
            heapq.heappush(waiting, ((j + 1) * period // share[k], k, j + 1))
    return {k: np.array(v, np.int64) for k, v in out.items()}


class Schedule:
    """Slots of all blocks: phases between which a source ends."""

    def __init__(self, blocks: dict[str, int], weights: dict[str, float], period: int = 1000):
        self.phases: dict[str, list[tuple[int, int, int, int, np.ndarray]]] = {k: [] for k in blocks}  # first block, past last, base slot, period, slots
        left, done, base = {k: n for k, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0
        while left:
            slots = period_slots(shares({k: weights[k] for k in left}, period))
            length = sum(map(len, slots.values()))
            ends = {k: (n - 1) // len(slots[k]) * length + int(slots[k][(n - 1) % len(slots[k])]) + 1 for k, n in left.items()}
            stop = min(ends.values())
            for k in list(left):
                n = stop // length * len(slots[k]) + int(np.searchsorted(slots[k], stop % length))
                self.phases[k].append((done[k], done[k] + n, base, length, slots[k]))
                done[k] += n
                left[k] -= n
                if not left[k]:
                    del left[k]
            base += stop
        self.slots = base

    def slot(self, source: str, block: np.ndarray) -> np.ndarray:
        rows = self.phases[source]
        out = np.zeros(len(block), np.int64)
        at = np.searchsorted(np.array([r[1] for r in rows]), block, "right")
        for i in np.unique(at):
            first, _, base, length, slots = rows[i]
            k = block[at == i] - first
            out[at == i] = base + k // len(slots) * length + slots[k % len(slots)]
        return out


def interleave(docs: DataFrame, weights: dict[str | None, float] | None = None, block_chars: int = 65_536, period: int = 1000, key_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17) -> tuple[DataFrame, int]:
    """docs with __source_block and __slot (order: __slot, then __shuffle), and the number of slots.

    weights: target of each source; None: the square root of its characters, which lifts small sources."""
    out, slots = _interleave(docs, weights, block_chars, period, key_col, source_col, text_col, seed)
    return out.select("row.*", F.col("block").alias("__source_block"), F.col("slot").alias("__slot"), F.col("shuffle").alias("__shuffle")), slots


def _interleave(docs: DataFrame, weights: dict[str | None, float] | None, block_chars: int, period: int = 1000, key_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17, carry: list[str] | None = None) -> tuple[DataFrame, int]:
    """(row: the columns of docs named in carry, all if none are, block, slot, shuffle) and the number of slots; rows travel packed, so their names meet no others."""
    prepare(docs.sparkSession)
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))
    size = F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    sums = {r.s: (r.rows, r.chars) for r in docs.groupBy(source.alias("s")).agg(F.count("*").alias("rows"), F.sum(size).alias("chars")).collect()}
    blocks = {k: max(1, -(-c // block_chars)) for k, (_, c) in sums.items()}
    if weights is None:
        target = {k: math.sqrt(max(1, c)) for k, (_, c) in sums.items()}
    else:
        given = {NO_SOURCE if k is None else k: w for k, w in weights.items() if w > 0}
        target = {k: given.get(k, min(given.values(), default=1.0)) for k in sums}
    schedule = Schedule(blocks, target, period)
    shuffle = F.shiftrightunsigned(F.xxhash64(F.col(key_col).cast("string"), F.lit(seed)), 11)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), source.alias("source"), size.alias("size"), shuffle.alias("shuffle"), F.col(key_col).cast("string").alias("key"))
    if not sums:
        return keyed.select("row", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("slot"), "shuffle"), 0
    ranges = F.create_map(*[x for k, (n, _) in sums.items() for x in (F.lit(k), F.lit(max(1, math.isqrt(n))))])[F.col("source")]
    # divided first: a key has 53 bits, which a double holds exactly, while its product with over 1,024 ranges overflows a long
    keyed = keyed.withColumn("range", F.floor(F.col("shuffle") / F.lit(float(1 << 53)) * ranges).cast("long"))
    parts = keyed.groupBy("source", "range").agg(F.sum("size").alias("chars"))
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "range", F.coalesce(F.sum("chars").over(along), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "range").orderBy("shuffle", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    last = F.create_map(*[x for k, n in blocks.items() for x in (F.lit(k), F.lit(n - 1))])[F.col("source")]
    placed = keyed.join(parts, ["source", "range"]).withColumn("block", F.least(F.floor(start / F.lit(block_chars)).cast("long"), last.cast("long")))
    sent = docs.sparkSession.sparkContext.broadcast(schedule)

    @F.pandas_udf("long")
    def slot(s: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(s), np.int64)
        block = b.to_numpy()
        for k, at in s.groupby(s, sort=False).indices.items():
            out[at] = sent.value.slot(k, block[at])
        return pd.Series(out)

    return placed.select("row", "block", slot("source", "block").alias("slot"), "shuffle"), schedule.slots


def op1(docs: DataFrame) -> DataFrame:
    out, _ = _interleave(docs, None, 65_536, carry=["doc_id", "source"])
    return out.select("row.doc_id", "row.source", "block", "slot", F.col("shuffle").alias("order_in_slot"))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, block_chars: int = 65_536) -> DataFrame:
    """docs in mixed order: partitions hold consecutive slots, rows in order within; all rows and columns stay."""
    out, slots = _interleave(docs, weights, block_chars)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = out.repartitionById(n, F.floor(F.col("slot") * n / max(1, slots)).cast("int")).sortWithinPartitions("slot", "shuffle")
    return out.select("row.*")
