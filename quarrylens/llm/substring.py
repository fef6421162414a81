"""Substring dedup: word windows that already start in an earlier document, found through super-k-mers.

Every window of `window` consecutive words has a minimiser: the least hash among its runs of `gram` words.
Consecutive windows of a document that share it travel as one packed string (a super-k-mer) to the bucket of that
minimiser, so all equal windows meet in one bucket; sorting the windows there tells each from its equals exactly, on
their bytes, and gives the least document id of each. The bucket replies with word ranges of the documents that came
later; ranges are merged per document and the words outside them are kept.

Skew: a map task sends a string of a passage once or twice, for its smallest id; its other holders are covered there
and then. A bucket does the same as strings arrive, so a passage of any number of documents takes the room of one. A
minimiser that very many different strings share (the words around a common passage) is found by a counting pass over
all rows, with counters that keep every share of 2 / HEAVY_MAX or more, and its windows travel one by one to the bucket
of their own hash; the list of such minimisers is at most HEAVY_MAX long, so it is sent with the task. Should the
strings of a bucket still pass HELD_BYTES, the windows of its largest minimisers go on to a second exchange, by the
windows themselves, where they are only streamed in order.

Defined cases: null and blank texts have no words; windows are judged on the input; repeated rows of one id have
equal ids and do not remove each other's words; rows without an id lose nothing and cover nothing; an empty table
gives no rows. A row's text is read whole."""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, mix64, pieces, prepare, release, span_hashes, total_bytes, words_of

SLICE_BYTES = 5 << 20
BUCKET_BYTES = 32 << 20
HEAVY_MIN, HEAVY_MAX = 20_000, 65_536
HELD_BYTES = 128 << 20
MEMORY_BYTES = 16 << 20
SLOTS = 1 << 20
SORT_ENTRIES = 20_000


def super_kmers(joined: bytes, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first word, last window's first word) of each super-k-mer, by word number over all texts."""
    n = len(starts)
    last = np.repeat(np.cumsum(counts), counts)
    at = np.flatnonzero(np.arange(n) + window <= last)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = span_hashes(np.frombuffer(joined, np.uint8), starts, ends)
    g = h[: n - gram + 1].copy()
    for j in range(1, gram):
        g = g * np.uint64(0x100000001B3) + h[j : n - gram + 1 + j]
    g = mix64(g)
    width, step = window - gram + 1, 1
    low = g
    while step * 2 <= width:
        low = np.minimum(low[: len(low) - step], low[step:])
        step *= 2
    if width > step:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    key = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | (last[at[1:]] != last[at[:-1]])
    first = np.flatnonzero(new)
    final = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return key[first], at[first], at[final]


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return [v.as_py() if v.is_valid else b"" for v in part.column(part.schema.get_field_index("text"))]


def add_counts(keys: np.ndarray, counts: np.ndarray, k: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Running counts with those of (k, n) added; beyond `most` keys all counts fall by that of the first key too many, so none is short by over one part in `most` of all."""
    every, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([counts, n])).astype(np.int64)
    if len(every) <= most:
        return every, total
    total -= np.partition(total, len(total) - most - 1)[len(total) - most - 1]
    return every[total > 0], total[total > 0]


def crowded_minimisers(docs: DataFrame, window: int, gram: int) -> np.ndarray:
    """Minimisers that more than HEAVY_MIN different strings (and 1 / HEAVY_MAX of all, 2 / HEAVY_MAX for sure) share, counted over all rows."""

    def run(batches):
        keys, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for part in pieces(batches, "text", SLICE_BYTES):
            joined, starts, ends, words = words_of(_texts(part))
            key, a, b = super_kmers(joined, starts, ends, words, window, gram)
            if not len(key):
                continue
            whole = span_hashes(np.frombuffer(joined, np.uint8), starts[a], ends[b + window - 1])
            _, one = np.unique(whole, return_index=True)
            k, n = np.unique(key[one], return_counts=True)
            total += len(one)
            keys, counts = add_counts(keys, counts, k, n, HEAVY_MAX)
        sure = counts > 1
        ks, cs = np.append(keys[sure], np.uint64(0)), np.append(counts[sure], total)
        yield pa.RecordBatch.from_arrays([pa.array(ks.view(np.int64)), pa.array(cs, pa.int64()), pa.array(np.arange(len(ks)) == len(ks) - 1)], ["k", "n", "total"])

    counted = materialize(docs.mapInArrow(run, "k long, n long, total boolean").groupBy("total", "k").agg(F.sum("n").alias("n")), "minimisers")
    total = counted.where("total").agg(F.sum("n")).first()[0] or 0
    heavy = counted.where(~F.col("total") & (F.col("n") > max(HEAVY_MIN, total // HEAVY_MAX))).select("k")
    return np.sort(np.array([r.k for r in heavy.collect()], np.int64).view(np.uint64))


class Memory:
    """Strings that a task has met in two of its slices, each with the least id it was sent for.

    Which strings were met before is kept by their hashes in a table of fixed size; those met again are kept by their
    bytes, up to MEMORY_BYTES. What is forgotten is only sent once more."""

    def __init__(self):
        self.least: dict[bytes, int] = {}
        self.size = 0
        self.table = np.zeros(SLOTS, np.int64)

    def learn(self, strings: list[bytes], ids: list[int]) -> None:
        if not strings:
            return
        h = np.fromiter(map(hash, strings), np.int64, len(strings)) | 1
        at = (h >> 8) & (SLOTS - 1)
        for i in np.flatnonzero(self.table[at] == h).tolist():
            self.size += 0 if strings[i] in self.least else len(strings[i]) + 100
            self.least[strings[i]] = ids[i]
        self.table[at] = h
        if self.size > MEMORY_BYTES:
            self.least.clear()
            self.size = 0


def _pack(joined, starts, ends, counts, ids, tags, window, gram, heavy, buckets, memory):
    """Blobs (bucket, bytes) of one slice of documents in order of their ids."""
    key, a, b = super_kmers(joined, starts, ends, counts, window, gram)
    doc = np.repeat(np.arange(len(counts)), counts)
    base = np.concatenate([[0], np.cumsum(counts)])
    if len(heavy) and len(key):
        single = np.isin(key, heavy)
        if single.any():
            n = (b - a + 1)[single]
            w = np.repeat(a[single], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            k = span_hashes(np.frombuffer(joined, np.uint8), starts[w], ends[w + window - 1])
            key, a, b = np.concatenate([key[~single], k]), np.concatenate([a[~single], w]), np.concatenate([b[~single], w])
            order = np.argsort(a, kind="stable")
            key, a, b = key[order], a[order], b[order]
    seen: dict[bytes, int] = {}  # the entry of a string; -1: an earlier slice has sent it for a smaller id
    sent: list[tuple[int, int]] = []  # index of the super-k-mer, document
    more: list[tuple[int, int]] = []  # entry, first word of a repeat in the same document
    known: list[list[int]] = []  # document, from, to: covered by an earlier document of this task
    before = memory.least
    rows = zip(range(len(key)), doc[a].tolist() if len(a) else [], a.tolist(), b.tolist(), starts[a].tolist() if len(a) else [], ends[b + window - 1].tolist() if len(b) else [])
    for i, d, x, y, s, e in rows:
        p = joined[s:e]
        at = seen.setdefault(p, len(sent))
        if at == len(sent):
            if p not in before or before[p] >= ids[d]:
                sent.append((i, d))
                continue
            seen[p] = at = -1
        if at >= 0:
            other = sent[at][1]
            if ids[other] == ids[d]:
                if other == d:
                    more.append((at, int(x - base[d])))
                elif tags[other] != tags[d]:
                    sent.append((i, d))  # another text under the same id: asks for itself
                continue
        if known and known[-1][0] == d and known[-1][2] >= x - base[d]:
            known[-1][2] = int(y - base[d] + window)
        else:
            known.append([d, int(x - base[d]), int(y - base[d] + window)])
    fresh = [(p, at) for p, at in seen.items() if at >= 0]
    memory.learn([p for p, _ in fresh], [ids[sent[at][1]] for _, at in fresh])
    out = []
    pick = np.array([i for i, _ in sent], np.int64)
    which = np.array([d for _, d in sent], np.int64)
    again = np.array(more, np.int64).reshape(-1, 2)
    again = again[np.argsort(again[:, 0], kind="stable")]
    repeats = np.bincount(again[:, 0], minlength=len(pick)) if len(again) else np.zeros(len(pick), np.int64)
    first_again = np.cumsum(repeats) - repeats
    to = (key[pick] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[by], np.arange(buckets + 1))
    direct = np.array(known, np.int64).reshape(-1, 3)
    home = int(np.abs(ids[0]) % buckets) if len(ids) else 0
    press = zstandard.ZstdCompressor(level=6)
    for t in range(buckets):
        own = by[edges[t] : edges[t + 1]]
        if not len(own) and not (t == home and len(direct)):
            continue
        k = pick[own]
        used, local = np.unique(which[own], return_inverse=True)
        s, e = starts[a[k]], ends[b[k] + window - 1]
        payload = (
            (key[k] >> np.uint64(32)).astype(np.uint32),
            np.array(ids, np.int64)[used],
            np.array(tags, np.int64)[used],
            local.astype(np.uint32),
            (a[k] - base[which[own]]).astype(np.int64),
            (e - s).astype(np.uint32),
            b"".join([joined[x:y] for x, y in zip(s.tolist(), e.tolist())]),
            repeats[own].astype(np.uint32),
            np.concatenate([again[first_again[i] : first_again[i] + repeats[i], 1] for i in own[repeats[own] > 0]] or [np.zeros(0, np.int64)]),
            (np.array(ids, np.int64)[direct[:, 0]], np.array(tags, np.int64)[direct[:, 0]], direct[:, 1], direct[:, 2]) if t == home and len(direct) else None,
        )
        out.append((t, press.compress(pickle.dumps(payload, protocol=5))))
    return out


def _runs(offsets: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for j in offsets:
        if out and out[-1][1] + 1 >= j:
            out[-1][1] = j
        else:
            out.append([j, j])
    return [(x, y) for x, y in out]


class Entries:
    """Super-k-mers of some blobs, by column: key, document (an index of ids and tags), first word, text and repeats."""

    def __init__(self, got: list[tuple]):
        doc_at = np.cumsum([0] + [len(p[1]) for p in got])
        self.keys = np.concatenate([p[0] for p in got])
        self.ids, self.tags = np.concatenate([p[1] for p in got]), np.concatenate([p[2] for p in got])
        self.doc = np.concatenate([p[3].astype(np.int64) + n for p, n in zip(got, doc_at)])
        self.first = np.concatenate([p[4] for p in got])
        self.length = np.concatenate([p[5] for p in got]).astype(np.int64)
        self.texts = [p[6] for p in got]
        self.source = np.repeat(np.arange(len(got)), [len(p[0]) for p in got])
        text_at = np.cumsum([0] + [len(x) for x in self.texts])
        self.repeats, self.again = np.concatenate([p[7] for p in got]).astype(np.int64), np.concatenate([p[8] for p in got])
        self.offset, self.again_at = np.cumsum(self.length) - self.length - text_at[self.source], np.cumsum(self.repeats) - self.repeats

    def text(self, e: int) -> bytes:
        return self.texts[self.source[e]][self.offset[e] : self.offset[e] + self.length[e]]

    def places(self, e: int) -> list[int]:
        """First words of every occurrence of the string in its document."""
        return [int(self.first[e]), *self.again[self.again_at[e] : self.again_at[e] + self.repeats[e]].tolist()]

    def pick(self, rows: np.ndarray) -> tuple:
        """These entries as one payload."""
        again = [self.again[self.again_at[e] : self.again_at[e] + self.repeats[e]] for e in rows[self.repeats[rows] > 0].tolist()]
        used, local = np.unique(self.doc[rows], return_inverse=True)
        text = b"".join([self.text(e) for e in rows.tolist()])
        return self.keys[rows], self.ids[used], self.tags[used], local.astype(np.uint32), self.first[rows], self.length[rows], text, self.repeats[rows], np.concatenate(again or [np.zeros(0, np.int64)]), None


def _word_starts(p: bytes) -> list[int]:
    """Where each word of a packed string begins, and one past its end where another would."""
    ws = [0]
    x = p.find(b" ")
    while x >= 0:
        ws.append(x + 1)
        x = p.find(b" ", x + 1)
    ws.append(len(p) + 1)
    return ws


class Bucket:
    """What one bucket has received. `add` and `finish` return rows (id, tag, from, to, window): found ranges (window None),
    and windows that the second exchange judges."""

    def __init__(self, window: int, held_bytes: int = HELD_BYTES):
        self.window, self.most = window, held_bytes
        self.got: list[tuple] = []
        self.size = 0
        self.passed = np.zeros(0, np.uint32)  # keys whose windows go on to the second exchange

    def add(self, blob: bytes) -> list[tuple]:
        p = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
        rows = list(zip(*[x.tolist() for x in p[9]], [None] * len(p[9][0]))) if p[9] is not None else []
        if len(self.passed) and (on := np.isin(p[0], self.passed)).any():
            e = Entries([p])
            rows += self._windows(e, np.flatnonzero(on))
            p = e.pick(np.flatnonzero(~on))
        if len(p[0]):
            self.got.append(p)
            self.size += len(p[6]) + 40 * len(p[0])
        if self.size > self.most:
            rows += self._reduce()
        return rows

    def _windows(self, e: Entries, which: np.ndarray) -> list[tuple]:
        out = []
        for x in which.tolist():
            p, d = e.text(x), e.doc[x]
            ws = _word_starts(p)
            for s in e.places(x):
                out += [(int(e.ids[d]), int(e.tags[d]), s + j, s + j + self.window, p[ws[j] : ws[j + self.window] - 1]) for j in range(len(ws) - self.window)]
        return out

    def _reduce(self) -> list[tuple]:
        """Of equal strings one stays, of the least id; then the largest keys go on, until half of the room is free."""
        e, rows = Entries(self.got), []
        best: dict[bytes, int] = {}
        keep = np.ones(len(e.keys), bool)
        who, tag = e.ids[e.doc], e.tags[e.doc]
        for x in range(len(e.keys)):
            p = e.text(x)
            y = best.setdefault(p, x)
            if x == y:
                continue
            if who[x] == who[y]:
                keep[x] = tag[x] != tag[y]  # a repeated row asks once
                continue
            if who[x] < who[y]:
                best[p], x, y = x, y, x
            keep[x] = False
            n = len(_word_starts(p)) - 1
            rows += [(int(who[x]), int(tag[x]), s, s + n, None) for s in e.places(x)]
        left = np.flatnonzero(keep)
        keys, at = np.unique(e.keys[left], return_inverse=True)
        weight = np.bincount(at, weights=e.length[left] + 40)
        if weight.sum() > self.most / 2:
            order = np.argsort(-weight, kind="stable")
            out = order[: 1 + int(np.searchsorted(np.cumsum(weight[order]), weight.sum() - self.most / 2))]
            gone = np.isin(at, out)
            rows += self._windows(e, left[gone])
            self.passed = np.union1d(self.passed, keys[out])
            left = left[~gone]
        self.got = [e.pick(left)] if len(left) else []
        self.size = sum(len(p[6]) + 40 * len(p[0]) for p in self.got)
        return rows

    def finish(self) -> list[tuple]:
        if not self.got:
            return []
        e, window, rows = Entries(self.got), self.window, []
        self.got = []
        order = np.argsort(e.keys, kind="stable")
        cut = np.flatnonzero(np.diff(e.keys[order])) + 1
        lows, highs = np.concatenate([[0], cut]), np.concatenate([cut, [len(e.keys)]])
        flagged: dict[int, list[int]] = {}
        for lo, hi in zip(lows[highs - lows > 1].tolist(), highs[highs - lows > 1].tolist()):
            own = order[lo:hi]
            who = e.ids[e.doc[own]]
            if (who == who[0]).all():
                continue
            spans = list(zip(own.tolist(), who.tolist(), e.source[own].tolist(), e.offset[own].tolist(), (e.offset[own] + e.length[own]).tolist()))
            rounds = -(-len(own) // SORT_ENTRIES)
            for r in range(rounds):
                found: list[tuple[bytes, int, int, int]] = []
                for x, i, source, low, high in spans:
                    p = e.texts[source][low:high]
                    ws = _word_starts(p)
                    for j in range(len(ws) - window):
                        w = p[ws[j] : ws[j + window] - 1]
                        if rounds == 1 or hash(w) % rounds == r:
                            found.append((w, i, x, j))
                found.sort()
                before, least = None, 0
                for w, i, x, j in found:
                    if w != before:
                        before, least = w, i
                    elif i > least:
                        flagged.setdefault(x, []).append(j)
        for x, offsets in flagged.items():
            i, t = int(e.ids[e.doc[x]]), int(e.tags[e.doc[x]])
            for lo, hi in _runs(sorted(offsets)):
                rows += [(i, t, s + lo, s + hi + window, None) for s in e.places(x)]
        return rows


def _judge_windows(rows: DataFrame) -> DataFrame:
    """(id, tag, lo, hi) of the windows (w) that a smaller id holds too: equal ones stand together, the least id first."""

    def run(batches):
        before, least = None, 0
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for r, (w, i) in enumerate(zip(batch.column(4).to_pylist(), batch.column(0).to_pylist())):
                if w != before:
                    before, least = w, i
                keep[r] = i > least
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep))

    return rows.repartition("w").sortWithinPartitions("w", "id").mapInArrow(run, "id long, tag long, lo long, hi long")


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 3, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(id, tag, lo, hi): words lo to hi - 1 of a text (tag: its hash) lie in windows that start in a document with a smaller id."""
    spark = docs.sparkSession
    prepare(spark)
    gram = min(gram, window)
    slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    slim = slim.select("id", F.xxhash64("t").alias("tag"), F.col("t").cast("binary").alias("text"))
    volume = 3.0 * total_bytes(slim, "text")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(volume // BUCKET_BYTES) + 1)
    heavy = crowded_minimisers(slim, window, gram)

    def send(batches):
        memory = Memory()
        for part in pieces(batches, "text", SLICE_BYTES):
            ids, tags = part.column(0).to_numpy(), part.column(1).to_numpy()
            order = np.argsort(ids, kind="stable")
            texts = _texts(part)
            joined, starts, ends, counts = words_of([texts[i] for i in order])
            rows = _pack(joined, starts, ends, counts, ids[order].tolist(), tags[order].tolist(), window, gram, heavy, buckets, memory)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def tables(rows):
        for i in range(0, len(rows), 20_000):
            columns = list(zip(*rows[i : i + 20_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "tag", "lo", "hi", "w"])

    def meet(batches):
        bucket = Bucket(window, held_bytes)
        for batch in batches:
            for x in batch.column(1):
                yield from tables(bucket.add(x.as_py()))
        yield from tables(bucket.finish())
        release()

    # a partition holds one bucket
    blobs = slim.mapInArrow(send, "bucket int, blob binary").repartitionById(buckets, "bucket")
    met = materialize(blobs.mapInArrow(meet, "id long, tag long, lo long, hi long, w binary"), "ranges")
    return met.where("w IS NULL").drop("w").unionByName(_judge_windows(met.where("w IS NOT NULL")))


def _with_ranges(docs: DataFrame, name: str, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """docs with the column `name`, the word ranges to remove (null: none)."""
    key, tag = free_name(docs, "id"), free_name(docs, "tag")
    cut = repeated_ranges(docs, id_col, text_col, window, gram).groupBy("id", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias(name))
    cut = cut.select(F.col("id").alias(key), F.col("tag").alias(tag), name)
    return docs.join(cut, (F.col(id_col).cast("long") == F.col(key)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(tag)), "left").drop(key, tag)


def _keep_mask(n: int, lo, hi) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(lo, n), 1)
    np.add.at(edge, np.minimum(hi, n), -1)
    return np.cumsum(edge[:n]) == 0


def cut_text(text: str, lo, hi) -> str:
    """The text without the words of the ranges; every other byte stays but the white space after a removed word."""
    raw = text.encode()
    b = np.frombuffer(raw, np.uint8)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts = edge[0::2]
    keep = _keep_mask(len(starts), lo, hi)
    if keep.all():
        return text
    if not keep.any():
        return ""
    ends = np.concatenate([starts[1:], [len(raw)]])
    head = raw[: starts[0]] if keep[0] else b""
    return (head + b"".join([raw[s:e] for s, e, k in zip(starts.tolist(), ends.tolist(), keep.tolist()) if k])).decode()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, window: int = 13, gram: int = 3) -> DataFrame:
    """docs with repeated windows cut from the text (length_col: gets the new number of code points); a document left without words goes, one that had none stays."""
    prepare(docs.sparkSession)
    cut = free_name(docs, "cut")
    marked = _with_ranges(docs, cut, id_col, text_col, window, gram)

    names = docs.columns
    at = names.index(text_col)
    count_at = names.index(length_col) if length_col else None

    def run(batches):
        for part in pieces(batches, text_col, SLICE_BYTES):
            lo, hi = part.column(len(names)).to_pylist(), part.column(len(names) + 1).to_pylist()
            columns = [part.column(i) for i in range(len(names))]
            text = [v.as_py() if x is None else cut_text(v.as_py(), x, y) for v, x, y in zip(columns[at], lo, hi)]
            keep = [x is None or bool(t.strip()) for t, x in zip(text, lo)]
            columns[at] = pa.array(text, columns[at].type)
            if count_at is not None:
                old = columns[count_at]
                columns[count_at] = pa.array([c.as_py() if x is None else len(t) for c, t, x in zip(old, text, lo)], old.type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    kinds = docs.select(*[F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in names]).schema
    rows = marked.select(*[F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in names], F.col(f"{cut}.lo").alias(free_name(docs, "lo")), F.col(f"{cut}.hi").alias(free_name(docs, "hi")))
    return rows.mapInArrow(run, kinds)


def op5(docs: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    marked = _with_ranges(slim, "cut", "doc_id", "text", 13, 3)
    marked = marked.select("doc_id", F.col("text").cast("binary").alias("text"), F.col("cut.lo").alias("lo"), F.col("cut.hi").alias("hi"))

    def finish(batches):
        for part in pieces(batches, "text", 4 << 20):
            n, gone, sha = [], [], []
            for t, a, b in zip(part.column(1), part.column(2).to_pylist(), part.column(3).to_pylist()):
                words = t.as_py().split() if t.is_valid else []
                n.append(len(words))
                if a:
                    keep = _keep_mask(len(words), a, b)
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                gone.append(n[-1] - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return marked.mapInArrow(finish, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM x),
f AS (SELECT t, min(doc_id) AS least FROM g GROUP BY t),
hit AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS j FROM g JOIN f USING (t) WHERE f.least < g.doc_id),
gone AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM hit GROUP BY doc_id),
kept AS (
  SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.j) AS t
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) a
  ANTI JOIN hit ON a.doc_id = hit.doc_id AND a.j = hit.j GROUP BY a.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
