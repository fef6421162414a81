"""SentencePiece ids by forward filtering and backward sampling over the piece lattice, and lossless decoding.

A text is cut into chunks, each a run of spaces with the non-spaces after it; no piece of the vocabulary crosses a
chunk's start, so a chunk's segmentations are independent of its neighbours. All different chunks of a slice of rows
become one lattice over bytes: an arc for every piece, byte pieces for characters that have none. The forward pass
sums path weights up to every position; the backward pass draws, for all occurrences at once, the last piece in
proportion to its share, then the one before it. Draws come from a counter-based generator keyed by the row's key,
the chunk's number and the step, so a row is segmented alike in any batch, task or run.

The vocabulary is a merge list without probabilities; an arc weighs alpha * -log(1 + rank) (Zipf's law over the
merge order): a large alpha approaches the heaviest path, a small one spreads evenly. Text is decoded by joining the
bytes of the pieces and taking off the one space put before a text; every slice is decoded and compared, and rows
whose chunks met in a hash collision are done again one by one.

Defined cases: a null or empty text has no ids; a literal U+2581 is spelt in byte pieces, as a piece's own mark
means a space; repeated rows get equal ids; a null key is a key of its own; an empty table gives no rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, free_name, hash_of, mix64, prepare, span_hashes, span_sums
from .common import pieces as slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SLICE_BYTES = 2 << 20
LARGE, SMALL = 20, 16


class Vocabulary:
    """A piece model's pieces as bytes, with a hash table over them; read on the driver, sent to tasks."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.spell: list[bytes] = [b""] * n
        self.byte_id = np.full(256, -1, np.int64)
        normal = []
        for i in range(n):
            if model.is_byte(i):
                b = int(model.id_to_piece(i)[3:5], 16)
                self.spell[i], self.byte_id[b] = bytes([b]), i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.spell[i] = model.id_to_piece(i).replace(MARK, " ").encode()
                normal.append(i)
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces; decoding could not be lossless")
        for i in normal:
            if b" " in self.spell[i].lstrip(b" "):
                raise ValueError("a piece has a space after another character")
        ids = np.array(normal, np.int64)
        rank = np.arange(len(ids))
        self.log_weight = np.full(n, -np.log(2.0 + len(ids)))
        self.log_weight[ids] = -np.log(1.0 + rank + 1)
        self.sizes = np.array([len(s) for s in self.spell], np.int64)
        self.bytes = np.frombuffer(b"".join(self.spell), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.lengths = np.unique(self.sizes[ids])
        h = span_hashes(self.bytes, self.starts[ids], self.starts[ids] + self.sizes[ids])
        if len(np.unique(h)) != len(h):
            raise ValueError("two pieces share a hash")
        self.tables = []
        for bits in (LARGE, SMALL, SMALL, SMALL):
            tag, key, value = np.zeros(1 << bits, np.uint8), np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            at = self._slot(h, bits, len(self.tables))
            _, first = np.unique(at, return_index=True)
            tag[at[first]], key[at[first]], value[at[first]] = self._tag(h[first]), h[first], ids[first]
            self.tables.append((bits, tag, key, value))
            rest = np.ones(len(h), bool)
            rest[first] = False
            h, ids = h[rest], ids[rest]
            if not len(h):
                break
        else:
            raise ValueError("the piece table did not settle")

    @staticmethod
    def _slot(h: np.ndarray, bits: int, level: int) -> np.ndarray:
        return ((h * np.uint64(2 * level + 1)) >> np.uint64(64 - bits)).astype(np.int64) if level else (h >> np.uint64(64 - bits)).astype(np.int64)

    @staticmethod
    def _tag(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(255)).astype(np.uint8) | np.uint8(1)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and those pieces."""
        own, tags = [], self._tag(h)
        for level, (bits, tag, key, value) in enumerate(self.tables):
            at = self._slot(h, bits, level)
            maybe = np.flatnonzero(tag[at] == tags)
            at = at[maybe]
            hit = key[at] == h[maybe]
            own.append((maybe[hit], value[at[hit]]))
        return np.concatenate([x for x, _ in own]), np.concatenate([v for _, v in own])


def _char_sizes(raw: np.ndarray) -> np.ndarray:
    """Bytes of the character that starts at each byte (0 inside one)."""
    return np.where(raw < 0x80, 1, np.where(raw < 0xC0, 0, np.where(raw < 0xE0, 2, np.where(raw < 0xF0, 3, 4))))


class Lattice:
    """Arcs of many chunks, by the position where they end, with forward sums and arc probabilities."""

    def __init__(self, vocab: Vocabulary, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, alpha: float):
        n = ends - starts
        self.base = np.cumsum(n + 1) - (n + 1)  # node of each chunk's start
        self.end = self.base + n
        total = int(n.sum())
        first_byte = np.cumsum(n) - n
        raw = raw[np.repeat(starts - first_byte, n) + np.arange(total)]  # the chunks alone, end to end
        chunk = np.repeat(np.arange(len(n)), n)
        pos = np.arange(total) - first_byte[chunk]
        room = n[chunk] - pos
        froms, tos, ids = [], [], []
        char = _char_sizes(raw)
        covered = np.zeros(total, bool)
        node = (self.base[chunk] + pos).astype(np.int32)
        sums, down = span_sums(raw)
        ok = np.flatnonzero(char > 0)
        for length in vocab.lengths.tolist():
            ok = ok[room[ok] >= length]
            if not len(ok):
                break
            hit, found = vocab.find(hash_of(sums[ok + length] - sums[ok], down[ok], length))
            own = ok[hit]
            covered[own[char[own] == length]] = True
            froms.append(node[own])
            tos.append(node[own] + np.int32(length))
            ids.append(found)
        lead = np.flatnonzero((char > 0) & ~covered)
        bare = np.repeat(lead, char[lead]) + np.arange(char[lead].sum()) - np.repeat(np.cumsum(char[lead]) - char[lead], char[lead])
        froms.append(node[bare])
        tos.append(node[bare] + np.int32(1))
        ids.append(vocab.byte_id[raw[bare]].astype(np.int32))
        src, dst, piece = np.concatenate(froms), np.concatenate(tos), np.concatenate(ids)
        nodes = int(self.end[-1]) + 1
        step = np.zeros(nodes, np.uint16 if int(n.max(initial=0)) < 1 << 16 else np.int64)  # position of a node in its chunk
        step[node + 1] = pos + 1
        by = np.argsort((dst & 0xFFFF).astype(np.uint16), kind="stable")  # by the node where they end, in two radix passes
        by = by[np.argsort((dst[by] >> 16).astype(np.uint16 if nodes < 1 << 32 else np.int64), kind="stable")]
        self.src, self.piece, final = src[by], piece[by], dst[by]
        order = np.argsort(step[final], kind="stable")
        src, dst, piece = self.src[order], final[order], self.piece[order]
        weight = alpha * vocab.log_weight[piece]
        forward = np.full(nodes, -np.inf)
        forward[self.base] = 0.0
        share = np.empty(len(src))
        edges = np.searchsorted(step[dst], np.arange(1, int(n.max()) + 2)) if len(n) else np.zeros(1, np.int64)
        heads = np.concatenate([[True], dst[1:] != dst[:-1]]) if len(dst) else np.zeros(0, bool)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if a == b:
                continue
            x = forward[src[a:b]] + weight[a:b]
            first = np.flatnonzero(heads[a:b])
            most = np.maximum.reduceat(x, first)
            size = np.diff(np.append(first, b - a))
            p = np.exp(x - np.repeat(most, size))
            total_p = np.add.reduceat(p, first)
            forward[dst[a + first]] = most + np.log(total_p)
            share[a:b] = p / np.repeat(total_p, size)
        own = np.empty(len(share))
        own[order] = share
        first = np.concatenate([[True], final[1:] != final[:-1]])
        begin = np.flatnonzero(first)
        self.first = np.zeros(nodes, np.int32)  # a node's first arc
        self.first[final[begin]] = begin
        # shares are summed node by node, so that no rounding of other nodes of the slice comes in
        left, at = np.diff(np.append(begin, len(final))), begin
        while (more := left > 1).any():
            at, left = at[more] + 1, left[more] - 1
            own[at] += own[at - 1]
        self.upto = own
        self.upto[np.append(begin[1:] - 1, len(final) - 1)] = 2.0
        self.forward = forward

    def sample(self, which: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For occurrences of chunks, each with its own seed: piece ids, one occurrence after another, and pieces of each."""
        node, live = self.end[which], np.arange(len(which))
        counts = np.zeros(len(which), np.int64)
        steps = []
        k = 0
        while len(live):
            r = mix64(seed[live] + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            u = (r >> np.uint64(11)).astype(np.float64) * 2.0**-53
            arc = self.first[node]
            on = np.flatnonzero(self.upto[arc] <= u)
            while len(on):
                arc[on] += 1
                on = on[self.upto[arc[on]] <= u[on]]
            steps.append((live, self.piece[arc]))
            counts[live] += 1
            node = self.src[arc]
            more = node > self.base[which[live]]
            live, node = live[more], node[more]
            k += 1
        stop = np.cumsum(counts)
        out = np.empty(int(stop[-1]) if len(stop) else 0, np.int32)
        for k, (own, piece) in enumerate(steps):
            out[stop[own] - 1 - k] = piece
        return out, counts


def decode(vocab: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of rows of ids, without the space before each, and where each row starts (and the last ends)."""
    size = vocab.sizes[ids]
    at = np.cumsum(size) - size
    raw = vocab.bytes[np.repeat(vocab.starts[ids] - at, size) + np.arange(int(size.sum()))]
    row = np.concatenate([[0], np.cumsum(counts)])
    edge = np.append(at, len(raw))[row]
    keep = np.ones(len(raw), bool)
    keep[edge[:-1][counts > 0]] = False
    return raw[keep], edge - np.concatenate([[0], np.cumsum(counts > 0)])


def encode(vocab: Vocabulary, texts: list[bytes], seeds: np.ndarray, alpha: float, by_bytes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and the number of ids of each.

    Equal chunks share a lattice, by a hash of their bytes; should the decoded texts tell that different chunks shared
    one, texts are taken one by one, and such a text's chunks by their bytes."""
    joined = b"".join([b" " + t for t in texts if t])
    full = np.array([bool(t) for t in texts], bool)
    if not joined:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    raw = np.frombuffer(joined, np.uint8)
    lens = np.array([len(t) + 1 for t in texts if t], np.int64)
    begin = np.cumsum(lens) - lens
    space = raw == 32
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[begin] = True
    a = np.flatnonzero(start)
    b = np.append(a[1:], len(raw))
    doc = np.searchsorted(begin, a, "right") - 1
    if by_bytes:
        seen: dict[bytes, int] = {}
        h = np.array([seen.setdefault(joined[x:y], len(seen)) for x, y in zip(a.tolist(), b.tolist())], np.int64)
    else:
        h = span_hashes(raw, a, b)
    _, pick, which = np.unique(h, return_index=True, return_inverse=True)
    lattice = Lattice(vocab, raw, a[pick], b[pick], alpha)
    number = np.arange(len(a)) - np.searchsorted(doc, doc)
    seed = mix64(seeds[full][doc] + (number + 1).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    ids, per_chunk = lattice.sample(which, seed)
    counts = np.zeros(len(texts), np.int64)
    counts[full] = np.bincount(doc, weights=per_chunk, minlength=int(full.sum())).astype(np.int64)
    back, edge = decode(vocab, ids, counts)
    if back.tobytes() != b"".join(texts):
        if by_bytes:
            raise AssertionError("decoding lost bytes")
        if len(texts) == 1:
            return encode(vocab, texts, seeds, alpha, by_bytes=True)
        parts = [encode(vocab, [t], seeds[i : i + 1], alpha) for i, t in enumerate(texts)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    return ids, counts


def tokenize(docs: DataFrame, keep: list[str], key_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = 1.0, seed: int = 3) -> DataFrame:
    """The columns named in keep, with ids (array of int), n_ids and decoded_sha256 (of the text decoded from the ids)."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(Vocabulary(model))
    name, whole = free_name(docs, "seed"), free_name(docs, "text")
    slim = docs.select(*keep, F.xxhash64(F.col(key_col).cast("string"), F.lit(seed)).alias(name), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias(whole))
    k = len(keep)

    def run(batches):
        vocab = sent.value
        for part in slices(batches, whole, SLICE_BYTES):
            raw, off = byte_view(part.column(k + 1))
            texts = [raw[x:y].tobytes() for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
            ids, counts = encode(vocab, texts, part.column(k).to_numpy().view(np.uint64), alpha)
            back, edge = decode(vocab, ids, counts)
            out = back.tobytes()
            sha = [hashlib.sha256(out[x:y]).hexdigest() for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(k)], lists, pa.array(counts, pa.int32()), pa.array(sha, pa.string())], [*keep, "ids", "n_ids", "decoded_sha256"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInArrow(run, f"{kinds}, ids array<int>, n_ids int, decoded_sha256 string")


def detokenize(rows: DataFrame, keep: list[str], ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """The columns named in keep, with text: the bytes of the ids, without the space before them (null ids: null)."""
    spark = rows.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(Vocabulary(model))
    slim = rows.select(*keep, F.col(ids_col).cast("array<int>").alias("__ids"))

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(len(keep)):
                ids = np.array(x.as_py() or [], np.int64)
                out.append(None if not x.is_valid else decode(sent.value, ids, np.array([len(ids)]))[0].tobytes().decode())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(out, pa.string())], [*keep, "text"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInArrow(run, f"{kinds}, text string")


def op3(docs: DataFrame) -> DataFrame:
    return tokenize(docs, ["doc_id"])
