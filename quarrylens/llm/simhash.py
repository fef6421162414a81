"""SimHash near-duplicates: 64-bit fingerprints over word shingles, linked through pigeonhole blocks.

A fingerprint is cut into `distance + 2` blocks; two fingerprints that differ in `distance` bits or fewer agree on
at least two whole blocks, so joining on every pair of blocks finds each close pair. Fingerprints, not documents,
are joined: copies collapse into one row by a partial aggregate before anything is dealt out. A block key that more
than `crowd` fingerprints share is not paired up: its members are keyed by the rest of the fingerprint with each
choice of `distance` bits blanked, where equal keys are within the distance by construction and at most
2**distance distinct fingerprints can meet. That is exact and linear in the members.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; repeated rows share their
fingerprint; a null id takes part in links but never names a component (null if a component has no id at all);
an empty table gives no rows; other columns are not read."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, mix64, pieces, prepare
from .components import components, spread_join

SEED = 42
SLICE_BYTES = 1 << 20
BANDS, ROWS = 20, 4
BLOCK, TOKENS = 256, 4096


def fingerprint_words(words: list[bytes], shingle: int, out: list[int]) -> int:
    """Append the XXH64 of each shingle of lower-cased words to out; the number appended."""
    n = len(words)
    if not n:
        return 0
    digest, line = xxhash.xxh64_intdigest, b" ".join(words)
    if n <= shingle:
        out.append(digest(line, SEED))
        return 1
    starts, ends, at = [], [], 0
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    out += [digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])]
    return n - shingle + 1


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes (counts long), the bits that over half of them set; runs of none give zero."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > counts[full][:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) per row: A-Z lower-cased, words between ASCII white space, shingles joined by one space."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in pieces([batch], "text", SLICE_BYTES):
                hashes, counts = [], []
                for v in part.column(1):
                    words = v.as_py().lower().split() if v.is_valid else []
                    counts.append(fingerprint_words(words, shingle, hashes))
                fp = majority_bits(np.array(hashes, np.uint64), np.array(counts, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return slim.mapInArrow(run, "id long, fp long")


def block_keys(blocks: int, keep: int) -> list[tuple[int, int]]:
    """(table number, mask) of every choice of `keep` of the blocks that 64 bits are cut into."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(blocks)]
    return [(t, sum(masks[i] for i in chosen)) for t, chosen in enumerate(combinations(range(blocks), keep))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def close_pairs(distinct: DataFrame, distance: int = 2, crowd: int = 64) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints (column fp) at `distance` bits or fewer.

    Every pair within the distance is either returned or joined by a path of returned pairs, all within it."""
    tables = block_keys(distance + 2, 2)
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in tables])).alias("b")).select("fp", "b.t", "b.k")
    shared = keyed.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    shared = materialize(shared, "blocks")
    pairs = shared.where("n = 2").select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    members = keyed.join(shared.where("n > 2").select("t", "k", "n"), ["t", "k"])
    few = members.where(F.col("n") <= crowd).groupBy("t", "k").agg(F.array_sort(F.collect_list("fp")).alias("f"))
    few = few.select(F.explode(F.expr(f"flatten(transform(f, (a, i) -> transform(filter(slice(f, i + 2, {crowd}), b -> bit_count(a ^ b) <= {distance}), b -> struct(a AS u, b AS v))))")).alias("p")).select("p.u", "p.v")
    full = (1 << 64) - 1
    blanks = F.lit(None).cast("array<bigint>")
    for t, m in tables:
        free = [i for i in range(64) if not m >> i & 1]
        own = F.array(*[F.lit(_signed(full ^ sum(1 << i for i in bits))) for bits in combinations(free, distance)])
        blanks = F.when(F.col("t") == t, own).otherwise(blanks)
    many = members.where(F.col("n") > crowd).select("t", "fp", F.posexplode(blanks).alias("which", "mask"))
    many = many.groupBy("t", "which", F.col("fp").bitwiseAND(F.col("mask")).alias("k")).agg(F.array_sort(F.collect_set("fp")).alias("f")).where(F.size("f") > 1)
    many = many.select(F.col("f")[0].alias("u"), F.explode(F.expr("slice(f, 2, size(f))")).alias("v"))
    return pairs.unionByName(few).unionByName(many).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """(id, fp, component) per row; component is the smallest id reachable through links."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    comp = components(close_pairs(classes.select("fp"), distance))
    linked = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = linked.groupBy("component").agg(F.min("rep").alias("name"))
    named = materialize(linked.join(names, "component").select("fp", F.col("name").alias("component")), "named")
    return fps.join(named, "fp").select("id", "fp", "component")


def sketches(docs: DataFrame, shingle: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, tag, key, fp, bands) per row (id, tag, text): a digest of the words, the fingerprint, and least hashes of the shingles, by bands."""
    prepare(docs.sparkSession)
    rng = np.random.default_rng(20)
    mult, add = (rng.integers(0, 1 << 63, bands * rows, np.int64).astype(np.uint64) for _ in range(2))
    mult |= np.uint64(1)

    def run(batches):
        for part in pieces(batches, "text", SLICE_BYTES // 2):
            hashes, counts, keys = [], [], []
            for v in part.column(2):
                words = v.as_py().lower().split() if v.is_valid else []
                counts.append(fingerprint_words(words, shingle, hashes))
                keys.append(hashlib.md5(b" ".join(words), usedforsecurity=False).digest())
            h, n = np.array(hashes, np.uint64), np.array(counts, np.int64)
            fp = majority_bits(h, n)
            full = np.flatnonzero(n)
            out = np.zeros((len(n), bands), np.uint64)
            if len(full):
                first = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                for band in range(bands):
                    acc = np.full(len(full), band + 1, np.uint64)
                    for r in range(band * rows, band * rows + rows):
                        acc = mix64(acc ^ np.minimum.reduceat(h * mult[r] + add[r], first))
                    out[full, band] = acc
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(out.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(fp.view(np.int64)), lists], ["id", "tag", "key", "fp", "bands"])

    slim = docs.select("id", "tag", F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, "id long, tag long, key binary, fp long, bands array<long>")


def shingle_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, s): the different shingle hashes of the text of each node (node, id, tag)."""
    prepare(docs.sparkSession)

    def run(batches):
        for part in pieces(batches, "text", SLICE_BYTES):
            out = []
            for v in part.column(1):
                h: list[int] = []
                fingerprint_words(v.as_py().lower().split() if v.is_valid else [], shingle, h)
                out.append(np.unique(np.array(h, np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.int64()))], ["node", "s"])

    own = docs.join(nodes, ["id", "tag"]).dropDuplicates(["node"]).select("node", F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(run, "node long, s array<long>")


def _within(buckets: DataFrame, crowd: int) -> DataFrame:
    """Candidate pairs of rows (t, k, rep): all of a bucket up to crowd members, beyond that each with the least."""
    shared = materialize(buckets.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("n > 1"), "buckets")
    two = shared.where("n = 2").select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    members = buckets.join(shared.where("n > 2").select("t", "k", "n", "lo"), ["t", "k"])
    few = members.where(F.col("n") <= crowd).groupBy("t", "k").agg(F.array_sort(F.collect_set("rep")).alias("f"))
    few = few.select(F.explode(F.expr(f"flatten(transform(f, (a, i) -> transform(slice(f, i + 2, {crowd}), b -> struct(a AS u, b AS v))))")).alias("p")).select("p.u", "p.v")
    star = members.where((F.col("n") > crowd) & (F.col("rep") != F.col("lo"))).select(F.col("lo").alias("u"), F.col("rep").alias("v"))
    return two.unionByName(few).unionByName(star)


def spanning_links(sets: list[np.ndarray], comp: np.ndarray, side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """(row, row) links that join all rows of side against the others at a Jaccard similarity, components aside."""
    n, size = len(sets), np.array([len(x) for x in sets], np.int64)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    often = np.bincount(token)[token] > 1  # what one row alone holds is in no pair
    row, token = row[often], np.unique(token[often], return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    common = np.zeros((n, n), np.float32)
    last = int(token[-1]) + 1 if len(token) else 0
    for low in range(0, last, TOKENS):
        a, b = np.searchsorted(token, [low, low + TOKENS])
        held = np.zeros((n, min(TOKENS, last - low)), np.float32)
        held[row[a:b], token[a:b] - low] = 1
        common += held @ held.T
    common = common.astype(np.int64)
    close = (common >= similarity * (size[:, None] + size[None, :] - common)) & (comp[:, None] != comp[None, :]) & (side[:, None] | side[None, :])
    seen, out = np.zeros(n, bool), []
    for first in range(n):
        if seen[first]:
            continue
        seen[first] = True
        stack = [first]
        while stack:
            x = stack.pop()
            fresh = np.flatnonzero(close[x] & ~seen)
            seen[fresh] = True
            stack += fresh.tolist()
            out += [(x, y) for y in fresh.tolist()]
    return out


def crowd_links(members: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v): verified links between different components c of the rows (t, k, rep, c) of each crowded bucket.

    Rows outside a bucket's largest component are held against all its rows, block by block: a group never has more
    than some 2 * BLOCK rows, and buckets of one component are not looked at."""
    sizes = members.groupBy("t", "k", "c").agg(F.count("*").alias("n"))
    most = sizes.groupBy("t", "k").agg(F.sum("n").alias("rows"), F.max_by("c", F.struct("n", "c")).alias("main"), F.max("n").alias("largest")).where("rows > largest")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("long")
    own = members.join(most, ["t", "k"]).withColumn("left", blocks(F.col("rows") - F.col("largest"))).withColumn("right", blocks(F.col("rows")))
    h = F.xxhash64("rep", F.lit(5))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    stray = own.where("c <> main").withColumn("i", F.pmod(h, F.col("left"))).select("t", "k", "rep", "c", "i", every("right").alias("j"), F.lit(True).alias("side"))
    rest = own.withColumn("j", F.pmod(h, F.col("right"))).select("t", "k", "rep", "c", every("left").alias("i"), "j", F.lit(False).alias("side"))
    dealt = stray.unionByName(rest.select(stray.columns)).groupBy("t", "k", "i", "j", "rep", "c").agg(F.max("side").alias("side"))
    dealt = materialize(dealt, "crowd_blocks")
    if dealt.isEmpty():
        return members.limit(0).select(F.col("rep").alias("u"), F.col("rep").alias("v"))
    own = nodes.join(dealt.select(F.col("rep").alias("node")).distinct(), "node", "left_semi")
    sets = materialize(shingle_sets(docs, own, shingle), "shingles")

    def compare(frame):
        import pandas as pd

        side = frame.side.to_numpy(bool)
        rep = frame.rep.to_numpy()
        found = spanning_links(frame.s.tolist(), frame.c.to_numpy(), side, similarity) if side.any() else []
        at = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": rep[at[:, 0]], "v": rep[at[:, 1]]})

    return dealt.join(sets.withColumnRenamed("node", "rep"), "rep").groupBy("t", "k", "i", "j").applyInPandas(compare, "u long, v long").distinct()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, text) of the rows with an id; tag is a hash of the text that tells rows of one id apart."""
    text = F.col(text_col).cast("string")
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, distance: int = 2, crowd: int = 64) -> DataFrame:
    """(id, tag, component, first) per row with an id: documents linked by a Jaccard similarity of shingle sets, verified exactly.

    component is the least id of a group, first the tag (hash of the text) of its least row. At this similarity
    fingerprints differ in 10 bits and more, far beyond what blocks of 64 bits can find, so
    candidates come from two searches: fingerprints within `distance` by pigeonhole blocks, and bands of least
    hashes, which miss a pair at 0.8 once in some 38,000 times. Texts of equal words are one node in both, whatever
    their ids: a node is a text, not an id. Buckets
    of over crowd rows first pair all rows that also share the next band, and every row with the bucket's least; rows
    that this leaves in different components are then held against each other in full (crowd_links)."""
    docs = _rows(docs, id_col, text_col)
    own = materialize(sketches(docs, shingle), "sketches")
    reps = own.groupBy("key").agg(F.min(F.struct("id", "tag")).alias("r"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    # the numbers stand once the table is written, whatever task wrote which row
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("rep"), "key", "r.id", "r.tag", "fp", "bands"), "representatives")
    nodes = reps.select(F.col("rep").alias("node"), "id", "tag")
    by_fp = materialize(reps.groupBy("fp").agg(F.min("rep").alias("least"), F.count("*").alias("n")), "classes")
    near = close_pairs(by_fp.select("fp"), distance, crowd)
    least = by_fp.select("fp", "least")
    close = near.join(least.select(F.col("fp").alias("u"), F.col("least").alias("a")), "u").join(least.select(F.col("fp").alias("v"), F.col("least").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    equal = reps.join(by_fp.where("n > 1").select("fp", "least"), "fp").where("rep <> least").select(F.col("least").alias("u"), F.col("rep").alias("v"))
    keyed = reps.select("rep", F.posexplode("bands").alias("t", "k"), F.col("bands").alias("all"))
    crowded = materialize(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("t", "k"), "crowds")
    deeper = keyed.join(crowded, ["t", "k"], "left_semi").select("rep", F.xxhash64("t", "k").alias("t"), F.xxhash64("k", F.element_at("all", F.pmod(F.col("t") + 1, F.size("all")) + 1)).alias("k"))
    pairs = close.unionByName(equal).unionByName(_within(keyed.select("rep", "t", "k"), crowd)).unionByName(_within(deeper, crowd))
    pairs = materialize(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "candidates")
    some = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    sets = materialize(shingle_sets(docs, nodes.join(some, "node", "left_semi"), shingle), "shingles")
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    links = materialize(both.where(common >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v"), "links")
    comp = materialize(components(links), "components")
    members = materialize(keyed.join(crowded, ["t", "k"], "left_semi").select("t", "k", "rep").join(comp, F.col("rep") == F.col("node"), "left").select("t", "k", "rep", F.coalesce("component", "rep").alias("c")), "crowd_members")
    more = materialize(crowd_links(members, docs, nodes, shingle, similarity), "crowd_links")
    if not more.isEmpty():
        comp = materialize(components(links.unionByName(more)), "components")
    # texts of one row a group are their own answer; only linked ones are named by their group
    linked = materialize(reps.select("key", "rep", "id", "tag").join(comp, F.col("rep") == F.col("node")).select("key", "component", "id", "tag"), "linked")
    names = linked.groupBy("component").agg(F.min(F.struct("id", "tag")).alias("r"), F.count("*").alias("n"))
    named = spread_join(linked.select("key", "component"), names, "component", linked.count()).select("key", "r")
    named = named.unionByName(reps.join(comp, F.col("rep") == F.col("node"), "left_anti").select("key", F.struct("id", "tag").alias("r")))
    sizes = own.groupBy("key").agg(F.count("*").alias("n"))
    named = materialize(named.join(sizes, "key"), "named")
    return spread_join(own.select("id", "tag", "key"), named, "key", own.count()).select("id", "tag", F.col("r.id").alias("component"), F.col("r.tag").alias("first"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without all but one row (the smallest id) of each group of similar texts; rows without an id stay.

    Rows are judged by their texts: different texts under one id are documents of their own, repeated rows are copies."""
    found = similar_groups(docs, id_col, text_col, shingle, similarity)
    found = materialize(found.select("id", "tag", ((F.col("id") == F.col("component")) & (F.col("tag") == F.col("first"))).alias("stays")).groupBy("id", "tag", "stays").agg(F.count("*").alias("n")), "decisions")
    key, mark = free_name(docs, "id"), free_name(docs, "tag")
    name = lambda df: df.select(F.col("id").alias(key), F.col("tag").alias(mark))
    same = (F.col(id_col).cast("long") == F.col(key)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(mark))
    again = found.where("stays AND n > 1")
    if again.isEmpty():
        return docs.join(name(found.where("NOT stays")), same, "left_anti")
    once = docs.join(name(found.where("NOT stays OR n > 1")), same, "left_anti")
    return once.unionByName(docs.join(name(again), same, "left_semi").dropDuplicates([id_col, text_col]))


def op2(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
