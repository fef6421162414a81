"""Language identification with a bit-sliced Bloom filter of character n-grams.

Each language owns one bit of a mask. The filter is one array of masks: adding an n-gram of a language sets that bit
at HASHES places, and AND-ing the masks at those places returns every language that may contain the n-gram in one
look-up. Over a whole text, the popcount of each bit is the number of n-grams that language contains plus its false
positives, whose rate is known from how full its slice is; the corrected count decides.

A language's filter holds the n-grams that make up at least MIN_SHARE of its own n-grams (the KEEP commonest at most:
about what the array takes at one false positive in a hundred for each of the languages); others may hold them too.
It is fitted on at most `per_language` labelled rows a language (least hash of id first), texts
whole; the array has a fixed size, so what is sent to tasks does not grow with the data.

Defined cases: a text that is null or has no letter is `und` with score 0; ties go to the first language in order;
with no labelled rows every text is `und`; repeated rows get equal answers; other columns are not read."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, mix64, pieces, prepare

ORDERS = (1, 2, 3, 4)
SLOTS = 1 << 20
HASHES = 3
MIN_SHARE = 2e-6
KEEP = 60_000
SLICE_BYTES = 384 << 10
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of lower-cased texts, the text of each, and whether each text has a letter.

    Runs of other characters than letters count as one space, also at both ends of a text."""
    padded = [f" {(t or '').lower()} " for t in texts]
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, padded), np.int64, len(padded)))
    letter = _letters()[c]
    has = np.bincount(doc, weights=letter, minlength=len(texts)) > 0
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
    c, doc = np.where(letter, c, np.uint32(32))[keep].astype(np.uint64), doc[keep]
    hashes, owners = [], []
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(c) - n + 1] * np.uint64(0x1F123BB5) + c[n - 1 :] + np.uint64(1)
        if n in ORDERS:
            ok = doc[: len(h)] == doc[n - 1 :]
            if n == 1:
                ok = ok & (c != 32)
            hashes.append(mix64(h[ok] + np.uint64(n << 56)))
            owners.append(doc[: len(h)][ok])
    return np.concatenate(hashes), np.concatenate(owners), has


def places(h: np.ndarray) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


class Filter:
    """The array of language masks; `counts` gives corrected popcounts of texts."""

    def __init__(self, languages: list[str], grams: dict[str, np.ndarray]):
        self.languages = languages
        bits = max(8, 1 << max(0, len(languages) - 1).bit_length()) if len(languages) <= 64 else 64 * -(-len(languages) // 64)
        self.words = max(1, bits // 64)
        kind = {8: np.uint8, 16: np.uint16, 32: np.uint32}.get(bits, np.uint64)
        self.masks = np.zeros((self.words, SLOTS), kind)
        self.rate = np.zeros(len(languages))
        for b, name in enumerate(languages):
            word, bit = divmod(b, 64)
            for p in places(grams[name]):
                self.masks[word][p] |= kind(1 << bit)
            self.rate[b] = (self.masks[word] >> kind(bit) & kind(1)).mean() ** HASHES

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(corrected n-grams by text and language, n-grams by text, whether it has a letter)."""
        h, doc, has = ngrams(texts)
        total = np.bincount(doc, minlength=len(texts)).astype(float)
        at = places(h)
        found = np.zeros((len(texts), len(self.languages)))
        for w in range(self.words):
            mask = self.masks[w][at[0]]
            for p in at[1:]:
                mask &= self.masks[w][p]
            for b in range(64 * w, min(64 * w + 64, len(self.languages))):
                hit = doc[(mask >> mask.dtype.type(b - 64 * w) & mask.dtype.type(1)).astype(bool)]
                found[:, b] = np.bincount(hit, minlength=len(texts))
        return np.clip((found - total[:, None] * self.rate) / (1 - self.rate), 0, None), total, has

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and a score: its corrected share of n-grams, times its lead over the next language."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        found, total, has = self.counts(texts)
        best = found.argmax(axis=1)
        top = np.sort(found, axis=1)
        first = top[:, -1]
        second = top[:, -2] if len(self.languages) > 1 else np.zeros(len(texts))
        score = np.where(first > 0, np.minimum(1, first / np.maximum(total, 1)) * (0.5 + 0.5 * (first - second) / np.maximum(first, 1e-9)), 0)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, has)]
        return names, np.where(has, np.clip(score, 0, 1), 0.0)


def gram_table(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A language's commonest n-grams with their shares."""
    hs, ns = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for i in range(0, len(texts), 50):
        h, n = np.unique(ngrams(texts[i : i + 50])[0], return_counts=True)
        merged, inverse = np.unique(np.concatenate([hs, h]), return_inverse=True)
        hs, ns = merged, np.bincount(inverse, weights=np.concatenate([ns, n])).astype(np.int64)
    share = ns / max(1, ns.sum())
    order = np.argsort(-share, kind="stable")[:KEEP]
    order = order[(share[order] >= MIN_SHARE) & (ns[order] > 1)] if len(texts) > 20 else order
    return hs[order], share[order]


def fit(docs: DataFrame, per_language: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filter:
    """A filter from labelled rows: at most per_language rows a language, those with the least hash of their id."""
    prepare(docs.sparkSession)
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.lit(7)).alias("h"), F.col(text_col).cast("string").alias("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Filter([], {})
    # a first cut by hash keeps about twice the bound; the exact bound is then taken from those few
    limit = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(2**63 - 1, int(min(1.0, 2.0 * (per_language + 50) / n) * 2**64) - 2**63))])[F.col("lang")]
    near = rows.where(F.col("h") <= limit)

    def table(key, frame):
        import pandas as pd

        own = frame.sort_values(["h", "text"]).head(per_language)
        h, share = gram_table(own.text.tolist())
        return pd.DataFrame({"lang": [key[0]], "h": [h.view(np.int64)], "share": [share]})

    got = near.groupBy("lang").applyInPandas(table, "lang string, h array<long>, share array<double>").collect()
    tables = {r.lang: (np.array(r.h, np.int64).view(np.uint64), np.array(r.share)) for r in got}
    languages = sorted(tables)
    return Filter(languages, {k: h for k, (h, _) in tables.items()})


def identify(docs: DataFrame, model: Filter, keep: list[str], text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """The columns named in keep, with the predicted language and its score, per row."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)
    whole = free_name(docs, "text")
    slim = docs.select(*keep, F.col(text_col).cast("string").alias(whole))

    def run(batches):
        for part in pieces(batches, whole, SLICE_BYTES):
            names, score = sent.value.predict(part.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], pa.array(names, pa.string()), pa.array(score, pa.float64())], [*keep, lang_as, score_as])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInArrow(run, f"{kinds}, `{lang_as}` string, `{score_as}` double")


def held_out(column: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10(docs: DataFrame) -> DataFrame:
    model = fit(docs.where(~held_out()))
    return identify(docs.withColumn("held_out", held_out()).select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])


def accept(docs: DataFrame, min_score: float = 0.05) -> DataFrame:
    """docs whose language can be told: a letter at all, and a score of min_score or more. All columns stay."""
    model = fit(docs.where(~held_out()))
    lang, score = free_name(docs, "lang"), free_name(docs, "score")
    found = identify(docs, model, docs.columns, lang_as=lang, score_as=score)
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= min_score)).select(*docs.columns)
