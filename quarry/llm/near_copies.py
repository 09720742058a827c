"""Groups of near copies: documents joined by links of Jaccard similarity `SIMILARITY` or more over sets of word shingles.

Candidates come from SimHash (the groups of `near_duplicates` over the same shingles) and from bands of minimum hashes: a pair of
similarity j shares one of the bands with probability 1 - (1 - j ** ROWS) ** BANDS, 0.99998 at 0.8. SimHash alone finds too few:
pairs of 0.8 differ in eight or nine bits on average. Documents that candidates join, directly or not, are gathered, and every
link between them is decided on their whole sets.

Cases: equal sets count once; a text of fewer words than a shingle is one shingle; wordless texts are copies of each
other; letters of ASCII are lower-cased; null ids and repeated rows are rows like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Memo, grams, mixed, row_key, texts_of, words_of, written
from .simhash import _LOWER, components, near_duplicates

SIMILARITY, SHINGLE, ROWS, BANDS = 0.8, 5, 5, 28
_BASE = 0x9E3779B97F4A7C15
_XOR = mixed(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(_BASE))
_TIMES = mixed(_XOR) | np.uint64(1)


def shingles(text: bytes, memo: Memo, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = words_of(text.translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    n = min(shingle, len(words))
    return np.unique(mixed(grams(np.array([memo[w] for w in words], dtype=np.uint64), n, _BASE) + np.uint64(n)))


def band_keys(h: np.ndarray) -> np.ndarray:
    """One key a band, of the least hashes of a set that is not empty."""
    least, step = np.empty(ROWS * BANDS, np.uint64), max(1, 65536 // len(h))
    for i in range(0, len(least), step):
        least[i : i + step] = ((h[None, :] ^ _XOR[i : i + step, None]) * _TIMES[i : i + step, None]).min(1)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mixed((key ^ row) * np.uint64(_BASE))
    return key


def linked(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[int]:
    """The number of its group for each set, by all links of `similarity`. No set is empty."""
    n, size = len(sets), np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    group, left = np.full(n, -1), np.ones(n, bool)
    unread = int(size.sum())
    for start in range(n):
        if not left[start]:
            continue
        group[start], left[start], todo = start, False, [start]
        unread -= size[start]
        while todo and unread:
            x = sets[todo.pop()]
            # a set that is similar enough holds one of any so many shingles: the rarest are looked up
            lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
            rare = np.argsort(hi - lo, kind="stable")[: len(x) - math.ceil(similarity * len(x) - 1e-9) + 1]
            if (hi - lo)[rare].sum() < unread:
                near = np.unique(np.concatenate([owner[a:b] for a, b in zip(lo[rare], hi[rare])]))
                near = near[left[near]]
            else:
                near = np.flatnonzero(left)
            near = near[(size[near] >= similarity * len(x) - 1e-9) & (similarity * size[near] <= len(x) + 1e-9)]
            if not len(near):
                continue
            other = np.concatenate([sets[i] for i in near])
            same = x[np.minimum(np.searchsorted(x, other), len(x) - 1)] == other
            both = np.add.reduceat(same.astype(np.int64), np.cumsum(size[near]) - size[near])
            new = near[both * (1 + similarity) >= similarity * (len(x) + size[near]) - 1e-9]
            group[new], left[new] = start, False
            unread -= int(size[new].sum())
            todo.extend(new.tolist())
    return group.tolist()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, k, root): rows of one root are one group; k tells rows of one id apart."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("k", row_key("id", "text"))

    def sketch(batches):
        memo = Memo(xxhash.xxh3_64_intdigest)
        for b in batches:
            sets = [shingles(t, memo) for t in texts_of(b)]
            s = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64).view(np.int64)
            keys = [band_keys(x).view(np.int64) if len(x) else np.zeros(0, np.int64) for x in sets]
            yield pa.record_batch({"k": b.column(0), "s": pa.array(s), "keys": pa.array(keys, pa.list_(pa.int64()))})

    marked = written(own.select("k", "text").mapInArrow(sketch, "k long, s long, keys array<long>"))
    alike = near_duplicates(docs, id_col, text_col, shingle=SHINGLE).select("k", F.xxhash64("root", F.lit(5)).alias("key"))
    bands = marked.groupBy("s").agg(F.first("keys").alias("keys")).select(F.explode("keys").alias("key"), "s")
    met = bands.unionByName(marked.where(F.size("keys") > 0).select("k", "s").join(alike, "k").select("key", "s").distinct())
    edges = met.withColumn("m", F.min("s").over(W.partitionBy("key"))).where("s <> m").select(F.col("s").alias("a"), F.col("m").alias("b"))
    coarse = components(edges).select(F.col("fp").alias("s"), F.col("root").alias("coarse"))
    coarse = written(coarse.unionByName(coarse.select(F.col("coarse").alias("s"), "coarse").distinct()))
    chosen = marked.join(coarse, "s").groupBy("s").agg(F.min("k").alias("k"), F.first("coarse").alias("coarse"))
    texts = own.select("k", "text").join(chosen, "k").select("coarse", "s", "text")

    def decide(batches):
        memo, at, held = Memo(xxhash.xxh3_64_intdigest), None, {}

        def groups():
            names = list(held)
            found = linked(list(held.values()), similarity)
            return pa.record_batch({"s": pa.array(names, pa.int64()), "root": pa.array([names[g] for g in found], pa.int64())})

        for b in batches:
            for c, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b)):
                if c != at and held:
                    yield groups()
                    held = {}
                at = c
                if s not in held:
                    held[s] = shingles(t, memo)
        if held:
            yield groups()

    decided = texts.repartition("coarse").sortWithinPartitions("coarse", "s").mapInArrow(decide, "s long, root long")
    rows = own.select("id", "k").join(marked.select("k", "s").distinct(), "k").join(decided, "s", "left")
    return rows.select(F.col("id").alias(id_col), "k", F.coalesce("root", "s").alias("root"))
