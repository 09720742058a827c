"""SimHash near-duplicates: fingerprints, links within a few bits by anchor-point covering, and components.

Covering. The 64 bits are cut into blocks of which, for two fingerprints within `radius` bits, one block
differs by at most t = radius // blocks bits. The anchors of a block are a code with covering radius R: every
block value has a home anchor within R bits. A fingerprint sits at its home, and is replicated to every anchor within
R + t bits, so of each linked pair one meets the other's replica at an anchor, whichever anchors are near. Only
these are compared. The code is a product of (7, 4) Hamming codes, each of covering radius 1, and free bits.

Equal fingerprints count once. At an anchor links are kept as a spanning forest (at most one row per
fingerprint), never as all pairs. Anchors with many homes are dealt out by blocks of homes.

Cases: null or wordless text has fingerprint zero and links like any other; a repeated row gets the same
result; null ids never name a component unless all ids of it are null; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed, row_key, texts_of, words_of, written

RADIUS, SHINGLE, SEED = 4, 4, 42
HOMES = 4096  # homes of one anchor that are compared in one group
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_H7 = [v for v in range(128) if not ((s := [v >> i & 1 for i in range(7)])[0] ^ s[2] ^ s[4] ^ s[6] or s[1] ^ s[2] ^ s[5] ^ s[6] or s[3] ^ s[4] ^ s[5] ^ s[6])]


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = words_of(text.translate(_LOWER))
    if not words:
        return 0
    if len(words) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], dtype=np.uint64)
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65536):
        total += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, k, fp): fp is the fingerprint's 64 bits as a signed long."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("k", row_key("id", "text"))

    def mark(batches):
        for b in batches:
            fp = np.array([simhash(t, shingle, seed) for t in texts_of(b)], dtype=np.uint64).view(np.int64)
            yield pa.record_batch({"id": b.column(0), "k": b.column(2), "fp": pa.array(fp, pa.int64())})

    return own.mapInArrow(mark, T.StructType([own.schema["id"], T.StructField("k", T.LongType()), T.StructField("fp", T.LongType())]))


class Cover:
    """Homes and replicas of one block: `codes` Hamming (7, 4) parts, the rest of the `width` bits free."""

    def __init__(self, width: int, codes: int, t: int):
        self.width, self.codes, reach = width, codes, codes + t
        near = np.bitwise_count(np.arange(128, dtype=np.uint8)[:, None] ^ np.array(_H7, dtype=np.uint8)[None, :])
        self.home = np.array(_H7, dtype=np.int64)[near.argmin(1)]
        masks = {0: 0}  # flips of free bits, by number
        for _ in range(t):
            masks |= {m ^ 1 << i: c + 1 for m, c in masks.items() for i in range(width - 7 * codes) if m ^ 1 << i not in masks}
        self.free = [(c, m) for m, c in masks.items()]
        self.near, self.reach = near.astype(np.int64), reach

    def homes(self, v: np.ndarray) -> np.ndarray:
        out = v >> (7 * self.codes) << (7 * self.codes)
        for i in range(self.codes):
            out |= self.home[v >> (7 * i) & 127] << (7 * i)
        return out

    def replicas(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into v, anchor) of all anchors within reach."""
        idx, anchor, left = np.arange(len(v)), v >> (7 * self.codes) << (7 * self.codes), np.full(len(v), self.reach)
        for i in range(self.codes):
            part = v[idx] >> (7 * i) & 127
            near = self.near[part]
            ok = near <= left[:, None]
            r, c = np.nonzero(ok)
            idx, anchor, left = idx[r], anchor[r] | np.array(_H7)[c] << (7 * i), left[r] - near[r, c]
        out_i, out_a = [], []
        for cost, m in self.free:
            ok = left >= cost
            out_i.append(idx[ok])
            out_a.append(anchor[ok] ^ (m << (7 * self.codes)))
        return np.concatenate(out_i), np.concatenate(out_a)


def blocks_for(n: int, radius: int, wide: bool | None = None) -> list[tuple[int, Cover]]:
    """(shift, cover) of each block: three blocks, or two wider ones, by themselves where fingerprints are many. Both find every link."""
    wide = n >= 1 << 25 if wide is None else wide
    sizes = [32, 32] if wide else [22, 21, 21]
    t = radius // len(sizes)
    shifts = np.cumsum([0, *sizes[:-1]])
    return [(int(s), Cover(w, 1 if w < 30 else 2, t)) for s, w in zip(shifts, sizes)]


def _compare(h: np.ndarray, r: np.ndarray, radius: int):
    """Spanning forest of the links between homes h and replicas r of one anchor: (value, root)."""
    values = np.unique(np.concatenate([h, r]))
    parent = np.arange(len(values))

    def roots(x):
        while True:
            up = parent[x]
            if (up == x).all():
                return x
            parent[x] = parent[up]
            x = up

    at = np.searchsorted(values, r)
    step = max(1, 4_000_000 // max(1, len(r)))
    for i in range(0, len(h), step):
        own = h[i : i + step]
        near = np.bitwise_count(own[:, None] ^ r[None, :]) <= radius
        linked = near.sum(1)
        for k in np.flatnonzero(linked > 1):  # a home meets its own replica too
            top = np.unique(roots(at[near[k]]))
            if len(top) > 1:
                parent[top[1:]] = top[0]
    root = roots(np.arange(len(values)))
    moved = root != np.arange(len(values))
    return values[moved], values[root[moved]]


def links(fps: DataFrame, radius: int = RADIUS, wide: bool | None = None) -> DataFrame:
    """(a, b), distinct fingerprints joined by links within radius bits: enough of them to span every component. wide: see blocks_for()."""
    blocks = blocks_for(fps.count() if wide is None else 0, radius, wide)

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fp), 20_000):
                part = fp[i : i + 20_000]
                for b, (shift, cover) in enumerate(blocks):
                    v = (part >> np.uint64(shift)).astype(np.int64) & ((1 << cover.width) - 1)
                    idx, anchor = cover.replicas(v)
                    home = cover.homes(v)
                    key = np.concatenate([anchor, home]) << 2 | b
                    val = np.concatenate([part[idx], part]).view(np.int64)
                    yield pa.record_batch({"key": pa.array(key), "fp": pa.array(val), "home": pa.array(np.arange(len(key)) >= len(anchor))})

    rows = fps.select("fp").mapInArrow(deal, "key long, fp long, home boolean")
    hot = rows.where("home").groupBy("key").count().where(F.col("count") > HOMES).select("key", F.ceil(F.col("count") / HOMES).cast("int").alias("parts"))
    hot = written(hot)
    if hot.isEmpty():
        dealt = rows.withColumn("part", F.lit(0))
    else:
        n_part = F.coalesce("parts", F.lit(1))
        own = F.when(F.col("home"), F.array(F.pmod(F.xxhash64("fp"), n_part).cast("int"))).otherwise(F.sequence(F.lit(0), n_part - 1))
        dealt = rows.join(hot, "key", "left").withColumn("part", F.explode(own)).drop("parts")

    def meet(batches):
        held: list[np.ndarray] = []

        def groups(rec, whole):
            cut = np.flatnonzero((np.diff(rec["key"]) != 0) | (np.diff(rec["part"]) != 0)) + 1
            bounds = np.concatenate([[0], cut, [len(rec)]])
            a, b = [], []
            for s, e in zip(bounds[:-1] if whole else bounds[:-2], bounds[1:] if whole else bounds[1:-1]):
                g = rec[s:e]
                is_home = g["home"]
                if e - s > 2 and is_home.any():
                    x, y = _compare(g["fp"][is_home], g["fp"][~is_home], radius)
                    a.append(x)
                    b.append(y)
            rest = rec[len(rec):] if whole else rec[bounds[-2]:]
            if a and sum(map(len, a)):
                return rest, pa.record_batch({"a": pa.array(np.concatenate(a).view(np.int64)), "b": pa.array(np.concatenate(b).view(np.int64))})
            return rest, None

        kind = np.dtype([("key", np.int64), ("part", np.int32), ("fp", np.uint64), ("home", bool)])
        for batch in batches:
            rec = np.zeros(batch.num_rows, dtype=kind)
            for k in kind.names:
                col = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
                rec[k] = col.view(np.uint64) if k == "fp" else col
            held.append(rec)
            if len(held) > 1 and held[0][0]["key"] == rec[-1]["key"] and held[0][0]["part"] == rec[-1]["part"]:
                continue  # one large group: wait for its end
            rest, out = groups(np.concatenate(held), False)
            held = [rest]
            if out:
                yield out
        if held:
            _, out = groups(np.concatenate(held), True)
            if out:
                yield out

    met = dealt.repartition("key", "part").sortWithinPartitions("key", "part").select("key", "part", "fp", "home")
    return met.mapInArrow(meet, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(fp, root) for every vertex of the edges: large-star and small-star steps to a fixed point, each written to the shared folder."""
    pairs = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        if pairs.isEmpty():
            break
        both = pairs.union(pairs.select("v", "u")).toDF("x", "y")
        low_x = written(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
        large = both.where("y > x").join(low_x.hint("shuffle_merge"), "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        step = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = written(step)
        freed(low_x)
        same = (new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
                == pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        freed(pairs)
        pairs = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, k, fp, root, component): component is the smallest id reachable over links, own id included; k tells rows of one id apart,
    and root, a fingerprint, tells groups apart, which may share a component where ids repeat or are null."""
    marked = written(fingerprints(docs, id_col, text_col, shingle, seed))
    roots = components(links(marked.select("fp").distinct(), radius))
    placed = marked.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # written, so that both sides of the join are plain exchanges and the partition of a large group can be split
    placed = written(placed)
    least = written(placed.groupBy("root").agg(F.min("id").alias("component")))
    return placed.join(least.hint("shuffle_merge"), "root").select(F.col("id").alias(id_col), "k", "fp", "root", "component")
