"""Remove bytes covered by strings of `length` bytes that also start elsewhere, by suffix arrays over shards.

Shards hold what can match. In every string of `length` bytes one gram of `GRAM` bytes, the one of smallest hash (leftmost on ties),
is its anchor, chosen from the string alone, so equal strings have equal anchors. Only anchors that occur twice or more
matter; around each the text that can share it (`length` - GRAM bytes to either side) goes to the anchor's shard, merged
where it overlaps within a document. Equal stretches of one batch of texts travel as one, with their places. A shard's different stretches, each once,
are joined with separators; its suffix array and permuted common prefixes tell which strings occur twice or more, a stretch that occurs
several times repeats as a whole.

Cases: null text is empty; rows alike in id and text are documents of their own, so of texts of `length` bytes or more nothing stays; shorter texts
stay whole; equal ids with different texts are different documents; an empty table gives an empty result. Cuts may fall inside a character:
what is kept is binary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed, grams, mixed, row_key, rows_by_size, sliding_min, texts_of, written
from .suffix_array import common_prefixes, suffix_array

LENGTH, GRAM = 400, 48
SHARD_BYTES = 1_500_000
_A = 0x9E3779B97F4A7C15


def anchors(text: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of anchors in concatenated documents, each at least `length` long."""
    g = mixed(grams(mixed(text.astype(np.uint64) + np.uint64(1)), gram, _A))
    span = length - gram + 1
    low = sliding_min(g, span)
    ends = np.cumsum(sizes)
    at = np.concatenate([np.arange(e - c, e - length + 1) for c, e in zip(sizes, ends)])
    new = np.ones(len(at), dtype=bool)
    follows = np.flatnonzero(np.diff(at) == 1) + 1
    here = at[follows]
    new[follows] = (low[here] != low[here - 1]) | (g[here - 1] == low[here])
    at = at[new]
    out = []
    for i in range(0, len(at), 4096):
        part = at[i : i + 4096]
        out.append(part + np.lib.stride_tricks.sliding_window_view(g, span)[part].argmin(1))
    pos = np.unique(np.concatenate(out))
    return pos, g[pos]


def shard_spans(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    """Stretches (ks, starts, content) of one shard in, spans (k, a, b) of repeated bytes out."""
    places = pd.DataFrame({"row": np.repeat(np.arange(len(frame)), frame["ks"].map(len)), "k": np.concatenate(frame["ks"].to_list()), "start": np.concatenate(frame["starts"].to_list())}).drop_duplicates(["k", "start"])
    texts, which = np.unique(frame["content"].to_numpy(dtype=object), return_inverse=True)
    which = which[places["row"].to_numpy()]
    count = np.bincount(which, minlength=len(texts))
    n = np.array([len(t) for t in texts])
    # separators are a byte that UTF-8 does not have
    text = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8)
    first = np.concatenate([[0], np.cumsum(n + 1)[:-1]])
    left = np.repeat(first + n, n + 1) - np.arange(len(text))
    repeated = np.repeat(count > 1, n + 1) & (left >= length)
    if len(texts) > 1 or n[0] > length:
        order = suffix_array(np.append(text.astype(np.int64) + 1, 0), depth=length)[1:]
        same = common_prefixes(text, order, length) >= length
        before = np.full(len(text), 0, dtype=np.int64)
        before[order[1:]] = order[:-1]
        hit = np.flatnonzero(same & (left >= length))
        hit = hit[left[before[hit]] >= length]
        repeated[hit] = True
        repeated[before[hit]] = True
    spans = []
    for i in range(len(texts)):
        s = np.flatnonzero(repeated[first[i] : first[i] + n[i]])
        if len(s):
            cut = np.flatnonzero(np.diff(s) > length) + 1
            firsts, lasts = s[np.concatenate([[0], cut])], s[np.concatenate([cut - 1, [len(s) - 1]])]
            spans.append((i, firsts, lasts + length))
    if not spans:
        return pd.DataFrame({"k": np.zeros(0, np.int64), "a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    table = pd.DataFrame({"which": np.concatenate([np.full(len(a), i) for i, a, _ in spans]), "a": np.concatenate([a for _, a, _ in spans]), "b": np.concatenate([b for _, _, b in spans])})
    rows = pd.DataFrame({"which": which, "k": places["k"].to_numpy(), "start": places["start"].to_numpy()}).merge(table, on="which")
    return pd.DataFrame({"k": rows["k"], "a": rows["a"] + rows["start"], "b": rows["b"] + rows["start"]})


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_spans(own: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    """(k, spans): per row key the bytes to remove. own: id, k, text."""

    def mark(batches):
        for b in batches:
            texts, keys = texts_of(b), b.column(0).to_numpy()
            long = [i for i, t in enumerate(texts) if len(t) >= length]
            for i, j in rows_by_size([texts[x] for x in long], 1_000_000):
                rows = np.array(long[i:j])
                sizes = np.array([len(texts[x]) for x in rows])
                pos, h = anchors(np.frombuffer(b"".join(texts[x] for x in rows), np.uint8), sizes, length, gram)
                ends = np.cumsum(sizes)
                doc = np.searchsorted(ends, pos, side="right")
                yield pa.record_batch({"h": pa.array(h.view(np.int64)), "k": pa.array(keys[rows][doc]), "pos": pa.array((pos - (ends - sizes)[doc]).astype(np.int64))})

    found = own.select("k", "text").mapInArrow(mark, "h long, k long, pos long")
    found = written(found)
    place = F.struct("k", "pos")
    # written, so that both sides of the join are plain exchanges and a hot anchor's partition can be split
    twice = written(found.groupBy("h").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("h"))
    hits = written(found.join(twice.hint("shuffle_merge"), "h", "left_semi"))
    freed(found)
    freed(twice)
    shards = max(1, hits.count() * (2 * length - gram) // SHARD_BYTES)

    def stretch(batches):
        for b in batches:
            seen: dict[tuple[int, bytes], tuple[list[int], list[int]]] = {}
            for key, text, at in zip(b.column(0).to_pylist(), texts_of(b), b.column(2)):
                if not at.is_valid or not len(at.values):
                    continue
                h, pos = at.values.field(0).to_numpy(), at.values.field(1).to_numpy()
                shard = (h.view(np.uint64) % np.uint64(shards)).astype(np.int64)
                order = np.lexsort([pos, shard])
                shard, lo = shard[order], pos[order] - (length - gram)
                hi = np.minimum(pos[order] + length, len(text))
                lo = np.maximum(lo, 0)
                new = np.append(True, (shard[1:] != shard[:-1]) | (lo[1:] > hi[:-1]))
                firsts = np.flatnonzero(new)
                for s, a, e in zip(shard[firsts].tolist(), lo[firsts].tolist(), hi[np.append(firsts[1:], len(lo)) - 1].tolist()):
                    ks, starts = seen.setdefault((s, text[a:e]), ([], []))
                    ks.append(key)
                    starts.append(a)
            many = pa.list_(pa.int64())
            yield pa.record_batch({"shard": pa.array([s for s, _ in seen], pa.int64()), "content": pa.array([c for _, c in seen], pa.binary()),
                                   "ks": pa.array([x for x, _ in seen.values()], many), "starts": pa.array([x for _, x in seen.values()], many)})

    by_doc = hits.groupBy("k").agg(F.collect_set(F.struct("h", "pos")).alias("at"))
    pieces = own.select("k", "text").join(by_doc, "k").select("k", "text", "at").mapInArrow(stretch, "shard long, content binary, ks array<long>, starts array<long>")
    spans = pieces.groupBy("shard").applyInPandas(lambda f: shard_spans(f, length), "k long, a long, b long")
    return spans.groupBy("k").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, spans: array of [a, b) byte ranges removed, kept: binary, kept_sha256) per document."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("k", row_key("id", "text"))
    spans = repeated_spans(own, length)
    alike = own.groupBy("k").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("k", F.lit(True).alias("alike"))
    spans = spans.join(alike, "k", "full")

    def cut(batches):
        for b in batches:
            n_bytes, n_removed, told, kept = [], [], [], []
            for text, at, alike in zip(texts_of(b), b.column(2).to_pylist(), b.column(3).to_pylist()):
                gone = [(0, len(text))] if alike and len(text) >= length else union([(x["a"], x["b"]) for x in at]) if at else []
                n_bytes.append(len(text))
                n_removed.append(sum(e - a for a, e in gone))
                told.append([{"a": a, "b": e} for a, e in gone])
                edges = [0, *[x for s in gone for x in s], len(text)]
                kept.append(b"".join(text[a:e] for a, e in zip(edges[::2], edges[1::2])))
            yield pa.record_batch({"id": b.column(0), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                                   "spans": pa.array(told, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), "kept": pa.array(kept, pa.binary()),
                                   "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())})

    span = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    schema = T.StructType([own.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType()), T.StructField("kept_sha256", T.StringType())])
    out = own.join(spans.hint("shuffle_merge"), "k", "left").select("id", "text", "spans", "alike").mapInArrow(cut, schema)
    return out.withColumnRenamed("id", id_col)
