"""Remove word windows that start earlier elsewhere, with a count-min prefilter.

A window is `window` consecutive words of one document. A word goes if a window covering it has the same
word sequence as a window that starts earlier (smaller id, or same document and earlier start).

Pass 1 sketches. Each task counts grams in its own count-min sketch and writes its cells by slice; slices
of all tasks are merged where they meet, and only one bit a cell ("counted twice or more") leaves the merge.
A window is entered by its smallest gram of `GRAM` words (leftmost on ties), so overlapping windows share an
entry. Equal windows have equal smallest grams at different places, so a cell never underestimates the count
of a window.
Pass 2 emits only windows whose cells are all set, and groups them exactly, by 128 bits of the word sequence. What starts later
than an equal window of the same chunk of texts goes at once and never meets its group, so that a group gets a row or so a chunk,
however frequent its window is.

Cases: null text has no words; fewer words than a window are kept whole; rows alike in id and text get the
same result and never remove each other; equal ids with different texts are ordered by a hash of the text;
null ids come last; an empty table gives an empty result. Other columns pass if named in `carry`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, grams, lots, mixed, row_key, sliding_min, word_hashes, words_of

GRAM = 8
ROWS = 2
#: Bytes of text that are split into words at once, of chunks whose equal windows meet, and words whose hashes a task remembers.
LOT_BYTES, CHUNK_BYTES, MEMO_WORDS = 500_000, 2_000_000, 100_000
SLICE_BITS = 20
#: Cells of a sketch row at most; the merged bits are then ROWS * 2**27 / 8 bytes = 32 MB. A fuller sketch only filters less.
MAX_BITS = 27
A1, A2, A3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def _windows(texts: list[bytes], memo: dict, window: int):
    """Over concatenated documents: word hashes, the starts of windows, the smallest gram of each and if it is newly smallest."""
    gram = min(GRAM, window)
    lists = [words_of(t) for t in texts]
    counts = np.array([len(x) for x in lists], dtype=np.int64)
    ends = np.cumsum(counts)
    h = np.frombuffer(b"".join(memo[w] for ws in lists for w in ws), dtype=np.uint64).reshape(-1, 2)
    starts = [np.arange(e - c, e - window + 1) for c, e in zip(counts, ends) if c >= window]
    if not starts:
        none = np.zeros(0, dtype=np.int64)
        return h, counts, none, none.astype(np.uint64), none.astype(bool)
    at = np.concatenate(starts)
    g = mixed(grams(np.ascontiguousarray(h[:, 0]), gram, A1))
    low = sliding_min(g, window - gram + 1)
    new = np.ones(len(at), dtype=bool)
    follows = np.flatnonzero(at[1:] == at[:-1] + 1) + 1
    here = at[follows]
    new[follows] = (low[here] != low[here - 1]) | (g[here - 1] == low[here])
    # the first window of a document follows nothing, even where the concatenation runs on
    first = np.isin(at, ends - counts)
    new[first] = True
    return h, counts, at, low[at], new


def _cells(low: np.ndarray, bits: int):
    mask = np.uint64((1 << bits) - 1)
    for r in range(ROWS):
        yield r, (low * np.uint64((A2, A3)[r % 2]) >> np.uint64(64 - bits)) & mask


def _sketcher(bits: int, window: int):
    def sketch(batches):
        memo, held, n = word_hashes(MEMO_WORDS), [[] for _ in range(ROWS)], 0

        def flush():
            for r in range(ROWS):
                cells = np.sort(np.concatenate(held[r])) if held[r] else np.zeros(0, np.uint64)
                held[r].clear()
                part = (cells >> np.uint64(SLICE_BITS)).astype(np.int64)
                cut = np.flatnonzero(np.diff(part)) + 1
                low = (cells & np.uint64((1 << SLICE_BITS) - 1)).astype(np.uint32)
                firsts = np.concatenate([[0], cut]) if len(cells) else []
                if len(firsts):
                    yield pa.record_batch({
                        "r": pa.array([r] * len(firsts), pa.int32()),
                        "slice": pa.array(part[firsts].astype(np.int32)),
                        "cells": pa.array([x.tobytes() for x in np.split(low, cut)], pa.binary())})

        for batch in batches:
            for _, _, texts in lots(batch, LOT_BYTES):
                *_, low, new = _windows(texts, memo, window)
                for r, cells in _cells(low[new], bits):
                    held[r].append(cells)
                n += int(new.sum())
                if n > 1_000_000:
                    yield from flush()
                    n = 0
        memo.clear()
        yield from flush()
        give_back()

    return sketch


def _merge(batches):
    """Saturating sums of the slices that meet here; memory is one byte a cell of these slices."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for r, s, cells in zip(*(batch.column(k).to_pylist() for k in range(3))):
            at = sums.setdefault((r, s), np.zeros(1 << SLICE_BITS, dtype=np.uint8))
            c = np.frombuffer(cells, dtype=np.uint32)
            once, n = np.unique(c, return_counts=True)
            at[once] = np.minimum(at[once] + np.minimum(n, 2), 2).astype(np.uint8)
    for (r, s), at in sums.items():
        yield pa.record_batch({"r": pa.array([r], pa.int32()), "slice": pa.array([s], pa.int32()),
                               "bits": pa.array([np.packbits(at >= 2).tobytes()], pa.binary())})


def sketch_bits(n_bytes: int, window: int) -> int:
    """Twice as many cells as grams are expected (a word has 6 bytes, a gram is smallest for half a window)."""
    grams_expected = n_bytes / 6 * 2 / (window - min(GRAM, window) + 2)
    return int(np.clip(np.ceil(np.log2(2 * grams_expected + 1)), SLICE_BITS, MAX_BITS))


def _later(hi: np.ndarray, lo: np.ndarray, seq: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows start later than an equal one of this chunk. seq: the place of each window's document in (id, key) order, equal for equal rows."""
    later = np.zeros(len(hi), dtype=bool)
    order = np.lexsort([start, seq])
    order = order[np.argsort(hi[order], kind="stable")]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hi[order[1:]] != hi[order[:-1]]) | (lo[order[1:]] != lo[order[:-1]])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later[order] = (seq[order] != seq[first]) | (start[order] != start[first])
    return later


def _places(ids: pa.Array, keys: np.ndarray) -> np.ndarray | None:
    """The dense rank of each row by (id, key), null ids last; None for types whose order may differ from Spark's."""
    t = ids.type
    if not (pa.types.is_integer(t) or pa.types.is_string(t) or pa.types.is_large_string(t)):
        return None
    rank = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
    order = np.lexsort([keys, rank])
    new = np.zeros(len(order), dtype=np.int64)
    new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (keys[order[1:]] != keys[order[:-1]])
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """(k, start): every window start, by row key, whose word sequence starts earlier elsewhere."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch_bits(n_bytes, window)
    cells = docs.select("text").mapInArrow(_sketcher(bits, window), "r int, slice int, cells binary")
    merged = cells.repartition("r", "slice").mapInArrow(_merge, "r int, slice int, bits binary").collect()
    table = [np.zeros((1 << bits) // 8, dtype=np.uint8) for _ in range(ROWS)]
    step = (1 << SLICE_BITS) // 8
    for m in merged:
        table[m["r"]][m["slice"] * step : (m["slice"] + 1) * step] = np.frombuffer(m["bits"], dtype=np.uint8)
    shared = spark.sparkContext.broadcast(table)

    def suspects(batches):
        memo, bitmaps = word_hashes(MEMO_WORDS), shared.value
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1).to_numpy()
            for i, j, texts in lots(batch, CHUNK_BYTES):
                h, counts, at, low, _ = _windows(texts, memo, window)
                hit = np.ones(len(at), dtype=bool)
                for r, cells in _cells(low, bits):
                    c = cells.astype(np.int64)
                    hit &= (bitmaps[r][c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
                if not hit.any():
                    continue
                at = at[hit]
                ends = np.cumsum(counts)
                doc = np.searchsorted(ends, at, side="right")
                hi = mixed(grams(np.ascontiguousarray(h[:, 0]), window, A2))[at]
                lo = mixed(grams(np.ascontiguousarray(h[:, 1]), window, A3))[at]
                start = (at - (ends - counts)[doc]).astype(np.int32)
                seq = _places(ids.slice(i, j - i), keys[i:j])
                if seq is not None:
                    later = _later(hi, lo, seq[doc], start)
                    gone_doc, gone = doc[later], start[later]
                    cut = np.flatnonzero(np.diff(gone_doc, prepend=-1))  # a row a document, dealt by its key and place
                    if len(cut):
                        k = keys[i + gone_doc[cut]]
                        yield pa.record_batch({
                            "hi": pa.array(k), "lo": pa.array(i + gone_doc[cut]), "id": ids.take(pa.array(i + gone_doc[cut])), "k": pa.array(k),
                            "start": pa.array(gone[cut]), "later": pa.ListArray.from_arrays(pa.array(np.append(cut, len(gone)).astype(np.int32)), pa.array(gone))})
                    hi, lo, doc, start = hi[~later], lo[~later], doc[~later], start[~later]
                take = pa.array(doc + i)
                for k in range(0, len(start), 200_000):
                    part = slice(k, k + 200_000)
                    yield pa.record_batch({
                        "hi": pa.array(hi[part].view(np.int64)), "lo": pa.array(lo[part].view(np.int64)),
                        "id": ids.take(take[part]), "k": pa.array(keys[(doc + i)[part]]), "start": pa.array(start[part]),
                        "later": pa.nulls(len(hi[part]), pa.list_(pa.int32()))})
        memo.clear()
        give_back()

    rows = docs.select("id", "k", "text").mapInArrow(suspects, T.StructType([
        T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), docs.schema["id"],
        T.StructField("k", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("later", T.ArrayType(T.IntegerType()))]))
    from pyspark.sql import Window as W

    told = F.col("later").isNotNull()
    order = W.partitionBy("hi", "lo", told).orderBy(F.col("id").asc_nulls_last(), "k", "start")
    gone = rows.withColumn("nth", F.rank().over(order)).where(told | (F.col("nth") > 1))
    return gone.select("k", F.explode(F.coalesce("later", F.array("start"))).alias("start"))


def _cutter(window: int, schema: pa.Schema):
    def cut(batches):
        for batch in batches:
            marks = batch.column(batch.schema.get_field_index("starts"))
            for i, j, texts in lots(batch, LOT_BYTES):
                kept, n_words, n_removed = [], [], []
                for t, starts in zip(texts, marks.slice(i, j - i)):
                    words = words_of(t)
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    if starts.is_valid and len(starts):
                        s = np.unique(starts.values.to_numpy(zero_copy_only=False))
                        np.add.at(gone, s, 1)
                        np.add.at(gone, s + window, -1)
                        cover = np.cumsum(gone)[: len(words)] > 0
                        n_removed.append(int(cover.sum()))
                        kept.append(b" ".join([w for w, c in zip(words, cover.tolist()) if not c]))
                    else:
                        n_removed.append(0)
                        kept.append(b" ".join(words))
                    n_words.append(len(words))
                new = {"kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
                yield pa.RecordBatch.from_arrays([new[f] if f in new else batch.column(batch.schema.get_field_index(f)).slice(i, j - i) for f in schema], names=schema)
        give_back()

    return cut


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, carried columns, kept_text (kept words joined by one space), n_words, n_removed."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"c_{c}") for c in carry]).withColumn("k", row_key("id", "text"))
    gone = repeated_windows(own, window).groupBy("k").agg(F.collect_set("start").alias("starts"))
    fields = ["id", *[f"c_{c}" for c in carry]]
    schema = T.StructType([*[own.schema[f] for f in fields], T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = own.join(gone.hint("shuffle_merge"), "k", "left").select(*fields, "text", "starts").mapInArrow(_cutter(window, schema.names), schema)
    return out.select(F.col("id").alias(id_col), *[F.col(f"c_{c}").alias(c) for c in carry], "kept_text", "n_words", "n_removed")
