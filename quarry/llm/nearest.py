"""Nearest neighbours by largest inner product: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

Vectors are cut into parts of two components, each coded by one of 16 words. Codes and words minimise an error in which the part of
the residual that is parallel to the vector weighs `eta` times the rest, as that part shifts large inner products. A query's products with all words
are tables; a block of queries scans the codes of a block of vectors by table look-ups, and the best are
reranked by exact double-precision products of the original vectors.

The codebook is fitted on at most `SAMPLE` vectors (those whose hashes are lowest); every vector is indexed. Equal vectors are
indexed once, with their 21 smallest ids: no more of them can be among 20 neighbours in order of ids.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor those of another dimension than most; fewer
candidates than asked give fewer rows; ties go to smaller ids; null ids take no part; a repeated id is a row of its
own, and a query leaves out every row of its id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

TOP, PART, WORDS, SAMPLE, THRESHOLD, ROUNDS = 20, 2, 16, 8192, 0.2, 8
RERANKED, QUERY_BLOCK, VECTOR_BLOCK = 256, 4096, 16384


def fit(x: np.ndarray, eta: float, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Codebook (parts, WORDS, PART) by coordinate descent on the anisotropic error."""
    n, d = x.shape
    parts = d // PART
    rng = np.random.default_rng(seed)
    book = np.stack([x[rng.choice(n, WORDS, replace=n < WORDS)][:, p * PART : (p + 1) * PART] for p in range(parts)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for step in range(rounds):
        weight = 1.0 if step < rounds // 2 else eta
        codes = encode(x, book, weight)
        residual = x - decode(codes, book)
        for p in range(parts):
            own = slice(p * PART, (p + 1) * PART)
            xs, us = x[:, own], unit[:, own]
            rest = (residual * unit).sum(1) - (residual[:, own] * us).sum(1)
            for w in range(WORDS):
                at = codes[:, p] == w
                if at.any():
                    u, target = us[at], rest[at] + (xs[at] * us[at]).sum(1)
                    a = at.sum() * np.eye(PART) + (weight - 1) * u.T @ u
                    book[p, w] = np.linalg.solve(a, xs[at].sum(0) + (weight - 1) * (u * target[:, None]).sum(0))
            residual[:, own] = xs - book[p, codes[:, p]]
    return book


def decode(codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.concatenate([book[p, codes[:, p]] for p in range(len(book))], axis=1)


def encode(x: np.ndarray, book: np.ndarray, eta: float, passes: int = 2) -> np.ndarray:
    """Codes, part by part, each the best given the others."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    parts = [slice(p * PART, (p + 1) * PART) for p in range(len(book))]
    dist = [((x[:, s][:, None] - b[None]) ** 2).sum(2) for s, b in zip(parts, book)]
    par = [(((x[:, s][:, None] - b[None])) * unit[:, s][:, None]).sum(2) for s, b in zip(parts, book)]
    codes = np.stack([d.argmin(1) for d in dist], axis=1)
    rows = np.arange(len(x))
    if eta > 1:
        total = sum(q[rows, codes[:, p]] for p, q in enumerate(par))
        for _ in range(passes):
            for p in range(len(book)):
                rest = total - par[p][rows, codes[:, p]]
                codes[:, p] = (dist[p] + (eta - 1) * (rest[:, None] + par[p]) ** 2).argmin(1)
                total = rest + par[p][rows, codes[:, p]]
    return codes.astype(np.uint8)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte; there are as many parts as make whole bytes."""
    return codes[:, 0::2] << 4 | codes[:, 1::2]


def scan(queries: np.ndarray, codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Approximate products from packed codes: a look-up in a table of 256 sums for each byte."""
    tables = np.stack([queries[:, p * PART : (p + 1) * PART] @ b.T for p, b in enumerate(book)], axis=1).astype(np.float32)
    out = np.zeros((len(queries), len(codes)), np.float32)
    for j in range(codes.shape[1]):
        both = (tables[:, 2 * j, :, None] + tables[:, 2 * j + 1, None, :]).reshape(len(queries), WORDS * WORDS)
        out += np.take(both, codes[:, j], axis=1)
    return out


def valid(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _matrix(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, top: int = TOP, reranked: int = RERANKED) -> DataFrame:
    """(query_id, rank, id, score): for each row whose id is divisible by `every`, its `top` nearest other rows."""
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType()) else "array<double>"  # floats travel as they are
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).where(F.col("id").isNotNull() & valid(F.col("v")))
    most = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = most["d"] if most else PART
    own = own.where(F.size("v") == d)
    order = W.partitionBy("v").orderBy("id")
    members = written(own.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top + 1).withColumn("class", F.min("id").over(order)))
    classes = members.where("nth = 1").select("class", "v")
    n, n_queries = classes.count(), own.where(F.col("id") % every == 0).count()
    padded = -(-d // (2 * PART)) * 2 * PART
    sample = classes.orderBy(F.xxhash64("v"), "class").limit(SAMPLE).collect()
    x = np.zeros((len(sample), padded))
    if len(sample):
        x[:, :d] = np.array([r["v"] for r in sample])
    eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    book = spark.sparkContext.broadcast(fit(x, eta) if len(sample) else np.zeros((padded // PART, WORDS, PART)))

    def index(batches):
        for b in batches:
            rows = np.zeros((b.num_rows, padded))
            rows[:, :d] = _matrix(b, "v", d)
            codes = packed(encode(rows, book.value, eta))
            yield pa.record_batch({"class": b.column(0), "v": b.column(1), "code": pa.array([c.tobytes() for c in codes], pa.binary())})

    groups, blocks = max(1, -(-n // VECTOR_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    indexed = classes.mapInArrow(index, f"class long, v {kind}, code binary")
    left = indexed.select(F.pmod(F.xxhash64("class"), F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "class", "v", "code")
    right = own.where(F.col("id") % every == 0).distinct().select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), F.col("id").alias("query"), F.col("v").alias("q"))

    def search(vs: pa.Table, qs: pa.Table) -> pa.Table:
        empty = {"query": pa.array([], pa.int64()), "class": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not vs.num_rows or not qs.num_rows:
            return pa.table(empty)
        ids, q_ids = vs.column("class").to_numpy(), qs.column("query").to_numpy()
        by_id = np.argsort(ids, kind="stable")
        ids = ids[by_id]
        v = _matrix(vs.combine_chunks().to_batches()[0], "v", d)[by_id]
        codes = np.frombuffer(b"".join(vs.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[by_id]
        q = _matrix(qs.combine_chunks().to_batches()[0], "q", d)
        wide = np.zeros((len(q), padded))
        wide[:, :d] = q
        take, keep = min(len(ids), reranked), min(len(ids), top + 1)
        out_q, out_c, out_s = [], [], []
        for i in range(0, len(q), 128):
            part = q[i : i + 128]
            rough = scan(wide[i : i + 128], codes, book.value)
            best = np.sort(np.argpartition(-rough, take - 1, axis=1)[:, :take], axis=1)
            exact = np.einsum("qd,qcd->qc", part, v[best])
            first = np.argsort(-exact, axis=1, kind="stable")[:, :keep]
            out_q.append(np.repeat(q_ids[i : i + 128], keep))
            out_c.append(ids[np.take_along_axis(best, first, 1)].ravel())
            out_s.append(np.take_along_axis(exact, first, 1).ravel())
        return pa.table({"query": np.concatenate(out_q), "class": np.concatenate(out_c), "score": np.concatenate(out_s)})

    found = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(search, "query long, class long, score double")
    nth = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "class"))
    best = found.withColumn("nth", nth).where(F.col("nth") <= top + 1).drop("nth")
    rows = best.join(members.select("class", "id"), "class").where("id <> query")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
