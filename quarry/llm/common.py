"""What several operators share: scratch tables, word splitting and hashing."""

from __future__ import annotations

import atexit
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1
OWN_CHECKPOINTS = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only in local mode, where it is shared too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        os.makedirs(OWN_CHECKPOINTS, exist_ok=True)
        folder = f"file://{OWN_CHECKPOINTS}"
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back. Deleted when the session's process ends, or by freed()."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quarry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def freed(df: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    _remove(df.sparkSession, df._quarry_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already
        pass


def row_key(id_col: str, text_col: str) -> Column:
    """Identity of a row by id and text: repeated rows share it, equal ids with different texts do not."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")), F.lit(7))


class Memo(dict):
    """A bounded per-worker memo: forgets everything beyond `limit` entries, so memory stays flat and results are the same."""

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and \\x09-\\x0D, which is what bytes.split() yields."""
    return text.split()


def word_hashes(limit: int = 400_000) -> Memo:
    return Memo(xxhash.xxh3_128_digest, limit)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def grams(x: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hash of every n consecutive entries of x, by doubling: log2(n) vector steps."""
    base &= M64
    out, width, have = None, 0, x
    size, power = 1, base
    while True:
        if n & size:
            out, width = (have, size) if out is None else (
                out[: len(x) - width - size + 1] * np.uint64(power) + have[width : width + len(x) - width - size + 1], width + size)
        if size * 2 > n:
            return out
        have = have[: len(have) - size] * np.uint64(power) + have[size:]
        size, power = size * 2, power * power & M64


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive entries."""
    have, size = x, 1
    while size * 2 <= n:
        have = np.minimum(have[: len(have) - size], have[size:])
        size *= 2
    rest = n - size
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def rows_by_size(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of at most `limit` bytes (or one text)."""
    start = used = 0
    for i, t in enumerate(texts):
        if i > start and used + len(t) > limit:
            yield start, i
            start, used = i, 0
        used += len(t)
    if start < len(texts):
        yield start, len(texts)


def lots(batch: pa.RecordBatch, limit: int, name: str = "text") -> Iterator[tuple[int, int, list[bytes]]]:
    """The same cut of a batch's texts, (first row, end, texts): only the texts of one lot are Python objects at a time."""
    at = batch.schema.get_field_index(name)
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, start = np.concatenate([[0], np.cumsum(sizes)]), 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + limit, side="right")) - 1)
        yield start, end, texts_of(batch.slice(start, end - start), name)
        start = end


def give_back() -> None:
    """Freed memory goes back to the system: at the end of a task, as workers live on and allocators keep what they have."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
