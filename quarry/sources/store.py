"""A dataset is a folder of Parquet snapshots, v000001 and so on, a pointer file that names the current one, and a change log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import Conflict

EMPTY = T.StructType([T.StructField("_id", T.StringType(), False)])


class Files:
    """File operations of whatever system the path is on."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def make(self, p: str) -> None:
        self.fs.mkdirs(self.path(p))

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def names(self, p: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(p))) if self.exists(p) else []

    def size(self, p: str) -> int:
        return self.fs.getContentSummary(self.path(p)).getLength() if self.exists(p) else 0

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, p: str, text: str, overwrite: bool = True) -> None:
        """Whole or not at all: written aside, then renamed. Without overwrite, False rename means that another was first."""
        aside = f"{p}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(aside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if overwrite and self.exists(p):
            self.delete(p)
        if not self.fs.rename(self.path(aside), self.path(p)):
            self.delete(aside)
            raise Conflict(p)

    def copy(self, a: str, b: str) -> None:
        conf = self.fs.getConf()
        to = self.path(b)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path(a), to.getFileSystem(conf), to, False, conf)


class Store:
    """The newest `_v` marker is the current version: publishing creates the next marker, which only one writer can."""

    def __init__(self, spark: SparkSession, path: str, compression: str | None = None):
        """compression: a codec of Parquet (snappy, zstd, gzip, none); None is Spark's own setting."""
        self.spark, self.root, self.compression = spark, path.rstrip("/"), compression
        self.files = Files(spark, path)
        self.files.make(self.root)

    def version(self) -> int:
        return max((int(n[2:]) for n in self.files.names(self.root) if n.startswith("_v") and n[2:].isdigit()), default=0)

    def snapshot(self, version: int | None = None) -> str | None:
        version = self.version() if version is None else version
        return f"{self.root}/{self.files.read(f'{self.root}/_v{version}').strip()}" if version else None

    def read(self) -> DataFrame:
        path = self.snapshot()
        return self.spark.read.parquet(path) if path else self.spark.createDataFrame([], EMPTY)

    def stage(self, df: DataFrame) -> str:
        """Write the files of a snapshot that nobody sees yet; its folder's name."""
        name = f"s-{uuid.uuid4().hex}"
        writer = df.write.option("compression", self.compression) if self.compression else df.write
        writer.parquet(f"{self.root}/{name}")
        return name

    def publish(self, name: str, expected: int) -> int:
        """Make it current, unless another version came between."""
        if self.version() != expected or self.files.exists(f"{self.root}/_v{expected + 1}"):
            self.files.delete(f"{self.root}/{name}")
            raise Conflict(f"version {expected} is not the last any more")
        self.files.write(f"{self.root}/_v{expected + 1}", name, overwrite=False)
        return expected + 1

    def commit(self, df: DataFrame, expected: int | None = None) -> int:
        expected = self.version() if expected is None else expected
        return self.publish(self.stage(df), expected)

    def withdraw(self, version: int) -> None:
        """Undo the publishing of the last version."""
        self.files.delete(f"{self.root}/_v{version}")

    def vacuum(self, keep: int = 1) -> int:
        """Delete snapshots that none of the last `keep` versions names; how many went."""
        last = self.version()
        kept = {self.files.read(f"{self.root}/_v{v}").strip() for v in range(max(1, last - keep + 1), last + 1) if self.files.exists(f"{self.root}/_v{v}")}
        gone = [n for n in self.files.names(self.root) if n.startswith("s-") and n not in kept]
        for n in gone:
            self.files.delete(f"{self.root}/{n}")
        for v in range(1, last - keep + 1):
            self.files.delete(f"{self.root}/_v{v}")
        return len(gone)

    @property
    def log_path(self) -> str:
        return f"{self.root}/_changes"
