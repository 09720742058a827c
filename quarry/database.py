"""A database is a folder of collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .collection import Collection
from .encrypted import EncryptedCollection
from .errors import QueryError
from .limits import check_name
from .sources.store import Files
from .transaction import Transaction


class Database:
    def __init__(self, spark: SparkSession, path: str, **options):
        """compression: the codec of snapshots. Options of other engines (cache sizes, locks) are accepted; Spark's settings stand for them."""
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self.files = Files(spark, path)
        self.files.make(self.path)
        self.is_open, self._open = True, {}

    open = classmethod(lambda cls, spark, path, **options: cls(spark, path, **options))

    def collection(self, name: str) -> Collection:
        if not self.is_open:
            raise QueryError("the database is closed")
        if name not in self._open:
            self._open[name] = Collection(self.spark, f"{self.path}/{check_name(name)}", name, self.frame, self.options.get("compression"))
        return self._open[name]

    def collection_v2(self, name: str, passphrase: str | None = None, key: bytes | None = None) -> EncryptedCollection:
        return EncryptedCollection(self.spark, f"{self.path}/{check_name(name)}", name, passphrase, key)

    def frame(self, name: str) -> DataFrame:
        """A collection as a DataFrame: the default resolver of $lookup."""
        return self.collection(name).df()

    def begin_transaction(self) -> Transaction:
        return Transaction(self)

    def list_collections(self) -> list[str]:
        return [n for n in self.files.names(self.path) if not n.startswith(("_", "."))]

    def collection_exists(self, name: str) -> bool:
        return name in self.list_collections()

    def drop_collection(self, name: str) -> bool:
        there = self.collection_exists(check_name(name))
        self._open.pop(name, None)
        self.files.delete(f"{self.path}/{name}")
        return there

    def flush_all(self) -> None:
        """Writes are durable when they return."""

    def backup(self, to: str) -> None:
        if f"{to.rstrip('/')}/".startswith(f"{self.path}/"):
            raise QueryError("a backup goes outside the database")
        self.files.copy(self.path, to)

    def status(self) -> dict:
        stats = {n: self.collection(n).stats() for n in self.list_collections()}
        return {"path": self.path, "collections": stats, "healthy": all(s["fragmentation"] <= 0.6 for s in stats.values())}

    def close(self) -> None:
        self.is_open = False
