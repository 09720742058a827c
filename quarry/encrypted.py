"""A collection whose snapshots hold ids and encrypted documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .collection import TOKENS, Collection
from .crypto import CryptoLayer


class EncryptedCollection(Collection):
    def __init__(self, spark: SparkSession, path: str, name: str, passphrase: str | None = None, key: bytes | None = None):
        super().__init__(spark, path, name)
        self.layer: CryptoLayer | None = None
        self.init(passphrase, key)

    def init(self, passphrase: str | None = None, key: bytes | None = None) -> None:
        salt = f"{self.store.root}/_salt"
        if key is not None:
            self.layer = CryptoLayer.from_key(key)
        elif passphrase is not None:
            known = bytes.fromhex(self.store.files.read(salt)) if self.store.files.exists(salt) else None
            self.layer = CryptoLayer.from_passphrase(passphrase, known)
            if known is None:
                self.store.files.write(salt, self.layer.salt.hex())

    @property
    def is_encrypted(self) -> bool:
        return self.layer is not None

    def df(self) -> DataFrame:
        return self._opened(self.store.read())

    def _searchable(self) -> tuple[DataFrame, str | None]:
        df = self.df()
        return (df, None) if self.text_index is None else (self._with_tokens(df), TOKENS)

    def _opened(self, raw: DataFrame) -> DataFrame:
        if self.layer is None or "_schema" not in raw.columns:
            return raw.drop(TOKENS)
        told = raw.select("_schema").first()
        if told is None:
            return raw.select("_id")
        schema = T.StructType.fromDDL(told["_schema"])
        return raw.select(F.from_json(self.layer.decrypt(F.col("_data")), schema).alias("d")).select("d.*")

    def _sealed(self, df: DataFrame) -> DataFrame:
        if self.layer is None:
            return super()._sealed(df)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.select("_id", self.layer.encrypt(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("_data"), F.lit(ddl).alias("_schema"))

    def _commit(self, df: DataFrame, events: DataFrame | None = None, expected: int | None = None) -> None:
        """Events tell which document changed and how, but hold nothing of it: the log is not encrypted."""
        if events is not None and self.layer is not None:
            events = events.withColumns({"fullDocument": F.lit(None).cast("string"), "updateDescription": F.lit(None).cast("string")})
        super()._commit(df, events, expected)

    def rotate_encryption_key(self, passphrase: str | None = None, key: bytes | None = None) -> int:
        plain = self.df().cache()
        n = plain.count()
        if key is None:
            self.store.files.delete(f"{self.store.root}/_salt")
        self.init(passphrase, key)
        self._commit(plain)
        plain.unpersist()
        return n
