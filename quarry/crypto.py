"""Encryption of records and fields: AES-256-GCM in the JVM. A record is a version byte, then Spark's layout of vector, text and tag."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION, ROUNDS = 2, 100_000


class CryptoLayer:
    def __init__(self, key: bytes, salt: bytes = b""):
        if len(key) != 32:
            raise ValueError("a key has 32 bytes")
        self.key, self.salt = key, salt

    version = VERSION

    @classmethod
    def from_key(cls, key: bytes) -> CryptoLayer:
        return cls(key)

    @classmethod
    def from_passphrase(cls, passphrase: str, salt: bytes | None = None) -> CryptoLayer:
        salt = salt or os.urandom(16)
        return cls(hashlib.pbkdf2_hmac("sha512", passphrase.encode(), salt, ROUNDS, 32), salt)

    def encrypt(self, text: Column) -> Column:
        return F.concat(F.unhex(F.lit(f"{VERSION:02x}")), F.aes_encrypt(text.cast("binary"), F.lit(self.key), F.lit("GCM")))

    def decrypt(self, data: Column) -> Column:
        """Null where the key does not fit; records without the version byte are read too."""
        body = F.when(self.key_version(data) == VERSION, F.substring(data, 2, 1 << 30))
        return F.coalesce(F.try_aes_decrypt(body, F.lit(self.key), F.lit("GCM")), F.try_aes_decrypt(data, F.lit(self.key), F.lit("GCM"))).cast("string")

    @staticmethod
    def key_version(data: Column) -> Column:
        return F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int")

    def verify(self, data: Column) -> Column:
        return self.decrypt(data).isNotNull()

    def is_encrypted(self, data: Column) -> Column:
        return (F.octet_length(data) > 28) & (self.key_version(data) == VERSION)

    def reencrypt(self, data: Column, to: CryptoLayer) -> Column:
        return to.encrypt(self.decrypt(data))

    rotate_key = reencrypt


class FieldCrypto:
    """Encrypted fields are base64 strings; `_ef` lists them."""

    def __init__(self, layer: CryptoLayer):
        self.layer = layer

    def encrypt_fields(self, df: DataFrame, fields: list[str]) -> DataFrame:
        new = {f: F.base64(self.layer.encrypt(F.to_json(F.struct(F.col(f"`{f}`").alias("v"))))) for f in fields}
        return df.withColumns(new | {"_ef": F.array(*map(F.lit, fields))})

    def decrypt_fields(self, df: DataFrame, types: dict[str, str]) -> DataFrame:
        new = {f: F.from_json(self.layer.decrypt(F.unbase64(F.col(f"`{f}`"))), f"v {t}")["v"] for f, t in types.items()}
        return df.withColumns(new).drop("_ef")

    @staticmethod
    def is_encrypted_field(df: DataFrame, field: str) -> Column:
        return F.array_contains("_ef", field) if "_ef" in df.columns else F.lit(False)
