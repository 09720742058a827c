"""Dotted paths to Columns, in a row of typed columns, a struct, or a VARIANT document."""

from __future__ import annotations

import datetime
import decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError


def kind_of_type(t: T.DataType | None) -> str:
    if t is None or isinstance(t, T.NullType):
        return "missing"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "object"


def kind_of_value(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float, decimal.Decimal)):
        return "number"
    if isinstance(v, str):
        return "string"
    if isinstance(v, (list, tuple)):
        return "array"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return "time"
    if isinstance(v, dict):
        return "object"
    raise QueryError(f"not a document value: {v!r}")


def literal(v: object) -> Column:
    """Lists become arrays, objects structs."""
    if isinstance(v, dict):
        return F.struct(*[literal(x).alias(k) for k, x in v.items()]) if v else F.create_map().cast("map<string,string>")
    if isinstance(v, (list, tuple)):
        return F.array(*[literal(x) for x in v])
    return F.lit(v)


class Scope:
    """Typed: missing is null. `root` is a struct column, or None for the columns of the row."""

    dynamic = False

    def __init__(self, schema: T.StructType, root: Column | None = None, tokens: str | None = None):
        self.schema, self.root, self.tokens = schema, root, tokens

    def type(self, path: str) -> T.DataType | None:
        t: T.DataType | None = self.schema
        for part in path.split("."):
            if isinstance(t, T.StructType) and part in t.names:
                t = t[part].dataType
            elif isinstance(t, T.MapType):
                t = t.valueType
            elif isinstance(t, T.ArrayType) and part.isdigit():
                t = t.elementType
            else:
                return None
        return t

    def kind(self, path: str) -> str:
        return kind_of_type(self.type(path))

    def col(self, path: str) -> Column:
        """Null where the path leads nowhere."""
        t: T.DataType = self.schema
        out = self.root
        for part in path.split("."):
            if isinstance(t, T.StructType) and part in t.names:
                out = F.col(f"`{part}`") if out is None else out.getField(part)
                t = t[part].dataType
            elif isinstance(t, T.MapType):
                out, t = out.getItem(part), t.valueType
            elif isinstance(t, T.ArrayType) and part.isdigit():
                out, t = F.get(out, F.lit(int(part))), t.elementType
            else:
                return F.lit(None)
        return out


class VariantScope:
    """Dynamic: a path that leads nowhere is SQL null, a JSON null is a variant null, and every use asks for the type first."""

    dynamic = True

    def __init__(self, doc: Column, id_col: str | None = "_id", tokens: str | None = None):
        self.doc, self.id_col, self.tokens = doc, id_col, tokens

    def col(self, path: str) -> Column:
        if path == self.id_col:
            return F.variant_get(F.parse_json(F.to_json(F.struct(F.col(path).alias("v")))), "$.v", "variant")
        return F.try_variant_get(self.doc, "$." + path, "variant")

    def value(self, path: str, kind: str) -> Column:
        """The value where it is of that kind, else null."""
        if path == self.id_col:
            return F.col(path) if kind == "string" else F.lit(None)
        v, told = self.col(path), self.told(path)
        if kind == "number":
            return F.when(told.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))
        if kind == "string":
            return F.when(told == "STRING", F.try_variant_get(v, "$", "string"))
        if kind == "boolean":
            return F.when(told == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        if kind == "array":
            return F.when(told.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
        return F.when(told.startswith("OBJECT"), v)

    def told(self, path: str) -> Column:
        return F.lit("STRING") if path == self.id_col else F.schema_of_variant(self.col(path))

    def missing(self, path: str) -> Column:
        return F.lit(False) if path == self.id_col else self.col(path).isNull()

    def null(self, path: str) -> Column:
        return F.lit(False) if path == self.id_col else F.coalesce(F.is_variant_null(self.col(path)), F.lit(False))

    def key(self, path: str) -> Column:
        """Canonical text of the value, for grouping: numbers as doubles; null and missing differ."""
        return F.when(self.missing(path), F.lit(None)).otherwise(F.coalesce(self.value(path, "number").cast("string"), F.to_json(self.col(path))))
