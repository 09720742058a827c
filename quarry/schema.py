"""Validation of typed rows: every rule is a Column that is a message or null; the messages of a row are its `_errors`."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import QueryError, ValidationError
from .functions.scope import Scope, kind_of_type
from .functions.updates import typed_literal

RULES = ("type", "required", "nullable", "min_length", "max_length", "pattern", "enum", "min", "max", "integer", "min_items", "max_items", "items", "properties", "custom", "default")


class Field(dict):
    """A rule under construction: field('string').required().min_length(2).build()."""

    def __getattr__(self, name: str) -> Callable:
        snake = re.sub("[A-Z]", lambda m: "_" + m[0].lower(), name)
        if snake == "build":
            return lambda: dict(self)
        if snake not in RULES:
            raise AttributeError(name)
        return lambda value=True: Field(self | {snake: value})


def field(type: str) -> Field:
    return Field(type=type)


class SchemaValidator:
    def __init__(self, schema: dict[str, dict]):
        for name, rule in schema.items():
            if unknown := set(rule) - set(RULES):
                raise QueryError(f"unknown rules of {name}: {sorted(unknown)}")
        self.schema = schema

    def _violations(self, path: str, col: Column, t: T.DataType | None, rule: dict) -> list[Column]:
        def bad(when: Column, message: str) -> Column:
            return F.when(F.coalesce(when, F.lit(False)), F.lit(f"{path}: {message}"))

        kind, want, there = kind_of_type(t), rule.get("type", "any"), col.isNotNull()
        out = [bad(col.isNull(), "required")] if rule.get("required") and not rule.get("nullable") else []
        if want != "any" and kind not in (want, "missing"):
            return [*out, bad(there, f"expected {want}")]  # a wrong type stops the field
        if kind == "missing":
            return out
        if kind == "string":
            n = F.length(col)
            out += [bad(n < rule["min_length"], "too short")] if "min_length" in rule else []
            out += [bad(n > rule["max_length"], "too long")] if "max_length" in rule else []
            out += [bad(~col.rlike(rule["pattern"]), "does not match")] if "pattern" in rule else []
        if kind == "number":
            out += [bad(col < rule["min"], "too small")] if "min" in rule else []
            out += [bad(col > rule["max"], "too large")] if "max" in rule else []
            out += [bad(col != F.floor(col), "not an integer")] if rule.get("integer") else []
        if "enum" in rule and kind in ("string", "number", "boolean"):
            out.append(bad(there & ~col.isin(list(rule["enum"])), "not one of the values"))
        if kind == "array":
            out += [bad(F.size(col) < rule["min_items"], "too few items")] if "min_items" in rule else []
            out += [bad(F.size(col) > rule["max_items"], "too many items")] if "max_items" in rule else []
            if "items" in rule:
                inner = rule["items"]

                def wrong(x: Column) -> Column:
                    return F.size(F.array_compact(F.array(F.lit(None).cast("string"), *self._violations("item", x, t.elementType, inner)))) > 0

                out.append(bad(F.exists(col, wrong), "has bad items"))
        if kind == "object" and isinstance(t, T.StructType):
            for name, inner in rule.get("properties", {}).items():
                sub = t[name].dataType if name in t.names else None
                found = self._violations(f"{path}.{name}", col.getField(name) if sub is not None else F.lit(None), sub, inner)
                out += [F.when(there, v) for v in found]
        if "custom" in rule:  # Column -> Column of message or null; a pandas UDF serves too
            out.append(rule["custom"](col))
        return out

    def errors(self, df: DataFrame) -> Column:
        scope = Scope(df.schema)
        found = [v for path, rule in self.schema.items() for v in self._violations(path, scope.col(path), scope.type(path), rule)]
        return F.array_compact(F.array(F.lit(None).cast("string"), *found))

    def validate(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_errors", self.errors(df)).withColumn("_ok", F.size("_errors") == 0)

    def validate_or_throw(self, df: DataFrame) -> DataFrame:
        bad = self.validate(df).where("not _ok").select("_errors").limit(100).collect()
        if bad:
            raise ValidationError([e for r in bad for e in r["_errors"]])
        return df

    def apply_defaults(self, df: DataFrame) -> DataFrame:
        new = {}
        for name, rule in self.schema.items():
            if "default" in rule:
                new[name] = F.coalesce(F.col(f"`{name}`"), typed_literal(rule["default"], df.schema[name].dataType)) if name in df.columns else F.lit(rule["default"])
        return df.withColumns(new) if new else df
