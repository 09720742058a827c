"""Update documents to new Columns of a typed row. Operators apply in a fixed order, each to what the ones before left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..limits import MAX_EACH, check_keys
from .filters import _equal, _field, _operators, compile_filter
from .scope import Scope, kind_of_type, kind_of_value, literal

# The order of application.
OPERATORS = ("$set", "$unset", "$inc", "$mul", "$push", "$pull", "$addToSet", "$rename", "$min", "$max", "$setOnInsert")


def check_update(update: dict) -> None:
    if not isinstance(update, dict) or not update:
        raise QueryError("an update is an object of operators")
    for op, spec in update.items():
        if op not in OPERATORS:
            raise QueryError(f"unknown update operator {op}")
        if not isinstance(spec, dict):
            raise QueryError(f"{op} takes an object")
        check_keys(spec)
        if "_id" in spec and op != "$setOnInsert":
            raise QueryError("_id cannot be changed")
        for v in spec.values():
            if op == "$push" and isinstance(v, dict) and len(v.get("$each", ())) > MAX_EACH:
                raise QueryError(f"$each takes at most {MAX_EACH} values")


class Row:
    """Columns under construction: name -> (Column, type)."""

    def __init__(self, schema: T.StructType):
        self.cols: dict[str, tuple[Column, T.DataType]] = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in schema.fields}

    def get(self, path: str) -> tuple[Column, T.DataType | None]:
        head, *rest = path.split(".")
        if head not in self.cols:
            return F.lit(None), None
        col, t = self.cols[head]
        for part in rest:
            if not isinstance(t, T.StructType) or part not in t.names:
                return F.lit(None), None
            col, t = col.getField(part), t[part].dataType
        return col, t

    def set(self, path: str, value: Column, t: T.DataType) -> None:
        head, *rest = path.split(".")
        if not rest:
            self.cols[head] = (value, t)
            return
        base = self.cols.get(head)
        self.cols[head] = self._within(base if base and isinstance(base[1], T.StructType) else None, rest, value, t)

    def _within(self, base: tuple[Column, T.StructType] | None, rest: list[str], value: Column, t: T.DataType) -> tuple[Column, T.DataType]:
        """The struct with one field set; parents are made where they are absent."""
        fields: dict[str, tuple[Column, T.DataType]] = {f.name: (base[0].getField(f.name), f.dataType) for f in base[1].fields} if base else {}
        if len(rest) == 1:
            fields[rest[0]] = (value, t)
        else:
            inner = fields.get(rest[0])
            fields[rest[0]] = self._within(inner if inner and isinstance(inner[1], T.StructType) else None, rest[1:], value, t)
        return F.struct(*[c.cast(k).alias(n) for n, (c, k) in fields.items()]), T.StructType([T.StructField(n, k) for n, (_, k) in fields.items()])

    def drop(self, path: str) -> None:
        head, *rest = path.split(".")
        if head not in self.cols:
            return
        col, t = self.cols[head]
        if rest:
            _, inner = self.get(path)
            if inner is not None:
                self.set(path, F.lit(None).cast(inner), inner)
        else:
            self.cols[head] = (F.lit(None).cast(t), t)


def type_of(v: object) -> T.DataType:
    kind = kind_of_value(v)
    if kind == "null":
        return T.NullType()
    if kind == "boolean":
        return T.BooleanType()
    if kind == "number":
        return T.LongType() if isinstance(v, int) else T.DoubleType()
    if kind == "string":
        return T.StringType()
    if kind == "time":
        return T.TimestampType()
    if kind == "array":
        out: T.DataType = T.NullType()
        for x in v:
            out = merged(out, type_of(x))
        return T.ArrayType(out)
    return T.StructType([T.StructField(k, type_of(x)) for k, x in v.items()])


def merged(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both; numbers widen, anything else that differs is an error."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType() if isinstance(a, (T.DoubleType, T.FloatType)) or isinstance(b, (T.DoubleType, T.FloatType)) else T.LongType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = [*a.names, *[n for n in b.names if n not in a.names]]
        return T.StructType([T.StructField(n, merged(a[n].dataType, b[n].dataType) if n in a.names and n in b.names else (a if n in a.names else b)[n].dataType) for n in names])
    raise QueryError(f"a typed field cannot hold both {a.simpleString()} and {b.simpleString()}; use a dynamic collection")


def conform(col: Column, have: T.DataType, want: T.DataType) -> Column:
    """A cast by field name."""
    if have == want:
        return col
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        parts = [conform(col.getField(f.name), have[f.name].dataType, f.dataType).alias(f.name) if f.name in have.names else F.lit(None).cast(f.dataType).alias(f.name) for f in want.fields]
        return F.when(col.isNotNull(), F.struct(*parts))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(col, lambda x: conform(x, have.elementType, want.elementType))
    return col.cast(want)


def typed_literal(v: object, t: T.DataType) -> Column:
    if v is None:
        return F.lit(None).cast(t)
    return conform(literal(v), type_of(v), t) if not (isinstance(v, (list, dict)) and not v) else (F.array().cast(t) if isinstance(v, list) else F.lit(None).cast(t))


def compile_update(update: dict, schema: T.StructType, inserting: bool = False) -> list[tuple[str, Column, T.DataType]]:
    """(name, Column, type) of the row after the update."""
    check_update(update)
    row = Row(schema)

    def assign(path: str, v: object) -> None:
        have = row.get(path)[1]
        t = merged(have, type_of(v)) if have is not None else type_of(v)
        row.set(path, typed_literal(v, t), t)

    for op in OPERATORS:
        for path, v in update.get(op, {}).items():
            col, t = row.get(path)
            kind = kind_of_type(t)
            if op == "$set" or op == "$setOnInsert" and inserting:
                assign(path, v)
            elif op == "$unset":
                row.drop(path)
            elif op in ("$inc", "$mul"):
                t = merged(t, type_of(v)) if kind == "number" else type_of(v)
                base = F.coalesce(col, F.lit(0)) if kind == "number" else F.lit(0)
                row.set(path, (base + F.lit(v) if op == "$inc" else base * F.lit(v)).cast(t), t)
            elif op in ("$push", "$addToSet"):
                _append(row, path, op, v)
            elif op == "$pull":
                if kind == "array":
                    row.set(path, F.filter(col, lambda x: _kept(x, t.elementType, v)), t)
            elif op == "$rename":
                if t is not None:
                    row.set(v, col, t)
                    row.drop(path)
            elif op in ("$min", "$max"):
                if kind != "number":
                    assign(path, v)
                else:
                    t = merged(t, type_of(v))
                    pick = F.least if op == "$min" else F.greatest
                    row.set(path, F.coalesce(pick(col.cast(t), F.lit(v).cast(t)), F.lit(v).cast(t)), t)
    return [(n, c, t) for n, (c, t) in row.cols.items()]


def _append(row: Row, path: str, op: str, v: object) -> None:
    col, t = row.get(path)
    options = v if op == "$push" and isinstance(v, dict) and "$each" in v else {}
    new = list(options["$each"]) if options else [v]
    have = t if isinstance(t, T.ArrayType) else T.ArrayType(T.NullType())
    t = merged(have, type_of(new))
    base = F.coalesce(conform(col, have, t), F.array().cast(t)) if kind_of_type(row.get(path)[1]) == "array" else F.array().cast(t)
    added = typed_literal(new, t)
    if op == "$addToSet":
        found = F.exists(base, lambda x: F.to_json(F.struct(x.alias("v"))) == F.to_json(F.struct(added[0].alias("v"))))
        out = F.when(found, base).otherwise(F.concat(base, added))
    else:
        out = F.concat(base, added)
    if "$sort" in options:
        ((field, way),) = options["$sort"].items()

        def compare(a: Column, b: Column) -> Column:
            x, y = (a.getField(field), b.getField(field)) if isinstance(t.elementType, T.StructType) else (a, b)
            less, more = (F.lit(-1), F.lit(1)) if way > 0 else (F.lit(1), F.lit(-1))
            return F.when(x.eqNullSafe(y), 0).when(x.isNull(), less).when(y.isNull(), more).when(x < y, less).otherwise(more)

        out = F.array_sort(out, compare)
    if "$slice" in options:
        n = int(options["$slice"])
        out = F.slice(out, 1, n) if n >= 0 else F.slice(out, F.lit(1), F.greatest(F.size(out) + n, F.lit(0)))
    row.set(path, out, t)


def _kept(x: Column, t: T.DataType, v: object) -> Column:
    """True for what $pull leaves."""
    if isinstance(v, dict) and _operators(v):
        return _field(x, t, v, False)
    if isinstance(v, dict) and isinstance(t, T.StructType):
        return compile_filter(v, Scope(t, x), want=False)
    return _equal(x, t, v, False)
