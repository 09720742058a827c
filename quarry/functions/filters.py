"""Filter documents to boolean Columns.

A filter compiles to a Column that is true where the document matches, or with want=False to one that is true where it does not;
elsewhere it is false or null, which `where`, `when` and `filter` treat alike. Negations are carried down to the single comparisons, which then
ask for null themselves, so every comparison of a plain column reaches the Parquet scan.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..limits import MAX_IN, check_filter, check_regex
from .scope import Scope, VariantScope, kind_of_type, kind_of_value
from .text import matches_all


def total(p: Column) -> Column:
    """Two-valued: unknown is false. Needed before a predicate is negated as a whole."""
    return F.coalesce(p, F.lit(False))


def all_of(ps: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, ps) if ps else F.lit(True)


def any_of(ps: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, ps) if ps else F.lit(False)


def none_but(p: Column, want: bool) -> Column:
    return p if want else ~total(p)


def _both(parts: list[Column], want: bool) -> Column:
    """All parts hold; parts of want=False say that theirs does not."""
    return all_of(parts) if want else any_of(parts)


def _either(parts: list[Column], want: bool) -> Column:
    return any_of(parts) if want else all_of(parts)


def _plain(col: Column, p: Column, want: bool) -> Column:
    """A predicate that is null only where col is."""
    return p if want else col.isNull() | ~p


def compile_filter(f: dict, scope: Scope | VariantScope, checked: bool = False, want: bool = True) -> Column:
    if not checked:
        check_filter(f)
    out = []
    for key, cond in f.items():
        if key == "$and":
            out.append(_both([compile_filter(x, scope, True, want) for x in cond], want))
        elif key == "$or":
            out.append(_either([compile_filter(x, scope, True, want) for x in cond], want))
        elif key == "$nor":
            out.append(_either([compile_filter(x, scope, True, not want) for x in cond], not want))
        elif key == "$not":
            out.append(compile_filter(cond, scope, True, not want))
        elif key == "$text":
            if scope.tokens is None:
                raise QueryError("$text needs a text index")
            out.append(none_but(matches_all(F.col(scope.tokens), scope.kind(scope.tokens) == "array", cond.get("$search", "") if isinstance(cond, dict) else cond), want))
        elif key.startswith("$"):
            raise QueryError(f"unknown operator {key}")
        elif scope.dynamic:
            out.append(none_but(_dynamic(scope, key, cond), want))
        else:
            out.append(_field(scope.col(key), scope.type(key), cond, want))
    return _both(out, want)


def _operators(cond: object) -> bool:
    if not isinstance(cond, dict) or not cond:
        return False
    marked = [k.startswith("$") for k in cond]
    if any(marked) and not all(marked):
        raise QueryError("operators and fields mixed in one condition")
    return all(marked)


def _equal(col: Column, t: T.DataType | None, v: object, want: bool = True) -> Column:
    """Strict: values of another type differ."""
    if v is None:
        return col.isNull() if want else col.isNotNull()
    kind, other = kind_of_type(t), kind_of_value(v)
    if kind != other:
        return F.lit(not want)
    if other == "object":
        names = t.names if isinstance(t, T.StructType) else []
        if set(v) != set(names):
            return F.lit(not want)
        return _both([col.isNotNull() if want else col.isNull(), *[_equal(col.getField(k), t[k].dataType, x, want) for k, x in v.items()]], want)
    if other == "array":
        parts = [_equal(F.get(col, F.lit(i)), t.elementType, x, want) for i, x in enumerate(v)]
        return _both([_plain(col, F.size(col) == len(v), want), *parts], want)
    return col == F.lit(v) if want else col.isNull() | (col != F.lit(v))


def _regex(col: Column, pattern: object, options: str = "", want: bool = True) -> Column:
    if isinstance(pattern, re.Pattern):
        options += "".join(c for c, flag in (("i", re.I), ("m", re.M), ("s", re.S)) if pattern.flags & flag)
        pattern = pattern.pattern
    if not isinstance(pattern, str):
        raise QueryError("$regex takes a string")
    flags = "".join(sorted(set(options) & set("ims")))
    return _plain(col, col.rlike((f"(?{flags})" if flags else "") + check_regex(pattern)), want)


def _list(op: str, v: object) -> list | None:
    if not isinstance(v, (list, tuple)):
        return None
    if len(v) > MAX_IN:
        raise QueryError(f"{op} takes at most {MAX_IN} values")
    return list(v)


def _member(col: Column, t: T.DataType | None, values: list, want: bool = True) -> Column:
    """An array column is a member if one of its elements is."""
    if isinstance(t, T.ArrayType):
        return none_but(F.exists(col, lambda x: _member(x, t.elementType, values)), want)
    kind = kind_of_type(t)
    plain = [x for x in values if x is not None and kind_of_value(x) == kind and kind not in ("object", "array")]
    found = [_plain(col, col.isin(plain), want)] if plain else []
    found += [_equal(col, t, x, want) for x in values if x is None or kind_of_value(x) in ("object", "array")]
    return _either(found, want)


_TYPES = {"number": "number", "string": "string", "boolean": "boolean", "array": "array", "object": "object", "time": "object", "missing": "undefined"}
_COMPARE = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}


def _field(col: Column, t: T.DataType | None, cond: object, want: bool = True) -> Column:
    never, kind = F.lit(not want), kind_of_type(t)
    if isinstance(cond, re.Pattern):
        return _regex(col, cond, want=want) if kind == "string" else never
    if not _operators(cond):
        return _equal(col, t, cond, want)
    out = []
    for op, v in cond.items():
        if op in ("$eq", "$ne"):
            out.append(_equal(col, t, v, want == (op == "$eq")))
        elif op in _COMPARE:
            fits = v is not None and kind == kind_of_value(v) and kind not in ("array", "object")
            out.append(_plain(col, _COMPARE[op](col, F.lit(v)), want) if fits else never)
        elif op in ("$in", "$nin"):
            values = _list(op, v)
            out.append(never if values is None else _member(col, t, values, want == (op == "$in")))
        elif op == "$exists":
            out.append(never if not isinstance(v, bool) else col.isNotNull() if v == want else col.isNull())
        elif op == "$regex":
            out.append(_regex(col, v, str(cond.get("$options", "")), want) if kind == "string" else never)
        elif op == "$options":
            continue
        elif op == "$size":
            out.append(_plain(col, (F.size(col) == F.lit(v)) & col.isNotNull(), want) if kind == "array" else never)
        elif op == "$all":
            out.append(none_but(_all(col, t, v), want))
        elif op == "$elemMatch":
            out.append(none_but(_element(col, t, v), want))
        elif op == "$type":
            told = v in ("null", "undefined")
            out.append((col.isNull() if told == want else col.isNotNull()) if told or _TYPES[kind] == v else never)
        elif op == "$mod":
            if not isinstance(v, (list, tuple)) or len(v) != 2:
                raise QueryError("$mod takes [divisor, remainder]")
            out.append(none_but(F.try_mod(col, F.lit(v[0])) == F.lit(v[1]), want) if kind == "number" else never)
        elif op == "$not":
            out.append(_field(col, t, v, not want))
        elif op == "$where":
            raise QueryError("$where is not allowed")
        else:
            raise QueryError(f"unknown operator {op}")
    return _both(out, want)


def _all(col: Column, t: T.DataType | None, values: object) -> Column:
    if not isinstance(t, T.ArrayType) or not isinstance(values, (list, tuple)):
        return F.lit(False)

    def holds(w: object) -> Column:
        return F.exists(col, lambda x: _equal(x, t.elementType, w))

    return col.isNotNull() & all_of([holds(w) for w in values])


def _element(col: Column, t: T.DataType | None, cond: dict) -> Column:
    if not isinstance(t, T.ArrayType):
        return F.lit(False)
    e = t.elementType
    if _operators(cond) and not any(k in ("$and", "$or", "$nor") for k in cond):
        return F.exists(col, lambda x: _field(x, e, cond))
    if not isinstance(e, T.StructType):
        return F.lit(False)
    return F.exists(col, lambda x: compile_filter(cond, Scope(e, x), True))


def _dynamic(scope: VariantScope, path: str, cond: object) -> Column:
    """As _field, on a VARIANT: null and missing differ, and types are those of the value at hand."""

    def equal(v: object) -> Column:
        if v is None:
            return scope.null(path)
        kind = kind_of_value(v)
        if kind in ("array", "object"):
            import json

            return total(F.to_json(scope.col(path)) == F.to_json(F.parse_json(F.lit(json.dumps(v)))))
        return total(scope.value(path, kind) == F.lit(float(v) if kind == "number" else v))

    if isinstance(cond, re.Pattern):
        return total(_regex(scope.value(path, "string"), cond))
    if not _operators(cond):
        return equal(cond)
    out = []
    for op, v in cond.items():
        if op == "$eq":
            out.append(equal(v))
        elif op == "$ne":
            out.append(~equal(v))
        elif op in _COMPARE:
            kind = kind_of_value(v)
            out.append(total(_COMPARE[op](scope.value(path, kind), F.lit(float(v) if kind == "number" else v))) if kind in ("number", "string", "boolean") else F.lit(False))
        elif op in ("$in", "$nin"):
            values = _list(op, v)
            hit = any_of([equal(x) for x in values or []])
            out.append(hit if op == "$in" or values is None else ~hit)
        elif op == "$exists":
            out.append(F.lit(False) if not isinstance(v, bool) else ~scope.missing(path) if v else scope.missing(path))
        elif op == "$regex":
            out.append(total(_regex(scope.value(path, "string"), v, str(cond.get("$options", "")))))
        elif op == "$options":
            continue
        elif op == "$size":
            out.append(total(F.size(scope.value(path, "array")) == F.lit(v)) & scope.value(path, "array").isNotNull())
        elif op == "$all":
            arr = scope.value(path, "array")
            out.append(arr.isNotNull() & all_of([_any_element(arr, {"$eq": w}) for w in v]))
        elif op == "$elemMatch":
            out.append(_any_element(scope.value(path, "array"), v))
        elif op == "$type":
            told = scope.told(path)
            out.append({
                "undefined": scope.missing(path), "null": scope.null(path), "number": scope.value(path, "number").isNotNull(), "string": total(told == "STRING"),
                "boolean": total(told == "BOOLEAN"), "array": total(told.startswith("ARRAY")), "object": total(told.startswith("OBJECT")),
            }.get(v, F.lit(False)))
        elif op == "$mod":
            out.append(total(F.try_mod(scope.value(path, "number"), F.lit(float(v[0]))) == F.lit(float(v[1]))))
        elif op == "$not":
            out.append(~_dynamic(scope, path, v))
        else:
            raise QueryError(f"unknown operator {op}")
    return all_of(out)


def _any_element(arr: Column, cond: dict) -> Column:
    if _operators(cond):
        return total(F.exists(arr, lambda x: _dynamic(VariantScope(F.parse_json(F.concat(F.lit('{"v":'), F.to_json(x), F.lit("}"))), None), "v", cond)))
    return total(F.exists(arr, lambda x: compile_filter(cond, VariantScope(x, None), True)))
