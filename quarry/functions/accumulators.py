"""Accumulators of $group and $bucket."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from .expressions import compile_expression
from .scope import Scope

ORDERED = ("$push", "$first", "$last", "$addToSet")


class Order:
    """The current ordering: (column, ascending) pairs; nulls are lowest, as Spark has them."""

    def __init__(self, keys: list[tuple[Column, bool]], types: list[T.DataType | None] | None = None):
        self.keys, self.types = keys, types or [None] * len(keys)

    def columns(self) -> list[Column]:
        return [c.asc() if up else c.desc() for c, up in self.keys]

    def fields(self) -> list[Column]:
        return [c.alias(f"o{i}") for i, (c, _) in enumerate(self.keys)]

    def one_way(self) -> bool | None:
        ways = {up for _, up in self.keys}
        return ways.pop() if len(ways) == 1 else None

    def sorted(self, pairs: Column) -> Column:
        """An array of structs with fields o0, o1, … in order."""
        if self.one_way() is True:
            return F.array_sort(pairs)
        if self.one_way() is False:
            return F.reverse(F.array_sort(pairs))

        def compare(a: Column, b: Column) -> Column:
            out = F.lit(0)
            for i, (_, up) in reversed(list(enumerate(self.keys))):
                x, y = a[f"o{i}"], b[f"o{i}"]
                less, more = (F.lit(-1), F.lit(1)) if up else (F.lit(1), F.lit(-1))
                out = F.when(x.eqNullSafe(y), out).when(x.isNull(), less).when(y.isNull(), more).when(x < y, less).otherwise(more)
            return out

        return F.array_sort(pairs, compare)


def _turned(c: Column, t: T.DataType | None, up: bool) -> Column | None:
    """A key whose ascending order is that of c, or for up=False its descending one; None for types that cannot be turned round."""
    if up:
        return c
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return F.struct(c.isNull(), ~F.isnan(c), -c)  # nulls last, NaN first
    if isinstance(t, T.IntegralType):
        return F.struct(c.isNull(), F.bitwise_not(c))
    if isinstance(t, T.DecimalType):
        return F.struct(c.isNull(), -c)
    if isinstance(t, T.DateType):
        return F.struct(c.isNull(), -F.unix_date(c))
    if isinstance(t, T.BooleanType):
        return F.struct(c.isNull(), ~c)
    if isinstance(t, T.TimestampType):
        return F.struct(c.isNull(), -F.unix_micros(c))
    return None


def compile_accumulator(spec: object, scope: Scope, order: Order) -> Column:
    if not isinstance(spec, dict) or len(spec) != 1:
        raise QueryError("an output has one accumulator")
    ((op, e),) = spec.items()
    if op == "$count":
        return F.count(F.lit(1))
    if op == "$sum":
        if isinstance(e, (int, float)) and not isinstance(e, bool):
            return F.count(F.lit(1)) * F.lit(e)
        if isinstance(e, str) and scope.kind(e[1:]) != "number":
            return F.count(F.lit(1)) * F.lit(0)
        return F.coalesce(F.sum(compile_expression(e, scope)), F.lit(0))
    if op == "$avg":
        if isinstance(e, str) and scope.kind(e[1:]) != "number":
            return F.avg(F.lit(None).cast("double"))
        return F.avg(compile_expression(e, scope))
    value = compile_expression(e, scope)
    if op == "$min":
        return F.min(value)
    if op == "$max":
        return F.max(value)
    pair = F.struct(*order.fields(), value.alias("v"))
    if op == "$push":
        return F.transform(order.sorted(F.collect_list(pair)), lambda x: x["v"])
    if op == "$addToSet":
        kept = F.collect_list(F.when(value.isNotNull(), pair))
        return F.array_distinct(F.transform(order.sorted(kept), lambda x: x["v"]))
    if op in ("$first", "$last"):
        way = order.one_way()
        if way is not None:
            pick = F.min_by if (op == "$first") == way else F.max_by
            return pick(F.struct(value.alias("v")), F.struct(*order.fields()))["v"]
        keys = [_turned(c, t, up) for (c, up), t in zip(order.keys, order.types)]
        if all(k is not None for k in keys):
            return (F.min_by if op == "$first" else F.max_by)(F.struct(value.alias("v")), F.struct(*keys))["v"]
        return F.element_at(order.sorted(F.collect_list(pair)), 1 if op == "$first" else -1)["v"]
    raise QueryError(f"unknown accumulator {op}")
