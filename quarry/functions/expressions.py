"""Expression documents to Columns; expressions nest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from .filters import compile_filter
from .scope import Scope, literal


def compile_expression(e: object, scope: Scope) -> Column:
    if isinstance(e, str) and e.startswith("$"):
        return scope.col(e[1:])
    if isinstance(e, dict) and any(k.startswith("$") for k in e):
        if len(e) != 1:
            raise QueryError("an expression has one operator")
        ((op, args),) = e.items()
        return _operator(op, args, scope)
    if isinstance(e, dict):
        return F.struct(*[compile_expression(v, scope).alias(k) for k, v in e.items()])
    if isinstance(e, (list, tuple)):
        return F.array(*[compile_expression(v, scope) for v in e])
    return literal(e)


def _numeric(e: object, scope: Scope, otherwise: float) -> Column:
    """Numbers count; whatever else counts as the neutral element."""
    if isinstance(e, str) and e.startswith("$"):
        return F.coalesce(scope.col(e[1:]), F.lit(otherwise)) if scope.kind(e[1:]) == "number" else F.lit(otherwise)
    if isinstance(e, dict):
        return F.coalesce(compile_expression(e, scope), F.lit(otherwise))
    return F.lit(e) if isinstance(e, (int, float)) and not isinstance(e, bool) else F.lit(otherwise)


def _operator(op: str, args: object, scope: Scope) -> Column:
    many = list(args) if isinstance(args, (list, tuple)) else [args]
    if op == "$literal":
        return literal(args)
    if op == "$concat":
        return F.concat(*[F.coalesce(compile_expression(a, scope).cast("string"), F.lit("")) for a in many])
    if op == "$add":
        return reduce(lambda a, b: a + b, [_numeric(a, scope, 0) for a in many])
    if op == "$multiply":
        return reduce(lambda a, b: a * b, [_numeric(a, scope, 1) for a in many])
    if op in ("$subtract", "$divide"):
        if len(many) != 2:
            raise QueryError(f"{op} takes two operands")
        a, b = (compile_expression(x, scope) for x in many)
        return a - b if op == "$subtract" else F.try_divide(a, b)
    if op == "$cond":
        test, then, other = (args["if"], args["then"], args["else"]) if isinstance(args, dict) else many
        return F.when(compile_filter(test, scope), compile_expression(then, scope)).otherwise(compile_expression(other, scope))
    if op == "$ifNull":
        return F.coalesce(*[compile_expression(a, scope) for a in many])
    raise QueryError(f"unknown expression operator {op}")
