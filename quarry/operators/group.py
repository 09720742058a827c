"""$group, $bucket, $count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.accumulators import compile_accumulator
from ..functions.expressions import compile_expression
from .frame import Frame


def _key(spec: object, f: Frame) -> Column:
    if isinstance(spec, dict) and not any(k.startswith("$") for k in spec):
        return F.struct(*[compile_expression(v, f.scope).alias(k) for k, v in spec.items()])
    if spec is None:
        return F.lit(None).cast("string")
    return compile_expression(spec, f.scope)


def group(f: Frame, spec: dict) -> Frame:
    """A constant key still groups, so that empty input gives no row."""
    if "_id" not in spec:
        raise QueryError("$group needs _id")
    order = f.ordering()
    outputs = [compile_accumulator(v, f.scope, order).alias(k) for k, v in spec.items() if k != "_id"]
    keyed = f.df.groupBy(_key(spec["_id"], f).alias("_id"))
    return f.to(keyed.agg(*outputs) if outputs else keyed.agg(F.count(F.lit(1)).alias("__n")).drop("__n"), keep_order=False)


def bucket(f: Frame, spec: dict) -> Frame:
    """Half-open buckets of a numeric expression; `default` takes the rest, and has a row even when empty."""
    bounds, has_default, default = list(spec["boundaries"]), "default" in spec, spec.get("default")
    if len(bounds) < 2 or any(a >= b for a, b in zip(bounds, bounds[1:])):
        raise QueryError("boundaries ascend, two at least")
    path = spec["groupBy"]
    numeric = not isinstance(path, str) or f.scope.kind(path.removeprefix("$")) == "number"
    value = compile_expression(path, f.scope) if numeric else F.lit(None).cast("double")
    as_text = isinstance(default, str)
    place: Column = F.lit(None)
    for a, b in reversed(list(zip(bounds, bounds[1:]))):
        place = F.when((value >= a) & (value < b), F.lit(str(a) if as_text else a)).otherwise(place)
    if has_default:
        place = F.coalesce(place, F.lit(default))
    order, output = f.ordering(), dict(spec.get("output", {}))
    columns = {"count": F.count(F.lit(1))} | {k: compile_accumulator(v, f.scope, order) for k, v in output.items()}
    keyed = f.df.where(place.isNotNull()).groupBy(place.alias("_id"))
    out = keyed.agg(*[c.alias(k) for k, c in columns.items()])
    if has_default:
        # the accumulators over no row, joined to nothing: only taken if the bucket is absent
        empty = f.df.where(F.lit(False)).agg(*[c.alias(k) for k, c in columns.items()]).select(F.lit(default).cast(out.schema["_id"].dataType).alias("_id"), *columns)
        out = out.unionByName(empty.join(out.where(F.col("_id") == F.lit(default)).select("_id"), "_id", "left_anti"))
    return f.to(out, keep_order=False)


def count(f: Frame, name: str) -> Frame:
    return f.to(f.df.agg(F.count(F.lit(1)).alias(name)), keep_order=False)
