"""$match, $project, $addFields, $replaceRoot, $unwind, $sort, $limit, $skip, $densify, $facet."""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.accumulators import Order
from ..functions.expressions import compile_expression
from ..functions.filters import compile_filter
from ..functions.scope import literal
from ..functions.updates import Row
from ..limits import check_count
from .frame import Frame, column


def match(f: Frame, spec: dict) -> Frame:
    return f.to(f.df.where(compile_filter(spec, f.scope)))


def project(f: Frame, spec: dict) -> Frame:
    """Inclusion, renaming and computing; or, where every value is 0, exclusion. _id comes last unless it is 0."""
    off = [k for k, v in spec.items() if v in (0, False) and not isinstance(v, str)]
    if spec and len(off) == len(spec):
        return f.to(f.df.drop(*off))
    out: list[Column] = []
    for k, v in spec.items():
        if k == "_id" or k in off:
            continue
        if v in (1, True) and not isinstance(v, (str, float)):
            if k in f.df.columns:
                out.append(column(k))
        else:
            out.append(compile_expression(v, f.scope).alias(k))
    if "_id" not in off:
        if spec.get("_id") not in (None, 1, True):
            out.append(compile_expression(spec["_id"], f.scope).alias("_id"))
        elif "_id" in f.df.columns:
            out.append(column("_id"))
    renamed = {k for k, v in spec.items() if not (v in (1, True) and not isinstance(v, (str, float)))}
    return f.to(f.df.select(*out), keep_order=not any(p.split(".")[0] in renamed for p, _ in f.order))


def add_fields(f: Frame, spec: dict) -> Frame:
    """All right-hand sides read the input; dotted targets make their parents."""
    row = Row(f.df.schema)
    made = f.df.select(*[compile_expression(v, f.scope).alias(k) for k, v in spec.items()]).schema
    for k, v in spec.items():
        row.set(k, compile_expression(v, f.scope), made[k].dataType)
    return f.to(f.df.select(*[c.alias(n) for n, (c, _) in row.cols.items()]), keep_order=not any(p.split(".")[0] in {k.split(".")[0] for k in spec} for p, _ in f.order))


def replace_root(f: Frame, spec: dict) -> Frame:
    root = spec["newRoot"]
    if isinstance(root, str):
        t = f.scope.type(root[1:])
        if not isinstance(t, T.StructType):
            return f.to(f.df.select(), keep_order=False)
        return f.to(f.df.select(f.scope.col(root[1:]).alias("r")).select("r.*"), keep_order=False)
    return f.to(f.df.select(*[literal(v).alias(k) for k, v in root.items()]), keep_order=False)


def unwind(f: Frame, spec: object) -> Frame:
    """A row per element. What is kept of an empty array is null, as the column takes the type of its elements."""
    path, keep = (spec, False) if isinstance(spec, str) else (spec["path"], bool(spec.get("preserveNullAndEmptyArrays")))
    path = path.removeprefix("$")
    t = f.scope.type(path)
    if not isinstance(t, T.ArrayType):
        return f if keep else f.to(f.df.where(F.lit(False)))
    head = path.split(".")[0]
    explode = F.explode_outer if keep else F.explode
    if head == path:
        out = f.df.select(*[explode(column(c)).alias(c) if c == path else column(c) for c in f.df.columns])
    else:
        wide = f.df.withColumn("__element", explode(f.scope.col(path)))
        row = Row(wide.schema)
        row.set(path, F.col("__element"), t.elementType)
        out = wide.select(*[c.alias(n) for n, (c, _) in row.cols.items() if n != "__element"])
    return f.to(out, keep_order=not any(p.split(".")[0] == head for p, _ in f.order))


def sort(f: Frame, spec: dict) -> Frame:
    keys = []
    for path, way in spec.items():
        if isinstance(way, bool) or way not in (1, -1):
            raise QueryError("$sort takes 1 or -1")
        if f.scope.type(path) is not None:
            keys.append((path, way == 1))
    if not keys:
        return f
    cols = [f.scope.col(p).asc() if up else f.scope.col(p).desc() for p, up in keys]
    return replace(f, df=f.df.orderBy(*cols), order=tuple(keys))


def limit(f: Frame, n: object) -> Frame:
    return f.to(f.df.limit(check_count(n, "$limit")))


def skip(f: Frame, n: object) -> Frame:
    return f.to(f.df.offset(check_count(n, "$skip")))


def densify(f: Frame, spec: dict) -> Frame:
    """Rows that hold the field alone, for every step of the range (bounds included) that no row has; sorted by the field.

    bounds: [low, high], "full" (the field's own range), or "partition" (the range of each partition of partitionByFields). A field of
    dates or timestamps takes a step in range.unit (millisecond to week).
    """
    field, bounds = spec["field"], spec["range"]["bounds"]
    step, by = spec["range"]["step"], list(spec.get("partitionByFields", []))
    if isinstance(step, bool) or not isinstance(step, (int, float)) or not (step > 0 and math.isfinite(step)):
        raise QueryError("$densify needs a step above 0")
    if f.scope.kind(field) == "time":
        return _densify_time(f, spec)
    if f.scope.kind(field) not in ("number", "missing") or "unit" in spec["range"]:
        raise QueryError("$densify needs a numeric field, or one of times and a unit")
    t = f.scope.type(field) or T.DoubleType()
    value = f.scope.col(field).cast(t)
    if isinstance(bounds, (list, tuple)):
        low, high = bounds
        if high < low:
            raise QueryError("$densify bounds run upward")
        span = f.df.sparkSession.range(0, int(math.floor((high - low) / step)) + 1).select((F.lit(low) + F.col("id") * F.lit(step)).cast(t).alias("__v"))
        grid = f.df.select(*by).distinct().join(F.broadcast(span)) if by else span
    elif bounds in ("full", "partition"):
        ends = f.df.groupBy(*(by if bounds == "partition" else [])).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")).where("__lo is not null")
        if by and bounds == "full":
            ends = f.df.select(*by).distinct().join(F.broadcast(ends))
        count = F.floor((F.col("__hi") - F.col("__lo")) / F.lit(step)).cast("long")
        grid = ends.select(*by, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), count), lambda i: (F.col("__lo") + i * F.lit(step)).cast(t))).alias("__v"))
    else:
        raise QueryError("$densify takes [low, high], 'full' or 'partition'")
    have = f.df.select(*by, value.alias("__v"))
    new = grid.join(have, [*by, "__v"], "left_anti")
    if "." in field:
        row = Row(T.StructType([]))
        row.set(field, F.col("__v"), t)
        ((name, (made, _)),) = row.cols.items()
        new = new.select(*by, made.alias(name))
    else:
        new = new.withColumnRenamed("__v", field)
    out = f.df.unionByName(new, allowMissingColumns=True)
    return sort(f.to(out, keep_order=False), {field: 1})


#: Microseconds of the units of time that have a fixed length.
UNITS = {"millisecond": 10**3, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6, "week": 7 * 86400 * 10**6}


def _densify_time(f: Frame, spec: dict) -> Frame:
    """As for numbers, on microseconds since 1970."""
    field, span = spec["field"], spec["range"]
    if "." in field:
        raise QueryError("$densify of times takes a field of the document itself")
    if span.get("unit") not in UNITS:
        raise QueryError(f"$densify of times needs a unit: {', '.join(UNITS)}")
    t = f.df.schema[field].dataType
    moment = lambda c: F.unix_micros(c.cast("timestamp"))
    bounds = span["bounds"]
    if isinstance(bounds, (list, tuple)):
        bounds = list(f.df.sparkSession.range(1).select(*[moment(F.lit(x)).alias(f"b{i}") for i, x in enumerate(bounds)]).first())
    numbers = f.to(f.df.withColumn(field, moment(column(field))), keep_order=False)
    out = densify(numbers, spec | {"range": {"bounds": bounds, "step": int(span["step"] * UNITS[span["unit"]])}})
    return sort(f.to(out.df.withColumn(field, F.timestamp_micros(field).cast(t)), keep_order=False), {field: 1})


def facet(f: Frame, spec: dict, run) -> Frame:
    """One row of arrays: each branch is gathered in its own order. Branches read the input each for itself, so each scans only its own columns."""
    source, rows = f, []
    for name, stages in spec.items():
        out = run(source, stages)
        # rows keep the place that a sort gave them, even where its keys were projected away
        placed = out.df.withColumn("__place", F.monotonically_increasing_id())
        order = out.ordering() if out.order else Order([(column("__place"), True)])
        pair = F.struct(*order.fields(), F.struct(*[column(c) for c in out.df.columns]).alias("v"))
        rows.append(placed.agg(F.transform(order.sorted(F.collect_list(pair)), lambda x: x["v"]).alias(name)))
    return f.to(reduce(lambda a, b: a.crossJoin(b), rows), keep_order=False)  # single rows only
