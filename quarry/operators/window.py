"""$setWindowFields."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.expressions import compile_expression
from .frame import Frame


#: Ranges that a running aggregate over all rows is cut into.
RANGES = 128


def _edge(x: object, low: bool) -> int:
    if x == "unbounded":
        return Window.unboundedPreceding if low else Window.unboundedFollowing
    if x == "current":
        return 0
    if isinstance(x, bool) or not isinstance(x, int):
        raise QueryError("a window edge is 'unbounded', 'current' or a whole number")
    return x


def _global_rank(f: Frame, key: str, up: bool, dense: bool, name: str) -> Frame:
    """Rank over all rows without moving them to one task: only the distinct keys and their counts are ranked."""
    col = f.scope.col(key)
    keys = f.df.groupBy(col.alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy(F.col("__k").asc() if up else F.col("__k").desc())
    rank = F.row_number().over(w) if dense else F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    ranked = keys.select("__k", rank.cast("long").alias("__rank"))
    out = f.df.join(ranked, col.eqNullSafe(F.col("__k")), "left")
    return f.to(out.select(*[F.col(f"`{c}`") for c in f.df.columns if c != name], F.col("__rank").alias(name)))


def _spread(f: Frame, key: str, up: bool) -> tuple[Column, int] | None:
    """Numbers of ranges of the first sort key, in order, and how many there are; None where the key has no quantiles. Equal keys share a range."""
    t = f.scope.type(key)
    col = f.scope.col(key)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        col = F.unix_micros(col.cast("timestamp"))
    elif isinstance(t, T.DateType):
        col = F.unix_date(col)
    elif not isinstance(t, T.NumericType):
        return None
    steps = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    cuts = sorted(set(f.df.agg(F.percentile_approx(col, steps, 10 * RANGES)).first()[0] or []))
    at = sum([F.coalesce((col >= F.lit(c)).cast("int"), F.lit(0)) for c in cuts], F.lit(0))
    return at if up else F.lit(len(cuts)) - at, len(cuts) + 1


def _running(f: Frame, keys: list, order: list, new: dict[str, tuple[str, Column]]) -> Frame | None:
    """Aggregates from the first row to the current one without partitionBy: each range of the first key runs by itself, and
    what the ranges before it amount to (one small row a range) is joined back. Null keys are in the first or last range."""
    spread = _spread(f, *keys[0])
    if spread is None:
        return None
    at, _ = spread
    df = f.df.withColumn("__range", at)
    combine = {"$sum": F.sum, "$count": F.sum, "$n": F.sum, "$min": F.min, "$max": F.max}
    own = {"$sum": lambda c: F.sum(c), "$count": lambda c: F.count(F.lit(1)), "$n": lambda c: F.count(c), "$min": lambda c: F.min(c), "$max": lambda c: F.max(c)}
    parts: dict[str, tuple[str, Column]] = {}
    for name, (fn, value) in new.items():
        for kind in ("$sum", "$n") if fn == "$avg" else (fn,):
            parts[f"__{kind[1:]}_{name}"] = (kind, value)
    totals = df.groupBy("__range").agg(*[own[k](v).alias(n) for n, (k, v) in parts.items()])
    past = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    before = totals.select("__range", *[combine[k](n).over(past).alias(f"{n}_before") for n, (k, _) in parts.items()])
    w = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({n: own[k](v).over(w) for n, (k, v) in parts.items()}).join(F.broadcast(before), "__range")
    joined = {}
    for n, (k, _) in parts.items():
        a, b = F.col(f"`{n}`"), F.col(f"`{n}_before`")
        joined[n] = F.least(a, b) if k == "$min" else F.greatest(a, b) if k == "$max" else F.coalesce(a + b, a, b)
    told = {name: F.coalesce(joined[f"__sum_{name}"], F.lit(0)) if fn == "$sum" else F.try_divide(joined[f"__sum_{name}"], joined[f"__n_{name}"]) if fn == "$avg" else joined[f"__{fn[1:]}_{name}"] for name, (fn, _) in new.items()}
    return f.to(out.select(*[F.col(f"`{c}`") for c in f.df.columns if c not in told], *[c.alias(n) for n, c in told.items()]))


def set_window_fields(f: Frame, spec: dict) -> Frame:
    """$sum, $avg, $rank, $denseRank, and $min, $max, $count as they come for free. Frames are in rows, from the start to the current row by default."""
    sort_by, output = spec.get("sortBy") or {}, spec["output"]
    keys = [(p, way == 1) for p, way in sort_by.items()]
    order = [f.scope.col(p).asc() if up else f.scope.col(p).desc() for p, up in keys]
    by = spec.get("partitionBy")
    parts = [compile_expression(by, f.scope)] if by is not None else []
    new, later, running = {}, [], {}
    for name, out in output.items():
        (fn,) = [k for k in out if k != "window"]
        if fn in ("$rank", "$denseRank"):
            if not keys:
                raise QueryError(f"{fn} needs sortBy")
            if not parts:
                later.append((name, fn == "$denseRank"))
                continue
            rank = F.dense_rank() if fn == "$denseRank" else F.rank()
            new[name] = rank.over(Window.partitionBy(*parts).orderBy(order[0])).cast("long")  # by the first sort key
            continue
        low, high = (out.get("window") or {}).get("documents", ["unbounded", "current"])
        w = Window.partitionBy(*parts).orderBy(*order).rowsBetween(_edge(low, True), _edge(high, False)) if order else Window.partitionBy(*parts)
        arg = out[fn]
        numeric = not isinstance(arg, str) or f.scope.kind(arg[1:]) == "number"
        value = compile_expression(arg, f.scope) if numeric else F.lit(None).cast("double")
        if not parts and order and fn in ("$sum", "$avg", "$min", "$max", "$count") and (low, high) == ("unbounded", "current"):
            running[name] = (fn, compile_expression(arg, f.scope) if fn in ("$min", "$max") else value)
            continue
        if fn == "$sum":
            new[name] = F.coalesce(F.sum(value).over(w), F.lit(0))
        elif fn == "$avg":
            new[name] = F.avg(value).over(w)
        elif fn in ("$min", "$max"):
            new[name] = (F.min if fn == "$min" else F.max)(compile_expression(arg, f.scope)).over(w)
        elif fn == "$count":
            new[name] = F.count(F.lit(1)).over(w)
        else:
            raise QueryError(f"unknown window function {fn}")
    if running:
        done = _running(f, keys, order, running)
        if done is None:  # a key without quantiles: one task
            w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
            plain = {"$sum": lambda c: F.coalesce(F.sum(c).over(w), F.lit(0)), "$avg": lambda c: F.avg(c).over(w), "$min": lambda c: F.min(c).over(w), "$max": lambda c: F.max(c).over(w), "$count": lambda c: F.count(F.lit(1)).over(w)}
            done = f.to(f.df.withColumns({n: plain[fn](c) for n, (fn, c) in running.items()}))
        f = done
    out = f.to(f.df.withColumns(new) if new else f.df)
    for name, dense in later:
        out = _global_rank(out, *keys[0], dense, name)
    return out
