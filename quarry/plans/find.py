"""find: filter, then sort, skip, limit, and project last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.filters import compile_filter
from ..functions.scope import Scope
from ..limits import check_count

OPTIONS = ("limit", "skip", "sort", "projection", "after", "hint", "explain")


def find(df: DataFrame, f: dict | None = None, options: dict | None = None, tokens: str | None = None) -> DataFrame:
    options = options or {}
    if unknown := set(options) - set(OPTIONS):
        raise QueryError(f"unknown options: {sorted(unknown)}")
    scope = Scope(df.schema, tokens=tokens)
    out = df.where(compile_filter(f, scope)) if f else df
    if options.get("after") is not None:
        out = out.where(F.col("_id") > F.lit(options["after"]))
    if options.get("sort"):
        keys = [(scope.col(p), way) for p, way in options["sort"].items() if scope.type(p) is not None]
        out = out.orderBy(*[c.asc() if way > 0 else c.desc() for c, way in keys]) if keys else out
    elif options.get("after") is not None:
        out = out.orderBy("_id")
    if options.get("skip"):
        out = out.offset(check_count(options["skip"], "skip"))
    if options.get("limit") is not None:
        out = out.limit(check_count(options["limit"], "limit"))
    return project(out, options.get("projection"))


def project(df: DataFrame, spec: dict | None) -> DataFrame:
    """Any 1 includes (with _id unless it is 0); all 0 exclude."""
    if not spec:
        return df
    if any(v in (1, True) for v in spec.values()):
        names = [c for c in df.columns if spec.get(c) in (1, True) or c == "_id" and spec.get("_id") not in (0, False)]
        return df.select(*[F.col(f"`{c}`") for c in names])
    return df.drop(*spec)
