"""$lookup: a left outer group join."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.scope import Scope, kind_of_type
from ..functions.updates import Row
from .frame import Frame, column, orderable


def lookup(f: Frame, spec: dict) -> Frame:
    """Attach the array of foreign rows whose foreignField equals localField; null keys match null keys. Arrays are in the order of the
    foreign rows' own fields. The foreign side is grouped before the join, so rows meet once a key."""
    if f.resolver is None:
        raise QueryError("$lookup needs a resolver")
    foreign = f.resolver(spec["from"])
    rows = F.struct(*[column(c) for c in foreign.columns])
    scope, remote = f.scope, Scope(foreign.schema)
    gathered = F.collect_list(rows)
    if orderable(foreign.schema):
        gathered = F.array_sort(gathered)
    grouped = foreign.groupBy(remote.col(spec["foreignField"]).alias("__key")).agg(gathered.alias("__rows"))
    local, lt, ft = scope.col(spec["localField"]), scope.type(spec["localField"]), remote.type(spec["foreignField"])
    same = kind_of_type(lt) == kind_of_type(ft) or "missing" in (kind_of_type(lt), kind_of_type(ft))
    on = local.eqNullSafe(F.col("__key")) if same else F.lit(False)  # 1 is not "1"
    joined = f.df.join(grouped, on, "left") if same else f.df.withColumn("__rows", F.lit(None).cast(T.ArrayType(foreign.schema)))
    found = F.coalesce(F.col("__rows"), F.array().cast(T.ArrayType(foreign.schema)))
    row = Row(f.df.schema)
    row.set(spec["as"], found, T.ArrayType(foreign.schema))
    return f.to(joined.select(*[c.alias(n) for n, (c, _) in row.cols.items()]), keep_order=False)
