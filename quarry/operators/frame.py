"""A DataFrame with what stages must carry: its ordering, and where foreign collections come from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.accumulators import Order
from ..functions.scope import Scope

Resolver = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    order: tuple[tuple[str, bool], ...] = ()  # paths of the last $sort that still hold
    resolver: Resolver | None = None
    tokens: str | None = None

    @property
    def scope(self) -> Scope:
        return Scope(self.df.schema, tokens=self.tokens if self.tokens in self.df.columns else None)

    def to(self, df: DataFrame, keep_order: bool = True) -> Frame:
        kept = self.order if keep_order and all(p.split(".")[0] in df.columns for p, _ in self.order) else ()
        return replace(self, df=df, order=kept)

    def ordering(self) -> Order:
        """The sort in force; without one, _id, or all columns that can be compared: input order means nothing in Spark."""
        if self.order:
            return Order([(self.scope.col(p), up) for p, up in self.order], [self.scope.type(p) for p, _ in self.order])
        if "_id" in self.df.columns and orderable(self.df.schema["_id"].dataType):
            return Order([(F.col("_id"), True)])
        names = [f.name for f in self.df.schema.fields if orderable(f.dataType)]
        return Order([(F.col(f"`{n}`"), True) for n in names])


def orderable(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return orderable(t.elementType)
    if isinstance(t, T.StructType):
        return all(orderable(f.dataType) for f in t.fields)
    return not isinstance(t, (T.MapType, T.VariantType))


def column(name: str) -> Column:
    return F.col(f"`{name}`")
