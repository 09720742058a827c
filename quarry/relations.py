"""References between collections. A populated field is the struct of the document found, null on a miss, beside `<field>_id` with the key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import QueryError


class RelationManager:
    def __init__(self):
        self._known: dict[str, DataFrame | object] = {}

    def register(self, name: str, source) -> RelationManager:
        """source: a DataFrame with _id, or a collection."""
        self._known[name] = source
        return self

    def registered_collections(self) -> list[str]:
        return sorted(self._known)

    def clear(self) -> None:
        self._known.clear()

    def _frame(self, name: str) -> DataFrame:
        if name not in self._known:
            raise QueryError(f"no collection {name} is registered")
        source = self._known[name]
        return source if isinstance(source, DataFrame) else source.df()

    def populate_many(self, df: DataFrame, fields: dict[str, str]) -> DataFrame:
        """fields: name -> collection. Keys are strings, or arrays of them, whose documents come in the array's order. No limit on distinct keys."""
        for field, name in fields.items():
            other = self._frame(name)
            payload = other.select(F.col("_id").alias("__key"), F.struct(*[F.col(f"`{c}`") for c in other.columns]).alias("__doc"))
            kind = df.schema[field].dataType
            rest = [F.col(f"`{c}`") for c in df.columns if c != field]
            if isinstance(kind, T.ArrayType):
                # joined by the array itself: equal arrays have equal documents, so no row number must survive a recomputation
                lists = df.select(F.col(f"`{field}`").alias("__list")).where("__list is not null").distinct()
                parts = lists.select("__list", F.posexplode("__list").alias("__at", "__key")).join(payload, "__key", "left")
                gathered = parts.groupBy("__list").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", F.struct(F.col("__doc").alias("d")).alias("w")))), lambda x: x["w"]["d"]).alias("__docs"))
                df = df.join(gathered, F.col(f"`{field}`") == F.col("__list"), "left").select(*rest, F.col(f"`{field}`").alias(f"{field}_id"), F.col("__docs").alias(field))
            elif isinstance(kind, T.StringType):
                df = df.join(payload, F.col(f"`{field}`") == F.col("__key"), "left").select(*rest, F.col(f"`{field}`").alias(f"{field}_id"), F.col("__doc").alias(field))
        return df

    def populate(self, doc: dict, fields: dict[str, str]) -> dict:
        """One document: the key stays where nothing is found."""
        out = dict(doc)
        for field, name in fields.items():
            if isinstance(doc.get(field), str):
                rows = self._frame(name).where(F.col("_id") == F.lit(doc[field])).limit(1).collect()
                out[field] = rows[0].asDict(recursive=True) if rows else doc[field]
        return out
