"""Change events are rows of an append-only Parquet log beside the snapshots, read as a stream."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.filters import compile_filter
from ..functions.scope import VariantScope

SCHEMA = T.StructType([
    T.StructField("operationType", T.StringType()), T.StructField("documentKey", T.StringType()), T.StructField("fullDocument", T.StringType()),
    T.StructField("updateDescription", T.StringType()), T.StructField("timestamp", T.LongType()), T.StructField("txId", T.LongType()),
])


def events(rows: DataFrame, kind: str, update: dict | None = None) -> DataFrame:
    full = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])) if kind != "delete" else F.lit(None).cast("string")
    told = json.dumps({"updatedFields": update.get("$set", {}), "removedFields": sorted(update.get("$unset", {}))}, default=str) if update else None
    return rows.select(F.lit(kind).alias("operationType"), F.col("_id").alias("documentKey"), full.alias("fullDocument"), F.lit(told).cast("string").alias("updateDescription"),
                       F.unix_millis(F.current_timestamp()).alias("timestamp"), F.lit(0).cast("long").alias("txId"))


def drop_event(spark: SparkSession) -> DataFrame:
    return events(spark.createDataFrame([("*",)], "_id string"), "delete").withColumn("operationType", F.lit("drop"))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


class ChangeStream:
    """Listeners by event; `change` hears all. A filter is only asked of events that have a document, so deletes always pass."""

    def __init__(self, spark: SparkSession, path: str, f: dict | None = None, full_document: bool = True):
        self.spark, self.path, self.filter, self.full = spark, path, f, full_document
        self.listeners: dict[str, list[Callable[[dict | None], None]]] = {}
        self.query = None
        self.is_closed = False
        spark.createDataFrame([], SCHEMA).write.mode("append").parquet(path)  # the folder must be there

    def frame(self) -> DataFrame:
        """The stream itself."""
        out = self.spark.readStream.schema(SCHEMA).parquet(self.path)
        if self.filter:
            doc = VariantScope(F.try_parse_json("fullDocument"), None)
            out = out.where(F.col("fullDocument").isNull() | compile_filter(self.filter, doc))
        return out if self.full else out.withColumn("fullDocument", F.lit(None).cast("string"))

    def on(self, event: str, listener: Callable[[dict | None], None]) -> ChangeStream:
        self.listeners.setdefault(event, []).append(listener)
        return self

    def start(self, checkpoint: str, available_now: bool = False):
        def deliver(batch: DataFrame, _: int) -> None:
            for r in batch.orderBy("timestamp").toLocalIterator():
                event = r.asDict()
                for name in ("change", event["operationType"]):
                    for listener in self.listeners.get(name, ()):
                        listener(event)

        writer = self.frame().writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
        self.query = (writer.trigger(availableNow=True) if available_now else writer).start()
        return self.query

    def close(self) -> None:
        if self.is_closed:
            return
        self.is_closed = True
        if self.query is not None:
            self.query.stop()
        for listener in self.listeners.get("close", ()):
            listener(None)
