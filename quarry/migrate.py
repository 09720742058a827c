"""Migrations: documents below a version are transformed together, and marked with it."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .collection import aligned
from .errors import QueryError
from .functions.updates import merged

VERSION = "_schemaVersion"


def pending(df: DataFrame, version: int) -> Column:
    return F.coalesce(F.col(VERSION) < version, F.lit(True)) if VERSION in df.columns else F.lit(True)


def migrated(df: DataFrame, version: int, transform: Callable[[DataFrame], DataFrame], chosen: DataFrame | None = None) -> DataFrame:
    """transform: DataFrame to DataFrame, on the documents below the version (and, if given, with an _id in chosen); the others stay."""
    todo = df.where(pending(df, version))
    rest = df.where(~pending(df, version))
    if chosen is not None:
        rest = df.join(chosen, "_id", "left_anti")
        todo = df.join(chosen, "_id", "left_semi")
    new = transform(todo).withColumn(VERSION, F.lit(version).cast("int"))
    schema = merged(df.schema, new.schema)
    return aligned(rest, schema).unionByName(aligned(new, schema))


class MigrationRunner:
    def __init__(self, collection):
        self.collection = collection

    def _pending(self, version: int, f: dict | None) -> DataFrame:
        found = self.collection.find(f or {})
        return found.where(pending(found, version))

    def migrate(self, version: int, transform: Callable[[DataFrame], DataFrame], dry_run: bool = False, continue_on_error: bool = False, on_progress: Callable[[int], None] | None = None,
                filter: dict | None = None, batch_size: int | None = None, timeout: float | None = None) -> dict:
        """One rewrite of the collection; with batch_size one for each so many documents, in order of _id, after each of which on_progress
        hears how many are done. Past timeout seconds no further batch begins: those done stay, and a later call goes on. filter: only documents that match."""
        if isinstance(version, bool) or not isinstance(version, int) or version < 1:
            raise QueryError("a schema version is a whole number, 1 or more")
        if batch_size is not None and batch_size < 1:
            raise QueryError("a batch holds a document at least")
        start, n = time.monotonic(), self._pending(version, filter).count()
        out = {"version": version, "migrated": 0, "pending": n, "dryRun": dry_run, "errors": [], "timedOut": False}
        while out["migrated"] < n and not out["timedOut"]:
            try:
                chosen = None
                if batch_size is not None or filter:
                    chosen = self._pending(version, filter).select("_id")
                    chosen = chosen if batch_size is None else chosen.orderBy("_id").limit(batch_size)
                size = n if batch_size is None else min(batch_size, n - out["migrated"])
                new = migrated(self.collection.df(), version, transform, chosen)
                if dry_run:
                    new.schema  # the transformation is at least analysed
                    out["migrated"] = n
                else:
                    self.collection._commit(new)
                    out["migrated"] += size
            except Exception as e:
                if not continue_on_error:
                    raise
                out["errors"].append(str(e))
                break
            if on_progress:
                on_progress(out["migrated"])
            out["timedOut"] = timeout is not None and time.monotonic() - start > timeout and out["migrated"] < n
        return out

    def count_pending(self, version: int, filter: dict | None = None) -> int:
        return self._pending(version, filter).count()

    def is_complete(self, version: int) -> bool:
        return self.count_pending(version) == 0
