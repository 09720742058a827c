"""A named bag of typed documents over versioned snapshots. Names are in snake case; camel-case names work too."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ids
from .errors import DuplicateKey, QueryError
from .functions.filters import compile_filter
from .functions.scope import Scope
from .functions.text import tokens
from .functions.updates import compile_update, conform, merged, type_of
from .limits import MAX_DOC_BYTES, check_filter, check_id, check_keys
from .plans.find import find, project
from .plans.pipeline import aggregate
from .sources import files
from .sources.store import Store
from .streaming import changes

TOKENS = "__tokens"


def schema_of(docs: list[dict]) -> T.StructType:
    out: T.DataType = T.StructType([T.StructField("_id", T.StringType())])
    for d in docs:
        out = merged(out, type_of(d))
    return T.StructType([T.StructField(f.name, _known(f.dataType)) for f in out.fields])


def _known(t: T.DataType) -> T.DataType:
    if isinstance(t, T.NullType):
        return T.StringType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_known(t.elementType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _known(f.dataType)) for f in t.fields])
    return t


def _shaped(v: object, t: T.DataType) -> object:
    if isinstance(t, T.DoubleType) and isinstance(v, int):
        return float(v)
    if isinstance(t, T.StructType) and isinstance(v, dict):
        return {f.name: _shaped(v.get(f.name), f.dataType) for f in t.fields}
    if isinstance(t, T.ArrayType) and isinstance(v, list):
        return [_shaped(x, t.elementType) for x in v]
    return v


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[(conform(F.col(f"`{f.name}`"), df.schema[f.name].dataType, f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


class Collection:
    def __init__(self, spark: SparkSession, path: str, name: str, resolver: Callable[[str], DataFrame] | None = None, compression: str | None = None):
        self.spark, self.name, self.resolver = spark, name, resolver
        self.store = Store(spark, path, compression)
        self.indexes: dict[str, dict] = {}
        self.text_index: str | None = None
        self.bulk: list[dict] | None = None
        self.held: list[DataFrame] | None = None  # change events of a transaction that has not committed yet
        if self.store.files.exists(self._definitions):
            told = json.loads(self.store.files.read(self._definitions))
            self.indexes, self.text_index = told["indexes"], told["text"]

    def __getattr__(self, name: str):
        snake = re.sub("[A-Z]", lambda m: "_" + m[0].lower(), name)
        if snake != name and hasattr(type(self), snake):
            return getattr(self, snake)
        raise AttributeError(name)

    @property
    def _definitions(self) -> str:
        return f"{self.store.root}/_indexes"

    def _save_definitions(self) -> None:
        self.store.files.write(self._definitions, json.dumps({"indexes": self.indexes, "text": self.text_index}))

    # reading

    def df(self) -> DataFrame:
        return self.store.read().drop(TOKENS)

    def _searchable(self) -> tuple[DataFrame, str | None]:
        """With the tokens of the text index: stored beside the documents, or computed where a snapshot is older than the index."""
        df = self.store.read()
        if self.text_index is None:
            return df.drop(TOKENS), None
        if TOKENS in df.columns:
            return df, TOKENS
        return self._with_tokens(self.df()), TOKENS

    def _with_tokens(self, df: DataFrame) -> DataFrame:
        scope = Scope(df.schema)
        if scope.kind(self.text_index) != "string":
            return df.withColumn(TOKENS, F.array().cast("array<string>"))
        return df.withColumn(TOKENS, F.array_distinct(tokens(scope.col(self.text_index))))

    def find(self, f: dict | None = None, **options) -> DataFrame:
        check_filter(f or {})
        df, column = self._searchable() if "$text" in json.dumps(f or {}, default=str) else (self.df(), None)
        out = find(df, f, options, column)
        return out.drop(TOKENS) if column else out

    def find_one(self, f: dict | None = None) -> dict | None:
        rows = self.find(f, limit=1).collect()
        return rows[0].asDict(recursive=True) if rows else None

    def find_by_id(self, id: str) -> dict | None:
        return self.find_one({"_id": id})

    def find_many_by_id(self, wanted: Iterable[str] | DataFrame) -> DataFrame:
        keys = wanted if isinstance(wanted, DataFrame) else self.spark.createDataFrame([(x,) for x in wanted], "_id string")
        return self.df().join(keys.select("_id"), "_id", "left_semi")

    def find_with_stats(self, f: dict | None = None, **options) -> tuple[list[dict], dict]:
        start = time.perf_counter()
        docs = [r.asDict(recursive=True) for r in self.find(f, **options).collect()]
        scanned = self.df().count()
        return docs, {"scanned": scanned, "returned": len(docs), "rejected": scanned - len(docs), "ms": (time.perf_counter() - start) * 1000, "plan": self.explain(f)["planType"]}

    def count_documents(self, f: dict | None = None) -> int:
        return self.find(f).count()

    def distinct_values(self, field: str, f: dict | None = None) -> DataFrame:
        """One column, value: the distinct values of a (dotted) field that are not null."""
        df = self.find(f)
        scope = Scope(df.schema)
        return df.select(scope.col(field).alias("value")).where("value is not null").distinct()

    def distinct(self, field: str, f: dict | None = None) -> list:
        """As a list on the driver; distinct_values() stays distributed."""
        return [r["value"] for r in self.distinct_values(field, f).collect()]

    def exists(self, f: dict | None = None) -> bool:
        return not self.find(f, limit=1).isEmpty()

    def aggregate(self, stages: list[dict], resolver: Callable[[str], DataFrame] | None = None) -> DataFrame:
        df, column = self._searchable()
        out = aggregate(df, stages, resolver or self.resolver, column)
        return out.drop(TOKENS)

    def explain(self, f: dict | None = None, **options) -> dict:
        check_filter(f or {})
        fields = set(f or {})
        kind, index = "full", None
        if "_id" in fields:
            kind = "primary"
        else:
            index = next((n for n, i in self.indexes.items() if i["fields"][0] in fields), None)
            kind = "index" if index else kind
        plan = find(self.df(), {k: v for k, v in (f or {}).items() if k != "$text"}, options)._jdf.queryExecution().simpleString()
        return {"planType": kind, "indexField": index, "plan": plan}

    def watch(self, f: dict | None = None, full_document: bool = True) -> changes.ChangeStream:
        return changes.ChangeStream(self.spark, self.store.log_path, f, full_document)

    # writing

    def _frame(self, docs: list[dict], schema: T.StructType) -> DataFrame:
        return self.spark.createDataFrame([tuple(_shaped(d.get(f.name), f.dataType) for f in schema.fields) for d in docs], schema)

    def _checked(self, doc: dict) -> dict:
        check_keys(doc)
        doc = {"_id": doc.get("_id") or ids.generate_id()} | {k: v for k, v in doc.items() if k != "_id"}
        check_id(doc["_id"])
        if len(json.dumps(doc, default=str).encode()) > MAX_DOC_BYTES:
            raise QueryError("document too large")
        return doc

    def _commit(self, df: DataFrame, events: DataFrame | None = None, expected: int | None = None) -> None:
        """Unique indexes are checked on the staged snapshot, before it is published."""
        expected = self.store.version() if expected is None else expected
        name = self.store.stage(self._sealed(df))
        staged = self._opened(self.spark.read.parquet(f"{self.store.root}/{name}"))
        try:
            for index in self.indexes.values():
                if index.get("unique"):
                    self._check_unique(staged, index)
        except DuplicateKey:
            self.store.files.delete(f"{self.store.root}/{name}")
            raise
        self.store.publish(name, expected)
        if events is not None:
            if self.held is not None:
                self.held.append(events)
            else:
                changes.append(events, self.store.log_path)

    def _sealed(self, df: DataFrame) -> DataFrame:
        """What a snapshot holds of the documents."""
        return self._with_tokens(df.drop(TOKENS)) if self.text_index else df

    def _opened(self, stored: DataFrame) -> DataFrame:
        """The documents of a snapshot."""
        return stored.drop(TOKENS)

    def _check_unique(self, df: DataFrame, index: dict) -> None:
        scope = Scope(df.schema)
        if any(scope.type(p) is None for p in index["fields"]):
            return
        rows = df.where(compile_filter(index["partial"], scope)) if index.get("partial") else df
        keys = [scope.col(p).alias(f"k{i}") for i, p in enumerate(index["fields"])]
        keyed = rows.select(*keys)
        for c in keyed.columns:
            keyed = keyed.where(F.col(c).isNotNull())
        if not keyed.groupBy(*keyed.columns).count().where("count > 1").isEmpty():
            raise DuplicateKey(f"unique index on {index['fields']}")

    def insert_one(self, doc: dict) -> str:
        return self.insert_many([doc])[0]

    def insert_many(self, docs: list[dict]) -> list[str]:
        docs = [self._checked(d) for d in docs]
        if not docs:
            return []
        if self.bulk is not None:
            self.bulk += docs
            return [d["_id"] for d in docs]
        if len({d["_id"] for d in docs}) < len(docs):
            raise DuplicateKey("an _id is given twice")
        self.insert_frame(self._frame(docs, schema_of(docs)))
        return [d["_id"] for d in docs]

    def insert_frame(self, new: DataFrame) -> int:
        """Append a DataFrame with _id; the batch way in."""
        old = self.df()
        if not old.join(new.select("_id"), "_id", "left_semi").isEmpty():
            raise DuplicateKey("an _id is there already")
        schema = merged(old.schema, new.schema)
        self._commit(aligned(old, schema).unionByName(aligned(new, schema)), changes.events(new, "insert"))
        return new.count()

    def _rewrite(self, f: dict, update: dict, one: bool) -> list[dict] | int:
        check_filter(f)
        old = self.df()
        hit = self._target(f, one)
        n = hit.count()
        if not n:
            return 0
        new = compile_update(update, old.schema)
        marked = old.join(hit.withColumn("__hit", F.lit(True)), "_id", "left")
        out = marked.select(*[F.when(F.col("__hit"), c).otherwise(conform(F.col(f"`{k}`"), old.schema[k].dataType, t) if k in old.columns else F.lit(None).cast(t)).cast(_known(t)).alias(k) for k, c, t in new], "__hit")
        after = out.where("__hit").drop("__hit")
        self._commit(out.drop("__hit"), changes.events(after, "update", update))
        return n

    def _target(self, f: dict, one: bool) -> DataFrame:
        """Ids that match; of one, the smallest."""
        found = self.find(f).select("_id")
        return found.orderBy("_id").limit(1) if one else found

    def update_one(self, f: dict, update: dict) -> bool:
        return bool(self._rewrite(f, update, True))

    def update_many(self, f: dict, update: dict) -> int:
        return int(self._rewrite(f, update, False))

    def upsert_one(self, f: dict, update: dict) -> dict:
        hit = self._target(f, True).collect()
        if hit:
            self.update_one({"_id": hit[0]["_id"]}, update)
            return self.find_by_id(hit[0]["_id"])
        doc = dict(update.get("$setOnInsert", {})) | dict(update.get("$set", {}))
        if isinstance(f.get("_id"), str):
            doc["_id"] = f["_id"]
        return self.find_by_id(self.insert_one(doc))

    def replace_one(self, f: dict, doc: dict) -> bool:
        hit = self._target(f, True).collect()
        if not hit:
            return False
        old = self.df()
        new = self._frame([doc := self._checked(doc | {"_id": hit[0]["_id"]})], schema_of([doc]))
        schema = merged(old.schema, new.schema)
        self._commit(aligned(old.where(F.col("_id") != hit[0]["_id"]), schema).unionByName(aligned(new, schema)), changes.events(new, "update"))
        return True

    def _delete(self, f: dict, one: bool) -> int:
        return self.delete_ids(self._target(f, one))

    def delete_ids(self, hit: DataFrame) -> int:
        """Documents whose _id is in a DataFrame go, in one rewrite."""
        n = hit.count()
        if n:
            self._commit(self.df().join(hit, "_id", "left_anti"), changes.events(hit, "delete"))
        return n

    def delete_one(self, f: dict) -> bool:
        return bool(self._delete(f, True))

    def delete_many(self, f: dict | None = None) -> int:
        return self._delete(f or {}, False)

    def truncate(self) -> None:
        self._commit(self.df().limit(0), changes.drop_event(self.spark))

    def find_one_and_update(self, f: dict, update: dict) -> dict | None:
        hit = self._target(f, True).collect()
        if not hit:
            return None
        self.update_one({"_id": hit[0]["_id"]}, update)
        return self.find_by_id(hit[0]["_id"])

    def find_one_and_delete(self, f: dict) -> dict | None:
        hit = self._target(f, True).collect()
        before = self.find_by_id(hit[0]["_id"]) if hit else None
        if hit:
            self.delete_one({"_id": hit[0]["_id"]})
        return before

    def find_one_and_replace(self, f: dict, doc: dict) -> dict | None:
        hit = self._target(f, True).collect()
        if not hit:
            return None
        self.replace_one({"_id": hit[0]["_id"]}, doc)
        return self.find_by_id(hit[0]["_id"])

    def bulk_write(self, ops: list[dict], ordered: bool = True) -> dict:
        """insertOne, updateOne, updateMany, upsertOne, replaceOne, deleteOne, deleteMany; ordered stops at the first error."""
        out = {"insertedCount": 0, "updatedCount": 0, "upsertedCount": 0, "deletedCount": 0, "errors": []}
        for i, op in enumerate(ops):
            ((kind, a),) = op.items()
            try:
                if kind == "insertOne":
                    self.insert_one(a["document"])
                    out["insertedCount"] += 1
                elif kind in ("updateOne", "updateMany"):
                    out["updatedCount"] += int((self.update_one if kind == "updateOne" else self.update_many)(a["filter"], a["update"]))
                elif kind == "upsertOne":
                    new = not self.exists(a["filter"])
                    self.upsert_one(a["filter"], a["update"])
                    out["upsertedCount" if new else "updatedCount"] += 1
                    out["insertedCount"] += int(new)
                elif kind == "replaceOne":
                    out["updatedCount"] += int(self.replace_one(a["filter"], a["replacement"]))
                elif kind in ("deleteOne", "deleteMany"):
                    out["deletedCount"] += int((self.delete_one if kind == "deleteOne" else self.delete_many)(a["filter"]))
                else:
                    raise QueryError(f"unknown operation {kind}")
            except Exception as e:
                if ordered:
                    raise
                out["errors"].append({"index": i, "error": str(e)})
        return out

    # indexes and upkeep

    def create_index(self, fields: str | list[str], unique: bool = False, partial: dict | None = None, sparse: bool = False, include: list[str] | None = None) -> str:
        """Uniqueness is enforced from now on; scans need no structure. sparse and include are accepted and have no effect."""
        fields = [fields] if isinstance(fields, str) else list(fields)
        name = "_".join(fields)
        if name not in self.indexes:
            index = {"fields": fields, "unique": unique, "partial": partial}
            if unique:
                self._check_unique(self.df(), index)
            self.indexes[name] = index
            self._save_definitions()
        return name

    def drop_index(self, name: str) -> bool:
        if self.indexes.pop(name, None) is None:
            return False
        self._save_definitions()
        return True

    def create_text_index(self, field: str) -> None:
        """Tokens of the field are stored beside the documents from now on. The first index stays."""
        if self.text_index is None:
            self.text_index = field
            self._save_definitions()
            if self.store.version():
                self._commit(self.df())

    def compact(self) -> int:
        """Rewrite the snapshot in fewer files and drop old versions. Documents are laid out by the fields of the first index (else by _id), so
        that a filter on them skips files and row groups by their statistics."""
        df = self.store.read()
        scope = Scope(df.schema)
        fields = next((i["fields"] for i in self.indexes.values()), ["_id"])
        keys = [scope.col(p) for p in fields if scope.type(p) is not None] or [scope.col("_id")]
        files_wanted = max(1, self.store.files.size(self.store.snapshot() or self.store.root) // (128 << 20))
        self.store.commit(df.repartitionByRange(files_wanted, *keys).sortWithinPartitions(*keys))
        return self.store.vacuum()

    def flush(self) -> None:
        """Every write is durable when it returns."""

    def stats(self) -> dict:
        current, total = self.store.files.size(self.store.snapshot() or ""), self.store.files.size(self.store.root)
        return {"liveDocs": self.df().count(), "deadDocs": 0, "segments": len([n for n in self.store.files.names(self.store.root) if n.startswith("s-")]), "bytes": total, "fragmentation": 1 - current / total if total else 0.0, "cacheHits": 0, "cacheBytes": 0}

    def begin_bulk_load(self) -> None:
        self.bulk = []

    def end_bulk_load(self) -> int:
        docs, self.bulk = self.bulk or [], None
        return len(self.insert_many(docs))

    def export_to(self, path: str, format: str | None = None, projection: dict | None = None) -> int:
        return files.export(self.df(), path, format, projection)

    def import_from(self, path: str, format: str | None = None, upsert: bool = False, mode: str | None = None, continue_on_error: bool = True) -> files.ImportResult:
        """Rows without _id get one; rows whose _id is there are errors, or replace it with upsert (or mode='upsert')."""
        upsert = upsert or mode == "upsert"
        if files.format_of(path, format) == "ndjson":
            new, errors, n_bad = files.read_lines(self.spark, path)
        else:
            new, errors, n_bad = files.read_array(self.spark, path), [], 0
        if errors and not continue_on_error:
            raise QueryError(f"line {errors[0]['line']}: {errors[0]['error']}")
        new = new.withColumn("_id", F.coalesce(F.col("_id").cast("string") if "_id" in new.columns else F.lit(None), F.md5(F.concat(F.uuid(), F.lit("-"))).substr(1, 24))).cache()
        try:
            n = new.count()
            names = [F.col(f"`{c}`") for c in new.columns]
            # of rows with one _id the last in order of its fields stays with upsert, else the first; the others are errors
            kept = new.groupBy("_id").agg((F.max_by if upsert else F.min_by)(F.struct(*names), F.to_json(F.struct(*names))).alias("r")).select("r.*")
            old = self.df()
            n_kept = kept.count()
            n_clash = old.select("_id").join(kept.select("_id"), "_id", "left_semi").count()
            twice = n - n_kept
            if twice and not upsert:
                errors.append({"line": None, "error": f"{twice} rows repeat an _id of the file"})
            schema = merged(old.schema, kept.schema)
            if upsert:
                rest, added = old.join(kept.select("_id"), "_id", "left_anti"), kept
            else:
                rest, added = old, kept.join(old.select("_id"), "_id", "left_anti")
                errors += [{"line": None, "error": f"{n_clash} ids are there already"}] if n_clash else []
            if (n_clash or twice) and not upsert and not continue_on_error:
                raise DuplicateKey("ids are there already, or twice in the file")
            self._commit(aligned(rest, schema).unionByName(aligned(added, schema)), changes.events(added, "insert"))
        finally:
            new.unpersist()
        skipped = n_bad + (0 if upsert else n_clash + twice)
        return files.ImportResult(n + n_bad, n + n_bad - skipped, skipped, errors)

    def project(self, spec: dict) -> DataFrame:
        return project(self.df(), spec)
