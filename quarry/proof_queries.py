"""Registered queries of what the others leave out: nulls, negations, single update operators, and writes through a collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import Database
from .functions.scope import Scope
from .functions.filters import compile_filter
from .functions.updates import compile_update
from .plans.find import find
from .plans.pipeline import aggregate
from .sources.scratch import scratch_path

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _add(name: str, sql: str, build: Callable[[SparkSession, str], DataFrame]) -> None:
    _QUERIES[name], _SQL[name] = build, sql


def _holed(spark: SparkSession, d: str) -> DataFrame:
    """Parts of which some have no size or name."""
    return _table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("s"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("name"))


_HOLED = "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size END AS s, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS name FROM part"


def _null_filter(name: str, f: dict, where: str) -> None:
    _add(name, f"SELECT p_partkey, s, name FROM ({_HOLED}) WHERE {where}", lambda spark, d: find(_holed(spark, d), f))


_null_filter("nulls_negated", {"s": {"$ne": 10, "$nin": [1, 2, 4], "$not": {"$gt": 40}}}, "(s IS NULL OR s <> 10) AND (s IS NULL OR s NOT IN (1, 2, 4)) AND (s IS NULL OR NOT s > 40)")
_null_filter("nulls_nor", {"$nor": [{"s": {"$gt": 20}}, {"name": {"$regex": "a"}}]}, "(s IS NULL OR s <= 20) AND (name IS NULL OR NOT contains(name, 'a'))")
_null_filter("nulls_not_and", {"$not": {"s": {"$gte": 5, "$lt": 30}, "name": {"$exists": True}}}, "s IS NULL OR s < 5 OR s >= 30 OR name IS NULL")
_null_filter("nulls_equal", {"$or": [{"s": None}, {"s": {"$in": [None, 7]}}]}, "s IS NULL OR s = 7")
_null_filter("nulls_not_equal", {"s": {"$ne": None}, "name": {"$eq": None}}, "s IS NOT NULL AND name IS NULL")
_null_filter("nulls_exists", {"s": {"$exists": False}, "name": {"$exists": True}}, "s IS NULL AND name IS NOT NULL")
_null_filter("nulls_type", {"$or": [{"s": {"$type": "null"}}, {"s": {"$type": "string"}}, {"name": {"$type": "string"}}]}, "s IS NULL OR name IS NOT NULL")
_null_filter("nulls_wrong_type", {"s": {"$not": {"$gt": "5"}}, "name": {"$nin": [1, 2]}}, "true")
_null_filter("nulls_mod", {"s": {"$not": {"$mod": [5, 0]}}}, "s IS NULL OR s % 5 <> 0")


def _found(name: str, table: str, f: dict, where: str, columns: str) -> None:
    keep = {c.strip(): 1 for c in columns.split(",")} | {"_id": 0}
    _add(name, f"SELECT {columns} FROM {table} WHERE {where}", lambda spark, d: find(_table(spark, d, table), f, {"projection": keep}))


_found("filter_eq_operator", "orders", {"o_orderstatus": {"$eq": "P"}, "o_orderpriority": {"$eq": "5-LOW"}}, "o_orderstatus = 'P' AND o_orderpriority = '5-LOW'", "o_orderkey, o_orderstatus")
_found("filter_regex_hits", "customer", {"c_name": {"$regex": "^customer#0+[1-9]*[05]$", "$options": "i"}}, "regexp_matches(lower(c_name), '^customer#0+[1-9]*[05]$')", "c_custkey, c_name")
_found("filter_range_lookup", "orders", {"o_custkey": {"$gte": 100, "$lte": 120}, "o_orderstatus": "O"}, "o_custkey BETWEEN 100 AND 120 AND o_orderstatus = 'O'", "o_orderkey, o_custkey")
_add("find_exclusion", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal > 0", lambda s, d: find(_table(s, d, "customer"), {"c_acctbal": {"$gt": 0}}, {"projection": {"c_acctbal": 0, "c_nationkey": 0}}))
_add("filter_dotted", "SELECT n_nationkey FROM nation WHERE n_regionkey >= 2 AND n_name <> 'CHINA'",
     lambda s, d: find(aggregate(_table(s, d, "nation"), [{"$addFields": {"info.name": "$n_name", "info.region": "$n_regionkey"}}]), {"info.region": {"$gte": 2}, "info.name": {"$ne": "CHINA"}}, {"projection": {"n_nationkey": 1}}))


def _updated(df: DataFrame, f: dict, update: dict) -> DataFrame:
    hit = compile_filter(f, Scope(df.schema))
    return df.select(*[F.when(hit, c).otherwise(F.col(n).cast(t) if n in df.columns else F.lit(None)).alias(n) for n, c, t in compile_update(update, df.schema)])


_add("update_min", "SELECT s_suppkey, CASE WHEN s_nationkey < 10 THEN least(s_acctbal, 500.0) ELSE s_acctbal END AS s_acctbal FROM supplier",
     lambda s, d: _updated(_table(s, d, "supplier"), {"s_nationkey": {"$lt": 10}}, {"$min": {"s_acctbal": 500.0}}).select("s_suppkey", "s_acctbal"))
_add("update_unset", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN NULL ELSE n_name END AS n_name FROM nation",
     lambda s, d: (lambda t: t.withColumn("n_name", F.when(compile_filter({"n_regionkey": 1}, Scope(t.schema)), dict((n, c) for n, c, _ in compile_update({"$unset": {"n_name": ""}}, t.schema)).get("n_name", F.lit(None))).otherwise(F.col("n_name"))).select("n_nationkey", "n_name"))(_table(s, d, "nation")))
_LISTS = [{"$sort": {"o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "p": {"$push": "$o_orderpriority"}}}, {"$project": {"c": "$_id", "p": 1, "_id": 0}}]
_LISTED = "SELECT o_custkey AS c, list(o_orderpriority ORDER BY o_orderkey) AS p FROM orders GROUP BY 1"
_add("update_push_plain", f"SELECT c, list_append(p, '9-NEW') AS p FROM ({_LISTED})", lambda s, d: _updated(aggregate(_table(s, d, "orders"), _LISTS), {}, {"$push": {"p": "9-NEW"}}))
_add("update_push_slice_negative", f"SELECT c, list_append(p, '9-NEW')[1:greatest(len(p) - 1, 0)] AS p FROM ({_LISTED})",
     lambda s, d: _updated(aggregate(_table(s, d, "orders"), _LISTS), {}, {"$push": {"p": {"$each": ["9-NEW"], "$slice": -2}}}))
_TURNS = [{"$sort": {"turn": 1}}, {"$group": {"_id": "$conv_id", "turns": {"$push": {"turn": "$turn", "role": "$role"}}}}]
_add("update_push_sort", "SELECT conv_id AS _id, list(turn ORDER BY turn DESC) AS turns FROM (SELECT conv_id, turn FROM conversations UNION ALL SELECT DISTINCT conv_id, 99::BIGINT FROM conversations) GROUP BY 1",
     lambda s, d: _updated(aggregate(_table(s, d, "conversations"), _TURNS), {}, {"$push": {"turns": {"$each": [{"turn": 99, "role": "end"}], "$sort": {"turn": -1}}}}).select("_id", F.transform("turns", lambda x: x["turn"].cast("long")).alias("turns")))

_SIZES = [{"$match": {"p_size": {"$mod": [7, 0]}}}, {"$group": {"_id": {"b": "$p_brand", "s": "$p_size"}, "n": {"$sum": 1}}}, {"$project": {"b": "$_id.b", "s": "$_id.s", "n": 1, "_id": 0}}]
_GROUPED = "SELECT p_brand AS b, p_size AS s, count(*) AS n FROM part WHERE p_size % 7 = 0 GROUP BY 1, 2"


def _densified(spark: SparkSession, d: str, by: str | list) -> DataFrame:
    out = aggregate(_table(spark, d, "part"), [*_SIZES, {"$densify": {"field": "s", "partitionByFields": ["b"], "range": {"bounds": by, "step": 5}}}])
    return out.select("b", F.col("s").cast("long").alias("s"), F.col("n").cast("long").alias("n"))


_add("densify_partition", f"WITH g AS ({_GROUPED}), e AS (SELECT b, min(s) AS lo, max(s) AS hi FROM g GROUP BY 1), x AS (SELECT b, unnest(range(lo, hi + 1, 5))::BIGINT AS s FROM e) SELECT b, s::BIGINT AS s, n FROM g UNION ALL SELECT b, s, NULL FROM x WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.b = x.b AND g.s = x.s)", lambda s, d: _densified(s, d, "partition"))
_add("densify_full", f"WITH g AS ({_GROUPED}), e AS (SELECT min(s) AS lo, max(s) AS hi FROM g), x AS (SELECT b, unnest(range(lo, hi + 1, 5))::BIGINT AS s FROM e, (SELECT DISTINCT b FROM g)) SELECT b, s::BIGINT AS s, n FROM g UNION ALL SELECT b, s, NULL FROM x WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.b = x.b AND g.s = x.s)", lambda s, d: _densified(s, d, "full"))

_add("densify_time", "WITH g AS (SELECT date_trunc('hour', ts) AS t, count(*) AS n FROM events WHERE event_type = 'click' AND value > 40 GROUP BY 1), e AS (SELECT min(t) AS lo, max(t) AS hi FROM g), x AS (SELECT unnest(generate_series(lo, hi, INTERVAL 2 HOUR)) AS t FROM e) SELECT epoch_ms(t) AS t, n FROM g UNION ALL SELECT epoch_ms(t), NULL FROM x WHERE t NOT IN (SELECT t FROM g)",
     lambda s, d: aggregate(find(_table(s, d, "events"), {"event_type": "click", "value": {"$gt": 40}}).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg(F.count(F.lit(1)).alias("n")),
                            [{"$densify": {"field": "t", "range": {"bounds": "full", "step": 2, "unit": "hour"}}}]).select(F.unix_millis(F.col("t").cast("timestamp")).alias("t"), "n"))

_add("window_running_all", "SELECT event_id, round(sum(value) OVER w, 2) AS run, count(*) OVER w AS n, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
     lambda s, d: aggregate(_table(s, d, "events"), [{"$setWindowFields": {"sortBy": {"ts": 1, "event_id": 1}, "output": {"run": {"$sum": "$value"}, "n": {"$count": {}}, "lo": {"$min": "$value"}, "hi": {"$max": "$value"}}}}])
     .select("event_id", F.round("run", 2).alias("run"), F.col("n").cast("long").alias("n"), "lo", "hi"))
_add("group_first_last_text", "SELECT o_custkey AS _id, list(o_orderkey ORDER BY o_orderpriority DESC, o_orderkey)[1] AS first, list(o_orderkey ORDER BY o_orderpriority DESC, o_orderkey)[-1] AS last FROM orders GROUP BY 1",
     lambda s, d: aggregate(_table(s, d, "orders"), [{"$sort": {"o_orderpriority": -1, "o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "first": {"$first": "$o_orderkey"}, "last": {"$last": "$o_orderkey"}}}]))


def _collection(spark: SparkSession, d: str):
    """Customers in a collection, as documents with an _id."""
    c = Database.open(spark, scratch_path(spark)).collection("customers")
    c.insert_frame(_table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("_id"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
    return c


def collection_writes(spark: SparkSession, d: str) -> DataFrame:
    c = _collection(spark, d)
    c.update_many({"c_nationkey": {"$lt": 5}}, {"$inc": {"c_acctbal": 100}, "$set": {"c_mktsegment": "NEAR"}})
    c.update_one({"c_nationkey": 7}, {"$set": {"c_mktsegment": "ONE"}})
    c.delete_many({"c_acctbal": {"$lt": 0}})
    c.insert_many([{"_id": "n1", "c_name": "New", "c_acctbal": 1.5}, {"_id": "n2", "c_name": "Newer"}])
    c.upsert_one({"_id": "n3"}, {"$set": {"c_name": "Newest"}, "$setOnInsert": {"c_acctbal": 2.5}})
    c.replace_one({"_id": "n2"}, {"c_name": "Replaced"})
    c.delete_one({"_id": "n1"})
    return c.df().select("_id", "c_name", "c_nationkey", F.round("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment")


_add("collection_writes", """WITH a AS (SELECT c_custkey::VARCHAR AS _id, c_name, c_nationkey, round(CASE WHEN c_nationkey < 5 THEN c_acctbal + 100 ELSE c_acctbal END, 2) AS c_acctbal,
    CASE WHEN c_nationkey < 5 THEN 'NEAR' ELSE c_mktsegment END AS seg FROM customer), o AS (SELECT min(_id) AS one FROM a WHERE c_nationkey = 7)
    SELECT _id, c_name, c_nationkey, c_acctbal, CASE WHEN _id = one THEN 'ONE' ELSE seg END AS c_mktsegment FROM a, o WHERE c_acctbal >= 0
    UNION ALL SELECT 'n2', 'Replaced', NULL, NULL, NULL UNION ALL SELECT 'n3', 'Newest', NULL, 2.5, NULL""", collection_writes)
_add("collection_distinct", "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_acctbal > 5000", lambda s, d: _collection(s, d).distinct_values("c_mktsegment", {"c_acctbal": {"$gt": 5000}}))
_add("collection_find_many_by_id", "SELECT c_custkey::VARCHAR AS _id, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
     lambda s, d: _collection(s, d).find_many_by_id(_table(s, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").cast("string").alias("_id")).distinct()).select("_id", "c_name"))
_add("collection_point_read", "SELECT c_custkey::VARCHAR AS _id, c_name, c_acctbal FROM customer WHERE c_custkey = 77", lambda s, d: _collection(s, d).find({"_id": "77"}).select("_id", "c_name", "c_acctbal"))


def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    c = _collection(spark, d)
    told = [(c.count_documents({"c_acctbal": {"$lt": 0}}), c.count_documents(), c.exists({"c_mktsegment": "BUILDING"}), c.exists({"c_mktsegment": "NONE"}))]
    return spark.createDataFrame(told, "owing long, n long, building boolean, none boolean")


_add("collection_counts", "SELECT count(*) FILTER (WHERE c_acctbal < 0) AS owing, count(*) AS n, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') > 0 AS building, false AS none FROM customer", collection_counts)


def collection_text(spark: SparkSession, d: str) -> DataFrame:
    c = Database.open(spark, scratch_path(spark)).collection("texts")
    c.insert_frame(_table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("_id"), "text"))
    c.create_text_index("text")
    return c.find({"$text": {"$search": "With THE"}}, projection={"_id": 1})


_TOKENS = "list_filter(string_split_regex(lower(text), '[^a-z0-9\\x{00C0}-\\x{024F}]+'), lambda t: length(t) >= 2)"
_add("collection_text", f"SELECT doc_id::VARCHAR AS _id FROM documents WHERE list_has_all({_TOKENS}, ['the', 'with'])", collection_text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
