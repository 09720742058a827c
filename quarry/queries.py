"""The registered queries of the document engine over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.filters import compile_filter
from .functions.scope import Scope, VariantScope
from .functions.text import tokens
from .functions.updates import compile_update
from .plans.find import find
from .plans.pipeline import aggregate

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _add(name: str, sql: str, build: Callable[[SparkSession, str], DataFrame]) -> None:
    _QUERIES[name], _SQL[name] = build, sql


def _pipe(name: str, table: str, stages: list[dict], sql: str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """A pipeline over one table; foreign collections are the tables beside it."""
    _add(name, sql, lambda spark, d: then(aggregate(_table(spark, d, table), stages, lambda other: _table(spark, d, other))))


def _filter(name: str, table: str, f: dict, where: str, columns: str) -> None:
    keep = {c.strip(): 1 for c in columns.split(",")} | {"_id": 0}
    _add(name, f"SELECT {columns} FROM {table} WHERE {where}", lambda spark, d: find(_table(spark, d, table), f, {"projection": keep}))


def _longs(*names: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({n: F.col(n).cast("long") for n in names})


def _rounded(*names: str, digits: int = 2) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({n: F.round(n, digits) for n in names})


FLAGSHIP = [{"$match": {"l_quantity": {"$gte": 30}}}, {"$group": {"_id": "$l_returnflag", "qty": {"$sum": "$l_quantity"}, "n": {"$sum": 1}}}, {"$sort": {"qty": -1}}, {"$limit": 5}]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return aggregate(_table(spark, d, "lineitem"), FLAGSHIP)


_add("flagship", "SELECT l_returnflag AS _id, round(sum(l_quantity),2) AS qty, count(*) AS n FROM lineitem WHERE l_quantity >= 30 GROUP BY 1 ORDER BY qty DESC LIMIT 5",
     lambda spark, d: _rounded("qty")(_longs("n")(flagship(spark, d))))

# filters
_filter("filter_cmp", "lineitem", {"l_quantity": {"$gt": 10, "$lte": 45}, "l_discount": {"$gte": 0.05, "$lt": 0.09}}, "l_quantity > 10 AND l_quantity <= 45 AND l_discount >= 0.05 AND l_discount < 0.09", "l_orderkey, l_linenumber, l_quantity, l_discount")
_filter("filter_eq_ne", "orders", {"o_orderstatus": "O", "o_orderpriority": {"$ne": "1-URGENT"}}, "o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT'", "o_orderkey, o_orderstatus, o_orderpriority")
_filter("filter_in_nin", "orders", {"o_orderstatus": {"$in": ["F", "P"]}, "o_orderpriority": {"$nin": ["5-LOW", "1-URGENT"]}}, "o_orderstatus IN ('F','P') AND o_orderpriority NOT IN ('5-LOW','1-URGENT')", "o_orderkey, o_orderstatus, o_orderpriority")
_filter("filter_logic", "part", {"$or": [{"p_size": {"$lt": 5}}, {"$and": [{"p_size": {"$gt": 45}}, {"p_retailprice": {"$gt": 1000}}]}], "$nor": [{"p_size": 2}], "$not": {"p_size": 48}}, "(p_size < 5 OR (p_size > 45 AND p_retailprice > 1000)) AND NOT (p_size = 2) AND NOT (p_size = 48)", "p_partkey, p_size, p_retailprice")
_filter("filter_not_field", "part", {"p_size": {"$not": {"$gte": 10, "$lte": 40}}}, "NOT (p_size >= 10 AND p_size <= 40)", "p_partkey, p_size")
_filter("filter_regex", "part", {"p_name": {"$regex": "^[a-m].*[0-9]", "$options": "i"}}, "regexp_matches(lower(p_name), '^[a-m].*[0-9]')", "p_partkey, p_name")
_filter("filter_mod", "orders", {"o_orderkey": {"$mod": [7, 3]}}, "o_orderkey % 7 = 3", "o_orderkey, o_custkey")
_filter("filter_exists", "customer", {"c_name": {"$exists": True}, "c_missing": {"$exists": False}}, "c_name IS NOT NULL", "c_custkey, c_name")
_filter("filter_type", "events", {"value": {"$type": "number"}, "event_type": {"$type": "string"}}, "value IS NOT NULL AND event_type IS NOT NULL", "event_id, value, event_type")
_filter("filter_type_strict", "customer", {"$or": [{"c_custkey": "1"}, {"c_custkey": {"$gt": "1"}}, {"c_custkey": {"$lte": 20}}]}, "c_custkey <= 20", "c_custkey")
_filter("filter_array_size", "embeddings", {"embedding": {"$size": 64}, "label": {"$lt": 5}}, "len(embedding) = 64 AND label < 5", "vec_id, label")
_filter("filter_elem_match", "embeddings", {"embedding": {"$elemMatch": {"$gt": 0.3}}}, "len(list_filter(embedding, lambda x: x > 0.3)) > 0", "vec_id, label")

_ROLES = "SELECT conv_id, list(role ORDER BY turn) AS roles, list({'turn': turn, 'role': role} ORDER BY turn) AS turns FROM conversations GROUP BY conv_id"


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    return aggregate(_table(spark, d, "conversations"), [{"$sort": {"turn": 1}}, {"$group": {"_id": "$conv_id", "roles": {"$push": "$role"}, "turns": {"$push": {"turn": "$turn", "role": "$role"}}}}])


_add("filter_all", f"SELECT conv_id AS _id FROM ({_ROLES}) WHERE list_contains(roles,'user') AND list_contains(roles,'assistant')", lambda s, d: find(_conversations(s, d), {"roles": {"$all": ["user", "assistant"]}}, {"projection": {"_id": 1}}))
_add("filter_elem_match_doc", f"SELECT conv_id AS _id FROM ({_ROLES}) WHERE len(list_filter(turns, lambda x: x.turn >= 2 AND x.role = 'user')) > 0", lambda s, d: find(_conversations(s, d), {"turns": {"$elemMatch": {"turn": {"$gte": 2}, "role": "user"}}}, {"projection": {"_id": 1}}))
_add("filter_in_array", f"SELECT conv_id AS _id FROM ({_ROLES}) WHERE list_has_any(roles, ['system'])", lambda s, d: find(_conversations(s, d), {"roles": {"$in": ["system"]}}, {"projection": {"_id": 1}}))

# projections and expressions
_pipe("project_rename_compute", "part", [{"$project": {"key": "$p_partkey", "p_name": 1, "total": {"$multiply": ["$p_retailprice", "$p_size"]}, "kind": {"$literal": "part"}}}], "SELECT p_partkey AS key, p_name, round(p_retailprice * p_size, 2) AS total, 'part' AS kind FROM part", _rounded("total"))
_pipe("project_exclude", "customer", [{"$project": {"c_acctbal": 0, "c_nationkey": 0}}], "SELECT c_custkey, c_name, c_mktsegment FROM customer")
_pipe("add_fields", "customer", [{"$addFields": {"c_acctbal": {"$add": ["$c_acctbal", 100]}, "before": "$c_acctbal"}}, {"$project": {"c_custkey": 1, "c_acctbal": 1, "before": 1}}], "SELECT c_custkey, round(c_acctbal + 100, 2) AS c_acctbal, c_acctbal AS before FROM customer", _rounded("c_acctbal"))
_pipe("add_fields_nested", "nation", [{"$addFields": {"info.name": "$n_name", "info.region": "$n_regionkey"}}, {"$project": {"n_nationkey": 1, "name": "$info.name", "region": "$info.region"}}], "SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation")
_pipe("cond_ifnull", "customer", [{"$project": {"c_custkey": 1, "state": {"$cond": {"if": {"c_acctbal": {"$lt": 0}}, "then": "owes", "else": "$c_mktsegment"}}, "name": {"$ifNull": ["$nickname", "$c_name"]}}}], "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owes' ELSE c_mktsegment END AS state, c_name AS name FROM customer")
_pipe("concat", "part", [{"$project": {"p_partkey": 1, "label": {"$concat": ["$p_brand", "/", "$p_type", "/", "$nothing"]}}}], "SELECT p_partkey, p_brand || '/' || p_type || '/' AS label FROM part")
_pipe("arith", "lineitem", [{"$project": {"l_orderkey": 1, "net": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}, "per": {"$divide": ["$l_extendedprice", "$l_quantity"]}}}], "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 5) AS net, round(l_extendedprice / l_quantity, 7) AS per FROM lineitem", lambda df: _rounded("net", digits=5)(_rounded("per", digits=7)(df)))
_pipe("replace_root", "orders", [{"$project": {"doc": {"key": "$o_orderkey", "status": "$o_orderstatus"}}}, {"$replaceRoot": {"newRoot": "$doc"}}], "SELECT o_orderkey AS key, o_orderstatus AS status FROM orders")

# grouping
_pipe("group_sum_avg_min_max_count", "lineitem", [{"$group": {"_id": "$l_returnflag", "s": {"$sum": "$l_quantity"}, "a": {"$avg": "$l_extendedprice"}, "lo": {"$min": "$l_discount"}, "hi": {"$max": "$l_tax"}, "n": {"$count": {}}}}], "SELECT l_returnflag AS _id, round(sum(l_quantity),2) AS s, round(avg(l_extendedprice),2) AS a, min(l_discount) AS lo, max(l_tax) AS hi, count(*) AS n FROM lineitem GROUP BY 1", _rounded("s", "a"))
_pipe("group_compound", "lineitem", [{"$group": {"_id": {"f": "$l_returnflag", "s": "$l_linestatus"}, "n": {"$sum": 1}}}, {"$project": {"f": "$_id.f", "s": "$_id.s", "n": 1, "_id": 0}}], "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY 1, 2", _longs("n"))
_pipe("group_null_key", "orders", [{"$group": {"_id": None, "n": {"$sum": 2}, "t": {"$avg": "$o_totalprice"}}}, {"$project": {"_id": 0, "n": 1, "t": 1}}], "SELECT 2 * count(*) AS n, round(avg(o_totalprice), 2) AS t FROM orders", lambda df: _rounded("t")(_longs("n")(df)))
_pipe("group_empty", "orders", [{"$match": {"o_orderkey": {"$lt": -1}}}, {"$group": {"_id": None, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "n": 1}}], "SELECT count(*) AS n FROM orders WHERE o_orderkey < -1 GROUP BY o_orderkey", _longs("n"))
_pipe("group_first_last", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "first": {"$first": "$o_orderkey"}, "last": {"$last": "$o_orderkey"}}}], "SELECT o_custkey AS _id, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1] AS first, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[-1] AS last FROM orders GROUP BY 1")
_pipe("group_add_to_set", "orders", [{"$sort": {"o_orderpriority": 1}}, {"$group": {"_id": "$o_custkey", "set": {"$addToSet": "$o_orderpriority"}}}], "SELECT o_custkey AS _id, list_sort(list(DISTINCT o_orderpriority)) AS set FROM orders GROUP BY 1")
_pipe("bucket_default", "customer", [{"$bucket": {"groupBy": "$c_acctbal", "boundaries": [0, 2500, 5000], "default": "other", "output": {"total": {"$sum": "$c_acctbal"}}}}], "SELECT CASE WHEN c_acctbal >= 0 AND c_acctbal < 2500 THEN '0' WHEN c_acctbal >= 2500 AND c_acctbal < 5000 THEN '2500' ELSE 'other' END AS _id, count(*) AS count, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1", _rounded("total"))
_pipe("bucket_output", "part", [{"$bucket": {"groupBy": "$p_size", "boundaries": [0, 10, 30, 40], "output": {"avg": {"$avg": "$p_retailprice"}}}}], "SELECT CASE WHEN p_size < 10 THEN 0 WHEN p_size < 30 THEN 10 ELSE 30 END AS _id, count(*) AS count, round(avg(p_retailprice), 2) AS avg FROM part WHERE p_size >= 0 AND p_size < 40 GROUP BY 1", _rounded("avg"))
_pipe("bucket_empty_default", "part", [{"$bucket": {"groupBy": "$p_size", "boundaries": [0, 100], "default": -1}}], "SELECT 0 AS _id, count(*) AS count FROM part UNION ALL SELECT -1, 0")
_pipe("count_stage", "orders", [{"$match": {"o_orderstatus": "F"}}, {"$count": "n"}], "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
_pipe("count_stage_empty", "orders", [{"$match": {"o_orderstatus": "none"}}, {"$count": "n"}], "SELECT 0::BIGINT AS n")
_add("distinct_field", "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderstatus = 'P'", lambda s, d: find(_table(s, d, "orders"), {"o_orderstatus": "P"}).select(F.col("o_orderpriority").alias("value")).where("value is not null").distinct())

# windows
_pipe("window_running_sum", "events", [{"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"ts": 1, "event_id": 1}, "output": {"run": {"$sum": "$value"}}}}, {"$project": {"event_id": 1, "run": 1}}], "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS run FROM events", _rounded("run"))
_pipe("window_moving_avg", "events", [{"$setWindowFields": {"partitionBy": "$event_type", "sortBy": {"ts": 1, "event_id": 1}, "output": {"mov": {"$avg": "$value", "window": {"documents": [-2, 2]}}}}}, {"$project": {"event_id": 1, "mov": 1}}], "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mov FROM events", _rounded("mov", digits=6))
_pipe("window_rank", "part", [{"$setWindowFields": {"sortBy": {"p_size": -1}, "output": {"r": {"$rank": {}}}}}, {"$project": {"p_partkey": 1, "r": 1}}], "SELECT p_partkey, rank() OVER (ORDER BY p_size DESC) AS r FROM part")
_pipe("window_dense_rank", "part", [{"$setWindowFields": {"sortBy": {"p_size": 1}, "output": {"r": {"$denseRank": {}}}}}, {"$project": {"p_partkey": 1, "r": 1}}], "SELECT p_partkey, dense_rank() OVER (ORDER BY p_size) AS r FROM part")
_pipe("window_partitioned_rank", "orders", [{"$setWindowFields": {"partitionBy": "$o_orderpriority", "sortBy": {"o_totalprice": -1}, "output": {"r": {"$rank": {}}, "d": {"$denseRank": {}}}}}, {"$project": {"o_orderkey": 1, "r": 1, "d": 1}}], "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS r, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS d FROM orders")

# order, pages, reshaping
_pipe("sort_limit_skip", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$skip": 10}, {"$limit": 25}, {"$project": {"o_orderkey": 1, "o_totalprice": 1}}], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
_add("cursor_after", "SELECT c_name AS _id, c_custkey FROM customer WHERE c_name > 'Customer#000000100' ORDER BY c_name LIMIT 20", lambda s, d: find(_table(s, d, "customer").select(F.col("c_name").alias("_id"), "c_custkey"), {}, {"after": "Customer#000000100", "limit": 20}))
_add("find_topk", "SELECT p_partkey, p_retailprice FROM part WHERE p_size > 20 ORDER BY p_retailprice DESC, p_partkey LIMIT 15", lambda s, d: find(_table(s, d, "part"), {"p_size": {"$gt": 20}}, {"sort": {"p_retailprice": -1, "p_partkey": 1}, "limit": 15, "projection": {"p_partkey": 1, "p_retailprice": 1}}))
_UNWIND = [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "orders"}}, {"$unwind": {"path": "$orders", "preserveNullAndEmptyArrays": True}}, {"$project": {"c_custkey": 1, "key": "$orders.o_orderkey"}}]
_add("unwind_preserve", "SELECT c_custkey, o_orderkey AS key FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey", lambda s, d: aggregate(_table(s, d, "customer"), _UNWIND, lambda t: find(_table(s, d, t), {"o_totalprice": {"$gt": 300000}})))
_add("lookup_count", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey GROUP BY 1", lambda s, d: aggregate(_table(s, d, "customer"), _UNWIND[:1], lambda t: find(_table(s, d, t), {"o_totalprice": {"$gt": 300000}})).select("c_custkey", F.size("orders").cast("long").alias("n")))
_pipe("lookup_array", "region", [{"$lookup": {"from": "nation", "localField": "r_regionkey", "foreignField": "n_regionkey", "as": "nations"}}], "SELECT r_regionkey, r_name, list(n_name ORDER BY n_nationkey) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2", lambda df: df.select("r_regionkey", "r_name", F.transform("nations", lambda x: x["n_name"]).alias("names")))
_pipe("facet", "part", [{"$facet": {"by_brand": [{"$group": {"_id": "$p_brand", "n": {"$sum": 1}}}, {"$sort": {"_id": 1}}], "dear": [{"$sort": {"p_retailprice": -1, "p_partkey": 1}}, {"$limit": 3}, {"$project": {"p_partkey": 1}}]}}], "SELECT (SELECT list(b ORDER BY b) FROM (SELECT p_brand AS b FROM part GROUP BY 1)) AS brands, (SELECT list(n ORDER BY b) FROM (SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1)) AS ns, (SELECT list(p_partkey ORDER BY p_retailprice DESC, p_partkey) FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 3)) AS dear", lambda df: df.select(F.transform("by_brand", lambda x: x["_id"]).alias("brands"), F.transform("by_brand", lambda x: x["n"].cast("long")).alias("ns"), F.transform("dear", lambda x: x["p_partkey"]).alias("dear")))
_pipe("densify", "part", [{"$match": {"p_size": {"$mod": [7, 0]}}}, {"$group": {"_id": "$p_size", "n": {"$sum": 1}}}, {"$project": {"p_size": "$_id", "n": 1, "_id": 0}}, {"$densify": {"field": "p_size", "range": {"bounds": [0, 50], "step": 5}}}], "WITH g AS (SELECT p_size, count(*) AS n FROM part WHERE p_size % 7 = 0 GROUP BY 1) SELECT p_size, n FROM g UNION ALL SELECT x::INT, NULL FROM (SELECT unnest(range(0, 51, 5)) AS x) WHERE x NOT IN (SELECT p_size FROM g)", _longs("n"))
_pipe("multi_stage", "orders", [{"$match": {"o_totalprice": {"$gt": 50000}}}, {"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}}, {"$unwind": "$c"}, {"$group": {"_id": "$c.c_mktsegment", "n": {"$sum": 1}, "t": {"$sum": "$o_totalprice"}}}, {"$sort": {"t": -1}}, {"$limit": 3}], "SELECT c_mktsegment AS _id, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 50000 GROUP BY 1 ORDER BY t DESC LIMIT 3", lambda df: _rounded("t")(_longs("n")(df)))


# updates: the state of the matching and the other rows after the update
def _updated(df: DataFrame, f: dict, update: dict) -> DataFrame:
    hit = compile_filter(f, Scope(df.schema))
    new = compile_update(update, df.schema)
    return df.select(*[F.when(hit, c).otherwise(F.col(n).cast(t) if n in df.columns else F.lit(None)).alias(n) for n, c, t in new])


_add("update_set_inc_mul_min_max", "SELECT s_suppkey, s_name, CASE WHEN s_nationkey < 10 THEN 7 ELSE s_nationkey END AS s_nationkey, round(CASE WHEN s_nationkey < 10 THEN greatest((s_acctbal + 10) * 2, 500) ELSE s_acctbal END, 2) AS s_acctbal FROM supplier",
     lambda s, d: _rounded("s_acctbal")(_updated(_table(s, d, "supplier"), {"s_nationkey": {"$lt": 10}}, {"$set": {"s_nationkey": 7}, "$inc": {"s_acctbal": 10}, "$mul": {"s_acctbal": 2}, "$max": {"s_acctbal": 500}})).withColumn("s_nationkey", F.col("s_nationkey").cast("int")))
_add("update_rename_unset", "SELECT n_nationkey, CAST(NULL AS VARCHAR) AS n_name, n_regionkey, n_name AS title FROM nation", lambda s, d: _updated(_table(s, d, "nation"), {}, {"$rename": {"n_name": "title"}}))
_add("delete_where", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT (c_mktsegment = 'BUILDING' OR c_acctbal < 0)", lambda s, d: (lambda t: t.where(compile_filter({"$or": [{"c_mktsegment": "BUILDING"}, {"c_acctbal": {"$lt": 0}}]}, Scope(t.schema), want=False)).select("c_custkey", "c_mktsegment"))(_table(s, d, "customer")))

# arrays, over every row
_pipe("unwind", "embeddings", [{"$unwind": "$embedding"}, {"$project": {"vec_id": 1, "embedding": 1}}], "SELECT vec_id, unnest(embedding) AS embedding FROM embeddings")
_pipe("group_push", "orders", [{"$sort": {"o_orderdate": 1, "o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "keys": {"$push": "$o_orderkey"}}}], "SELECT o_custkey AS _id, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS keys FROM orders GROUP BY 1")
_PRIORITIES = [{"$sort": {"o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "p": {"$push": "$o_orderpriority"}}}, {"$project": {"c": "$_id", "p": 1, "_id": 0}}]
_LISTED = "SELECT o_custkey AS c, list(o_orderpriority ORDER BY o_orderkey) AS p FROM orders GROUP BY 1"
_add("update_push_pull_add_to_set", f"SELECT c, CASE WHEN c % 2 = 0 THEN list_concat(list_filter(p, lambda x: x <> '5-LOW'), ['9-NEW']) ELSE p END AS p FROM ({_LISTED})",
     lambda s, d: _updated(aggregate(_table(s, d, "orders"), _PRIORITIES), {"c": {"$mod": [2, 0]}}, {"$pull": {"p": "5-LOW"}, "$addToSet": {"p": "9-NEW"}}))
_add("update_push_slice", f"SELECT c, list_concat(p, ['a', 'b'])[1:3] AS p FROM ({_LISTED})",
     lambda s, d: _updated(aggregate(_table(s, d, "orders"), _PRIORITIES), {}, {"$push": {"p": {"$each": ["a", "b"], "$slice": 3}}}))

# text, relations, documents
_TOKENS = "list_filter(string_split_regex(lower(text), '[^a-z0-9\\x{00C0}-\\x{024F}]+'), lambda t: length(t) >= 2)"
_add("text_search", f"SELECT doc_id, lang FROM documents WHERE list_has_all({_TOKENS}, ['the', 'with'])", lambda s, d: find(_table(s, d, "documents"), {"$text": {"$search": "With THE"}}, {"projection": {"doc_id": 1, "lang": 1}}, tokens="text"))
_add("text_tokens", f"SELECT doc_id, len({_TOKENS})::BIGINT AS n, len(list_distinct({_TOKENS}))::BIGINT AS n_distinct FROM documents", lambda s, d: _table(s, d, "documents").select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n"), F.size(F.array_distinct(tokens(F.col("text")))).cast("long").alias("n_distinct")))


def _props(spark: SparkSession, d: str) -> DataFrame:
    events = _table(spark, d, "events").select("event_id", F.parse_json("props").alias("doc"))
    scope = VariantScope(F.col("doc"), None)
    return events.where(compile_filter({"k": {"$gte": 40, "$mod": [3, 0]}, "zz": {"$exists": False}}, scope)).select("event_id", scope.value("k", "number").cast("long").alias("k"))


_add("json_props_extract", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE json_extract(props, '$.k')::BIGINT >= 40 AND json_extract(props, '$.k')::BIGINT % 3 = 0", _props)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import proof_queries, service_queries

    return _QUERIES | service_queries.queries() | proof_queries.queries()


def oracle_sql() -> dict[str, str]:
    from . import proof_queries, service_queries

    return _SQL | service_queries.oracle_sql() | proof_queries.oracle_sql()
