"""Registered queries of relations, validation, migration, expiry, encryption and percentiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .crypto import CryptoLayer
from .migrate import VERSION, migrated
from .relations import RelationManager
from .schema import SchemaValidator, field
from .streaming.ttl import expired


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def populate_many(spark: SparkSession, d: str) -> DataFrame:
    regions = _table(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").cast("string").alias("_id"), "r_name")
    nations = _table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("region"))
    return RelationManager().register("region", regions).populate_many(nations, {"region": "region"}).select("n_nationkey", "region_id", F.col("region.r_name").alias("name"))


def populate_array(spark: SparkSession, d: str) -> DataFrame:
    nations = _table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("_id"), "n_name")
    lists = _table(spark, d, "region").select("r_regionkey", F.array(*[(F.col("r_regionkey") + i).cast("string") for i in (2, 1, 0)]).alias("near"))
    return RelationManager().register("nation", nations).populate_many(lists, {"near": "nation"}).select("r_regionkey", F.transform("near", lambda x: x["n_name"]).alias("names"))


def find_many_by_id(spark: SparkSession, d: str) -> DataFrame:
    ids = _table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return _table(spark, d, "orders").join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


_CUSTOMER = {
    "c_name": field("string").required().min_length(5).pattern("^Customer").build(), "c_acctbal": field("number").min(0).max(9000).build(),
    "c_mktsegment": field("string").enum(["BUILDING", "MACHINERY", "AUTOMOBILE"]).build(), "nickname": field("string").required().nullable().build(),
}


def schema_validate(spark: SparkSession, d: str) -> DataFrame:
    return SchemaValidator(_CUSTOMER).validate(_table(spark, d, "customer")).select("c_custkey", F.size("_errors").cast("long").alias("n_errors"), F.col("_ok").alias("ok"))


def migrate_pending(spark: SparkSession, d: str) -> DataFrame:
    versioned = _table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 > 0, (F.col("c_custkey") % 3).cast("int")).alias(VERSION))
    out = migrated(versioned, 2, lambda df: df.withColumn("c_name", F.upper("c_name")))
    return out.select("c_custkey", "c_name", F.col(VERSION).alias("version"))


def ttl_purge(spark: SparkSession, d: str) -> DataFrame:
    events = _table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("expires_at"))
    return events.where(~expired(F.col("expires_at"), 1_705_276_800_000)).select("event_id")


def encrypt_round_trip(spark: SparkSession, d: str) -> DataFrame:
    layer, other = CryptoLayer.from_key(bytes(range(32))), CryptoLayer.from_key(bytes(32))
    sealed = _table(spark, d, "supplier").select("s_suppkey", layer.encrypt(F.col("s_name")).alias("x"))
    return sealed.select("s_suppkey", layer.decrypt(F.col("x")).alias("s_name"), other.verify(F.col("x")).alias("wrong_key_reads"))


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").groupBy("event_type").agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


_SQL = {
    "populate_many": "SELECT n_nationkey, n_regionkey::VARCHAR AS region_id, r_name AS name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey",
    "populate_array": "SELECT r_regionkey, list(n_name ORDER BY i DESC) AS names FROM (SELECT r_regionkey, unnest([0, 1, 2]) AS i FROM region) LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON n_nationkey = r_regionkey + i GROUP BY 1",
    "find_many_by_id": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "schema_validate": "SELECT c_custkey, n AS n_errors, n = 0 AS ok FROM (SELECT c_custkey, ((length(c_name) < 5)::BIGINT + (NOT regexp_matches(c_name, '^Customer'))::BIGINT + (c_acctbal < 0)::BIGINT + (c_acctbal > 9000)::BIGINT + (c_mktsegment NOT IN ('BUILDING','MACHINERY','AUTOMOBILE'))::BIGINT) AS n FROM customer)",
    "migrate_pending": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN c_name ELSE upper(c_name) END AS c_name, 2 AS version FROM customer",
    "ttl_purge": "SELECT event_id FROM events WHERE epoch_ms(ts) > 1705276800000",
    "encrypt_round_trip": "SELECT s_suppkey, s_name, false AS wrong_key_reads FROM supplier",
    "percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (populate_many, populate_array, find_many_by_id, schema_validate, migrate_pending, ttl_purge, encrypt_round_trip, percentiles)}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
