"""Plans that filters must reach, and stages against brute force where SQL rounds otherwise."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from quarry import queries
from quarry.database import Database
from quarry.errors import DuplicateKey, QueryError
from quarry.functions.filters import compile_filter
from quarry.functions.scope import Scope
from quarry.limits import check_regex
from quarry.plans.pipeline import aggregate

SMALL = "/root/testdata/sf0.001"


def explained(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["flagship", "filter_cmp", "filter_eq_ne", "filter_in_nin", "filter_logic", "filter_not_field", "filter_type_strict", "filter_exists", "filter_range_lookup", "find_topk", "multi_stage"])
def test_filters_reach_the_scan(spark, name):
    assert "PushedFilters: [" in explained(queries.queries()[name](spark, SMALL)).replace("PushedFilters: []", "")


FILTERS = [
    {"a": 1}, {"a": {"$ne": 1}}, {"a": {"$gt": 1, "$lt": 4}}, {"a": {"$in": [1, None]}}, {"a": {"$nin": [1, None]}}, {"a": {"$nin": [2, 3]}}, {"a": {"$exists": True}}, {"a": None}, {"a": {"$type": "number"}},
    {"s": {"$regex": "^x"}}, {"l": {"$size": 2}}, {"l": {"$all": [1, 2]}}, {"l": {"$elemMatch": {"$gt": 1}}}, {"l": {"$in": [2]}}, {"l": [1, 2]}, {"a": {"$mod": [2, 1]}}, {"a": {"$not": {"$gte": 2}}}, {"d.k": {"$lte": 1}},
    {"$and": [{"a": {"$gt": 0}}, {"s": "x"}]}, {"$or": [{"a": 2}, {"s": {"$ne": "x"}}]}, {"$nor": [{"a": 2}, {"s": "x"}]}, {"a": "1"}, {"nothing": {"$ne": 3}}, {"d": {"k": 1}},
]


@pytest.mark.parametrize("f", FILTERS, ids=str)
def test_a_filter_and_its_negation_split_all_rows(spark, f):
    rows = [(1, "x", [1, 2], (1,)), (2, None, None, None), (None, "xy", [], (None,)), (3, "y", [None, 2], (5,)), (None, None, None, None)]
    df = spark.createDataFrame(rows, "a int, s string, l array<int>, d struct<k:int>").withColumn("i", F.monotonically_increasing_id())
    scope = Scope(df.schema)
    hit = {r["i"] for r in df.where(compile_filter(f, scope)).collect()}
    for rest in (df.where(compile_filter(f, scope, want=False)), df.where(compile_filter({"$nor": [f]}, scope)), df.where(compile_filter({"$not": f}, scope))):
        assert {r["i"] for r in rest.collect()} == {r["i"] for r in df.collect()} - hit


def test_running_window_over_all_rows(spark):
    rows = [(i, (i * 7) % 13 if i % 5 else None, float(i % 4) if i % 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, k int, v double").repartition(5)
    spec = {"sortBy": {"k": -1, "i": 1}, "output": {"s": {"$sum": "$v"}, "m": {"$avg": "$v"}, "n": {"$count": {}}, "lo": {"$min": "$v"}, "hi": {"$max": "$v"}}}
    got = aggregate(df, [{"$setWindowFields": spec}])
    seen, n = [], 0
    told = {r["i"]: r for r in got.collect()}
    for i, _, v in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])):
        n += 1
        seen += [v] if v is not None else []
        r = told[i]
        assert (r["n"], r["s"], r["lo"], r["hi"]) == (n, sum(seen), min(seen, default=None), max(seen, default=None))
        assert r["m"] == (pytest.approx(sum(seen) / len(seen)) if seen else None)


def test_first_and_last_in_mixed_order(spark):
    rows = [(i % 3, None if i % 7 == 0 else (i * 5) % 11, i) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, k int, i int")
    got = aggregate(df, [{"$sort": {"k": -1, "i": 1}}, {"$group": {"_id": "$g", "f": {"$first": "$i"}, "l": {"$last": "$i"}}}]).collect()
    for r in got:
        own = sorted((x for x in rows if x[0] == r["_id"]), key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
        assert (r["f"], r["l"]) == (own[0][2], own[-1][2])


def test_patterns(spark):
    check_regex("(foo|bar)+")
    for bad in ("(a+)+", "(.*)*", "a{1,2}{3}"):
        with pytest.raises(QueryError):
            check_regex(bad)


def test_indexes_outlive_the_session(spark, tmp_path):
    c = Database.open(spark, str(tmp_path)).collection("c")
    c.insert_many([{"_id": "a", "n": "x"}, {"_id": "b", "n": "Other words"}])
    c.create_index("n", unique=True)
    c.create_text_index("n")
    again = Database.open(spark, str(tmp_path)).collection("c")
    with pytest.raises(DuplicateKey):
        again.insert_one({"n": "x"})
    assert [r["_id"] for r in again.find({"$text": {"$search": "WORDS other"}}).collect()] == ["b"]
    assert "__tokens" in again.store.read().columns and "__tokens" not in again.df().columns
    with pytest.raises(DuplicateKey):
        c.insert_many([{"_id": "p", "m": 1}, {"_id": "q", "m": 1}])
        c.create_index("m", unique=True)


def test_uniqueness_and_events_of_encrypted_collections(spark, tmp_path):
    c = Database.open(spark, str(tmp_path)).collection_v2("c", passphrase="p")
    c.insert_many([{"_id": "a", "n": 1}])
    c.create_index("n", unique=True)
    with pytest.raises(DuplicateKey):
        c.insert_one({"_id": "b", "n": 1})
    log = spark.read.parquet(c.store.log_path).collect()
    assert [(r["operationType"], r["documentKey"], r["fullDocument"]) for r in log] == [("insert", "a", None)]


def test_events_tell_only_of_what_was_committed(spark, tmp_path):
    db = Database.open(spark, str(tmp_path))
    c = db.collection("c")
    c.insert_many([{"_id": "a", "n": 1}])
    t = db.begin_transaction()
    t.insert("c", {"_id": "y", "n": 2})
    t.insert("c", {"_id": "a", "n": 3})
    with pytest.raises(DuplicateKey):
        t.commit()
    t = db.begin_transaction()
    t.insert("c", {"_id": "z", "n": 4})
    t.commit()
    log = {r["documentKey"]: r["txId"] for r in spark.read.parquet(c.store.log_path).collect()}
    assert set(log) == {"a", "z"} and log["z"] == t.id and log["a"] == 0


def test_import_counts_every_bad_line(spark, tmp_path):
    lines = [f'{{"_id":"{i}"}}' if i % 2 else "bad" for i in range(2400)] + ['{"_id":"1"}']
    (tmp_path / "x.ndjson").write_text("\n".join(lines))
    out = Database.open(spark, str(tmp_path / "db")).collection("c").import_from(str(tmp_path / "x.ndjson"))
    assert (out.total, out.inserted, out.skipped) == (2401, 1200, 1201)
    assert [e["line"] for e in out.errors[:3]] == [1, 3, 5]


def test_migration_in_batches(spark, tmp_path):
    from quarry.migrate import MigrationRunner

    c = Database.open(spark, str(tmp_path)).collection("c")
    c.insert_many([{"_id": f"k{i}", "n": i, "_schemaVersion": 1 if i % 2 else 2} for i in range(10)])
    runner, seen = MigrationRunner(c), []
    up = lambda df: df.withColumn("n", F.col("n") + 100)
    assert runner.migrate(2, up, dry_run=True)["pending"] == 5 and runner.count_pending(2) == 5
    assert runner.migrate(2, up, batch_size=2, timeout=0)["timedOut"] and runner.count_pending(2) == 3
    out = runner.migrate(2, up, batch_size=2, on_progress=seen.append)
    assert out["migrated"] == 3 and seen == [2, 3] and runner.is_complete(2)
    assert sorted(r["n"] for r in c.df().collect()) == sorted(i + 100 if i % 2 else i for i in range(10))
    assert runner.migrate(3, up, filter={"n": {"$lt": 5}})["migrated"] == 3 and runner.count_pending(3) == 7
    with pytest.raises(QueryError):
        runner.migrate(0, up)


def test_compaction_lays_out_by_the_index(spark, tmp_path):
    c = Database.open(spark, str(tmp_path), compression="zstd").collection("c")
    c.insert_many([{"_id": str(i), "n": (i * 37) % 100} for i in range(100)])
    c.create_index("n")
    c.compact()
    assert [r["n"] for r in c.store.read().collect()] == sorted((i * 37) % 100 for i in range(100))
    assert all(".zstd." in n for n in c.store.files.names(c.store.snapshot()) if n.endswith(".parquet"))


def test_metrics_by_collection():
    from quarry.metrics import Observability

    o = Observability()
    for i in range(1, 11):
        o.record("find", i, collection="a")
        o.record("find", 10 * i, ok=i != 3, collection="b")
    told = o.report()
    assert told["collections"]["a"]["find"]["p50"] == 5 and told["collections"]["b"]["find"]["errors"] == 1 and told["operations"]["find"]["count"] == 20
    assert 'quarry_operations_total{collection="b",op="find"} 10' in o.to_prometheus()
