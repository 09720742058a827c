import pytest

from quarry.database import Database
from quarry.errors import Conflict, DuplicateKey, QueryError
from quarry.ids import generate_id, id_to_timestamp, is_valid_id
from quarry.metrics import Observability
from quarry.migrate import MigrationRunner
from quarry.streaming.ttl import TTLIndex, format_ttl

PEOPLE = [{"_id": "a", "name": "Ann", "age": 30, "tags": ["x", "y"]}, {"_id": "b", "name": "Bo", "age": 25, "tags": []}, {"_id": "c", "name": "Cy", "city": "Rome", "at": {"zip": 5}}]


@pytest.fixture
def db(spark, tmp_path):
    return Database.open(spark, str(tmp_path / "db"))


@pytest.fixture
def people(db):
    c = db.collection("people")
    c.insert_many(PEOPLE)
    return c


def ids(df):
    return sorted(r["_id"] for r in df.collect())


def test_reads(people):
    assert people.count_documents() == 3
    assert people.find_by_id("a")["name"] == "Ann"
    assert ids(people.find({"age": {"$gte": 25}})) == ["a", "b"]
    assert ids(people.find({"age": {"$ne": 30}})) == ["b", "c"]
    assert ids(people.find({"age": {"$not": {"$gt": 26}}})) == ["b", "c"]
    assert ids(people.find({"at.zip": 5})) == ["c"]
    assert ids(people.find({"tags": {"$all": []}})) == ["a", "b"]
    assert ids(people.find({"name": {"$in": []}})) == []
    assert [r["_id"] for r in people.find({}, sort={"age": -1}, limit=1, projection={"_id": 1}).collect()] == ["a"]
    assert sorted(people.distinct("name")) == ["Ann", "Bo", "Cy"]
    assert people.exists({"name": "Bo"}) and not people.exists({"name": 1})
    assert ids(people.findManyById(["a", "zz", "c"])) == ["a", "c"]
    with pytest.raises(QueryError):
        people.find({"$where": "1"})
    with pytest.raises(QueryError):
        people.find({"age": {"$near": 1}})


def test_writes_and_versions(people):
    assert people.update_many({"age": {"$lt": 100}}, {"$inc": {"age": 1}, "$set": {"at.zip": 7}, "$push": {"tags": "z"}}) == 2
    assert people.find_by_id("a") | {"city": None} == {"_id": "a", "name": "Ann", "age": 31, "tags": ["x", "y", "z"], "city": None, "at": {"zip": 7}}
    assert people.upsert_one({"_id": "n"}, {"$set": {"name": "New"}, "$setOnInsert": {"age": 1}})["age"] == 1
    assert people.replace_one({"_id": "b"}, {"name": "Bob"}) and people.find_by_id("b")["age"] is None
    assert people.find_one_and_delete({"_id": "b"})["name"] == "Bob"
    assert people.delete_many({"name": {"$regex": "^n", "$options": "i"}}) == 1
    with pytest.raises(DuplicateKey):
        people.insert_one({"_id": "a"})
    with pytest.raises(QueryError):
        people.update_one({}, {"$set": {"_id": "q"}})
    out = people.bulk_write([{"insertOne": {"document": {"_id": "k"}}}, {"insertOne": {"document": {"_id": "k"}}}, {"deleteOne": {"filter": {"_id": "k"}}}], ordered=False)
    assert (out["insertedCount"], out["deletedCount"], len(out["errors"])) == (1, 1, 1)
    before = people.store.version()
    with pytest.raises(Conflict):
        people.store.publish(people.store.stage(people.df()), before - 1)
    people.compact()
    assert people.stats()["liveDocs"] == 2
    people.truncate()
    assert people.count_documents() == 0


def test_reopen_and_unique(spark, db, people):
    again = Database.open(spark, db.path)
    assert again.list_collections() == ["people"] and again.collection("people").count_documents() == 3
    people.create_index("name", unique=True)
    with pytest.raises(DuplicateKey):
        people.insert_one({"name": "Ann"})
    assert people.count_documents() == 3


def test_text_and_lookup(db, people):
    with pytest.raises(QueryError):
        people.find({"$text": {"$search": "ann"}}).collect()
    people.create_text_index("name")
    assert ids(people.find({"$text": {"$search": "ANN!"}})) == ["a"]
    assert ids(people.find({"$text": {"$search": "!"}})) == []
    db.collection("orders").insert_many([{"_id": "1", "user": "a", "n": 2}, {"_id": "2", "user": "a", "n": 3}])
    rows = people.aggregate([{"$lookup": {"from": "orders", "localField": "_id", "foreignField": "user", "as": "orders"}}, {"$sort": {"_id": 1}}]).collect()
    assert [len(r["orders"]) for r in rows] == [2, 0, 0]


def test_transactions(db, people):
    t = db.begin_transaction()
    t.insert("people", {"_id": "t1"})
    t.savepoint("s")
    t.insert("people", {"_id": "t2"})
    t.rollback_to("s")
    t.commit()
    assert t.status == "committed" and people.exists({"_id": "t1"}) and not people.exists({"_id": "t2"})
    t = db.begin_transaction()
    t.delete("people", {"_id": "a"})
    t.insert("people", {"_id": "t1"})
    with pytest.raises(DuplicateKey):
        t.commit()
    assert t.status == "aborted" and people.exists({"_id": "a"})


def test_changes(people, tmp_path):
    seen = []
    stream = people.watch({"name": "Ann"}).on("change", seen.append)
    people.update_one({"_id": "a"}, {"$set": {"age": 1}})
    people.delete_one({"_id": "b"})
    stream.start(str(tmp_path / "ck"), available_now=True).awaitTermination(60)
    assert sorted((e["operationType"], e["documentKey"]) for e in seen) == [("delete", "b"), ("insert", "a"), ("update", "a")]
    stream.close()
    assert stream.is_closed


def test_encrypted(db):
    c = db.collection_v2("secret", passphrase="p")
    c.insert_many([{"_id": "a", "n": 1}, {"_id": "b", "n": 2}])
    assert ids(c.find({"n": {"$gt": 1}})) == ["b"] and "n" not in c.store.read().columns
    assert db.collection_v2("secret", passphrase="wrong").find({"n": 1}).count() == 0
    assert c.rotate_encryption_key(passphrase="q") == 2
    assert ids(db.collection_v2("secret", passphrase="q").find({})) == ["a", "b"]


def test_files(spark, db, people, tmp_path):
    assert people.export_to(str(tmp_path / "out.ndjson")) == 3
    assert people.export_to(str(tmp_path / "out.json")) == 3
    other = db.collection("other")
    assert other.import_from(str(tmp_path / "out.json")).inserted == 3
    (tmp_path / "bad.ndjson").write_text('{"_id":"a","name":"X"}\n\nnot json\n{"_id":"z","name":"Z"}\n')
    out = other.import_from(str(tmp_path / "bad.ndjson"))
    assert (out.inserted, out.errors[0]["line"]) == (1, 2)
    assert other.import_from(str(tmp_path / "out.json"), mode="upsert").inserted == 3
    db.backup(str(tmp_path / "copy"))
    assert Database.open(spark, str(tmp_path / "copy")).collection("people").count_documents() == 3


def test_services(people):
    runner = MigrationRunner(people)
    assert runner.count_pending(2) == 3
    assert runner.migrate(2, lambda df: df.withColumn("seen", df["_id"].isNotNull()))["migrated"] == 3 and runner.is_complete(2)
    people.insert_one({"_id": "old", "expires": 5})
    ttl = TTLIndex(people, "expires")
    assert ttl.purge_now() == 1 and ttl.total_deleted == 1
    assert format_ttl(90_000) == "2m" and is_valid_id(generate_id()) and id_to_timestamp(generate_id()) > 1_600_000_000_000
    o = Observability()
    for i in range(1, 101):
        o.record("find", i)
    assert o.report()["operations"]["find"]["p95"] == 95
