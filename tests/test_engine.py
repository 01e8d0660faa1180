import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.database import Database, allowed
from tessera.functions.embedding import HashProvider
from tessera.operators import find as finder
from tessera.operators import fusion, knn, schema, text, updates
from tessera.streaming import feed
from tessera.tools import TOOLS, call


def test_registry_needs_no_session():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "p1_found" in entry.queries()


@pytest.mark.parametrize(
    "docs,query,want",
    [
        ([("d1", "hello world")], "hello", {"d1": 0.28768207245178085}),
        ([("d1", "hello world")], "hello world", {"d1": 0.5753641449035617}),
        ([("d1", "hello world"), ("d2", "hello hello foo bar baz")], "hello", {"d1": 0.2210828326477875, "d2": 0.22372525694238257}),
        ([("d1", "hello"), ("d2", None)], " ", {}),
    ],
)
def test_bm25_known_values(spark, docs, query, want):
    df = spark.createDataFrame(docs, "id string, t string")
    got = {r["id"]: r["score"] for r in text.bm25(df, F.col("t"), "id", query).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_rrf_and_vectors(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0)], "id string, score double")
    b = spark.createDataFrame([("y", 9.0), ("z", 1.0)], "id string, score double")
    got = {r["id"]: r["score"] for r in fusion.rrf([a, b]).collect()}
    assert math.isclose(got["y"], 1 / 62 + 1 / 61) and math.isclose(got["z"], 1 / 62)
    with pytest.raises(ValueError):
        fusion.rrf([a], 0)
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("n", None), ("o", [0.0, 0.0])], "id string, v array<double>")
    assert [(r["id"], r["score"]) for r in knn.nearest(v, "v", "id", [1, 0], 2).collect()] == [("a", 1.0), ("b", 0.0)]
    q = spark.createDataFrame([([-2.5, 127.0],)], "v array<double>").select(knn.quantize(F.col("v")).alias("q")).collect()[0]["q"]
    assert q["data"] == [-2, 127]


def test_update_operators(spark):
    df = spark.createDataFrame([(1, None, "s", ["a"]), (2, 5, "t", None)], "_id int, n int, s string, tags array<string>")
    got = updates.apply_update(df, {"$inc": {"n": 2, "_id": 9}, "$push": {"tags": "z"}, "$set": {"s": "new"}}, F.col("_id") == 2).orderBy("_id").collect()
    assert [tuple(r) for r in got] == [(1, None, "s", ["a"]), (2, 7, "new", ["z"])]
    with pytest.raises(Exception, match="non-number"):
        updates.apply_update(df, {"$inc": {"s": 1}}).collect()


def test_paging_and_budget(spark):
    df = spark.createDataFrame([(i, f"name{i}", None if i == 3 else i * 10) for i in range(20)], "_id int, name string, score int")
    r = finder.find(df, {"score": {"$gte": 0}}, sort="-score", limit=5, offset=1)
    assert [x["_id"] for x in r.records.collect()] == [18, 17, 16, 15, 14] and r.total == 19 and r.truncated
    assert [x["_id"] for x in finder.find(df, None, sort="score", limit=20).records.collect()][-1] == 3
    assert finder.find(df, None, max_tokens=1).records.count() == 1
    long = spark.createDataFrame([(1, "x" * 300, list(range(20)))], "_id int, a string, b array<int>")
    assert finder.find(long, None, summary=True).records.collect()[0][1:] == (None, None)


def test_schema_functions(spark):
    s = {"name": "t", "version": 2, "fields": {"a": {"type": "enum", "values": ["x", "y"]}, "n": {"type": "number", "min": 1, "required": True}}}
    schema.validate_schema(s)
    with pytest.raises(ValueError):
        schema.validate_schema({"name": "t", "fields": {"a": {"type": "nope"}}})
    df = spark.createDataFrame([("x", 2.0), ("z", 0.0), (None, None)], "a string, n double")
    assert [len(r["v"]) for r in df.select(schema.violations(df, s).alias("v")).collect()] == [0, 2, 1]
    merged, warn = schema.merge_schemas(s, {"name": "t", "version": 1, "fields": {"n": {"type": "string", "description": "d"}}, "indexes": ["n"]})
    assert merged["version"] == 1 and merged["fields"]["n"]["type"] == "number" and merged["fields"]["n"]["description"] == "d" and len(warn) == 2
    assert [d["change"] for d in schema.diff_schemas(s, {"fields": {"n": {"type": "string"}, "q": {"type": "date"}}})] == ["removed", "changed", "added"]
    rows = spark.createDataFrame([('{"a":"2020-01-01","b":[1],"c":1}',), ('{"a":"2021-02-02","b":[],"c":"x"}',), ("broken",), (None,)], "doc string")
    got = {r["field"]: r["type"] for r in schema.infer(rows, "doc").collect()}
    assert got["a"] == "date" and got["c"] is None


def test_collection_life(spark, tmp_path):
    db = Database(spark, str(tmp_path), HashProvider(16))
    c = db.collection("notes")
    seen = []
    c.on_change(seen.append)
    c.insert_many([{"_id": "a", "n": 1, "tags": ["red"], "body": "hello world"}, {"_id": "b", "n": "7", "body": "hello hello foo"}, {"_id": "c", "n": 2.5}])
    assert seen[0]["type"] == "insert" and sorted(seen[0]["ids"]) == ["a", "b", "c"]
    assert [r["_id"] for r in c.find({"n": {"$gt": 1}}).records.collect()] == ["b", "c"]
    assert c.update("+red", {"$inc": {"n": 4}, "$push": {"tags": "x"}, "$set": {"_id": "no", "z": None}}) == 1
    assert c.find_one("a") == {"_id": "a", "_version": 2, "n": 5, "tags": ["red", "x"], "body": "hello world", "z": None}
    with pytest.raises(ValueError):
        c.update({"_id": "a"}, {"$set": {"n": 0}}, expected_version=1)
    assert c.upsert("d", {"v": 1})["action"] == "inserted" and c.upsert("d", {"v": 2})["action"] == "updated"
    assert c.undo() and c.find_one("d")["v"] == 1
    assert c.search("hello foo").total == 1
    assert [r["_id"] for r in c.bm25_search("hello", where={"n": 5}).collect()] == ["a"]
    assert c.hybrid_search("hello world", 2).first()["_id"] == "a"
    assert c.archive({"_id": "c"}, "old") == 1 and c.list_archive_segments() == ["old"] and c.load_archive("old").count() == 1
    c.insert({"_id": "t"}, ttl=-1000)
    assert c.find_one("t") is None and c.cleanup() == 1
    c.compact()
    assert c.delete_by_id("b") and sorted(r["_id"] for r in c.iterate()) == ["a", "d"]
    got = []
    ck = str(tmp_path / "ck")
    feed.tail(c, ck, lambda df, i: got.append(df.count()))
    c.insert({"_id": "e"})
    feed.tail(c, ck, lambda df, i: got.append(df.count()))
    assert got[-1] == 1
    assert len(TOOLS) == 41 and "error" in call(db, "db_find_one", {})
    assert call(db, "db_count", {"collection": "notes"})["result"] == {"count": 3}


def test_permissions():
    rules = {"r": {"read": True}, "a": {"admin": True}}
    assert allowed(None, None, "admin") and allowed(rules, "a", "read") and allowed(rules, "r", "read")
    assert not allowed(rules, "r", "write") and not allowed(rules, None, "read")
