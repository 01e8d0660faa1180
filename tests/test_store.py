import json

import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.collection import Collection
from tessera.database import Database
from tessera.functions import documents as docs
from tessera.functions import joins
from tessera.functions.embedding import CohereProvider, GeminiProvider, HttpProvider, OllamaProvider
from tessera.operators import reports, schema, text, updates
from tessera.plans import store


def test_an_indexed_filter_reaches_the_scan(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "c")
    c.create_index("n")
    c.insert_many([{"_id": str(i), "n": i, "mixed": i if i % 2 else str(i), "s": None if i % 3 else "x"} for i in range(200)])
    c.create_index("mixed")
    c.create_index("s")
    c.compact()
    assert c.manifest()["columns"] == {"n": "double", "s": "string"}
    df = c.matching({"n": {"$gt": 150}, "s": "x"})
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    pushed = next(x for x in plan.split("\n") if x.startswith("PushedFilters") and "dou:n" in x)
    assert "GreaterThan(`dou:n`,150.0)" in pushed and "EqualTo(`str:s`,x)" in pushed
    # kept columns give what the documents give
    for where in ({"n": {"$ne": 3}}, {"s": None}, {"s": {"$exists": False}}, {"$not": {"s": "x"}}, {"n": {"$in": [1, 2, "3"]}}, {"mixed": {"$gt": 100}}, {"n": {"$lt": "10"}}, {"s": {"$strLen": 1}}, {"n": {"$contains": 1}}):
        got = {r["_id"] for r in c.matching(where).select("_id").collect()}
        rows = c.find_all()
        from tessera.operators.find import resolve

        assert got == {r["_id"] for r in rows.where(resolve(rows, where, variant="doc")).collect()}, where


def test_a_commit_that_came_late_is_not_lost(spark, tmp_path):
    one, two = Collection(spark, str(tmp_path), "c", writer="one"), Collection(spark, str(tmp_path), "c", writer="two")
    one.insert({"_id": "a"})
    one.insert({"_id": "b"})
    one.compact()
    two.seq = lambda: 0
    two.insert({"_id": "late"})
    assert {r["_id"] for r in one.find_all().collect()} == {"a", "b", "late"}
    one.compact(full=True)
    assert {r["_id"] for r in two.find_all().collect()} == {"a", "b", "late"}
    with pytest.raises(Exception, match="(?i)exist"):
        two.insert({"_id": "again"})


def test_text_index_follows_updates_and_expiry(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "c")
    c.create_text_index()
    c.insert_many([{"_id": "a", "t": "red blue"}, {"_id": "b", "t": "red"}, {"_id": "x", "t": None}])
    c.insert({"_id": "gone", "t": "red red"}, ttl=1)
    c.compact()
    c.update({"_id": "b"}, {"$set": {"t": "green"}})
    stored = {r["id"]: round(r["score"], 9) for r in c.bm25_scores("red").collect()}
    plain = {r["id"]: round(r["score"], 9) for r in text.bm25(c._docs(), c._searchable(), "_id", "red").collect()}
    assert stored == plain and set(stored) == {"a"}
    assert [r["_id"] for r in c.search("RED blue").records.collect()] == ["a"] and c.search(" ").total == 0


def test_updates_of_documents(spark):
    m = docs.as_map(F.parse_json("d"))
    rows = spark.createDataFrame([('{"a":1,"t":["x"],"n":null,"o":{"k":1}}',), ("[1]",)], "d string")
    got = [json.loads(r[0]) for r in rows.select(docs.from_map(updates.fold_update(m, {"$set": {"a": [1], "_id": 2}, "$unset": {"o": 1}, "$inc": {"n": 2, "z": 1.5}, "$push": {"t": {"q": 1}, "u": 1}}))).collect()]
    assert got[0] == {"a": [1], "t": ["x", {"q": 1}], "n": 2, "z": 1.5, "u": [1]}
    with pytest.raises(Exception, match="non-array"):
        rows.select(docs.from_map(updates.fold_update(m, {"$push": {"a": 1}}))).collect()
    ops = [{"op": "copy", "from": "a", "to": "b"}, {"op": "default", "field": "n", "value": 7}, {"op": "default", "field": "q", "value": {"z": []}}, {"op": "rename", "from": "missing", "to": "t"}]
    got = json.loads(rows.select(docs.from_map(updates.fold_migrate(m, ops))).first()[0])
    assert got == {"a": 1, "b": 1, "t": ["x"], "n": None, "o": {"k": 1}, "q": {"z": []}}
    with pytest.raises(ValueError, match="protected"):
        updates.checked([{"op": "set", "field": "_id", "value": 1}])


def test_size_of_documents(spark):
    def chars(v):
        if v is None:
            return 4
        if isinstance(v, str):
            return len(v.encode("utf-16-le")) // 2 + 2
        if isinstance(v, bool):
            return len(str(v))
        if isinstance(v, (int, float)):
            return len(str(v))
        if isinstance(v, list):
            return 2 + sum(chars(x) + 1 for x in v)
        return 2 + sum(len(k) + 3 + chars(x) + 1 for k, x in v.items())

    for v in ({}, {"a": 1}, {"a": [], "b": {}}, {"a": 'q"uo\\te\n{[', "b": [1, [2, "]"]], "c": None, "d": True, "e": {"f": "😀é"}}):
        assert spark.range(1).select(docs.chars(F.parse_json(F.lit(json.dumps(v))))).first()[0] == chars(v), v


def test_null_array_elements_and_types_are_refused(spark):
    s = {"fields": {"t": {"type": "string[]"}, "n": {"type": "number[]"}, "o": {"type": "object"}, "d": {"type": "date"}}}
    rows = [{"t": ["a", None]}, {"n": [1, 2.5]}, {"n": ["1"]}, {"o": []}, {"o": {}}, {"d": 3}, {"t": [], "n": []}, {"t": None}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i int, d string")
    got = {r["i"]: r["violations"] for r in schema.doc_violations(df, docs.as_map(F.parse_json("d")), s).collect()}
    assert [bool(got[i]) for i in range(8)] == [True, False, True, True, False, True, False, False]


def test_lookup_beyond_the_bound_keeps_every_row(spark):
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, -1)], "k string, v int")
    small = spark.createDataFrame([("hot", "x" * 50), ("k3", "y")], "k string, w string")
    for how in ({}, {"max_rows": 1}, {"max_bytes": 10}):
        got = joins.lookup(big, small, "k", **how)
        assert got.count() == 301 and got.where("w is not null").count() == 201
    assert joins.small_enough(small) and not joins.small_enough(small, 1) and not joins.small_enough(small, 10, 10)


def test_scratch_is_deleted_and_needs_a_shared_folder(spark, monkeypatch):
    with session.scope(spark):
        df = session.written(spark.range(3), "x")
        path = session._GIVEN[spark.sparkContext.applicationId][-1]
        assert df.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(path).count()

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_providers_read_their_services_answers():
    assert HttpProvider("u").parse({"data": [{"embedding": [1]}]}) == [[1]] and HttpProvider("u", model="m").body(["t"]) == {"input": ["t"], "model": "m"}
    assert OllamaProvider("u").parse({"embeddings": [[1]]}) == [[1]]
    assert CohereProvider("u").parse({"embeddings": {"float": [[1]]}}) == [[1]] and CohereProvider("u").body(["t"])["texts"] == ["t"]
    assert GeminiProvider("u", model="m").parse({"embeddings": [{"values": [1]}]}) == [[1]] and len(GeminiProvider("u").body(["a", "b"])["requests"]) == 2


def test_embedding_errors_are_reported(spark, tmp_path):
    class Broken:
        def embed(self, texts):
            raise OSError("no service")

    c = Database(spark, str(tmp_path), Broken()).collection("c")
    c.insert_many([{"_id": "a", "t": "x"}, {"_id": "b", "t": "y"}])
    got = c.reembed_all()
    assert got["embedded"] == 0 and got["failed"] == 2 and got["errors"][0] == {"id": "a", "error": "no service"}


def test_watch_hands_over_what_comes(spark, tmp_path):
    from tessera.streaming import feed

    c, got = Collection(spark, str(tmp_path / "db"), "c"), []
    c.insert({"_id": "a"})
    q = feed.watch(c, str(tmp_path / "ck"), lambda rows, _: got.extend(r["_id"] for r in rows.collect()), "100 milliseconds")
    try:
        q.processAllAvailable()
        c.insert({"_id": "b"})
        q.processAllAvailable()
    finally:
        q.stop()
    assert got == ["a", "b"]


def test_reports(spark):
    df = spark.createDataFrame([("a", None), ("b", "x" * 1000), (None, "")], "k string, t string")
    assert {tuple(r) for r in reports.breakdown(df, F.col("k")).collect()} == {("a", 1), ("b", 1), (None, 1)}
    assert tuple(reports.cardinality(df, ["k", "t"]).first()) == (3, 3)
    assert [len(r[0]) for r in df.select(reports.chunks(F.col("t"))).collect()] == [0, 3, 0]


@pytest.mark.parametrize("name", ["store_validate", "store_defaults", "store_read_only", "store_schemas", "store_writers"])
def test_queries_that_say_what_they_expect(spark, name):
    """Their SQL is a list of values."""
    import duckdb

    cur = duckdb.sql(store.SQL[name])
    got = store.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert {tuple(r) for r in got.select(*cur.columns).collect()} == set(cur.fetchall())
