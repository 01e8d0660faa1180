"""Queries through collections, databases and tools, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.audit import AuditLog
from tessera.collection import Collection
from tessera.database import Database, allowed
from tessera.functions import documents as docs
from tessera.functions.embedding import HashProvider
from tessera.operators import schema as schemas
from tessera.session import scratch
from tessera.sources import files
from tessera.sources.tables import table
from tessera.streaming import feed
from tessera.tools import TOOLS, call

QUERIES: dict = {}
SQL: dict[str, str] = {}
_OPEN: dict[tuple[str, str, str], Database] = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _new(spark: SparkSession, keep: bool = False, **how) -> Database:
    return Database(spark, scratch(spark, "db", keep), **how)


def _once(spark: SparkSession, d: str, name: str, fill) -> Collection:
    """A collection that several queries read, filled once per application and folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _OPEN:
        db = _new(spark, keep=True)
        fill(db.collection(name))
        _OPEN[key] = db
    return _OPEN[key].collection(name)


def _order_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("_id"), "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def _orders(spark: SparkSession, d: str) -> Collection:
    """Orders with indexes, folded; then every order of status P is updated and the cheap ones removed, which is not folded."""

    def fill(c: Collection) -> None:
        c.create_index("o_orderstatus", "o_totalprice")
        c.create_index("o_custkey")
        c.append(_order_docs(spark, d))
        c.compact()
        c.update({"o_orderstatus": "P"}, {"$set": {"o_orderstatus": "X"}, "$inc": {"n": 2}, "$push": {"tags": "late"}})
        c.remove({"o_totalprice": {"$lt": 20000}})

    return _once(spark, d, "orders", fill)


_ORDERS = """WITH o AS (SELECT o_orderkey::VARCHAR AS _id, o_custkey, o_orderpriority, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS status,
CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS _version FROM orders WHERE o_totalprice >= 20000 OR o_totalprice IS NULL)
"""


def _field(name: str, kind: str = "string"):
    return F.try_variant_get("doc", f"$.{name}", kind)


@_query(_ORDERS + "SELECT _id, _version::BIGINT AS version, status, CASE WHEN status = 'X' THEN 2 END::BIGINT AS n FROM o")
def store_find_all(spark: SparkSession, d: str) -> DataFrame:
    """All records after updates and removals, from base and log."""
    return _orders(spark, d).find_all().select("_id", F.col("_version").alias("version"), _field("o_orderstatus").alias("status"), _field("n", "long").alias("n"))


@_query(_ORDERS + "SELECT _id FROM o WHERE status = 'F' AND o_totalprice > 150000")
def store_scan_column(spark: SparkSession, d: str) -> DataFrame:
    """Keys that an indexed filter matches."""
    return _orders(spark, d).matching({"o_orderstatus": "F", "o_totalprice": {"$gt": 150000}}).select("_id")


@_query(_ORDERS + "SELECT count(*) AS n FROM o WHERE status = 'X'")
def store_count_column(spark: SparkSession, d: str) -> DataFrame:
    """Equality count on an indexed column and the log after it."""
    return spark.createDataFrame([(_orders(spark, d).count({"o_orderstatus": "X"}),)], "n long")


@_query(_ORDERS + "SELECT _id FROM o WHERE o_custkey % 7 = 3")
def store_by_ids(spark: SparkSession, d: str) -> DataFrame:
    """Records by a table of ids, some of which don't exist."""
    ids = table(spark, d, "orders").where("o_custkey % 7 = 3").select(F.col("o_orderkey").cast("string").alias("_id"))
    return _orders(spark, d).by_ids(ids.unionByName(ids.select(F.concat("_id", F.lit("x")).alias("_id")))).select("_id")


@_query(_ORDERS + "SELECT _id, o_totalprice AS price FROM o WHERE NOT (status = 'O') ORDER BY o_totalprice DESC, _id LIMIT 20 OFFSET 5")
def store_find_page(spark: SparkSession, d: str) -> DataFrame:
    """A sorted page through a collection."""
    return _orders(spark, d).find({"$not": {"o_orderstatus": "O"}}, sort="-o_totalprice", limit=20, offset=5).records.select("_id", _field("o_totalprice", "double").alias("price"))


@_query(_ORDERS + "SELECT count(*) AS total, count(*) > 30 AS truncated FROM o WHERE status = 'F'")
def store_find_total(spark: SparkSession, d: str) -> DataFrame:
    """Total and truncation of a page."""
    r = _orders(spark, d).find("o_orderstatus:F", limit=25, offset=5)
    return spark.createDataFrame([(r.total, r.truncated)], "total long, truncated boolean")


@_query("SELECT count(*) AS rows, count(DISTINCT o_orderstatus) AS statuses, count(DISTINCT o_totalprice) AS prices, count(DISTINCT o_custkey) AS customers FROM orders")
def store_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Rows and cardinalities that compaction notes."""
    m = _orders(spark, d).manifest()
    c = m["cardinality"]
    return spark.createDataFrame([(m["rows"], c["o_orderstatus"], c["o_totalprice"], c["o_custkey"])], "rows long, statuses long, prices long, customers long")


@_query("SELECT count(*) AS rows FROM orders")
def store_footers(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the base files by their footers."""
    c = _orders(spark, d)
    return files.footers(spark, f"{c.files.root}/{c.manifest()['base']}").agg(F.sum("rows").alias("rows"))


@_query(_ORDERS + "SELECT DISTINCT '\"' || status || '\"' AS value FROM o")
def store_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values of a field as JSON."""
    return _orders(spark, d).distinct_values("o_orderstatus")


@_query(_ORDERS + "SELECT o.* FROM (SELECT _id, status FROM o ORDER BY _id LIMIT 1) o")
def store_find_one(spark: SparkSession, d: str) -> DataFrame:
    """One record by its id."""
    c = _orders(spark, d)
    r = c.find_one(c.find(limit=1).records.first()["_id"])
    return spark.createDataFrame([(r["_id"], r["o_orderstatus"])], "_id string, status string")


@_query(_ORDERS + ", x AS (SELECT count(*) AS n FROM o) SELECT _id, status || ' of ' || n AS label FROM o, x ORDER BY _id LIMIT 10")
def store_computed(spark: SparkSession, d: str) -> DataFrame:
    """A computed field over the record and all records."""
    c = Collection(spark, *_orders(spark, d).files.root.rsplit("/", 1))
    c.define_computed("label", F.concat(_field("o_orderstatus"), F.lit(" of "), F.col("all_n").cast("string")), lambda rows: rows.agg(F.count("*").alias("all_n")))
    return c.find(limit=10).records.select("_id", "label")


def _nations(spark: SparkSession, d: str) -> Collection:
    def fill(c: Collection) -> None:
        rows = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("_id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("region"))
        c.append(rows.unionByName(table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("_id"), F.col("r_name").alias("name")), allowMissingColumns=True))

    return _once(spark, d, "places", fill)


@_query("SELECT 'n' || n_nationkey AS _id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%'")
def store_virtual_getter(spark: SparkSession, d: str) -> DataFrame:
    """A virtual filter that looks up the record that a field refers to."""
    c = _nations(spark, d)
    c.define_virtual("in_a", lambda _: F.try_variant_get("_in_a", "$.name", "string").startswith("A"), "region")
    return c.matching({"+in_a": True}).select("_id")


@_query("SELECT 'n' || n_nationkey AS _id, n_name AS name FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region")
def store_iterate(spark: SparkSession, d: str) -> DataFrame:
    """Records one after another."""
    return spark.createDataFrame([(r["_id"], r["name"]) for r in _nations(spark, d).iterate()], "_id string, name string")


def _texts(spark: SparkSession, d: str) -> Collection:
    """Documents with stored postings; then some are removed and some come anew."""

    def fill(c: Collection) -> None:
        rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("_id"), "text", "lang", "source")
        c.create_text_index()
        c.append(rows)
        c.compact()
        c.remove({"lang": "de"})
        c.append(rows.where("lang = 'fr'").withColumn("text", F.concat(F.lit("retry budget "), F.coalesce("text", F.lit("")))))

    db_schema = {"name": "texts", "fields": {"text": {"type": "string", "searchable": True}, "lang": {"type": "string"}, "source": {"type": "string"}}}
    key = (spark.sparkContext.applicationId, d, "texts")
    if key not in _OPEN:
        db = _new(spark, keep=True)
        db.persist_schema("texts", db_schema)
        fill(db.collection("texts"))
        _OPEN[key] = db
    return _OPEN[key].collection("texts")


_TEXTS = """WITH d AS (SELECT doc_id::VARCHAR AS id, lang, CASE WHEN lang = 'fr' THEN 'retry budget ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE lang IS DISTINCT FROM 'de'),
t AS (SELECT id, lang, coalesce(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+'), []) AS w FROM d)
"""


@_query(_TEXTS + "SELECT id AS _id FROM t WHERE list_has_all(w, ['retry', 'budget']) ORDER BY id LIMIT 10000")
def store_text_search(spark: SparkSession, d: str) -> DataFrame:
    """Records with all terms, from stored postings."""
    return _texts(spark, d).search("Budget RETRY", limit=10_000).records.select("_id")


@_query(
    _TEXTS
    + """, s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
p AS (SELECT id, len(w) AS dl, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM t) WHERE term IN ('overdue', 'retry', 'budget', 'legacy') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term)
SELECT id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN df USING (term), s GROUP BY id"""
)
def store_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Scores from stored postings, what was removed and what came since."""
    return _texts(spark, d).bm25_scores("overdue retry budget legacy").select("id", F.round("score", 6).alias("score"))


@_query("SELECT doc_id FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+'), ['für', 'die']) OR list_has_all(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+'), ['était'])")
def text_marks(spark: SparkSession, d: str) -> DataFrame:
    """Terms with accents, as letters of their own and as combining marks."""
    from tessera.operators import text

    rows = table(spark, d, "documents")
    marked = rows.unionByName(spark.createDataFrame([(-1, "हिन्दी भाषा"), (-2, "café noir")], "doc_id long, text string"), allowMissingColumns=True)
    hit = text.and_search(marked, F.col("text"), "FÜR die") | text.and_search(marked, F.col("text"), "était")
    strange = marked.where("doc_id < 0").where(text.and_search(marked, F.col("text"), "भाषा हिन्दी") | text.and_search(marked, F.col("text"), "CAFÉ"))
    if strange.count() != 2 or marked.where("doc_id < 0").where(text.and_search(marked, F.col("text"), "cafe")).count():
        raise AssertionError("terms with marks")
    return marked.where(hit & (F.col("doc_id") >= 0)).select("doc_id")


_Q = [((i * 31) % 17 - 8) / 9 for i in range(64)]


@_query(
    f"""WITH q AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(x * 127.0 / list_max(list_transform(embedding::DOUBLE[], lambda y: abs(y))) + 0.5)) AS v FROM embeddings),
s AS (SELECT vec_id::VARCHAR AS _id, label, list_cosine_similarity(v, {_Q}::DOUBLE[]) AS score FROM q), c AS (SELECT * FROM s ORDER BY score DESC, _id LIMIT 50)
SELECT _id, round(score, 6) AS score FROM c WHERE label < 3 ORDER BY score DESC, _id LIMIT 10"""
)
def store_vector_search(spark: SparkSession, d: str) -> DataFrame:
    """Quantised vectors of a collection: candidates, then the filter."""

    def fill(c: Collection) -> None:
        c.append_vectors(table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("_id"), F.col("embedding").alias("vector"), "label"))

    return _once(spark, d, "vectors", fill).search_by_vector(_Q, 10, {"label": {"$lt": 3}}).select("_id", F.round("score", 6).alias("score"))


@_query("SELECT count(*) AS embedded, 0::BIGINT AS again, count(*) AS reembedded, 0::BIGINT AS failed, 1::BIGINT AS kept, 0::BIGINT AS lost FROM nation")
def store_embed(spark: SparkSession, d: str) -> DataFrame:
    """Vectors made for records without one; an update keeps them as long as the text stays."""
    c = _new(spark, provider=HashProvider(16)).collection("n")
    c.append(table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("r")))
    n, again, all_ = c.embed_unembedded(), c.embed_unembedded(), c.reembed_all()
    have = lambda i: c.stored().where((F.col("_id") == i) & F.col("_embedding").isNotNull()).count()
    c.update({"_id": "1"}, {"$set": {"r": 9}})
    kept = have("1")
    c.update({"_id": "1"}, {"$set": {"name": "other"}})
    return spark.createDataFrame([(n, again, all_["embedded"], all_["failed"], kept, have("1"))], "embedded long, again long, reembedded long, failed long, kept long, lost long")


@_query("SELECT vec_id::VARCHAR AS _id FROM embeddings WHERE false")
def store_vector_dimension(spark: SparkSession, d: str) -> DataFrame:
    """A vector of another dimension is refused."""
    c = _new(spark).collection("v")
    c.insert_vector("a", [1.0, 2.0], {"label": 1})
    try:
        c.insert_vector("b", [1.0])
    except ValueError:
        return c.find_all().where("_id = 'b'").select("_id")
    raise AssertionError("dimension")


def _parts(spark: SparkSession, d: str) -> Collection:
    def fill(c: Collection) -> None:
        c.create_array_index("tags")
        c.create_bloom_filter("brand")
        c.append(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("_id"), F.split("p_name", " ").alias("tags"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.repeat("p_type", 12).alias("long"), F.struct("p_size").alias("inner")))
        c.compact()
        c.append(spark.createDataFrame([("new", ["red", "none"], "Brand#new")], "_id string, tags array<string>, brand string"))

    return _once(spark, d, "parts", fill)


@_query("SELECT p_partkey::VARCHAR AS _id FROM part WHERE list_contains(string_split(p_name, ' '), 'red') UNION ALL SELECT 'new'")
def store_array_index(spark: SparkSession, d: str) -> DataFrame:
    """Records whose array holds an element, by the table of elements and the log."""
    return _parts(spark, d).ids_containing("tags", "red")


@_query("SELECT p_partkey::VARCHAR AS _id FROM part WHERE string_split(p_name, ' ') = (SELECT string_split(p_name, ' ') FROM part ORDER BY p_partkey LIMIT 1)")
def store_array_equal(spark: SparkSession, d: str) -> DataFrame:
    """Arrays equal to one."""
    first = table(spark, d, "part").orderBy("p_partkey").first()["p_name"].split(" ")
    return _parts(spark, d).matching({"tags": first}).select("_id")


@_query("SELECT '' AS _id WHERE false")
def store_object_equal(spark: SparkSession, d: str) -> DataFrame:
    """An object as operand equals nothing."""
    return _parts(spark, d).matching({"inner": {"p_size": 1}}).select("_id")


@_query("SELECT DISTINCT p_brand AS brand, true AS might FROM part UNION ALL VALUES ('Brand#new', true), ('Brand#absent', false)")
def store_bloom(spark: SparkSession, d: str) -> DataFrame:
    """Whether values may be there: those of the base, one that came later, one that isn't."""
    c = _parts(spark, d)
    names = [r["p_brand"] for r in table(spark, d, "part").select("p_brand").distinct().collect()] + ["Brand#new", "Brand#absent"]
    return spark.createDataFrame([(n, c.might_have("brand", n)) for n in names], "brand string, might boolean")


@_query("SELECT p_partkey::VARCHAR AS _id, CASE WHEN len(string_split(p_name, ' ')) <= 10 THEN 1 ELSE 0 END + 2 + CASE WHEN length(p_type) * 12 <= 200 THEN 1 ELSE 0 END AS fields FROM part UNION ALL SELECT 'new', 2")
def store_summary(spark: SparkSession, d: str) -> DataFrame:
    """Fields that a summary keeps: no objects, no long texts or arrays."""
    page = _parts(spark, d).find(summary=True, limit=10_000).records
    return page.select("_id", F.size(docs.as_map(F.col("doc"))).alias("fields"))


@_query(
    """WITH p AS (SELECT n_nationkey::VARCHAR AS _id, 2 + (3 + 3 + length(n_nationkey::VARCHAR) + 2 + 1) + (8 + 3 + 1 + 1) + (4 + 3 + length(n_name) + 2 + 1) + (1 + 3 + (2 + (length(n_regionkey::VARCHAR) + 1) * 2) + 1) AS chars FROM nation),
t AS (SELECT _id, sum(CAST(ceil(chars / 4.0) AS BIGINT)) OVER (ORDER BY _id) AS s FROM p) SELECT _id FROM t WHERE s <= 150"""
)
def store_token_budget(spark: SparkSession, d: str) -> DataFrame:
    """As many records of a collection as fit in 150 tokens."""
    c = _new(spark).collection("n")
    c.append(table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("_id"), F.col("n_name").alias("name"), F.array("n_regionkey", "n_regionkey").alias("r")))
    return c.find(limit=1000, max_tokens=150).records.select("_id")


@_query("SELECT p_partkey::VARCHAR AS _id, p_brand || ' ' || p_name AS text FROM part")
def store_record_text(spark: SparkSession, d: str) -> DataFrame:
    """Text for embedding of a record."""
    rows = _parts(spark, d).matching({"size": {"$exists": True}})
    kept = F.to_variant_object(F.map_filter(docs.as_map(F.col("doc")), lambda k, _: k != "long"))
    return rows.select("_id", docs.record_text(kept).alias("text"))


@_query(
    """SELECT p_partkey::VARCHAR AS _id, CASE WHEN length(p_type) * 12 > 100 THEN left(repeat(p_type, 12), 100) || '...' ELSE repeat(p_type, 12) END AS long,
CASE WHEN len(t) > 5 THEN array_to_string(t[1:5], ' ') || ' ... (' || len(t) || ' items)' ELSE array_to_string(t, ' ') END AS tags FROM (SELECT *, string_split(p_name, ' ') AS t FROM part)"""
)
def store_examples(spark: SparkSession, d: str) -> DataFrame:
    """Values cut down for display."""
    rows = _parts(spark, d).matching({"size": {"$exists": True}})
    read = lambda n, t: F.from_json(docs.example(_field(n, "variant")), t)
    return rows.select("_id", F.get_json_object(F.concat(F.lit('{"v":'), docs.example(_field("long", "variant")), F.lit("}")), "$.v").alias("long"), F.array_join(read("tags", "array<string>"), " ").alias("tags"))


@_query("SELECT * FROM (VALUES ('brand', 'string'), ('inner', 'object'), ('long', 'string'), ('size', 'number'), ('tags', 'array')) t(field, types)")
def store_schema_sample(spark: SparkSession, d: str) -> DataFrame:
    """Types of the fields of the first records."""
    return _parts(spark, d).schema(50)


@_query("SELECT * FROM (VALUES ('insert', 'inserted', 3), ('upsert', 'inserted', 1), ('upsert', 'updated', 2)) t(step, action, n)")
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    """What inserts and upserts did."""
    c = _new(spark).collection("u")
    one = c._set(c._frame([{"_id": i, "v": 1} for i in "abc"]), "insert").collect()
    two = c.upsert_many([{"_id": i, "v": 2} for i in "bcd"])
    rows = [("insert", r["action"]) for r in one] + [("upsert", r["action"]) for r in two]
    return spark.createDataFrame(rows, "step string, action string").groupBy("step", "action").agg(F.count("*").cast("int").alias("n"))


@_query("SELECT * FROM (VALUES (1, 'conflict', 5), (2, 'done', 7), (3, 'missing passes', 1)) t(step, what, n)")
def store_optimistic_lock(spark: SparkSession, d: str) -> DataFrame:
    """Updates with an expected version."""
    c = _new(spark).collection("l")
    c.insert({"_id": "a", "n": 5})
    out = []
    try:
        c.update({"_id": "a"}, {"$inc": {"n": 1}}, expected_version=9)
    except ValueError:
        out.append((1, "conflict", c.find_one("a")["n"]))
    c.update({"_id": "a"}, {"$inc": {"n": 2}}, expected_version=1)
    out.append((2, "done", c.find_one("a")["n"]))
    c.insert({"_id": "b", "n": 1}, expected_version=4)
    out.append((3, "missing passes", c.find_one("b")["n"]))
    return spark.createDataFrame(out, "step int, what string, n int")


@_query("SELECT * FROM (VALUES ('b', 1), ('x', 1), ('y', 1)) t(_id, _version)")
def store_batch_undo(spark: SparkSession, d: str) -> DataFrame:
    """A batch in one commit, then another one undone."""
    c = _new(spark).collection("b")
    c.insert_many([{"_id": "a"}, {"_id": "b"}])
    c.batch([{"_id": "x"}, {"_id": "y"}], ["a"])
    c.batch([{"_id": "z"}], ["b"])
    c.undo()
    return c.find_all().select("_id", F.col("_version").cast("int").alias("_version"))


@_query("SELECT * FROM (VALUES ('set', 1, 'ann'), ('set', 2, 'bob'), ('delete', 2, NULL)) t(op, version, agent)")
def store_history(spark: SparkSession, d: str) -> DataFrame:
    """All operations on a record."""
    c = _new(spark).collection("h")
    c.insert_many([{"_id": "a"}, {"_id": "b"}], agent="ann", reason="first")
    c.update({"_id": "a"}, {"$set": {"v": 1}}, agent="bob")
    c.delete_by_id("a")
    return c.history("a").select("op", F.col("_version").cast("int").alias("version"), F.col("_agent").alias("agent"))


@_query("SELECT 2::BIGINT AS visible, 1::BIGINT AS removed, 2::BIGINT AS left_over")
def store_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Expired records are unseen, then removed."""
    c = _new(spark).collection("t")
    c.insert({"_id": "old"}, ttl=-1000)
    c.insert({"_id": "new"}, ttl=10**9)
    c.insert({"_id": "for ever"})
    seen = c.count()
    return spark.createDataFrame([(seen, c.cleanup(), c.stored().count())], "visible long, removed long, left_over long")


@_query(
    """SELECT p_partkey::VARCHAR AS _id, p_brand AS maker, p_size AS size, true AS checked, string_split(p_name, ' ') AS tags FROM part"""
)
def store_migrate(spark: SparkSession, d: str) -> DataFrame:
    """A migration keeps types and fields that it doesn't name."""
    c = _new(spark).collection("m")
    c.append(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("_id"), F.split("p_name", " ").alias("tags"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.lit("x").alias("junk")))
    ops = [{"op": "rename", "from": "brand", "to": "maker"}, {"op": "unset", "field": "junk"}, {"op": "default", "field": "checked", "value": True}, {"op": "default", "field": "size", "value": -1}]
    dry = call(c_db(spark, c), "db_migrate", {"collection": "m", "ops": ops, "dryRun": True})["result"]
    done = call(c_db(spark, c), "db_migrate", {"collection": "m", "ops": ops})["result"]
    if dry != done or done["updated"] != done["scanned"] or call(c_db(spark, c), "db_migrate", {"collection": "m", "ops": ops})["result"]["unchanged"] != done["scanned"]:
        raise AssertionError((dry, done))
    return c.find_all().select("_id", _field("maker").alias("maker"), F.when(F.schema_of_variant(_field("size", "variant")) == "BIGINT", _field("size", "int")).alias("size"), _field("checked", "boolean").alias("checked"), _field("tags", "array<string>").alias("tags"))


def c_db(spark: SparkSession, c: Collection) -> Database:
    """A database at the place of a collection."""
    return Database(spark, c.files.root.rsplit("/collections/", 1)[0])


@_query("SELECT * FROM (VALUES ('1', 10, 'ab', 'low', true), ('2', 1, 'cd', 'high', true), ('3', 11, NULL, 'low', false), ('4', 12, 'ef', 'low', true)) t(_id, number, code, level, open)")
def store_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Resolved values, defaults of missing fields, and numbers after the highest one."""
    s = {"name": "d", "fields": {"number": {"type": "autoIncrement"}, "code": {"type": "string", "resolve": lambda v: F.lower(F.trim(v))}, "level": {"type": "enum", "values": ["low", "high"], "default": "low"}, "open": {"type": "boolean", "default": lambda: F.lit(True)}}}
    c = _new(spark).collection(s)
    c.insert_many([{"_id": "1", "number": 10, "code": " AB"}, {"_id": "2", "number": 1, "code": "cd", "level": "high"}])
    c.insert_many([{"_id": "3", "code": None, "open": False}, {"_id": "4", "code": "EF "}])
    return c.find_all().select("_id", _field("number", "int").alias("number"), _field("code").alias("code"), _field("level").alias("level"), _field("open", "boolean").alias("open"))


@_query(
    "SELECT * FROM (VALUES (1, 'n: not a number'), (2, 'code: too long'), (3, 'kind: not one of its values'), (4, 'tags: not a string[]'), (5, 'n: required'), (6, 'ok'), (7, 'n: below min'), (8, 'custom')) t(step, what)"
)
def store_validate(spark: SparkSession, d: str) -> DataFrame:
    """Records that a schema refuses; values are never cast to the declared type."""
    s = {"name": "v", "fields": {"n": {"type": "number", "required": True, "min": 0}, "code": {"type": "string", "maxLength": 3}, "kind": {"type": "enum", "values": ["x", "y"]}, "tags": {"type": "string[]"}}}
    c = _new(spark).collection(s)
    c.validators.append(lambda m: F.when(F.try_variant_get(F.try_element_at(m, F.lit("code")), "$", "string") == "bad", "custom"))
    tries = [{"n": "7"}, {"n": 1, "code": "long"}, {"n": 1, "kind": "z"}, {"n": 1, "tags": ["a", 2]}, {"code": "a"}, {"n": 1.5, "code": "a", "kind": "x", "tags": [], "other": {"a": 1}}, {"n": -1}, {"n": 1, "code": "bad"}]
    out = []
    for i, t in enumerate(tries, 1):
        try:
            c.batch([t]) if i % 2 else c.insert(t)
            out.append((i, "ok"))
        except ValueError as e:
            out.append((i, str(e)))
    if c.count() != 1:
        raise AssertionError("refused records were written")
    return spark.createDataFrame(out, "step int, what string")


@_query("SELECT * FROM (VALUES ('beforeInsert', 2), ('afterInsert', 2), ('afterUpdate', 1), ('afterDelete', 1)) t(hook, n)")
def store_hooks(spark: SparkSession, d: str) -> DataFrame:
    """Hooks and the rows they are given."""
    c, seen = _new(spark).collection("k"), []
    for h in ("beforeInsert", "afterInsert", "afterUpdate", "afterDelete"):
        c.hooks[h] = lambda rows, h=h: seen.append((h, rows.count()))
    c.insert_many([{"_id": "a"}, {"_id": "b"}])
    c.update({"_id": "a"}, {"$set": {"x": 1}})
    c.delete_by_id("b")
    return spark.createDataFrame(seen, "hook string, n int")


@_query("SELECT 'insert' AS type, count(*) AS ids, count(DISTINCT o_orderkey) AS once FROM orders")
def store_change_events(spark: SparkSession, d: str) -> DataFrame:
    """Ids that listeners are handed, of a commit of any size."""
    c, got = _new(spark).collection("e"), []
    stop = c.on_change(lambda e: got.extend((e["type"], i) for i in e["ids"]))
    c.append(_order_docs(spark, d).select("_id", "o_orderstatus"))
    stop()
    c.insert({"_id": "unheard"})
    return spark.createDataFrame(got, "type string, id string").groupBy("type").agg(F.count("*").alias("ids"), F.count_distinct("id").alias("once"))


@_query("SELECT * FROM (VALUES (1, 'insert', 'a,b'), (2, 'delete', 'b'), (2, 'update', 'a')) t(step, type, ids)")
def store_tail(spark: SparkSession, d: str) -> DataFrame:
    """What came since the last look at a collection's feed, as events."""
    c, at, out = _new(spark).collection("f"), scratch(spark, "tail"), []
    for step in (1, 2):
        if step == 1:
            c.insert_many([{"_id": "a"}, {"_id": "b"}])
        else:
            c.update({"_id": "a"}, {"$set": {"x": 1}})
            c.delete_by_id("b")
        feed.tail(c, at, lambda rows, _, step=step: out.extend((step, r["type"], ",".join(r["ids"])) for r in feed.change_events(rows, "f").collect()))
    return spark.createDataFrame(out, "step int, type string, ids string")


@_query("SELECT * FROM (VALUES ('a', 3, 'two'), ('b', 1, 'one'), ('c', 1, 'two')) t(_id, version, writer)")
def store_writers(spark: SparkSession, d: str) -> DataFrame:
    """Two writers of one collection at once; commits of one number go by the writer's name."""
    db = _new(spark)
    c1, c2 = Collection(spark, f"{db.root}/collections", "w", writer="one"), Collection(spark, f"{db.root}/collections", "w", writer="two")
    c1.insert_many([{"_id": "a", "by": "one"}, {"_id": "b", "by": "one"}])
    seq = c2.seq
    c2.seq = lambda: 0  # it hasn't seen the first commit
    c2.insert({"_id": "c", "by": "two"})
    c2.seq = seq
    c1.compact()
    c1.upsert("a", {"by": "one"})
    c2.upsert("a", {"by": "two"})
    return c1.find_all().select("_id", F.col("_version").cast("int").alias("version"), _field("by").alias("writer"))


@_query("SELECT 120::BIGINT AS n, 3::BIGINT AS commits")
def store_group(spark: SparkSession, d: str) -> DataFrame:
    """Single inserts that share commits."""
    c = _new(spark).collection("g")
    with c.group(seconds=3600) as g:
        for i in range(120):
            g.insert({"_id": f"r{i}"})
    return spark.createDataFrame([(c.count(), c.seq())], "n long, commits long")


@_query("SELECT 'The database is read-only' AS refused, 1::BIGINT AS n")
def store_read_only(spark: SparkSession, d: str) -> DataFrame:
    """A read-only database refuses every writer and serves readers."""
    db = _new(spark)
    db.collection("r").insert({"_id": "a"})
    ro = Database(spark, db.root, read_only=True)
    c, said = ro.collection("r"), set()
    writes = [lambda: c.insert({"_id": "b"}), lambda: c.remove({}), lambda: c.update({}, {"$set": {"x": 1}}), c.compact, c.undo, lambda: c.archive({}), lambda: c.write_blob("a", "f", b""), lambda: ro.create_collection("q"), lambda: ro.drop_collection("r"), lambda: ro.persist_schema("r", {"fields": {}}), lambda: c.insert_vector("v", [1.0]), lambda: c.batch([{"_id": "z"}]), lambda: c.create_index("x")]
    for w in writes:
        try:
            w()
            said.add("written")
        except PermissionError as e:
            said.add(str(e))
    return spark.createDataFrame([(", ".join(sorted(said)), c.count())], "refused string, n long")


@_query("SELECT 'archive' AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') < '1998-01-01' UNION ALL SELECT 'live', count(*), round(sum(o_totalprice), 2) FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1998-01-01' OR o_orderdate IS NULL")
def store_archive(spark: SparkSession, d: str) -> DataFrame:
    """Records moved to a cold segment, and those that stay."""
    c = _new(spark).collection("a")
    c.append(_order_docs(spark, d).select("_id", "o_totalprice", "day"))
    c.archive({"day": {"$lt": "1998-01-01"}}, "old")
    if c.list_archive_segments() != ["old"]:
        raise AssertionError("segments")
    price = F.get_json_object("doc", "$.o_totalprice").cast("double")
    cold = c.load_archive("old").select(F.lit("archive").alias("part"), price.alias("p"))
    live = c.find_all().select(F.lit("live").alias("part"), _field("o_totalprice", "double").alias("p"))
    return cold.unionByName(live).groupBy("part").agg(F.count("*").alias("n"), F.round(F.sum("p"), 2).alias("total"))


@_query("SELECT o_orderkey::VARCHAR AS _id, CASE WHEN o_orderkey % 2 = 0 THEN 'kept' ELSE o_orderstatus END AS status FROM orders")
def store_export_import(spark: SparkSession, d: str) -> DataFrame:
    """A collection exported and imported where half of its records exist already."""
    db, other, at = _new(spark), _new(spark), scratch(spark, "export")
    rows = _order_docs(spark, d).select("_id", "o_orderstatus")
    db.collection("o").append(rows)
    n = db.export(at)
    other.collection("o").append(rows.where("cast(_id as long) % 2 = 0").withColumn("o_orderstatus", F.lit("kept")))
    done = call(other, "db_import", {"path": at})["result"]
    if done != {"collections": 1, "records": n}:
        raise AssertionError(done)
    return other.collection("o").find_all().select("_id", _field("o_orderstatus").alias("status"))


@_query("SELECT * FROM (VALUES ('x', 'a', 1), ('x', 'b', 9), ('y', 'c', 3)) t(coll, _id, v)")
def store_import_json(spark: SparkSession, d: str) -> DataFrame:
    """An export document: existing records stay, such without id are skipped."""
    db = _new(spark)
    db.collection("x").insert({"_id": "b", "v": 9})
    text = json.dumps({"version": 1, "collections": {"x": {"records": [{"_id": "a", "v": 1, "_version": 4}, {"_id": "b", "v": 2}, {"v": 7}]}, "y": {"records": [{"_id": "c", "v": 3}]}}})
    db.files.write("in.json", text.encode())
    db.import_json(f"{db.root}/in.json")
    one = lambda n: db.collection(n).find_all().select(F.lit(n).alias("coll"), "_id", _field("v", "int").alias("v"))
    return one("x").unionByName(one("y"))


@_query("SELECT n_nationkey::VARCHAR AS _id, CASE WHEN n_nationkey < 5 THEN 'new' ELSE n_name END AS name FROM nation")
def store_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """A record store of two files read back: of an id the line of the later file holds."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("_id"), F.lit(1).alias("_version"), F.to_json(F.struct(F.col("n_name").alias("name"))).alias("doc"))
    at = scratch(spark, "lines")
    files.record_store(rows, f"{at}/1")
    files.record_store(rows.where("cast(_id as int) < 5").withColumn("doc", F.lit('{"name":"new"}')), f"{at}/2")
    got = files.last_lines(files.json_lines(spark, f"{at}/*"))
    return got.select("_id", F.get_json_object("doc", "$.name").alias("name"))


@_query("SELECT n_nationkey::VARCHAR AS _id, n_name AS name FROM nation")
def store_legacy(spark: SparkSession, d: str) -> DataFrame:
    """Files of the old layout."""
    at = scratch(spark, "legacy")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("_id"), F.to_json(F.struct(F.col("n_name").alias("name"))).alias("_data"))
    rows.unionByName(spark.createDataFrame([("bad", "{"), (None, "{}")], "_id string, _data string")).write.parquet(at)
    return files.legacy_rows(spark, at).select("_id", F.get_json_object("doc", "$.name").alias("name"))


@_query("SELECT 20::BIGINT AS records, 1::BIGINT AS bases, true AS few_deltas, true AS few_open, 12::BIGINT AS vacuumed, 20::BIGINT AS still")
def store_compaction(spark: SparkSession, d: str) -> DataFrame:
    """Commits fold by themselves: incrementally, then into one base; what is superseded is deleted."""
    c = _new(spark).collection("c")
    for i in range(12):
        c.insert_many([{"_id": f"r{j}", "v": i} for j in range(i, i + 9)])
    m = c.manifest()
    n, open_ = c.count(), len(c._commits()) - len(m["folded"])
    c.compact(full=True)
    c.compact(full=True)
    bases = len([c.manifest()["base"]])
    return spark.createDataFrame([(n, bases, len(m["deltas"]) <= 10, open_ < 8, c.vacuum(), c.count())], "records long, bases long, few_deltas boolean, few_open boolean, vacuumed long, still long")


@_query("SELECT * FROM (VALUES ('a.txt', 5), ('b.bin', 3)) t(name, size)")
def store_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Blobs of records: a deleted record's go with it."""
    c = _new(spark).collection("b")
    c.insert_many([{"_id": "r"}, {"_id": "s"}])
    c.write_blob("r", "a.txt", b"hello")
    c.write_blob("r", "b.bin", b"\x00\x01\x02")
    c.write_blob("r", "c", b"x")
    c.write_blob("s", "d", b"x")
    c.delete_blob("r", "c")
    c.delete_by_id("s")
    if c.read_blob("r", "a.txt") != b"hello" or c.list_blobs("r") != ["a.txt", "b.bin"] or c.list_blobs("s"):
        raise AssertionError("blobs")
    return c.blobs().where("record_id = 'r'").select("name", F.length("content").alias("size"))


@_query("SELECT * FROM (VALUES ('indexes', 'a|b,c'), ('arrays', 't'), ('bloom', 'e'), ('suggested', 'hot:3'), ('views', 'v'), ('view total', '1')) t(what, list)")
def store_indexes(spark: SparkSession, d: str) -> DataFrame:
    """Indexes created, dropped, listed and suggested, and a view."""
    c = _new(spark).collection("i")
    c.insert({"_id": "1", "hot": 1})
    c.create_index("a")
    c.create_index("b", "c")
    c.create_index("gone")
    c.drop_index("gone")
    c.create_array_index("t")
    c.create_bloom_filter("e")
    for _ in range(3):
        c.count({"hot": 1})
    c.define_view("v", {"_version": 1})
    c.query_view("v")
    x = c.list_indexes()
    total = c.query_view("v").total
    rows = [("indexes", "|".join(",".join(f) for f in x["fields"])), ("arrays", ",".join(x["arrays"])), ("bloom", ",".join(x["bloom"])), ("suggested", ",".join(f"{s['field']}:{s['count']}" for s in c.suggest_indexes(3))), ("views", ",".join(c.list_views())), ("view total", str(total))]
    return spark.createDataFrame(rows, "what string, list string")


@_query("SELECT * FROM (VALUES ('places', 2, NULL, NULL), ('orders', 1, 'all orders', 2)) t(name, n, description, fields)")
def store_collections(spark: SparkSession, d: str) -> DataFrame:
    """Collections with their counts and what their schemas say."""
    db = _new(spark)
    db.persist_schema("orders", {"description": "all orders", "fields": {"a": {"type": "string"}, "b": {"type": "number"}}})
    db.collection("orders").insert({"a": "x", "b": 1})
    db.collection("places").insert_many([{"_id": "1"}, {"_id": "2"}])
    if db.stats() != {"collections": 2, "totalRecords": 3}:
        raise AssertionError(db.stats())
    rows = [(c["name"], c["recordCount"], c.get("schema", {}).get("description"), c.get("schema", {}).get("fieldCount")) for c in call(db, "db_collections")["result"]]
    return spark.createDataFrame(rows, "name string, n int, description string, fields int")


@_query("SELECT * FROM (VALUES ('live', 'b'), ('dropped', '1'), ('purged', '1'), ('after', '0')) t(what, list)")
def store_drop_purge(spark: SparkSession, d: str) -> DataFrame:
    """A collection put aside, then deleted for good."""
    db = _new(spark)
    for n in "ab":
        db.collection(n).insert({"_id": "1"})
    db.drop_collection("a")
    rows = [("live", ",".join(c["name"] for c in db.list_collections())), ("dropped", str(len(db.list_dropped()))), ("purged", str(db.purge_collection("a"))), ("after", str(len(db.list_dropped())))]
    return spark.createDataFrame(rows, "what string, list string")


@_query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'P') AS status_values, count(*) FILTER (o_totalprice < 50000) AS price_min, count(*) AS note_required, count(*) FILTER (length(o_orderpriority) > 5) AS priority_length FROM orders")
def store_diff_impact(spark: SparkSession, d: str) -> DataFrame:
    """How many records a stricter schema would concern."""
    db = _new(spark)
    db.persist_schema("o", {"fields": {"o_orderstatus": {"type": "enum", "values": ["F", "O", "P"]}, "o_totalprice": {"type": "number", "min": 0}, "o_orderpriority": {"type": "string"}}})
    Collection(spark, f"{db.root}/collections", "o").append(_order_docs(spark, d).drop("day", "o_custkey"))
    new = {"fields": {"o_orderstatus": {"type": "enum", "values": ["F", "O"]}, "o_totalprice": {"type": "number", "min": 50000}, "note": {"type": "string", "required": True}, "o_orderpriority": {"type": "string", "maxLength": 5}}}
    got = call(db, "db_diff_schema", {"collection": "o", "schema": new})["result"]["impact"]
    row = [got["total"], got["o_orderstatus.values"], got["o_totalprice.min"], got["note.required"], got["o_orderpriority.maxLength"]]
    return spark.createDataFrame([tuple(row)], "total long, status_values long, price_min long, note_required long, priority_length long")


@_query("SELECT * FROM (VALUES ('persisted', 'a:string:x,n:number:'), ('overlaid', 'a:string:y,n:number:'), ('merged', 'a:string:y,n:number:,z:date:'), ('files', 'f|f|bad.json'), ('deleted', 'true')) t(step, fields)")
def store_schemas(spark: SparkSession, d: str) -> DataFrame:
    """Schemas stored, laid over, merged with code, loaded from files and deleted."""
    db, out = _new(spark), []
    say = lambda step, s: out.append((step, ",".join(f"{n}:{f['type']}:{f.get('description', '')}" for n, f in sorted(s["fields"].items()))))
    say("persisted", db.persist_schema("s", {"fields": {"a": {"type": "string", "description": "x", "required": True, "resolve": F.lower}, "n": {"type": "number", "default": lambda: F.lit(1)}}}))
    say("overlaid", db.persist_schema("s", {"fields": {"a": {"type": "string", "description": "y", "required": False}}}))
    if "required" in db.load_schema("s")["fields"]["a"] or "resolve" in db.load_schema("s")["fields"]["a"]:
        raise AssertionError("overlay")
    merged, warnings = schemas.merge_schemas({"name": "s", "fields": {"z": {"type": "date"}, "n": {"type": "number"}}}, db.load_schema("s"))
    say("merged", merged)
    for n, t in (("f.json", '{"name":"f","fields":{"q":{"type":"string"}}}'), ("bad.json", '{"name":"g","fields":{"q":{"type":"nope"}}}')):
        db.files.write(f"schemas/{n}", t.encode())
    one, two = db.load_schemas(["schemas/f.json", "schemas/bad.json"]), db.load_schemas(["schemas/f.json"])
    out.append(("files", f"{','.join(one['loaded'])}|{','.join(two['skipped'])}|{','.join(x.rsplit('/', 1)[-1] for x in one['failed'])}"))
    out.append(("deleted", str(db.delete_schema("s") and db.load_schema("s") is None).lower()))
    return spark.createDataFrame(out, "step string, fields string")


@_query("SELECT least(count(*), 1000) AS n, true AS again FROM lineitem")
def store_sample(spark: SparkSession, d: str) -> DataFrame:
    """A uniform sample of fixed size, the same each time."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    a, b = schemas.sampled(rows, 1000, 3), schemas.sampled(rows.repartition(7), 1000, 3)
    return a.agg(F.count("*").alias("n")).withColumn("again", F.lit(a.exceptAll(b).isEmpty()))


@_query(
    """WITH e AS (SELECT * , lpad((row_number() OVER (ORDER BY entry_id, received_at, node))::VARCHAR, 16, '0') AS id FROM audit_log),
p AS (SELECT * FROM e WHERE id > '0000000000000500' ORDER BY id LIMIT 1000) SELECT count(*) AS n, min(id) AS first, max(id) AS last, count(agent_id) AS agents FROM p"""
)
def audit_pages(spark: SparkSession, d: str) -> DataFrame:
    """Two pages of the log after a cursor."""
    log = AuditLog(spark, scratch(spark, "audit"))
    rows = table(spark, d, "audit_log")
    log.append(rows.select(F.col("entry_ts").alias("ts"), "agent_id", F.col("rpc_method").alias("method"), "tool", "ip", "tenant_id", "metadata", F.col("event_kind").alias("event"), "entry_id", "received_at", "node").select("ts", "agent_id", "method", "tool", "ip", "tenant_id", "metadata", "event", "entry_id", "received_at", "node"), [F.col("entry_id"), F.col("received_at"), F.col("node")])
    one, cursor = log.query("0000000000000500", 500)
    two, _ = log.query(cursor, 500)
    return one.unionByName(two).agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.count("agent_id").alias("agents"))


@_query("SELECT * FROM (VALUES ('none', 'admin', true), ('reader', 'read', true), ('reader', 'write', false), ('writer', 'read', true), ('writer', 'admin', false), ('root', 'write', true), ('stranger', 'read', false)) t(who, level, may)")
def permissions(spark: SparkSession, d: str) -> DataFrame:
    """Levels that agents have."""
    rules = {"reader": {"read": True}, "writer": {"write": True}, "root": {"admin": True}}
    asked = [("none", "admin"), ("reader", "read"), ("reader", "write"), ("writer", "read"), ("writer", "admin"), ("root", "write"), ("stranger", "read")]
    return spark.createDataFrame([(w, level, allowed(None if w == "none" else rules, w, level)) for w, level in asked], "who string, level string, may boolean")


@_query("SELECT unnest([" + ", ".join(f"'{t}'" for t in TOOLS) + "]) AS tool, true AS answered")
def tools(spark: SparkSession, d: str) -> DataFrame:
    """Every tool called once with good arguments."""
    db = _new(spark, provider=HashProvider(8))
    at, c = scratch(spark, "tools"), {"collection": "t"}
    calls = [
        ("db_create", c), ("db_insert", c | {"records": [{"_id": x, "v": i, "s": f"hello {x}"} for i, x in enumerate("abcdef")]}), ("db_collections", {}), ("db_stats", {}), ("db_find", c | {"filter": {"v": {"$gt": 1}}, "summary": True, "maxTokens": 50}),
        ("db_find_one", c | {"id": "a"}), ("db_update", c | {"filter": {"_id": "a"}, "update": {"$set": {"v": 9}}, "expectedVersion": 1}), ("db_upsert", c | {"id": "g", "record": {"v": 1}}), ("db_count", c), ("db_history", c | {"id": "a"}), ("db_distinct", c | {"field": "v"}),
        ("db_batch", c | {"operations": [{"op": "insert", "record": {"_id": "h"}}, {"op": "delete", "id": "b"}, {"op": "update", "filter": {"_id": "c"}, "update": {"$inc": {"v": 1}}}]}), ("db_undo", c), ("db_schema", c), ("db_set_schema", c | {"schema": {"fields": {"v": {"type": "number"}}}}),
        ("db_get_schema", c), ("db_diff_schema", c | {"schema": {"fields": {"v": {"type": "number", "min": 3}}}}), ("db_infer_schema", c | {"sampleSize": 5}), ("db_delete_schema", c), ("db_migrate", c | {"ops": [{"op": "set", "field": "w", "value": 1}]}), ("db_archive", c | {"filter": {"_id": "c"}, "segment": "s"}),
        ("db_archive_list", c), ("db_archive_load", c | {"segment": "s"}), ("db_embed", c), ("db_semantic_search", c | {"query": "hello"}), ("db_vector_upsert", c | {"id": "z", "vector": [1.0] * 8}), ("db_vector_search", c | {"vector": [1.0] * 8}), ("db_bm25_search", c | {"query": "hello"}), ("db_reembed_all", c),
        ("db_hybrid_search", c | {"query": "hello"}), ("db_blob_write", c | {"id": "a", "name": "n", "content": "aGk="}), ("db_blob_read", c | {"id": "a", "name": "n"}), ("db_blob_list", c | {"id": "a"}), ("db_blob_delete", c | {"id": "a", "name": "n"}), ("db_export", {"path": at}), ("db_import", {"path": at, "overwrite": True}),
        ("db_subscribe", c | {"callback": print}), ("db_delete", c | {"id": "d"}),
    ]
    said = {name: call(db, name, args) for name, args in calls}
    said["db_unsubscribe"] = call(db, "db_unsubscribe", said["db_subscribe"]["result"])
    said["db_drop"] = call(db, "db_drop", c)
    said["db_purge"] = call(db, "db_purge", {"name": said["db_drop"]["result"]["dropped"]})
    wrong = {n: s["error"] for n, s in said.items() if "error" in s}
    if wrong:
        raise AssertionError(wrong)
    return spark.createDataFrame([(n, True) for n in said], "tool string, answered boolean")
