"""Queries of the document engine and their SQL, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.filters import Compiler, TypedFields
from tessera.operators import find as finder
from tessera.operators import fusion, knn, oplog, reports, schema, text, updates
from tessera.operators.find import resolve
from tessera.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _filtered(name: str, tab: str, key: str, where, sql: str, prepare=None, **how) -> None:
    """A query of the keys that a filter matches."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, tab)
        df = prepare(df) if prepare else df
        return df.where(resolve(df, where, **how)).select(key)

    run.__name__, run.__doc__ = name, f"Keys of {tab} that match {where!r}."
    QUERIES[name], SQL[name] = run, f"SELECT {key} FROM {sql}"


_filtered("filter_eq", "orders", "o_orderkey", {"o_orderstatus": "F"}, "orders WHERE o_orderstatus = 'F'")
_filtered("filter_ne", "orders", "o_orderkey", {"o_orderpriority": {"$ne": "1-URGENT"}}, "orders WHERE o_orderpriority IS DISTINCT FROM '1-URGENT'")
_filtered("filter_range", "lineitem", "l_orderkey", {"l_quantity": {"$gte": 10, "$lt": 20}, "l_discount": {"$gt": 0.05}}, "lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount > 0.05")
_filtered("filter_in", "orders", "o_orderkey", {"o_orderpriority": {"$in": ["1-URGENT", "2-HIGH", 7, None]}}, "orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderpriority IS NULL")
_filtered("filter_nin", "documents", "doc_id", {"lang": {"$nin": ["en", "de"]}}, "documents WHERE lang NOT IN ('en', 'de') OR lang IS NULL")
_filtered("filter_contains_string", "part", "p_partkey", {"p_name": {"$contains": "re"}}, "part WHERE contains(p_name, 're')")
_filtered("filter_contains_array", "part", "p_partkey", {"tags": {"$contains": "red"}}, "part WHERE list_contains(string_split(p_name, ' '), 'red')", lambda df: df.withColumn("tags", F.split("p_name", " ")))
_filtered("filter_starts_ends", "part", "p_partkey", {"p_type": {"$startsWith": "S"}, "p_brand": {"$endsWith": "3"}}, "part WHERE starts_with(p_type, 'S') AND ends_with(p_brand, '3')")
_filtered("filter_regex", "customer", "c_custkey", {"c_name": {"$regex": "[02468]$"}}, "customer WHERE regexp_matches(c_name, '[02468]$')")
_filtered("filter_strlen", "documents", "doc_id", {"title": {"$strLen": {"$gt": 15}}}, "documents WHERE length(title) + len(regexp_extract_all(title, '[\\x{10000}-\\x{10FFFF}]')) > 15")
_filtered("filter_exists", "documents", "doc_id", {"text": {"$exists": True}, "title": {"$exists": False}}, "documents WHERE text IS NOT NULL AND title IS NULL")
_filtered("filter_and_or_not", "orders", "o_orderkey", {"$or": [{"o_orderstatus": "F"}, {"o_totalprice": {"$gt": 200000}}], "$not": {"o_orderpriority": "5-LOW"}}, "orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT coalesce(o_orderpriority = '5-LOW', false)")
_filtered("filter_field_not", "documents", "doc_id", {"lang": {"$not": {"$startsWith": "e"}}}, "documents WHERE NOT coalesce(starts_with(lang, 'e'), false)")
_filtered("filter_mixed_compare", "part", "p_partkey", {"p_size": {"$gt": "20"}}, "part WHERE p_size > 20")
_filtered("filter_time", "orders", "o_orderkey", {"o_orderdate": {"$gte": "1995-01-01", "$lt": "1996-01-01"}}, "orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
_filtered("filter_variant", "events", "event_id", {"doc.k": {"$gt": 50}}, "events WHERE TRY_CAST(props ->> '$.k' AS DOUBLE) > 50", lambda df: df.withColumn("doc", F.parse_json(F.concat(F.lit('{"doc":'), "props", F.lit("}")))), variant="doc")
_filtered("compact_query", "orders", "o_orderkey", "o_orderstatus:F (o_totalprice.gt:100000 or o_orderpriority.starts:1)", "orders WHERE o_orderstatus = 'F' AND (o_totalprice > 100000 OR starts_with(o_orderpriority, '1'))")
_filtered("compact_tags", "part", "p_partkey", "+red -blue", "part WHERE list_contains(string_split(p_name, ' '), 'red') AND NOT list_contains(string_split(p_name, ' '), 'blue')", lambda df: df.withColumn("tags", F.split("p_name", " ")))
_TAGS = lambda df: df.withColumn("tags", F.split("p_name", " "))
_filtered("filter_array_equal", "part", "p_partkey", {"tags": ["red", "blue"]}, "part WHERE string_split(p_name, ' ') = ['red', 'blue']", _TAGS)
_filtered("filter_object_equal", "part", "p_partkey", {"p_name": {"a": 1}}, "part WHERE false")
_filtered("compact_strlen", "part", "p_partkey", "p_name.strLen.gt:8 p_brand.strLen:8", "part WHERE length(p_name) > 8 AND length(p_brand) = 8")
_filtered("compact_in", "orders", "o_orderkey", "o_orderpriority.in:1-URGENT,2-HIGH o_orderstatus.nin:F,P", "orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND (o_orderstatus NOT IN ('F', 'P') OR o_orderstatus IS NULL)")
_filtered("compact_exists", "documents", "doc_id", "title.exists:false or lang.exists:true", "documents WHERE title IS NULL OR lang IS NOT NULL")
_filtered("compact_quotes", "part", "p_partkey", """"p_name:red blue" or 'p_type:ECONOMY'""", "part WHERE p_name = 'red blue' OR p_type = 'ECONOMY'")
_filtered("compact_words", "orders", "o_orderkey", "(o_orderstatus.is:F or o_orderstatus.equals:P) and o_totalprice.above:50000 o_totalprice.under:90000 o_orderpriority.right:H", "orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice > 50000 AND o_totalprice < 90000 AND ends_with(o_orderpriority, 'H')")
_filtered("virtual_filter", "lineitem", "l_orderkey", {"+bulk": True, "l_returnflag": "R"}, "lineitem WHERE l_quantity * l_extendedprice > 1000000 AND l_returnflag = 'R'", virtual={"bulk": lambda _: F.col("l_quantity") * F.col("l_extendedprice") > 1_000_000})


_WRONG = ({"a": {"$nope": 1}}, {"$nope": []}, ["a"], {"a": {"$in": 1}}, {"a": {"$startsWith": 1}}, {"a": {"$exists": 1}}, {"a": {"$regex": "(a+)+"}}, {"a": {"$not": 1}}, {"$and": {}}, {"$not": 1}, "a:1 (", "and")


@_query(f"SELECT unnest(range({len(_WRONG)}))::INT AS filter, true AS refused")
def filter_errors(spark: SparkSession, d: str) -> DataFrame:
    """Filters that are refused when they are compiled."""
    df, out = table(spark, d, "region"), []
    for i, f in enumerate(_WRONG):
        try:
            resolve(df, f, searchable=F.col("r_name"))
            out.append((i, False))
        except ValueError:
            out.append((i, True))
    return spark.createDataFrame(out, "filter int, refused boolean")


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def find_sort_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten dearest finished orders."""
    df = table(spark, d, "orders")
    return finder.find(df, {"o_orderstatus": "F", "o_totalprice": {"$gt": 100000}}, sort="-o_totalprice", limit=10, key="o_orderkey").records.select("o_orderkey", "o_totalprice")


@_query("SELECT c_custkey FROM customer ORDER BY c_acctbal ASC NULLS LAST, c_custkey LIMIT 25 OFFSET 50")
def find_page(spark: SparkSession, d: str) -> DataFrame:
    """A page from the middle."""
    return finder.find(table(spark, d, "customer"), None, sort="c_acctbal", limit=25, offset=50, key="c_custkey").records.select("c_custkey")


@_query("SELECT doc_id FROM documents ORDER BY title DESC NULLS LAST, doc_id LIMIT 100")
def find_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    """Nulls last in descending order too."""
    return finder.find(table(spark, d, "documents"), None, sort="-title", limit=100, key="doc_id").records.select("doc_id")


@_query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text END AS text, source FROM documents ORDER BY doc_id LIMIT 500")
def find_summary(spark: SparkSession, d: str) -> DataFrame:
    """Long texts left out of a page."""
    return finder.find(table(spark, d, "documents").select("doc_id", "text", "source"), limit=500, summary=True, key="doc_id").records


@_query(
    """WITH p AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 1000),
t AS (SELECT *, CAST(ceil((2 + 14 + length(o_orderkey::VARCHAR) + 17 + length(o_orderstatus) + 2 + 19 + length(o_orderpriority) + 2) / 4.0) AS BIGINT) AS tok FROM p)
SELECT o_orderkey FROM (SELECT *, sum(tok) OVER (ORDER BY o_orderkey) AS s, row_number() OVER (ORDER BY o_orderkey) AS n FROM t) WHERE s <= 2000 OR n = 1"""
)
def find_token_budget(spark: SparkSession, d: str) -> DataFrame:
    """As many records as fit in 2000 tokens."""
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return finder.find(df, limit=1000, max_tokens=2000, key="o_orderkey").records.select("o_orderkey")


@_query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate > TIMESTAMP '1995-06-01'")
def count_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Filtered count."""
    return finder.count(table(spark, d, "lineitem"), {"l_returnflag": "R", "l_shipdate": {"$gt": "1995-06-01"}})


@_query("SELECT DISTINCT c_mktsegment AS value FROM customer")
def distinct_field(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values."""
    return finder.distinct(table(spark, d, "customer"), "c_mktsegment")


@_query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'documents', count(*) FROM documents")
def stats_collections(spark: SparkSession, d: str) -> DataFrame:
    """Records of several tables."""
    return reports.table_counts({t: table(spark, d, t) for t in ("orders", "customer", "documents")})


@_query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def count_by_status(spark: SparkSession, d: str) -> DataFrame:
    """Breakdown by status."""
    return reports.breakdown(table(spark, d, "orders"), F.col("o_orderstatus").alias("status"))


@_query("SELECT count(DISTINCT coalesce(lang, 'null')) AS lang, count(DISTINCT coalesce(source, 'null')) AS source, count(DISTINCT coalesce(coll, 'null')) AS coll FROM documents")
def column_cardinality(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values of columns, null as one."""
    return reports.cardinality(table(spark, d, "documents"), ["lang", "source", "coll"])


_TERMS = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+')"


@_query(f"SELECT doc_id FROM documents WHERE list_has_all({_TERMS}, ['retry', 'budget', 'shared'])")
def text_and(spark: SparkSession, d: str) -> DataFrame:
    """Documents with all terms."""
    docs = table(spark, d, "documents")
    return docs.where(text.and_search(docs, F.col("text"), "Shared retry BUDGET")).select("doc_id")


@_query(f"SELECT doc_id FROM documents WHERE list_has_all({_TERMS}, ['retry', 'budget']) AND lang = 'en'")
def text_filter(spark: SparkSession, d: str) -> DataFrame:
    """Text search and a field in one compact filter."""
    docs = table(spark, d, "documents")
    return docs.where(resolve(docs, "retry budget lang:en", searchable=F.col("text"))).select("doc_id")


_BM25 = f"""
WITH t AS (SELECT doc_id AS id, lang, coalesce({_TERMS}, []) AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
p AS (SELECT id, len(w) AS dl, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM t) WHERE term IN ('overdue', 'retry', 'budget', 'legacy') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
b AS (SELECT id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM p JOIN df USING (term), s GROUP BY id)
"""


@_query(_BM25 + "SELECT id, round(score, 6) AS score FROM b")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all documents with a term."""
    found = text.bm25(table(spark, d, "documents", spread=True), F.col("text"), "doc_id", "overdue retry budget legacy retry")
    return found.select("id", F.round("score", 6).alias("score"))


@_query(_BM25 + ", c AS (SELECT * FROM b ORDER BY score DESC, id LIMIT 50) SELECT c.id, round(score, 6) AS score FROM c JOIN t USING (id) WHERE lang = 'en' ORDER BY score DESC, c.id LIMIT 10")
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by score, then the filter, then the limit."""
    docs = table(spark, d, "documents", spread=True)
    best = text.bm25(docs, F.col("text"), "doc_id", "overdue retry budget legacy").orderBy(F.desc("score"), "id").limit(fusion.candidates(10))
    rows = docs.where(resolve(docs, {"lang": "en"})).join(F.broadcast(best), F.col("doc_id") == F.col("id"))  # 50 candidates
    return rows.orderBy(F.desc("score"), "id").limit(10).select("id", F.round("score", 6).alias("score"))


@_query(f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY term")
def text_postings(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies of all terms."""
    p = text.postings(table(spark, d, "documents", spread=True), F.col("text"), "doc_id")
    return p.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


_Q = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_QSQL = "[" + ", ".join(map(str, _Q)) + "]::DOUBLE[]"
_NEAR = f"SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {_QSQL}) AS score FROM embeddings"


@_query(f"SELECT vec_id, round(score, 6) AS score FROM ({_NEAR}) ORDER BY score DESC, vec_id LIMIT 20")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The vectors nearest to one."""
    return knn.nearest(table(spark, d, "embeddings"), "embedding", "vec_id", _Q, 20).select("vec_id", F.round("score", 6).alias("score"))


@_query(f"SELECT c.vec_id FROM (SELECT * FROM ({_NEAR}) ORDER BY score DESC, vec_id LIMIT 50) c JOIN embeddings e USING (vec_id) WHERE label < 3 ORDER BY score DESC, c.vec_id LIMIT 10")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Candidates, then a filter on their labels."""
    rows = table(spark, d, "embeddings")
    best = knn.nearest(rows, "embedding", "vec_id", _Q, fusion.candidates(10))
    kept = rows.where(resolve(rows, {"label": {"$lt": 3}})).select("vec_id").join(F.broadcast(best), "vec_id")  # 50 candidates
    return kept.orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id")


@_query(
    """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v, 127.0 / list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS s FROM embeddings)
SELECT vec_id, CAST(list_sum(list_transform(v, lambda x: floor(x * s + 0.5))) AS BIGINT) AS total, round(s, 6) AS scale FROM s"""
)
def vector_quantize(spark: SparkSession, d: str) -> DataFrame:
    """Sum of the quantised values and the scale of every vector."""
    q = table(spark, d, "embeddings").select("vec_id", knn.quantize(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.aggregate("q.data", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.round("q.scale", 6).alias("scale"))


_RRF = """, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM b QUALIFY r <= 50),
v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM (""" + _NEAR + """) QUALIFY r <= 50)
SELECT id, round(sum(1.0 / (60 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM v) GROUP BY id ORDER BY sum(1.0 / (60 + r)) DESC, id LIMIT 10"""


@_query(_BM25 + _RRF)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Text and vector results fused by reciprocal ranks."""
    out = fusion.hybrid(table(spark, d, "documents", spread=True), "doc_id", "text", "overdue retry budget legacy", table(spark, d, "embeddings"), "vec_id", "embedding", _Q)
    return out.select("id", F.round("score", 9).alias("score"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    return ev.select(F.col("user_id").alias("_id"), F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_type") == "refund", "delete").otherwise("set").alias("op"), "event_id", "value")


_OPSQL = "WITH o AS (SELECT user_id AS _id, ts, event_id, value, CASE WHEN event_type = 'refund' THEN 'delete' ELSE 'set' END AS op FROM events)"


@_query(_OPSQL + " SELECT _id, event_id, value FROM o WHERE _id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY _id ORDER BY ts DESC, event_id DESC) = 1 AND op = 'set'")
def oplog_state(spark: SparkSession, d: str) -> DataFrame:
    """State of a log: the last operation of each key, if it sets it."""
    return oplog.state(_log(spark, d)).select("_id", "event_id", "value")


@_query(
    _OPSQL
    + """, l AS (SELECT *, sum((op = 'delete')::INT) OVER (PARTITION BY _id ORDER BY ts, event_id) AS life FROM o)
SELECT event_id, CAST(sum((op = 'set')::INT) OVER (PARTITION BY _id, life ORDER BY ts, event_id) AS BIGINT) AS version FROM l"""
)
def oplog_versions(spark: SparkSession, d: str) -> DataFrame:
    """Version of the record after every operation."""
    return oplog.versions(_log(spark, d)).select("event_id", F.col("_version").alias("version"))


@_query(_OPSQL + ", u AS (SELECT * FROM o WHERE (ts, event_id) < (SELECT max((ts, event_id)) FROM o)) SELECT _id, event_id FROM u QUALIFY row_number() OVER (PARTITION BY _id ORDER BY ts DESC, event_id DESC) = 1 AND op = 'set'")
def oplog_undo(spark: SparkSession, d: str) -> DataFrame:
    """State without the last operation."""
    return oplog.state(oplog.undone(_log(spark, d))).select("_id", "event_id")


@_query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' OR ts IS NULL")
def ttl_live(spark: SparkSession, d: str) -> DataFrame:
    """Records that live five days, on the 15th."""
    ev = table(spark, d, "events").withColumn("_expires", F.unix_millis(F.col("ts").cast("timestamp")) + 5 * 86_400_000)
    return finder.live(ev, F.unix_millis(F.lit("2024-01-15").cast("timestamp"))).select("event_id")


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Rows replaced by others with their key."""
    base = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return oplog.merge(base, base.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")), "o_orderkey")


@_query("SELECT action, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'updated' ELSE 'inserted' END AS action FROM orders) GROUP BY action")
def upsert_actions(spark: SparkSession, d: str) -> DataFrame:
    """Inserted and updated rows of an upsert."""
    all_ = table(spark, d, "orders").select("o_orderkey")
    return oplog.upsert_actions(all_.where("o_orderkey % 2 = 0"), all_, "o_orderkey").groupBy("action").agg(F.count("*").alias("n"))


@_query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE p_brand END AS p_brand, CASE WHEN p_size > 25 THEN p_size + 5 ELSE p_size END AS p_size FROM part")
def update_set_inc(spark: SparkSession, d: str) -> DataFrame:
    """$set and $inc where a filter matches."""
    df = table(spark, d, "part")
    hit = Compiler(TypedFields(df)).compile({"p_size": {"$gt": 25}})
    return updates.apply_update(df, {"$set": {"p_brand": "big"}, "$inc": {"p_size": 5}}, hit).select("p_partkey", "p_brand", "p_size")


@_query("SELECT count(*) AS scanned, count(*) FILTER (p_name IS NOT NULL OR p_size IS NOT NULL) AS changed, count(*) FILTER (p_name IS NULL AND p_size IS NULL) AS unchanged FROM part")
def migrate_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records that a rename and a copy change."""
    df = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return updates.migrate(df, [{"op": "rename", "from": "p_name", "to": "title"}, {"op": "copy", "from": "p_size", "to": "size"}], "p_partkey")[1]


@_query("SELECT count(*) AS total, count(*) FILTER (length(text) > 1000) AS too_long, count(*) FILTER (title IS NULL) AS without_title, count(*) FILTER (lang NOT IN ('en', 'de')) AS other_lang FROM documents")
def diff_impact(spark: SparkSession, d: str) -> DataFrame:
    """Records that a stricter schema would reject, in one pass."""
    return schema.impact(table(spark, d, "documents"), {"too_long": F.length("text") > 1000, "without_title": F.col("title").isNull(), "other_lang": ~F.col("lang").isin("en", "de")})


@_query("SELECT o_orderkey, list_filter([CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus: not one of its values' END, CASE WHEN o_totalprice > 300000 THEN 'o_totalprice: above max' END], lambda x: x IS NOT NULL)[1] AS first_violation FROM orders")
def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    """First rule that each record breaks."""
    df = table(spark, d, "orders")
    rules = {"fields": {"o_orderstatus": {"type": "enum", "values": ["F", "O"]}, "o_totalprice": {"type": "number", "max": 300000}}}
    return df.select("o_orderkey", F.get(schema.violations(df, rules), 0).alias("first_violation"))


_KEYS = """WITH k AS (SELECT unnest(json_keys(doc)) AS field, doc FROM stored_records WHERE doc IS NOT NULL AND json_valid(doc)),
v AS (SELECT field, json_type(doc, '$."' || field || '"') AS kind, doc ->> ('$."' || field || '"') AS txt FROM k)"""


@_query(
    _KEYS
    + """SELECT field, count(*) AS present, CAST(count(DISTINCT CASE WHEN kind = 'VARCHAR' THEN txt END) AS BIGINT) AS distinct_values, max(CASE WHEN kind = 'VARCHAR' THEN length(txt) END) AS max_length,
count(*) >= 0.95 * (SELECT count(*) FROM stored_records WHERE doc IS NOT NULL AND json_valid(doc)) AS required FROM v WHERE kind <> 'NULL' GROUP BY field"""
)
def infer_schema(spark: SparkSession, d: str) -> DataFrame:
    """Fields of all stored documents with their inferred statistics."""
    return schema.infer(table(spark, d, "stored_records"), "doc").select("field", "present", "distinct_values", "max_length", "required")


@_query(
    _KEYS
    + r""", b AS (SELECT field, txt, CASE WHEN kind = 'BOOLEAN' THEN 'boolean' WHEN kind IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'number' WHEN kind = 'VARCHAR' THEN 'string' WHEN kind = 'OBJECT' THEN 'object'
  WHEN kind = 'ARRAY' AND len(list_filter(json_extract(txt, '$[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0 THEN 'string[]'
  WHEN kind = 'ARRAY' AND len(list_filter(json_extract(txt, '$[*]'), lambda x: json_type(x) NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE'))) = 0 THEN 'number[]' ELSE 'other' END AS bucket FROM v WHERE kind <> 'NULL')
SELECT field, CASE WHEN count(DISTINCT bucket) > 1 THEN NULL WHEN any_value(bucket) <> 'string' THEN any_value(bucket)
  WHEN bool_and(regexp_matches(txt, '^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?$')) THEN 'date' WHEN count(DISTINCT txt) <= 10 THEN 'enum' ELSE 'string' END AS type FROM b GROUP BY field"""
)
def infer_types(spark: SparkSession, d: str) -> DataFrame:
    """Inferred type of each field."""
    return schema.infer(table(spark, d, "stored_records"), "doc").select("field", "type")


@_query("SELECT source, count(*) AS n, CAST(sum(CAST(ceil(greatest(length(text) - 50, 1) / 450.0) AS BIGINT)) AS BIGINT) AS chunks FROM documents WHERE length(text) > 0 GROUP BY source")
def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 500 characters with an overlap of 50, by source."""
    docs = table(spark, d, "documents").where(F.length("text") > 0)
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.size(reports.chunks(F.col("text")))).alias("chunks"))


@_query(_OPSQL + " SELECT _id, event_id, value FROM o WHERE _id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY _id ORDER BY ts DESC, event_id DESC) = 1 AND op = 'set'")
def stream_log_state(spark: SparkSession, d: str) -> DataFrame:
    """The state of the event log kept by a stream that reads what is new and stops."""
    from tessera.session import scratch
    from tessera.streaming.features import stream_of

    at = scratch(spark, "tail")
    log = stream_of(spark, f"{d}/events.parquet").select(F.col("user_id").alias("_id"), "ts", "event_id", "event_type", "value")
    q = log.writeStream.format("parquet").option("path", f"{at}/ops").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    ops = spark.read.parquet(f"{at}/ops").select("_id", F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_type") == "refund", "delete").otherwise("set").alias("op"), "event_id", "value")
    return oplog.state(ops).select("_id", "event_id", "value")
