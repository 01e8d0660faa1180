"""Queries of the problems on texts, vectors and rankings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import encode, leakage, ranking, truncation, vectors
from tessera.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs in which one vector is among the 5 most similar of the other."""
    return vectors.neighbour_pairs(vectors.neighbours(vectors.vectors_of(table(spark, d, "record_vectors", spread=True)), 5))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The first three items of every query's one ranking."""
    return ranking.top(ranking.fuse(table(spark, d, "ranked_items")), 3).select("query_id", "item_id")


def p5_closeness(spark: SparkSession, d: str) -> DataFrame:
    """Relative closeness of every item, rounded to 6 decimals."""
    return ranking.fuse(table(spark, d, "ranked_items")).select("query_id", "item_id", F.round("closeness", 6).alias("closeness"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encode_corpus(table(spark, d, "documents", spread=True).select("doc_id", "text")).select("doc_id", "ids")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold evaluation passages, and the items they leak."""
    return leakage.leaks(table(spark, d, "documents", spread=True), table(spark, d, "eval_items")).where("kind = 'copy'").select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents that hold them, of those that hold the answer too, and of those that paraphrase them."""
    rows = leakage.leaks(table(spark, d, "documents", spread=True), table(spark, d, "eval_items"))
    copy = F.col("kind") == "copy"
    return rows.groupBy("item_id").agg(F.count_if(copy).alias("n_docs"), F.count_if(copy & F.col("answer_too")).alias("n_with_answer"), F.count_if(~copy).alias("n_paraphrased"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text was cut."""
    return truncation.truncated(table(spark, d, "documents", spread=True)).where("cut").select("doc_id")


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut documents of every source."""
    return truncation.share_by_source(table(spark, d, "documents", spread=True), F.col("source"))


_FUSED = """
WITH b AS (
  SELECT query_id, list_name, item_id, max(CASE WHEN list_name = 'distance' THEN -score ELSE score END) AS s
  FROM ranked_items WHERE query_id IS NOT NULL AND list_name IS NOT NULL AND item_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, list_name ORDER BY s) AS n, count(*) OVER (PARTITION BY query_id, list_name) AS m FROM b),
l AS (SELECT query_id, list_name, max(s) FILTER (n = ceil(0.05 * m)) AS lo, max(s) FILTER (n = ceil(0.9 * m)) AS hi, max(s) AS mx FROM r GROUP BY ALL),
q AS (SELECT query_id, count(*) AS k FROM l GROUP BY query_id),
v AS (SELECT b.*, k, CASE WHEN hi > lo THEN least(1, greatest(0, (s - lo) / (hi - lo))) ELSE 1 END AS v, CASE WHEN mx > lo THEN least(1, greatest(0, (s - lo) / (mx - lo))) ELSE 1 END AS u
  FROM b JOIN l USING (query_id, list_name) JOIN q USING (query_id)),
d AS (SELECT query_id, item_id, sqrt(sum((1 - v) * (1 - v)) + any_value(k) - count(*)) AS i, sqrt(sum(v * v)) AS a, sum(u) / any_value(k) AS u FROM v GROUP BY ALL),
c AS (SELECT query_id, item_id, round(CASE WHEN i + a > 0 THEN a / (i + a) ELSE 1 END, 12) AS closeness, round(u, 12) AS u FROM d)
"""

_VECTORS = """
WITH r AS (SELECT vec_id, coalesce(vec::DOUBLE[], embedding::DOUBLE[]) AS v FROM record_vectors WHERE vec_id IS NOT NULL),
v AS (SELECT DISTINCT vec_id, v FROM r WHERE len(v) = 96 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id, b.vec_id AS near_id, round(list_cosine_similarity(a.v, b.v), 9) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id),
n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, near_id) <= 5)
SELECT DISTINCT least(vec_id, near_id) AS vec_id, greatest(vec_id, near_id) AS near_id FROM n
"""

SQL = {
    "p4_found": _VECTORS,
    "p5_found": _FUSED + "SELECT query_id, item_id FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY closeness DESC, u DESC, item_id) <= 3",
    "p5_closeness": _FUSED + "SELECT query_id, item_id, round(closeness, 6) AS closeness FROM c",
}

QUERIES = {f.__name__: f for f in (p4_found, p5_found, p5_closeness, p8_ids, p9_found, p9_items, p10_found, p10_sources)}
