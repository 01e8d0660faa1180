"""Full-text search: postings, AND search, BM25."""

from __future__ import annotations

from functools import reduce

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the ranking.
K1, B = 1.2, 0.75
TERM = r"([\p{L}\p{M}\p{N}]+)"


def terms(text: Column) -> Column:
    """Runs of letters, marks and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(1))


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query."""
    return sorted(set(regex.findall(TERM, query.lower())))


def lengths(docs: DataFrame, text: Column, doc_id: str) -> DataFrame:
    """id, dl: number of terms of every document, 0 for null and empty ones."""
    return docs.select(F.col(doc_id).alias("id"), F.coalesce(F.size(terms(text)), F.lit(0)).alias("dl")).withColumn("dl", F.greatest("dl", F.lit(0)))


def postings(docs: DataFrame, text: Column, doc_id: str, only: list[str] | None = None) -> DataFrame:
    """id, term, tf, dl. With ``only``, just these terms are kept, before anything is shuffled."""
    t = terms(text)
    rows = docs.select(F.col(doc_id).alias("id"), t.alias("t")).withColumn("dl", F.size("t"))
    if only is not None:
        rows = rows.withColumn("t", F.filter("t", lambda x: x.isin(only)))
    return rows.select("id", "dl", F.explode("t").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def and_search(docs: DataFrame, text: Column, query: str) -> Column | None:
    """Predicate of documents with every term of the query; None where the query has no term (nothing matches)."""
    q = query_terms(query)
    if not q:
        return None
    # texts without a term's letters are told by a plain search, before any is taken apart
    letters = reduce(Column.__and__, (F.lower(text).contains(w) for w in q))
    return letters & (F.size(F.array_except(F.array(*map(F.lit, q)), terms(text))) == 0)


def score(n: Column, avgdl: Column, df: Column, tf: Column, dl: Column) -> Column:
    """Part of a document's score that one term gives."""
    return F.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25_of_postings(found: DataFrame, n: int, total: int) -> DataFrame:
    """id, score from the postings (id, term, tf, dl) of a query's terms, the number of all documents and the sum of their lengths."""
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    rows = found.join(F.broadcast(df), "term")  # a row per term of the query
    part = score(F.lit(n), F.lit(total / max(n, 1)), F.col("df"), F.col("tf"), F.col("dl"))
    return rows.groupBy("id").agg(F.sum(part).alias("score"))


def bm25(docs: DataFrame, text: Column, doc_id: str, query: str) -> DataFrame:
    """id, score of documents with at least one term. Every document, also an empty one, counts for the mean length and the term weights.

    One narrow pass finds the query's terms in each document; only their counts are aggregated. No document or no term: no rows.
    """
    q = query_terms(query)
    if not q:
        return docs.select(F.col(doc_id).alias("id"), F.lit(0.0).alias("score")).where("false")

    def counted(some: DataFrame) -> DataFrame:
        rows = some.select(F.col(doc_id).alias("id"), F.coalesce(terms(text), F.array().cast("array<string>")).alias("t"))
        return rows.select("id", F.size("t").alias("dl"), *((F.size("t") - F.size(F.array_remove("t", w))).alias(f"tf{i}") for i, w in enumerate(q)))

    split = docs.select(F.coalesce(terms(text), F.array().cast("array<string>")).alias("t"))
    stats = split.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"), *(F.count_if(F.array_contains("t", w)).alias(f"df{i}") for i, w in enumerate(q)))
    # a filter on the text, not on the counts: that one would be pushed below them and repeat them
    part = r"[\p{L}\p{M}\p{N}]"
    letters = reduce(Column.__or__, (F.lower(text).contains(w) for w in q))
    hits = docs.where(letters & F.lower(text).rlike(f"(?<!{part})(?:{'|'.join(q)})(?!{part})"))
    scored = counted(hits).crossJoin(F.broadcast(stats))  # one row of totals
    parts = []
    for i in range(len(q)):
        part_score = score(F.col("n"), F.col("avgdl"), F.col(f"df{i}"), F.col(f"tf{i}"), F.col("dl"))
        parts.append(F.when(F.col(f"tf{i}") > 0, part_score).otherwise(F.lit(0.0)))
    return scored.select("id", sum(parts[1:], parts[0]).alias("score"))
