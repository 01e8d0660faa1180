"""Reciprocal rank fusion and hybrid search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import knn, text


def rrf(lists: list[DataFrame], k: float = 60, limit: int | None = None) -> DataFrame:
    """id, score: sum of 1 / (k + rank) over bounded lists (id, score), ranked by score, then id; an id twice in a list counts once, at its best.

    Each list is a search result with a limit of its own, so ranking it in one task is fine.
    """
    if k <= 0:
        raise ValueError("k must be above 0")
    ranked = []
    for x in lists:
        best = x.groupBy("id").agg(F.max("score").alias("score"))
        ranked.append(best.select("id", (1.0 / (k + F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")))).alias("part")))
    out = reduce(DataFrame.unionByName, ranked).groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "id")
    return out.limit(limit) if limit else out


def candidates(limit: int) -> int:
    """How many candidates a search takes before its filter."""
    return max(4 * limit, 50)


def hybrid(docs: DataFrame, doc_id: str, text_col: str, query: str, vectors: DataFrame, vec_id: str, vec: str, query_vector: list[float], limit: int = 10, k: float = 60) -> DataFrame:
    """id, score: BM25 and vector results fused. An arm without results is left out; a blank query has no text arm."""
    n = candidates(limit)
    words = text.bm25(docs, F.col(text_col), doc_id, query).orderBy(F.desc("score"), "id").limit(n)
    near = knn.nearest(vectors, vec, vec_id, query_vector, n).withColumnRenamed(vec_id, "id")
    return rrf([words, near], k, limit)
