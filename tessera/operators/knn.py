"""Vectors: cosine, quantisation, exact search for one query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a length is 0 or a vector empty; an error where the numbers of dimensions differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("Vector dimension mismatch")).cast("double"))
    return checked.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def scale_of(v: Column) -> Column:
    """127 over the largest absolute value; 1 for vectors of zeros."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.when(top > 0, 127.0 / top).otherwise(F.lit(1.0))


def quantize(v: Column) -> Column:
    """(data, scale): values times scale, rounded half up, as int8."""
    s = scale_of(v)
    return F.struct(F.transform(v, lambda x: F.floor(x.cast("double") * s + 0.5).cast("tinyint")).alias("data"), s.alias("scale"))


def dequantize(q: Column) -> Column:
    """Values of a quantised vector."""
    return F.transform(q["data"], lambda x: x.cast("double") / q["scale"])


def nearest(rows: DataFrame, vec: str, key: str, query: list[float], k: int) -> DataFrame:
    """The k rows most similar to one query vector: key, score; equal scores by key. One scan and a top-k, no shuffle."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.where(F.col(vec).isNotNull()).select(F.col(key), cosine(F.col(vec), q).alias("score")).orderBy(F.desc("score"), key).limit(k)
