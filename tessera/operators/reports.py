"""Counts over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def breakdown(df: DataFrame, by: Column) -> DataFrame:
    """The rows of every value: the column and ``n``; null is one."""
    return df.groupBy(by).agg(F.count("*").alias("n"))


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the number of distinct values of each column; with a null, "null" is one. Values are made distinct before they meet."""
    one = lambda c: df.select(F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("v")).distinct().agg(F.count("*").alias(c))
    return reduce(DataFrame.crossJoin, map(one, columns))  # a row each


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of several tables."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in tables.items()))


def chunks(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Pieces of a text of ``size`` characters, each beginning ``overlap`` before the last one's end; none of an empty or null text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - overlap, F.lit(1)), F.lit(size - overlap))
    return F.when(F.length(text) > 0, F.transform(starts, lambda s: F.substr(text, s, F.lit(size)))).otherwise(F.array().cast("array<string>"))
