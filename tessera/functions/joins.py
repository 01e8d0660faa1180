"""Joins that stay balanced and bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side with at most so many rows and bytes (as JSON text) is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 48_000_000


def small_enough(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table has so few rows and bytes; reads at most ``max_rows`` + 1 rows."""
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))), F.lit(0))
    got = df.limit(max_rows + 1).agg(F.count("*").alias("n"), size.alias("b")).collect()[0]
    return got["n"] <= max_rows and got["b"] <= max_bytes


def lookup(big: DataFrame, small: DataFrame, key: str | list[str], max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Left join on ``key`` with a table of one row per key, where few keys may hold most rows of ``big``.

    The small side is measured: broadcast if it is that small. Else both sides are shuffled by the key and sorted; adaptive execution, which is switched
    on, then splits the partitions of hot keys, which a left join with one row per key allows. A null key matches nothing and is kept.
    """
    if small_enough(small, max_rows, max_bytes):
        return big.join(F.broadcast(small), key, "left")
    big.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    big.sparkSession.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return big.join(small.hint("merge"), key, "left")
