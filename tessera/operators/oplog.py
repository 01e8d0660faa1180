"""An append-only log of operations and the state it stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def state(ops: DataFrame, key: str = "_id", seq: str = "seq", op: str = "op", keep_deleted: bool = False) -> DataFrame:
    """The last operation of every key by sequence number, if it sets a record (or always). Partial maxima: a key with any share of the log is no burden."""
    rest = [c for c in ops.columns if c not in (key, op)]
    last = ops.groupBy(key).agg(F.max_by(op, seq).alias(op), *(F.max_by(c, seq).alias(c) for c in rest))
    return (last if keep_deleted else last.where(F.col(op) == "set")).select(*ops.columns)


def versions(ops: DataFrame, key: str = "_id", seq: str = "seq", op: str = "op") -> DataFrame:
    """The log with _version: the number of sets of the key since it was last deleted, up to the operation."""
    by = Window.partitionBy(key).orderBy(seq)
    life = F.sum(F.when(F.col(op) == "delete", 1).otherwise(0)).over(by)
    rows = ops.withColumn("_life", life)
    return rows.withColumn("_version", F.sum(F.when(F.col(op) == "set", 1).otherwise(0)).over(Window.partitionBy(key, "_life").orderBy(seq)).cast("long")).drop("_life")


def history(ops: DataFrame, record: str, key: str = "_id", seq: str = "seq") -> DataFrame:
    """All operations on one record in order."""
    return ops.where(F.col(key) == record).orderBy(seq)


def since(ops: DataFrame, at: Column, ts: str = "ts") -> DataFrame:
    """Operations after a time."""
    return ops.where(F.col(ts) > at)


def undone(ops: DataFrame, seq: str = "seq") -> DataFrame:
    """The log without its last commit: all operations of the highest sequence number."""
    last = ops.agg(F.max(seq).alias("_last"))
    return ops.join(F.broadcast(last), F.col(seq) < F.col("_last")).drop("_last")  # one row


def merge(base: DataFrame, delta: DataFrame, key: str = "_id") -> DataFrame:
    """Base rows replaced by delta rows of the same key, and new ones added. One row per key on either side."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta.select(*base.columns))


def upsert_actions(base: DataFrame, delta: DataFrame, key: str = "_id") -> DataFrame:
    """key, action: whether each delta row is inserted or updates one."""
    known = base.select(key).distinct().withColumn("_known", F.lit(True))
    return delta.select(key).join(known, key, "left").select(key, F.when(F.col("_known"), "updated").otherwise("inserted").alias("action"))
