"""The change feed of a collection as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tessera.collection import _OPS, Collection


def operations(c: Collection) -> DataFrame:
    """A stream of the operations of every commit."""
    return c.spark.readStream.schema(_OPS).option("recursiveFileLookup", "true").parquet(f"{c.files.root}/ops")


def tail(c: Collection, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Hand over the operations since the last call with this checkpoint, then return."""
    q = operations(c).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def watch(c: Collection, checkpoint: str, handle: Callable[[DataFrame, int], None], every: str = "1 second") -> StreamingQuery:
    """Hand over operations as they come, until the query is stopped."""
    return operations(c).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def change_events(ops: DataFrame, collection: str) -> DataFrame:
    """event, collection, type, ids, agent, seq: one event per commit and agent of a batch of operations."""
    kind = F.when(F.col("op") == "delete", "delete").when(F.col("_version") == 1, "insert").otherwise("update")
    rows = ops.groupBy("seq", kind.alias("type"), F.col("_agent").alias("agent")).agg(F.sort_array(F.collect_list("_id")).alias("ids"))
    return rows.select(F.lit("db_change").alias("event"), F.lit(collection).alias("collection"), "type", "ids", "agent", "seq")
