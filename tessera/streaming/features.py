"""Per-entity features kept by a stateful stream.

The stream drops entries already counted (state: their ids) and keeps, for each entity and event type, a counter, the latest entry and totals (state: one
row each). Both states live in RocksDB beside the heap and are checkpointed with the offsets in the shared folder, so a run that dies is resumed without
skipping or repeating an entry. After each batch the rows that changed are upserted as a whole: appended under the number of the batch, of which the latest
holds, so an upsert costs what changed, and a batch that is run again overwrites its own rows only.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch
from tessera.sources.files import Files

_COUNTED = ("n", "last_ts", "last_id", "total")
_FEATURES = "entity string, kind string, n long, last_ts timestamp_ntz, last_id string, total long, batch long"
_ROCKS = "spark.sql.streaming.stateStore.rocksdb"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_ROCKS}.changelogCheckpointing.enabled": "true",
    f"{_ROCKS}.trackTotalNumberOfRows": "false",
    f"{_ROCKS}.boundedMemoryUsage": "true",
    f"{_ROCKS}.maxMemoryUsageMB": "300",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def stream_of(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file; new files are read as they come."""
    schema = spark.read.parquet(path).schema
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", p.getName()).parquet(str(p.getParent()))


class FeatureStore:
    """Feature rows (entity, kind, n, last_ts, last_id, total) under ``path``, fed by ``update``.

    ``d-N`` holds the rows that batch N changed, ``f-N`` all rows as of batch N. After FOLD batches those since the last fold are folded, so a batch costs
    what it changes, and a reader merges few files.
    """

    #: Batches between two folds.
    FOLD = 16

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.at = spark, path, f"{path}/checkpoint"
        self.files = Files(spark, f"{path}/features")

    def _numbers(self, kind: str) -> list[int]:
        return [int(n[2:]) for n in self.files.names() if n.startswith(f"{kind}-") and self.files.exists(f"{n}/_SUCCESS")]

    def _parts(self) -> list[str]:
        base = max(self._numbers("f"), default=-1)
        return [f"f-{base:09d}"] * (base >= 0) + [f"d-{n:09d}" for n in self._numbers("d") if n > base]

    def _upsert(self, changed: DataFrame, batch: int) -> None:
        # a batch that is run again overwrites its own rows only
        changed.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.files.root}/d-{batch:09d}")
        parts = self._parts()
        if len(parts) > self.FOLD:
            self._rows().write.mode("overwrite").parquet(f"{self.files.root}/f-{batch:09d}")
            for p in self.files.names():
                if p not in (f"d-{batch:09d}", f"f-{batch:09d}"):  # this batch may be run again
                    self.files.delete(p)

    def update(self, entries: DataFrame, entity: Column, kind: Column, ts: Column, entry_id: Column, amount: Column, repeated_within: tuple[Column, str] | None = None) -> None:
        """Count all entries that came since the last update. Entries with a null entity, kind, time or id are left out; a null amount adds nothing.

        An entry may come again at any time: the state keeps every id. With ``repeated_within`` (time of arrival, delay) copies must arrive within the
        delay, and the state keeps the ids of that time only.
        """
        rows = entries.select(entity.alias("entity"), kind.alias("kind"), ts.alias("ts"), entry_id.alias("id"), amount.cast("long").alias("amount"), *([repeated_within[0].cast("timestamp").alias("came")] if repeated_within else []))
        rows = rows.dropna(subset=["entity", "kind", "ts", "id"])
        once = rows.withWatermark("came", repeated_within[1]).dropDuplicatesWithinWatermark(["id"]) if repeated_within else rows.dropDuplicates(["id"])
        last = F.max(F.struct("ts", "id"))
        state = once.groupBy("entity", "kind").agg(F.count("*").alias("n"), last.alias("last"), F.coalesce(F.sum("amount"), F.lit(0)).alias("total"))
        state = state.select("entity", "kind", "n", F.col("last.ts").alias("last_ts"), F.col("last.id").alias("last_id"), "total")
        with _settings(self.spark, _STATE):
            writer = state.writeStream.outputMode("update").foreachBatch(self._upsert).option("checkpointLocation", self.at)
            query = writer.trigger(availableNow=True).start()
            query.awaitTermination()

    def _rows(self) -> DataFrame:
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], _FEATURES)
        rows = self.spark.read.schema(_FEATURES).parquet(*(f"{self.files.root}/{p}" for p in parts))
        if len(parts) == 1:
            return rows
        whole = F.struct("batch", *_COUNTED)
        return rows.groupBy("entity", "kind").agg(F.max(whole).alias("r")).select("entity", "kind", *(f"r.{c}" for c in _COUNTED), "r.batch")

    def features(self) -> DataFrame:
        """The feature rows; none before the first entry."""
        return self._rows().drop("batch")


def feature_rows(features: DataFrame) -> DataFrame:
    """One row per entity: its totals and ``features``, a map from kind to (n, last_ts, total). As many entries as the entity has kinds."""
    entry = F.struct("kind", F.struct("n", "last_ts", "total").alias("v"))
    last = F.max(F.struct("last_ts", "last_id"))
    rows = features.groupBy("entity").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), last.alias("last"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("features"))
    return rows.select("entity", "n", "total", "last.last_ts", "last.last_id", "features")


def new_store(spark: SparkSession) -> FeatureStore:
    """A store in the shared folder."""
    return FeatureStore(spark, scratch(spark, "features"))
