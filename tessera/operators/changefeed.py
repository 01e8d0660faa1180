"""Rebuild a table's current state from a feed of inserts, updates, upserts, deletes and undos.

Merge-on-read with equality deletes. A batch of the feed appends two kinds of files: data files hold the documents that changes put in place, delete files
the keys that changes touched, both with sequence numbers. A reader anti-joins the rows with the delete keys of later sequence numbers: what remains is
current. The sequence is (changed_at, version), so neither the order of arrival nor repetition matters, within a batch or between batches, and nothing that
was written is read or changed by an append. A batch is reduced to one row per key by partial aggregation before it is written, so that a key with any share
of all changes puts no weight on one task; compaction folds all batches into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch
from tessera.sources.files import Files

#: The version of a change without one: within an instant, it comes after all versions.
_NO_VERSION = 2147483647
_SEQ = "struct<at:timestamp_ntz,v:int,gone:int>"
_DATA = f"coll string, rec_id string, seq {_SEQ}, rec_version int, payload string"
_DELETES = f"coll string, rec_id string, seq {_SEQ}"


def changes(feed: DataFrame) -> DataFrame:
    """One row per change of one record: coll, rec_id, rec_version, doc, changed_at. Events without ids, coll or changed_at hold no change; a null id is none."""
    parts = F.arrays_zip(F.col("ids").alias("id"), F.col("versions").alias("v"), F.col("docs").alias("d"))
    rows = feed.select("coll", "changed_at", F.explode(parts).alias("c")).select("coll", F.col("c.id").alias("rec_id"), F.col("c.v").cast("int").alias("rec_version"), F.col("c.d").alias("doc"), "changed_at")
    return rows.dropna(subset=["coll", "rec_id", "changed_at"])


def sequence(gone: Column) -> Column:
    """Sequence number of a change: its time, then its version (none: last), then, for one version at one instant, removal last."""
    return F.struct(F.col("changed_at").alias("at"), F.coalesce("rec_version", F.lit(_NO_VERSION)).alias("v"), gone.cast("int").alias("gone"))


class ChangeTable:
    """The data and delete files of a table below ``path``: folders ``b-N`` of batches and ``c-N`` of all batches up to N, each with ``kind=data`` and ``kind=delete``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Files(spark, path)

    def _numbers(self, kind: str) -> list[int]:
        return [int(n[2:]) for n in self.files.names() if n.startswith(f"{kind}-") and self.files.exists(f"{n}/_SUCCESS")]

    def _current(self) -> list[str]:
        base = max(self._numbers("c"), default=-1)
        return [f"c-{base:09d}"] * (base >= 0) + [f"b-{n:09d}" for n in self._numbers("b") if n > base]

    def append(self, feed: DataFrame, payload: Column | None = None, batch: int | None = None) -> int:
        """Append a batch (coll, ids, versions, docs, changed_at; other columns are ignored); its number. A given number that was written before is no error."""
        n = batch if batch is not None else max([*self._numbers("b"), *self._numbers("c")], default=-1) + 1
        if batch is not None and (n in self._numbers("b") or n <= max(self._numbers("c"), default=-1)):
            return n
        rows = changes(feed)
        there = F.col("doc").isNotNull()
        row = F.struct(sequence(F.lit(False)).alias("seq"), F.col("rec_version").alias("rec_version"), (F.col("doc") if payload is None else payload).cast("string").alias("payload"))
        # the last document and the last change of each key; two documents at one number: the greater one
        once = rows.groupBy("coll", "rec_id").agg(F.max(F.when(there, row)).alias("row"), F.max(sequence(~there)).alias("seq"))
        put = F.when(F.col("row").isNotNull(), F.struct(F.lit("data").alias("kind"), F.col("row.seq").alias("seq"), F.col("row.rec_version").alias("rec_version"), F.col("row.payload").alias("payload")))
        dead = F.struct(F.lit("delete").alias("kind"), F.col("seq").alias("seq"), F.lit(None).cast("int").alias("rec_version"), F.lit(None).cast("string").alias("payload"))
        files = once.select("coll", "rec_id", F.explode(F.array_compact(F.array(put, dead))).alias("f")).select("coll", "rec_id", "f.*")
        files.write.mode("overwrite").partitionBy("kind").parquet(f"{self.files.root}/b-{n:09d}")
        return n

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.files.root}/{n}/kind={kind}" for n in self._current() if self.files.exists(f"{n}/kind={kind}")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def data(self) -> DataFrame:
        """coll, rec_id, seq, rec_version, payload of the data files."""
        return self._read("data", _DATA)

    def deletes(self) -> DataFrame:
        """coll, rec_id, seq of the delete files: a row of the key with a lower number is not current."""
        return self._read("delete", _DELETES)

    def _live(self) -> DataFrame:
        a, d = self.data().alias("a"), self.deletes().alias("d")
        later = (F.col("a.coll") == F.col("d.coll")) & (F.col("a.rec_id") == F.col("d.rec_id")) & (F.col("d.seq") > F.col("a.seq"))
        rows = a.join(d, later, "left_anti")
        if len(self._current()) < 2:
            return rows
        # a change that came in two batches stands in both; the join's partitioning serves here too
        return rows.groupBy("coll", "rec_id").agg(F.max(F.struct("seq", "rec_version", "payload")).alias("r")).select("coll", "rec_id", "r.*")

    def read(self) -> DataFrame:
        """Every record that exists now: coll, rec_id, rec_version, payload (by default its document)."""
        return self._live().select("coll", "rec_id", "rec_version", "payload")

    def compact(self) -> None:
        """Fold all batches into one: current rows, and one delete key for each record that is gone, so that older changes may still come."""
        done = self._current()
        if len(done) < 2:
            return
        n = max(self._numbers("b"))
        live = self._live().select("coll", "rec_id", F.struct(F.lit("data").alias("kind"), "seq", "rec_version", "payload").alias("f"))
        last = self.deletes().groupBy("coll", "rec_id").agg(F.max("seq").alias("seq"))
        dead = last.select("coll", "rec_id", F.struct(F.lit("delete").alias("kind"), "seq", F.lit(None).cast("int").alias("rec_version"), F.lit(None).cast("string").alias("payload")).alias("f"))
        live.unionByName(dead).select("coll", "rec_id", "f.*").write.mode("overwrite").partitionBy("kind").parquet(f"{self.files.root}/c-{n:09d}")
        for old in done:
            self.files.delete(old)


def current_state(feed: DataFrame, payload: Column | None = None) -> DataFrame:
    """Every record that still exists after a whole feed: coll, rec_id, rec_version, payload. An empty feed gives no records."""
    table = new_table(feed.sparkSession)
    table.append(feed, payload)
    return table.read()


def new_table(spark: SparkSession) -> ChangeTable:
    """A table in the shared folder."""
    return ChangeTable(spark, scratch(spark, "changes"))
