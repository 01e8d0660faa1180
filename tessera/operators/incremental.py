"""Process only what is new or changed, exactly once.

A run rereads all rows received since the oldest transaction that was open at the last successful run: what such a transaction wrote may have become visible
only after that run had read past it. Rows that earlier runs had are taken out by an anti-join of key-and-version pairs with the ledger of what was processed.

On disk: ``ledger/r-N`` the pairs that run N processed (one row per key, its highest version), ``ledger/f-N`` those of all runs up to N, ``marks/r-N`` one row per feed: up to where it was seen and from
where the next run rereads, and ``pending/r-N`` what a run that has begun is to process. A run fixes its pending pairs before anything is processed; it ends
by moving them into the ledger, which is the commit. A run that dies before is taken up again with the same number and the same pairs, so a consumer that
writes by run number neither skips nor repeats a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.joins import lookup
from tessera.session import scratch
from tessera.sources.files import Files

_KEY = ["feed", "rec_key"]
_LEDGER = "feed string, rec_key string, rec_version int"
_MARKS = "feed string, seen_until timestamp_ntz, reread_from timestamp_ntz"
#: Feeds whose bounds are pushed to the scan as literals; more are only joined.
_LITERAL_FEEDS = 200


def watermarks(runs: DataFrame) -> DataFrame:
    """feed, seen_until, reread_from of a history of attempts (feed, outcome, last_timestamp; run_id, attempt, started_at, finished_at where they are known).

    seen_until is the highest last_timestamp of the successful attempts. An attempt was open at that one if it began before that one ended, and hadn't ended
    when that one began (or never did) and no later attempt of its run followed; reread_from is the start of the oldest of these, but not after seen_until.
    Attempts without feed or last_timestamp are no success; repeated rows count once.
    """
    ok = runs.where((F.col("outcome") == "ok") & F.col("feed").isNotNull() & F.col("last_timestamp").isNotNull())
    if not {"run_id", "attempt", "started_at", "finished_at"} <= set(runs.columns):
        return ok.groupBy("feed").agg(F.max("last_timestamp").alias("seen_until")).withColumn("reread_from", F.col("seen_until"))
    last = ok.groupBy("feed").agg(F.max(F.struct("last_timestamp", "finished_at", "started_at")).alias("ok"))
    last = last.select("feed", F.col("ok.last_timestamp").alias("seen_until"), F.col("ok.started_at").alias("ok_began"), F.col("ok.finished_at").alias("ok_ended"))
    tries = runs.where("feed is not null and started_at is not null and (outcome is null or outcome <> 'ok')").select("feed", "run_id", "attempt", "started_at", "finished_at").distinct()
    # attempts are few, and retries of one run fewer
    later = F.max("attempt").over(Window.partitionBy("feed", "run_id"))
    tries = tries.withColumn("_later", later).where(F.col("finished_at").isNotNull() | (F.col("attempt") >= F.col("_later")))
    open_ = lookup(tries, last, "feed").where((F.col("started_at") <= F.col("ok_ended")) & (F.col("finished_at").isNull() | (F.col("finished_at") > F.col("ok_began"))))
    oldest = open_.groupBy("feed").agg(F.min("started_at").alias("oldest"))
    return last.join(oldest, "feed", "left").select("feed", "seen_until", F.least("seen_until", "oldest").alias("reread_from"))


def pairs_of(rows: DataFrame, feed: Column, key: Column, version: Column, received_at: Column) -> DataFrame:
    """feed, rec_key, rec_version, received_at. Rows with a null feed or key take no part; a null version counts as 0."""
    pairs = rows.select(feed.alias("feed"), key.alias("rec_key"), F.coalesce(version.cast("int"), F.lit(0)).alias("rec_version"), received_at.cast("timestamp_ntz").alias("received_at"))
    return pairs.dropna(subset=_KEY)


def _highest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*_KEY).agg(F.max("rec_version").alias("rec_version"))


class Ledger:
    """The runs of a consumer below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Files(spark, path)

    def _numbers(self, folder: str, kind: str = "r") -> list[int]:
        return [int(n[2:]) for n in self.files.names(folder) if n.startswith(f"{kind}-") and self.files.exists(f"{folder}/{n}/_SUCCESS")]

    def _read(self, names: list[str], schema: str) -> DataFrame:
        paths = [f"{self.files.root}/{n}" for n in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def last_run(self) -> int:
        """Number of the last run that committed, -1 before the first."""
        return max([*self._numbers("ledger"), *self._numbers("ledger", "f")], default=-1)

    def processed(self) -> DataFrame:
        """feed, rec_key, rec_version: what all runs had; a key once for each run since the last fold that had it."""
        folded = max(self._numbers("ledger", "f"), default=-1)
        names = [f"ledger/f-{folded:09d}"] * (folded >= 0) + [f"ledger/r-{n:09d}" for n in self._numbers("ledger") if n > folded]
        return self._read(names, _LEDGER)

    def run(self, n: int) -> DataFrame:
        """feed, rec_key, rec_version of one run that committed since the last fold."""
        return self._read([f"ledger/r-{n:09d}"], _LEDGER)

    def marks(self) -> DataFrame:
        """feed, seen_until, reread_from of the last run."""
        n = self.last_run()
        return self._read([f"marks/r-{n:09d}"] if n >= 0 else [], _MARKS)

    def adopt(self, pairs: DataFrame, runs: DataFrame) -> None:
        """Take over from runs that kept no ledger: what they saw of ``pairs`` becomes run 0. A null received_at was never seen."""
        if self.last_run() >= 0:
            raise ValueError("the ledger has runs already")
        self.files.delete("ledger/r-000000000")
        watermarks(runs).write.mode("overwrite").parquet(f"{self.files.root}/marks/r-000000000")
        marks = self._read(["marks/r-000000000"], _MARKS)
        seen = lookup(pairs, marks, "feed").where(F.col("received_at") <= F.col("seen_until"))
        _highest(seen).write.parquet(f"{self.files.root}/ledger/r-000000000")

    def reread(self, pairs: DataFrame) -> DataFrame:
        """The pairs received after the reread bound of their feed; those of other feeds, and without received_at, all."""
        marks = self.marks()
        bounds = marks.limit(_LITERAL_FEEDS + 1).collect()
        if 0 < len(bounds) <= _LITERAL_FEEDS:
            # literals reach the scan, where statistics of arrival order prune
            known = [b["feed"] for b in bounds]
            oldest = min(b["reread_from"] for b in bounds)
            pairs = pairs.where((F.col("received_at") > F.lit(oldest)) | F.col("received_at").isNull() | ~F.col("feed").isin(known))
        later = F.col("reread_from").isNull() | F.col("received_at").isNull() | (F.col("received_at") > F.col("reread_from"))
        return lookup(pairs, marks.select("feed", "reread_from"), "feed").where(later).drop("reread_from")

    def due(self, pairs: DataFrame) -> DataFrame:
        """feed, rec_key, rec_version that the next run must process: of every key reread its highest version, if that is above all the ledger has of it."""
        due = _highest(self.reread(pairs))
        done = _highest(self.processed()).withColumnRenamed("rec_version", "_done")
        # an outer join, as a bloom filter of the due keys can prune the ledger before it moves
        return due.join(done, _KEY, "left").where(F.col("_done").isNull() | (F.col("_done") < F.col("rec_version"))).drop("_done")

    def begin(self, pairs: DataFrame, open_since: DataFrame | None = None) -> tuple[int, DataFrame]:
        """(number of the run, what it must process). ``open_since`` (feed, oldest) has the start of the oldest transaction still open of the feeds that have one.

        If the run of this number had begun before, it is that one.
        """
        n = self.last_run() + 1
        if n not in self._numbers("pending"):
            # marks before pairs: rows that come between the two reads are reread
            seen = pairs.groupBy("feed").agg(F.max("received_at").alias("now"))
            old = self.marks().select("feed", "seen_until")
            new = seen.join(old, "feed", "full").withColumn("seen_until", F.greatest("now", "seen_until")).where("seen_until is not null")
            oldest = self.spark.createDataFrame([], "feed string, oldest timestamp_ntz") if open_since is None else open_since.groupBy("feed").agg(F.min("oldest").alias("oldest"))
            new = new.join(oldest, "feed", "left").select("feed", "seen_until", F.least("seen_until", "oldest").alias("reread_from"))
            new.write.mode("overwrite").parquet(f"{self.files.root}/marks/r-{n:09d}")
            self.due(pairs).write.mode("overwrite").parquet(f"{self.files.root}/pending/r-{n:09d}")
        return n, self._read([f"pending/r-{n:09d}"], _LEDGER)

    def commit(self, n: int) -> None:
        """End a run: what it had to process counts as processed. Once more is no error."""
        if n <= self.last_run():
            return
        if n not in self._numbers("pending"):
            raise ValueError(f"run {n} hasn't begun")
        self.files.delete(f"ledger/r-{n:09d}")
        self.files.rename(f"pending/r-{n:09d}", f"ledger/r-{n:09d}")

    def compact(self) -> None:
        """Fold all runs so far into one file set, a row per key; then what it replaces is deleted."""
        n = self.last_run()
        if n >= 0 and n not in self._numbers("ledger", "f"):
            _highest(self.processed()).write.mode("overwrite").parquet(f"{self.files.root}/ledger/f-{n:09d}")
        for kind in ("r", "f"):
            for old in self._numbers("ledger", kind):
                if old < n or kind == "r":
                    self.files.delete(f"ledger/{kind}-{old:09d}")
        for old in self._numbers("marks"):
            if old < n:
                self.files.delete(f"marks/r-{old:09d}")


def new_ledger(spark: SparkSession) -> Ledger:
    """A ledger in the shared folder."""
    return Ledger(spark, scratch(spark, "ledger"))


def new_keys(rows: DataFrame, runs: DataFrame, feed: Column, key: Column, version: Column, received_at: Column) -> DataFrame:
    """Distinct (feed, rec_key, rec_version) that the next run must process after a history of runs.

    A key is due if its highest version is above all versions that the feed's ledger holds for it (or the ledger doesn't hold it); it comes once, with
    that version. Without runs everything is due; without rows, nothing.
    """
    pairs = pairs_of(rows, feed, key, version, received_at)
    ledger = new_ledger(rows.sparkSession)
    ledger.adopt(pairs, runs)
    return ledger.due(pairs)
