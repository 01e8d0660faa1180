"""An append-only log of calls with pages by cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import Files

_ENTRY = "id string, ts timestamp, agent_id string, method string, tool string, ip string, tenant_id string, metadata string, event string"
#: Entries of a page: by default, at most (fixed values).
DEFAULT_LIMIT, MAX_LIMIT = 100, 1000


class AuditLog:
    """Entries below ``path``; an entry's id is its number with 16 digits, so ids sort as texts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Files(spark, path)

    def entries(self) -> DataFrame:
        names = [n for n in self.files.names() if n.startswith("part-") and self.files.exists(f"{n}/_SUCCESS")]
        return self.spark.read.schema(_ENTRY).parquet(*(f"{self.files.root}/{n}" for n in names)) if names else self.spark.createDataFrame([], _ENTRY)

    def append(self, rows: DataFrame, order: list[Column] | None = None) -> int:
        """Append rows (columns of an entry but id; others are null), numbered in their order; the last number.

        Numbers run on from partition to partition of the ordered rows, so nothing is gathered in one task.
        """
        last = int(self.entries().agg(F.max("id")).collect()[0][0] or 0)
        names = [c.split()[0] for c in _ENTRY.split(", ")][1:]
        have = set(rows.columns)
        out = rows.select(*((F.col(c) if c in have else F.lit(None)).cast(t.split()[1]).alias(c) for c, t in zip(names, _ENTRY.split(", ")[1:])))
        sort = order or [F.col("ts")]
        at = f"{self.files.root}/_new"
        out.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(at)
        new = self.spark.read.parquet(at).withColumn("_p", F.shiftright("_at", 33))
        counts = sorted((r["_p"], r["count"]) for r in new.groupBy("_p").count().collect())  # a row per partition
        if not counts:
            return last
        begin = self.spark.createDataFrame([(p, last + 1 + sum(n for _, n in counts[:i])) for i, (p, _) in enumerate(counts)], "_p long, _begin long")
        number = F.col("_begin") + F.col("_at").bitwiseAND(F.lit(2**33 - 1))
        numbered = new.join(F.broadcast(begin), "_p").select(F.lpad(number.cast("string"), 16, "0").alias("id"), *names)
        total = last + sum(n for _, n in counts)
        numbered.write.parquet(f"{self.files.root}/part-{total:016d}")
        self.files.delete("_new")
        return total

    def tenant_mismatch(self, agent: str | None = None, method: str | None = None, ip: str | None = None) -> int:
        """Append the entry of a call that its tenant forbids."""
        row = self.spark.createDataFrame([(agent, method or "unknown", ip, "tenant_mismatch")], "agent_id string, method string, ip string, event string")
        return self.append(row.withColumn("ts", F.current_timestamp()))

    def recent(self, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """The last entries, oldest first."""
        return self.entries().orderBy(F.desc("id")).limit(limit).orderBy("id")

    def query(self, cursor: str | None = None, limit: int = DEFAULT_LIMIT, tenant: str | None = None) -> tuple[DataFrame, str | None]:
        """(entries after the cursor in order, cursor of the next page or None at the end)."""
        limit = max(1, min(MAX_LIMIT, limit))
        rows = self.entries()
        rows = rows.where(F.col("id") > cursor) if cursor is not None else rows
        rows = rows.where(F.col("tenant_id") == tenant) if tenant is not None else rows
        page = rows.orderBy("id")
        ids = [r["id"] for r in page.select("id").limit(limit + 1).collect()]
        return page.limit(limit), ids[limit - 1] if len(ids) > limit else None
