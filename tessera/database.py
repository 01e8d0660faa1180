"""A database: a folder of collections, schemas and dropped collections."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.collection import Collection, check_name
from tessera.functions import documents as docs
from tessera.functions.embedding import EmbeddingProvider
from tessera.operators import schema as schemas
from tessera.session import written
from tessera.sources.files import Files

_LEVELS = ("read", "write", "admin")


def allowed(rules: Mapping[str, Mapping[str, bool]] | None, agent: str | None, level: str) -> bool:
    """Whether an agent may read, write or administer; each level includes those before. Without rules all may, with rules only named agents."""
    if not rules:
        return True
    mine = rules.get(agent) if agent else None
    return bool(mine) and any(mine.get(x) for x in _LEVELS[_LEVELS.index(level) :])


class Database:
    """Collections below a root path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str, provider: EmbeddingProvider | None = None, rules: Mapping | None = None, read_only: bool = False, writer: str = ""):
        self.spark, self.root, self.provider, self.rules, self.read_only, self.writer = spark, root.rstrip("/"), provider, rules, read_only, writer
        self.files = Files(spark, self.root)
        self._open: dict[str, Collection] = {}

    def collection(self, name: str | Mapping[str, Any]) -> Collection:
        """A collection by name or schema; a stored schema is merged with the given one."""
        code = None if isinstance(name, str) else name
        name = name if isinstance(name, str) else name["name"]
        if name not in self._open or code:
            stored = self.load_schema(name)
            merged = schemas.merge_schemas(code, stored)[0] if code else stored
            self._open[name] = Collection(self.spark, f"{self.root}/collections", check_name(name), merged if merged and merged.get("fields") else None, self.provider, self.read_only, self.writer)
        return self._open[name]

    def _guard(self) -> None:
        if self.read_only:
            raise PermissionError("The database is read-only")

    def create_collection(self, name: str) -> Collection:
        self._guard()
        self.files.write(f"collections/{check_name(name)}/created.json", json.dumps({"ts": time.time()}).encode())
        return self.collection(name)

    def list_collections(self) -> list[dict]:
        """Every collection with its number of records, and what its stored schema says of it."""
        out = []
        for n in self.files.names("collections"):
            s = self.load_schema(n)
            about = {"description": s.get("description"), "fieldCount": len(s.get("fields") or {}), "hasInstructions": bool(s.get("instructions")), "version": s.get("version")} if s else None
            out.append({"name": n, "recordCount": self.collection(n).count(), **({"schema": about} if about else {})})
        return out

    def drop_collection(self, name: str) -> str:
        """Put a collection aside; its name there."""
        self._guard()
        aside = f"_dropped_{check_name(name)}_{int(time.time() * 1000)}"
        self.files.rename(f"collections/{name}", f"dropped/{aside}")
        self._open.pop(name, None)
        return aside

    def list_dropped(self) -> list[str]:
        return self.files.names("dropped")

    def purge_collection(self, name: str) -> int:
        """Delete dropped collections for good, by their name there or their old one."""
        self._guard()
        hit = [n for n in self.list_dropped() if n == name or n.rpartition("_")[0] == f"_dropped_{name}"]
        for n in hit:
            self.files.delete(f"dropped/{n}")
        return len(hit)

    def stats(self) -> dict:
        all_ = self.list_collections()
        return {"collections": len(all_), "totalRecords": sum(c["recordCount"] for c in all_)}

    def persist_schema(self, name: str, schema: Mapping[str, Any]) -> dict:
        self._guard()
        old = self.load_schema(name)
        merged = schemas.persisted({**(schemas.overlay(old, schema) if old else schema), "name": name})
        schemas.validate_schema(merged)
        self.files.write(f"meta/{check_name(name)}.schema.json", json.dumps(merged, sort_keys=True).encode())
        self._open.pop(name, None)
        return merged

    def load_schema(self, name: str) -> dict | None:
        at = f"meta/{name}.schema.json"
        return json.loads(self.files.read(at)) if self.files.exists(at) else None

    def load_schemas(self, paths: list[str]) -> dict[str, list[str]]:
        """Lay schema files (paths below the database) over the stored ones: names loaded and skipped, paths failed."""
        self._guard()
        out = schemas.load_files(self.files, paths, "meta")
        for n in out["loaded"]:
            self._open.pop(n, None)
        return out

    def delete_schema(self, name: str) -> bool:
        self._guard()
        self._open.pop(name, None)
        return self.files.delete(f"meta/{check_name(name)}.schema.json")

    def export(self, path: str, names: list[str] | None = None) -> int:
        """Write records of collections as JSON Lines under ``path/<collection>``; their number."""
        total = 0
        for n in names or self.files.names("collections"):
            rows = self.collection(n).stored().select("_id", "doc")
            rows.select(F.to_json(F.struct(F.lit(n).alias("collection"), "_id", "doc")).alias("value")).write.text(f"{path}/{n}")
            total += rows.count()
        return total

    def import_(self, rows: DataFrame, overwrite: bool = False) -> dict:
        """Read exported rows (JSON text ``value``) back; records that exist stay unless ``overwrite``; rows without _id are skipped."""
        self._guard()
        r = written(rows.select(F.from_json("value", "collection string, _id string, doc string").alias("r")).select("r.*").where("_id is not null and collection is not null"), "import")
        names = [x["collection"] for x in r.select("collection").distinct().collect()]
        for n in names:
            c = self.collection(n)
            # of an id that comes twice one row holds
            new = r.where(F.col("collection") == n).groupBy("_id").agg(F.max("doc").alias("doc")).withColumn("n", F.lit(0).cast("long"))
            if not overwrite:
                new = new.join(c.stored().select("_id"), "_id", "left_anti")
            c._set(new, "insert")
        return {"collections": len(names), "records": r.count()}

    def import_json(self, path: str, overwrite: bool = False) -> dict:
        """Read a file of the form {"collections": {name: {"records": [...]}}}; records without _id are skipped."""
        v = self.spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
        tvf = self.spark.tvf
        parts = v.lateralJoin(tvf.variant_explode(F.try_variant_get(F.col("v").outer(), "$.collections", "variant"))).select(F.col("key").alias("collection"), F.col("value").alias("c"))
        recs = parts.lateralJoin(tvf.variant_explode(F.try_variant_get(F.col("c").outer(), "$.records", "variant"))).select("collection", F.col("value").alias("r"))
        m = docs.as_map(F.col("r"))
        flat = recs.select("collection", F.try_variant_get("r", "$._id", "string").alias("_id"), docs.from_map(F.map_filter(m, lambda k, _: ~k.isin(*docs.META_FIELDS))).alias("doc"))
        return self.import_(flat.select(F.to_json(F.struct("collection", "_id", "doc")).alias("value")), overwrite)
