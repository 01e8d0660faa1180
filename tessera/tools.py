"""The tools of a database: named functions with a permission each, that report errors instead of raising them."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.database import Database, allowed
from tessera.functions.filters import VariantFields
from tessera.operators import schema as schemas

#: At most so many rows of a result are handed to a caller.
PAGE = 10_000


def records(df: DataFrame) -> list[dict]:
    """Rows (_id, _version, doc VARIANT or text, others) of a bounded result as records."""
    out = []
    text = df.withColumn("doc", F.to_json("doc")) if dict(df.dtypes).get("doc") == "variant" else df
    for r in text.limit(PAGE).collect():
        d = r.asDict(recursive=True)
        doc = json.loads(d.pop("doc") or "{}") if "doc" in d else {}
        out.append({**d, **doc})
    return out


def _page(r: Any) -> dict:
    return {"records": records(r.records), "total": r.total, "truncated": r.truncated}


def _where(a: dict) -> Any:
    return a.get("filter")


def _find(db: Database, a: dict) -> dict:
    opts = {k: a[k] for k in ("limit", "offset", "sort", "summary") if k in a}
    return _page(db.collection(a["collection"]).find(_where(a), max_tokens=a.get("maxTokens", 0), **opts))


def _scored(df: DataFrame) -> dict:
    rows = records(df)
    return {"records": [{k: v for k, v in r.items() if k != "score"} for r in rows], "scores": [r["score"] for r in rows]}


def _batch(db: Database, a: dict) -> dict:
    """Inserts and deletes by id in one commit, then the updates; deletes by filter are not part of a batch."""
    c, ops = db.collection(a["collection"]), a["operations"]
    n = c.batch([o["record"] for o in ops if o["op"] == "insert"], [o["id"] for o in ops if o["op"] == "delete" and "id" in o])
    updated = sum(c.update(o["filter"], o["update"]) for o in ops if o["op"] == "update")
    return {"commit": n, "updated": updated}


def _migrate(db: Database, a: dict) -> dict:
    """Ordered operations on the matching records."""
    mut = {k: a[k] for k in ("agent", "reason") if a.get(k) is not None}
    return db.collection(a["collection"]).migrate(_where(a), a.get("ops") or a["operations"], bool(a.get("dryRun")), **mut)


def _diff(db: Database, a: dict) -> dict:
    """Changes that a schema would make, with their severity, and how many records each concerns, counted in one pass."""
    old = db.load_schema(a["collection"]) or {"fields": {}}
    new = schemas.overlay(old, a["schema"])
    out: dict = {"changes": schemas.diff_schemas(old, new)}
    if a.get("includeImpact", True):
        rows = db.collection(a["collection"]).find_all()
        out["impact"] = schemas.impact(rows, schemas.impact_of(old, new, VariantFields("doc", {"_id": "string", "_version": "number"}))).collect()[0].asDict()
    return out


def _infer(db: Database, a: dict) -> dict:
    """Fields with their types, of all records or of a sample; notes on fields whose type isn't one."""
    docs = db.collection(a["collection"]).find_all()
    docs = schemas.sampled(docs, a["sampleSize"]) if a.get("sampleSize") else docs
    rows = schemas.infer(docs, "doc", a.get("enumThreshold", 10)).orderBy("field").collect()
    typed = [r for r in rows if r["type"] is not None and r["type"] != "other"]
    notes = [f"Field '{r['field']}' skipped: values of several or unknown types" for r in rows if r not in typed]
    return {"fields": {r["field"]: {k: r[k] for k in ("type", "present", "distinct_values", "max_length", "required")} for r in typed}, "notes": notes}


def _vector(db: Database, a: dict) -> dict:
    db.collection(a["collection"]).insert_vector(a["id"], a["vector"], a.get("metadata"))
    return {"id": a["id"]}


def _c(f: Callable[[Any, dict], Any]) -> Callable[[Database, dict], Any]:
    """A tool on the collection that its arguments name."""
    return lambda db, a: f(db.collection(a["collection"]), a)


def _mut(a: dict) -> dict:
    return {k: a[k] for k in ("agent", "reason", "ttl") if a.get(k) is not None}


#: name -> (permission, function)
TOOLS: dict[str, tuple[str, Callable[[Database, dict], Any]]] = {
    "db_collections": ("read", lambda db, a: db.list_collections()),
    "db_create": ("write", lambda db, a: {"created": db.create_collection(a["collection"]).name}),
    "db_drop": ("admin", lambda db, a: {"dropped": db.drop_collection(a["collection"])}),
    "db_purge": ("admin", lambda db, a: {"purged": db.purge_collection(a["name"])}),
    "db_stats": ("read", lambda db, a: db.stats()),
    "db_insert": ("write", _c(lambda c, a: {"ids": c.insert_many(a["records"] if "records" in a else [a["record"]], **_mut(a))})),
    "db_find": ("read", _find),
    "db_find_one": ("read", _c(lambda c, a: c.find_one(a["id"]))),
    "db_update": ("write", _c(lambda c, a: {"modified": c.update(_where(a), a["update"], a.get("expectedVersion"), **_mut(a))})),
    "db_upsert": ("write", _c(lambda c, a: c.upsert(a["id"], a["record"], **_mut(a)))),
    "db_delete": ("admin", _c(lambda c, a: {"deleted": c.remove({"_id": a["id"]} if "id" in a else _where(a))})),
    "db_batch": ("write", _batch),
    "db_count": ("read", _c(lambda c, a: {"count": c.count(_where(a))})),
    "db_undo": ("admin", _c(lambda c, a: {"undone": c.undo()})),
    "db_history": ("read", _c(lambda c, a: [r.asDict(recursive=True) for r in c.history(a["id"]).limit(PAGE).collect()])),
    "db_distinct": ("read", _c(lambda c, a: c.distinct(a["field"]))),
    "db_schema": ("read", _c(lambda c, a: {r["field"]: r["types"] for r in c.schema(a.get("sampleSize", 50)).collect()})),
    "db_get_schema": ("read", lambda db, a: db.load_schema(a["collection"])),
    "db_set_schema": ("admin", lambda db, a: db.persist_schema(a["collection"], a["schema"])),
    "db_delete_schema": ("admin", lambda db, a: {"deleted": db.delete_schema(a["collection"])}),
    "db_diff_schema": ("read", _diff),
    "db_infer_schema": ("read", _infer),
    "db_migrate": ("write", _migrate),
    "db_archive": ("admin", _c(lambda c, a: {"archived": c.archive(_where(a), a.get("segment"))})),
    "db_archive_list": ("read", _c(lambda c, a: c.list_archive_segments())),
    "db_archive_load": ("read", _c(lambda c, a: records(c.load_archive(a["segment"])))),
    "db_semantic_search": ("read", _c(lambda c, a: _scored(c.semantic_search(a["query"], a.get("limit", 10), _where(a))))),
    "db_embed": ("write", _c(lambda c, a: {"embedded": c.embed_unembedded()})),
    "db_vector_upsert": ("write", _vector),
    "db_vector_search": ("read", _c(lambda c, a: _scored(c.search_by_vector(a["vector"], a.get("limit", 10), _where(a))))),
    "db_bm25_search": ("read", _c(lambda c, a: _scored(c.bm25_search(a["query"], a.get("limit", 10), _where(a), a.get("candidateLimit"))))),
    "db_reembed_all": ("write", _c(lambda c, a: c.reembed_all())),
    "db_hybrid_search": ("read", _c(lambda c, a: _scored(c.hybrid_search(a["query"], a.get("limit", 10), _where(a), a.get("k", 60))))),
    "db_blob_write": ("write", _c(lambda c, a: c.write_blob(a["id"], a["name"], base64.b64decode(a["content"])))),
    "db_blob_read": ("read", _c(lambda c, a: {"content": base64.b64encode(c.read_blob(a["id"], a["name"])).decode()})),
    "db_blob_list": ("read", _c(lambda c, a: c.list_blobs(a["id"]))),
    "db_blob_delete": ("admin", _c(lambda c, a: {"deleted": c.delete_blob(a["id"], a["name"])})),
    "db_export": ("read", lambda db, a: {"records": db.export(a["path"], a.get("collections"))}),
    "db_import": ("write", lambda db, a: db.import_(db.spark.read.option("recursiveFileLookup", "true").text(a["path"]), a.get("overwrite", False))),
    "db_subscribe": ("read", _c(lambda c, a: {"unsubscribe": c.on_change(a["callback"])})),
    "db_unsubscribe": ("read", lambda db, a: a["unsubscribe"]()),
}


def call(db: Database, name: str, args: dict | None = None, agent: str | None = None) -> dict:
    """{"result": ...} or {"error": text} of a tool; paths in errors are masked."""
    if name not in TOOLS:
        return {"error": f"Unknown tool: {name}"}
    level, f = TOOLS[name]
    if not allowed(db.rules, agent, level):
        return {"error": f"Permission denied: {name} needs {level}"}
    if db.read_only and level != "read":
        return {"error": "The database is read-only"}
    try:
        return {"result": f(db, args or {})}
    except Exception as e:  # noqa: BLE001
        text = f"missing argument {e}" if isinstance(e, KeyError) else str(e).split("\n")[0]
        return {"error": re.sub(r"(file:)?/[\w./-]+", "<path>", text)[:500]}
