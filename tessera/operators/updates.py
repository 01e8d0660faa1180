"""Updates and migrations of records."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import documents as docs

#: Fields that updates leave alone (fixed values).
PROTECTED = ("_id", "_version", "_agent", "_reason", "_expires", "_embedding", "__proto__", "constructor", "prototype")
MAX_OPS = 100


def _lit(v: Any) -> Column:
    return F.array(*map(_lit, v)) if isinstance(v, list) else F.lit(v)


def apply_update(df: DataFrame, update: Mapping[str, Mapping], when: Column | None = None) -> DataFrame:
    """$set, $unset, $inc, $push in this order on the rows where ``when`` holds; other rows stay. Top-level names only; protected ones are skipped.

    $inc on null or missing is the amount, on another type an error; $push on null or missing is a list of the value.
    """
    hit = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    rows = df.withColumn("_hit", hit)
    on = lambda new, old: F.when(F.col("_hit"), new).otherwise(old)
    free = lambda op: {k: v for k, v in (update.get(op) or {}).items() if k not in PROTECTED}
    for op in update:
        if op not in ("$set", "$unset", "$inc", "$push"):
            raise ValueError(f"Unknown update operator: {op}")
    for name, v in free("$set").items():
        new = _lit(v)
        old = F.col(f"`{name}`") if name in rows.columns else F.lit(None)
        rows = rows.withColumn(name, on(new.cast(rows.schema[name].dataType) if name in rows.columns else new, old))
    for name in free("$unset"):
        if name in rows.columns:
            rows = rows.withColumn(name, on(F.lit(None), F.col(f"`{name}`")))
    for name, v in free("$inc").items():
        if name not in rows.columns:
            rows = rows.withColumn(name, on(F.lit(v), F.lit(None)))
        elif isinstance(rows.schema[name].dataType, T.NumericType):
            rows = rows.withColumn(name, on(F.coalesce(F.col(f"`{name}`"), F.lit(0)) + F.lit(v), F.col(f"`{name}`")))
        else:
            wrong = F.raise_error(F.lit(f"Cannot $inc non-number field: {name}"))
            rows = rows.withColumn(name, F.when(F.col("_hit") & F.col(f"`{name}`").isNotNull(), wrong.cast(rows.schema[name].dataType)).otherwise(on(F.lit(v).cast(rows.schema[name].dataType), F.col(f"`{name}`"))))
    for name, v in free("$push").items():
        one = F.array(_lit(v))
        if name not in rows.columns:
            rows = rows.withColumn(name, on(one, F.lit(None)))
        elif isinstance(rows.schema[name].dataType, T.ArrayType):
            rows = rows.withColumn(name, on(F.concat(F.coalesce(F.col(f"`{name}`"), F.array().cast(rows.schema[name].dataType)), one), F.col(f"`{name}`")))
        else:
            raise ValueError(f"Cannot $push to non-array field: {name}")
    return rows.drop("_hit")


def migrate(df: DataFrame, ops: list[Mapping[str, Any]], key: str = "_id") -> tuple[DataFrame, DataFrame]:
    """(records after up to 100 ordered ops set, unset, rename, default, copy; one row of counts: scanned, changed, unchanged)."""
    whole = lambda d, names: F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(names))))
    rows = df.withColumn("_old_record", whole(df, df.columns))  # the record as it was goes along, instead of a join
    for kind, name, to, value in checked(ops):
        if kind == "set":
            rows = rows.withColumn(name, _lit(value))
        elif kind == "unset":
            rows = rows.drop(name)
        elif kind == "default":
            rows = rows.withColumn(name, F.coalesce(F.col(name), _lit(value)) if name in rows.columns else _lit(value))
        elif name in rows.columns:
            kept = F.coalesce(F.col(name), F.col(to)) if to in rows.columns else F.col(name)
            rows = rows.withColumn(to, kept)
            rows = rows.drop(name) if kind == "rename" else rows
    same = F.col("_old_record") == whole(rows, [c for c in rows.columns if c != "_old_record"])
    counts = rows.agg(F.count("*").alias("scanned"), F.count_if(~same).alias("changed"), F.count_if(same).alias("unchanged"))
    return rows.drop("_old_record"), counts


def checked(ops: list[Mapping[str, Any]]) -> list[tuple[str, str, str | None, Any]]:
    """(kind, field, target, value) of ordered operations; ValueError for too many or none, unknown kinds and protected fields."""
    if not 0 < len(ops) <= MAX_OPS:
        raise ValueError(f"between 1 and {MAX_OPS} operations")
    out = []
    for o in ops:
        kind, name, to = o["op"], o.get("field") or o.get("from"), o.get("to")
        if kind not in ("set", "unset", "rename", "default", "copy"):
            raise ValueError(f"Unknown migrate operation: {kind}")
        if name in PROTECTED or to in PROTECTED:
            raise ValueError(f"protected field: {name if name in PROTECTED else to}")
        out.append((kind, name, to, o.get("value")))
    return out


def fold_migrate(m: Column, ops: list[Mapping[str, Any]]) -> Column:
    """A map of fields after the operations: every field keeps its type, and fields that no operation names stay. A default fills a missing field, not null."""
    for kind, name, to, value in checked(ops):
        old = F.try_element_at(m, F.lit(name))
        if kind == "set":
            m = docs.put(m, name, docs.literal(value))
        elif kind == "unset":
            m = docs.put(m, name, None)
        elif kind == "default":
            m = F.when(F.map_contains_key(m, name), m).otherwise(docs.put(m, name, docs.literal(value)))
        else:
            moved = docs.put(docs.put(m, name, None) if kind == "rename" else m, to, old)
            m = F.when(F.map_contains_key(m, name), moved).otherwise(m)
    return m


def fold_update(m: Column, update: Mapping[str, Mapping]) -> Column:
    """A map of fields after $set, $unset, $inc, $push in this order; top-level names only, protected ones are skipped."""
    if unknown := set(update) - {"$set", "$unset", "$inc", "$push"}:
        raise ValueError(f"Unknown update operator: {sorted(unknown)[0]}")
    free = {op: {k: v for k, v in (update.get(op) or {}).items() if k not in PROTECTED} for op in ("$set", "$unset", "$inc", "$push")}
    for k, v in free["$set"].items():
        m = docs.put(m, k, docs.literal(v))
    for k in free["$unset"]:
        m = docs.put(m, k, None)
    for k, v in free["$inc"].items():
        old = F.try_element_at(m, F.lit(k))
        total = F.try_variant_get(old, "$", "double") + float(v)
        plain = F.when((total == F.floor(total)) & (F.abs(total) < 1e15), total.cast("long").cast("string")).otherwise(total.cast("string"))
        wrong = F.raise_error(F.lit(f"Cannot $inc non-number field: {k}")).cast("variant")
        m = docs.put(m, k, F.when(docs.missing(old), docs.literal(v)).when(docs.number_kind(F.schema_of_variant(old)), F.parse_json(plain)).otherwise(wrong))
    for k, v in free["$push"].items():
        old = F.try_element_at(m, F.lit(k))
        items = F.try_variant_get(old, "$", "array<variant>")
        grown = F.parse_json(F.concat(F.lit("["), F.array_join(F.concat(F.transform(items, lambda e: F.coalesce(F.to_json(e), F.lit("null"))), F.array(F.lit(json.dumps(v)))), ","), F.lit("]")))
        wrong = F.raise_error(F.lit(f"Cannot $push to non-array field: {k}")).cast("variant")
        m = docs.put(m, k, F.when(docs.missing(old), docs.literal([v])).when(F.schema_of_variant(old).startswith("ARRAY"), grown).otherwise(wrong))
    return m
