"""Schemas of collections: define, validate, merge, compare, infer."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import documents as docs
from tessera.functions.documents import units
from tessera.functions.filters import Compiler
from tessera.sources.files import Files

#: Declared types (fixed values) and their Spark types.
FIELD_TYPES = {"string": "string", "number": "double", "boolean": "boolean", "date": "string", "enum": "string", "string[]": "array<string>", "number[]": "array<double>", "object": "variant", "autoIncrement": "long"}
#: Bytes of a schema file, at most (fixed value).
MAX_FILE = 10 * 1024 * 1024
_OWNED_BY_CODE = ("type", "values", "maxLength", "pattern", "min", "max", "required", "default", "searchable")


def validate_schema(schema: Mapping[str, Any]) -> None:
    """Raise ValueError for a schema that isn't well formed. Unknown properties are let pass and kept."""
    if not isinstance(schema.get("name"), str) or not schema["name"]:
        raise ValueError("schema needs a name")
    for name, f in (schema.get("fields") or {}).items():
        if not isinstance(f, Mapping) or f.get("type") not in FIELD_TYPES:
            raise ValueError(f"field {name}: unknown type")
        if f["type"] == "enum" and not (isinstance(f.get("values"), list) and f["values"] and all(isinstance(v, str) for v in f["values"])):
            raise ValueError(f"field {name}: an enum needs values")
        if f.get("searchable") and f["type"] not in ("string", "string[]"):
            raise ValueError(f"field {name}: only texts are searchable")
        for k in ("maxLength", "min", "max"):
            if k in f and (isinstance(f[k], bool) or not isinstance(f[k], (int, float))):
                raise ValueError(f"field {name}: {k} must be a number")
    for k in ("indexes", "arrayIndexes"):
        if k in schema and not (isinstance(schema[k], list) and all(isinstance(x, str) for x in schema[k])):
            raise ValueError(f"{k} must be a list of names")


def violations(df: DataFrame, schema: Mapping[str, Any], prefix: str = "") -> Column:
    """Array of texts, one per rule that a row breaks; empty for valid rows. With a prefix the columns of ``df`` are fields of a struct."""
    found = []
    for name, f in schema["fields"].items():
        if name not in df.columns:
            if f.get("required"):
                found.append(F.lit(f"{name}: required"))
            continue
        c, t = F.col(f"{prefix}`{name}`"), df.schema[name].dataType
        say = lambda bad, what, name=name: found.append(F.when(bad, F.lit(f"{name}: {what}")))
        if f.get("required"):
            say(c.isNull(), "required")
        kind, text = f["type"], isinstance(t, T.StringType)
        wrong = {"string": not text, "enum": not text, "date": not (text or isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))), "number": not isinstance(t, T.NumericType), "boolean": not isinstance(t, T.BooleanType)}
        if wrong.get(kind) or (kind.endswith("[]") and not isinstance(t, T.ArrayType)):
            say(c.isNotNull(), f"not a {kind}")
            continue
        if kind == "string" and "maxLength" in f:
            say(units(c) > f["maxLength"], "too long")
        if kind == "string" and "pattern" in f:
            say(~c.rlike(f["pattern"]), "pattern")
        if kind == "enum":
            say(~c.isin(f["values"]), "not one of its values")
        if kind == "number" and "min" in f:
            say(c < f["min"], "below min")
        if kind == "number" and "max" in f:
            say(c > f["max"], "above max")
        if kind.endswith("[]"):
            say(F.exists(c, lambda e: e.isNull()), "null element")
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


_FITS: dict[str, Any] = {
    "string": lambda k: k == "STRING", "enum": lambda k: k == "STRING", "date": lambda k: (k == "STRING") | k.startswith("TIMESTAMP") | (k == "DATE"), "number": docs.number_kind, "boolean": lambda k: k == "BOOLEAN",
    "string[]": lambda k: k.isin("ARRAY<STRING>", "ARRAY<VOID>", "ARRAY<>"), "number[]": lambda k: k.rlike(r"^ARRAY<(BIGINT|DOUBLE|FLOAT|DECIMAL.*|VOID|)>$"), "object": lambda k: k.startswith("OBJECT"),
}


def doc_violations(rows: DataFrame, m: Column, schema: Mapping[str, Any], custom: tuple = ()) -> DataFrame:
    """The rows with ``violations``: texts, one per rule that the map of fields ``m`` breaks. A value of another type than declared breaks one, whatever it could be cast to.

    ``custom``: functions from the map to a text column that is null for valid records.
    """
    fields = schema.get("fields") or {}
    wrong, typed = [], []
    for name, f in fields.items():
        v = F.try_element_at(m, F.lit(name))
        fits = _FITS.get(f["type"])
        there = ~docs.missing(v)
        kind = F.schema_of_variant(v)
        if fits is not None:
            wrong.append(F.when(there & ~fits(kind), F.lit(f"{name}: not a {f['type']}")))
        t = FIELD_TYPES[f["type"]]
        # of another type: a value that no further rule looks at, but that is there
        value = F.try_variant_get(v, "$", t) if t != "variant" else F.to_json(v)
        typed.append((F.when(there & fits(kind), value) if fits is not None else value).alias(name))
        if f.get("required"):
            wrong.append(F.when(~there, F.lit(f"{name}: required")))
    rules = {n: {k: x for k, x in f.items() if k != "required"} for n, f in fields.items() if f["type"] not in ("object", "autoIncrement")}
    none = F.array().cast("array<string>")
    inner = violations(rows.select(*typed), {"fields": rules}, "_typed.") if typed else none
    flat = rows.withColumn("_typed", F.struct(*typed)) if typed else rows
    own = [*wrong, *(c(m) for c in custom)]
    return flat.withColumn("violations", F.array_compact(F.concat(F.array(*own) if own else none, inner))).drop("_typed")


def filled(m: Column, schema: Mapping[str, Any]) -> Column:
    """A map of fields with its values resolved, then missing ones filled by their defaults. Null is not missing.

    A field's ``resolve`` is a function from its typed value to another one, its ``default`` a JSON value or a function that gives a column.
    """
    for name, f in (schema.get("fields") or {}).items():
        if "resolve" in f:
            old = F.try_element_at(m, F.lit(name))
            new = f["resolve"](F.try_variant_get(old, "$", FIELD_TYPES[f["type"]]))
            m = F.when(docs.missing(old), m).otherwise(docs.put(m, name, new.cast("variant")))
    for name, f in (schema.get("fields") or {}).items():
        if "default" in f:
            d = f["default"]() if callable(f["default"]) else None
            m = F.when(F.map_contains_key(m, name), m).otherwise(docs.put(m, name, docs.literal(f["default"]) if d is None else d.cast("variant")))
    return m


def persisted(schema: Mapping[str, Any]) -> dict:
    """What of a schema can be stored: no functions, no patterns, no properties that say nothing."""
    out = {k: schema[k] for k in ("name", "version", "description", "instructions", "tagField", "storageMode", "bm25") if schema.get(k) is not None}
    out |= {k: list(schema[k]) for k in ("indexes", "compositeIndexes", "arrayIndexes") if schema.get(k)}
    if schema.get("fields") is not None:
        out["fields"] = {}
        for n, f in schema["fields"].items():
            kept = {k: f[k] for k in ("type", "default", "maxLength", "min", "max", "description", "searchable") if f.get(k) is not None and not callable(f[k])}
            out["fields"][n] = kept | ({"required": True} if f.get("required") else {}) | ({"values": list(f["values"])} if f.get("values") else {})
    return out


def merge_schemas(code: Mapping[str, Any], stored: Mapping[str, Any] | None) -> tuple[dict, list[str]]:
    """(merged, warnings): types and constraints as in code; version, description and instructions as stored; indexes of both."""
    if not stored:
        return dict(code), []
    warn = []
    if code.get("version") is not None and stored.get("version") is not None and code["version"] != stored["version"]:
        warn.append(f"version {code['version']} in code, {stored['version']} stored")
    out = {**stored, **code}
    for k in ("version", "description", "instructions"):
        if stored.get(k) is not None:
            out[k] = stored[k]
    fields = {n: dict(f) for n, f in (stored.get("fields") or {}).items()}
    for n, f in (code.get("fields") or {}).items():
        old = fields.get(n, {})
        if old.get("type") not in (None, f.get("type")):
            warn.append(f"field {n}: {f.get('type')} in code, {old['type']} stored")
        fields[n] = {**{k: v for k, v in old.items() if k not in _OWNED_BY_CODE}, **f, **({"description": old["description"]} if old.get("description") else {})}
    out["fields"] = fields
    for k in ("indexes", "compositeIndexes", "arrayIndexes"):
        both = [*(stored.get(k) or []), *(code.get(k) or [])]
        if both:
            out[k] = [x for i, x in enumerate(both) if x not in both[:i]]
    return out, warn


def overlay(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict:
    """Stored schema with properties of another laid over it, field by field; ``required: false`` clears."""
    out = {**base, **{k: v for k, v in over.items() if k != "fields" and v is not None}}
    out["fields"] = {n: dict(f) for n, f in (base.get("fields") or {}).items()}
    for n, f in (over.get("fields") or {}).items():
        out["fields"][n] = {k: v for k, v in {**out["fields"].get(n, {}), **f}.items() if not (k == "required" and v is False)}
    return out


def diff_schemas(old: Mapping[str, Any], new: Mapping[str, Any]) -> list[dict]:
    """Changes of fields: added, removed, changed (with the properties), each with a severity."""
    a, b, out = old.get("fields") or {}, new.get("fields") or {}, []
    for n in sorted({*a, *b}):
        if n not in a:
            out.append({"field": n, "change": "added", "severity": "high" if b[n].get("required") and "default" not in b[n] else "low"})
        elif n not in b:
            out.append({"field": n, "change": "removed", "severity": "medium"})
        else:
            props = sorted(k for k in {*a[n], *b[n]} if a[n].get(k) != b[n].get(k))
            if props:
                out.append({"field": n, "change": "changed", "properties": props, "severity": "high" if "type" in props else "medium" if {"required", "values", "maxLength", "min", "max", "pattern"} & {*props} else "low"})
    return out


def impact(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row: for each rule the number of records that it concerns, all counted in one pass."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))


def impact_of(old: Mapping[str, Any], new: Mapping[str, Any], fields: Any) -> dict[str, Column]:
    """For each change of a schema that records may break, by "field.property", the predicate of those records. ``fields`` is a filter compiler's set of fields."""
    compile_ = Compiler(fields).compile
    a, b, out = old.get("fields") or {}, new.get("fields") or {}, {}
    for n in sorted({*a, *b}):
        if n not in b:
            out[f"{n}.removed"] = compile_({n: {"$exists": True}})
            continue
        f, g = a.get(n, {}), b[n]
        if n in a and f.get("type") != g.get("type"):
            out[f"{n}.type"] = compile_({n: {"$exists": True}})
        if g.get("required") and not f.get("required"):
            out[f"{n}.required"] = compile_({n: {"$exists": False}})
        if gone := sorted(set(f.get("values") or []) - set(g.get("values") or [])) if "values" in g else []:
            out[f"{n}.values"] = compile_({n: {"$in": gone}})
        if "maxLength" in g and g["maxLength"] < f.get("maxLength", float("inf")):
            out[f"{n}.maxLength"] = compile_({n: {"$strLen": {"$gt": g["maxLength"]}}})
        if "min" in g and g["min"] > f.get("min", float("-inf")):
            out[f"{n}.min"] = compile_({n: {"$lt": g["min"]}})
        if "max" in g and g["max"] < f.get("max", float("inf")):
            out[f"{n}.max"] = compile_({n: {"$gt": g["max"]}})
    return out


def sampled(df: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """A uniform sample of at most ``size`` rows, the same for the same seed and rows: the rows of the lowest hashes."""
    h = F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c, t in df.dtypes if "variant" not in t and "map<" not in t))
    return df.withColumn("_h", h).orderBy("_h").limit(size).drop("_h")


def infer(df: DataFrame, doc: str, enum_threshold: int = 10, required_at: float = 0.95) -> DataFrame:
    """Per top-level field of JSON objects (text or VARIANT): field, type (null if mixed), present, distinct_values, max_length, required.

    Whole table, no sample. Types: boolean, number, string, enum (at most ``enum_threshold`` distinct texts), date, string[], number[], object.
    """
    v = F.col(doc) if isinstance(df.schema[doc].dataType, T.VariantType) else F.try_parse_json(doc)
    rows = df.select(v.alias("v")).where("v is not null")
    entries = rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))
    kind = F.schema_of_variant("value")
    text = F.try_variant_get("value", "$", "string")
    bucket = (
        F.when(kind == "BOOLEAN", "boolean").when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), "number").when(kind == "STRING", "string")
        .when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>", "ARRAY<>"), "string[]").when(kind.rlike(r"^ARRAY<(BIGINT|DOUBLE|FLOAT|DECIMAL.*)>$"), "number[]").when(kind.startswith("OBJECT"), "object")
    )
    e = entries.where(F.col("key").isNotNull() & ~F.is_variant_null("value")).select("key", F.coalesce(bucket, F.lit("other")).alias("b"), F.when(kind == "STRING", text).alias("t"))
    iso = r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?$"
    # value counts first: no set of values is ever gathered
    per_value = e.groupBy("key", "b", "t").agg(F.count("*").alias("n"))
    by = per_value.groupBy("key").agg(F.count_distinct("b").alias("kinds"), F.min("b").alias("b"), F.sum("n").alias("present"), F.count("t").alias("distinct_values"), F.max(F.length("t")).alias("max_length"), F.bool_and(F.col("t").rlike(iso)).alias("dates"))
    total = rows.agg(F.count("*").alias("total"))
    kind_ = F.when(F.col("kinds") > 1, None).when(F.col("b") != "string", F.col("b")).when(F.col("dates"), "date").when(F.col("distinct_values") <= enum_threshold, "enum").otherwise("string")
    return by.crossJoin(F.broadcast(total)).select(F.col("key").alias("field"), kind_.alias("type"), "present", "distinct_values", "max_length", (F.col("present") >= required_at * F.col("total")).alias("required"))  # one row of totals


def sample_fields(df: DataFrame, doc: str, size: int = 50, key: str = "_id") -> DataFrame:
    """field, types ("a | b") of the first ``size`` records by key."""
    v = F.col(doc) if isinstance(df.schema[doc].dataType, T.VariantType) else F.try_parse_json(doc)
    rows = df.orderBy(key).limit(size).select(v.alias("v"))
    e = rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).where("key is not null")
    k = F.schema_of_variant("value")
    name = F.when(F.is_variant_null("value"), "null").when(k == "STRING", "string").when(k == "BOOLEAN", "boolean").when(k.startswith("ARRAY"), "array").when(k.startswith("OBJECT"), "object").otherwise("number")
    return e.groupBy(F.col("key").alias("field")).agg(F.array_join(F.sort_array(F.collect_set(name)), " | ").alias("types"))


def load_files(files: Files, paths: list[str], into: str) -> dict[str, list[str]]:
    """Lay schema files over the stored ones, all below one root of any Hadoop file system: names loaded, skipped (nothing new) and paths failed, each by itself."""
    out: dict[str, list[str]] = {"loaded": [], "skipped": [], "failed": []}
    for p in paths:
        try:
            if files.size(p) > MAX_FILE:
                raise ValueError("file too large")
            new = json.loads(files.read(p))
            validate_schema(new)
            at = f"{into}/{new['name']}.schema.json"
            old = json.loads(files.read(at)) if files.exists(at) else None
            merged = overlay(old, new) if old else new
            if merged == old:
                out["skipped"].append(new["name"])
                continue
            files.write(at, json.dumps(merged, sort_keys=True).encode())
            out["loaded"].append(new["name"])
        except Exception:  # noqa: BLE001
            out["failed"].append(p)
    return out
