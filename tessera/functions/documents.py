"""Columns over whole JSON documents in VARIANT or as a map from field to VARIANT."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields that stand beside a document or belong to the store (fixed values).
META_FIELDS = ("_id", "_version", "_agent", "_reason", "_expires", "_embedding")


def as_map(doc: Column) -> Column:
    """Map from top-level field to VARIANT; a document that is no object has none."""
    return F.coalesce(doc.try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))


def from_map(m: Column) -> Column:
    """JSON text of a map of fields, in the order of their names."""
    return F.to_json(F.to_variant_object(m))


def literal(v: Any) -> Column:
    """A JSON value as VARIANT."""
    return F.parse_json(F.lit(json.dumps(v)))


def put(m: Column, name: str, v: Column | None) -> Column:
    """The map with a field set, or without it (None)."""
    kept = F.map_filter(m, lambda k, _: k != name)
    return kept if v is None else F.map_concat(kept, F.create_map(F.lit(name), v))


def number_kind(kind: Column) -> Column:
    """Whether a ``schema_of_variant`` is that of a number."""
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def missing(v: Column) -> Column:
    """Whether a VARIANT is absent or JSON null."""
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def units(c: Column) -> Column:
    """Length of a text in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def summary(doc: Column) -> Column:
    """The document without what is long, as VARIANT: objects, texts over 200 units, arrays over 10 elements."""

    def short(_: Column, v: Column) -> Column:
        kind = F.schema_of_variant(v)
        text = F.coalesce(units(F.try_variant_get(v, "$", "string")), F.lit(0))
        return ~((kind.startswith("OBJECT")) | ((kind == "STRING") & (text > 200)) | (kind.startswith("ARRAY") & (F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")), F.lit(0)) > 10)))

    return F.to_variant_object(F.map_filter(as_map(doc), short))


def chars(doc: Column) -> Column:
    """Estimated characters of a document: null 4, text its length + 2, number or boolean as printed, containers 2 and their parts with a separator each."""
    text = F.regexp_replace(F.to_json(doc), r"\\(u[0-9a-fA-F]{4}|.)", "x")
    bare = F.regexp_replace(text, r'"[^"]*"', "s")
    # JSON has one separator less than parts in each container that isn't empty
    return units(text) + F.length(bare) - F.length(F.regexp_replace(bare, r"[\[{](?![\]}])", ""))


def record_text(doc: Column) -> Column:
    """Top-level texts and texts in top-level arrays, joined by spaces, but those of META_FIELDS; "" where there is none."""

    def parts(e: Column) -> Column:
        kind = F.schema_of_variant(e["value"])
        one = F.when((kind == "STRING"), F.array(F.try_variant_get(e["value"], "$", "string")))
        many = F.filter(F.coalesce(F.try_variant_get(e["value"], "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x) == "STRING")
        return F.coalesce(F.filter(one, lambda x: x != ""), F.when(kind.startswith("ARRAY"), F.transform(many, lambda x: F.try_variant_get(x, "$", "string"))), F.array().cast("array<string>"))

    fields = F.filter(F.map_entries(as_map(doc)), lambda e: ~e["key"].isin(*META_FIELDS))
    return F.array_join(F.flatten(F.transform(fields, parts)), " ")


def example(v: Column) -> Column:
    """A value for display, as JSON text: a text's first 100 characters, an array's first 5 elements and their number."""
    kind, text, items = F.schema_of_variant(v), F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "array<variant>")
    long_text = F.to_json(F.array(F.concat(F.substring(text, 1, 100), F.lit("..."))))
    first = F.array_join(F.transform(F.slice(items, 1, 5), lambda e: F.to_json(e)), ",")
    long_items = F.concat(F.lit("["), first, F.lit(',"... ('), F.size(items).cast("string"), F.lit(' items)"]'))
    return F.when((kind == "STRING") & (F.length(text) > 100), long_text.substr(F.lit(2), F.length(long_text) - 2)).when(kind.startswith("ARRAY") & (F.size(items) > 5), long_items).otherwise(F.to_json(v))
