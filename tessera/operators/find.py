"""Filtered find: filter, sort, page, summary, token budget, count, distinct."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import documents as docs
from tessera.functions.compact import parse_compact
from tessera.functions.filters import Compiler, TypedFields, VariantFields
from tessera.operators import text

MAX_LIMIT = 10_000
#: Fields of a record that stand in columns beside its VARIANT.
BESIDE = {"_id": "string", "_version": "number"}
#: Columns of a stored record that readers don't see.
META = ("_agent", "_reason", "_expires", "_embedding")


@dataclass
class FindResult:
    """A page: its records, the number of all matches, and whether there are more."""

    records: DataFrame
    _matches: DataFrame
    _end: int
    _budget_hit: Callable[[], bool] = lambda: False

    @property
    def total(self) -> int:
        return self._matches.count()

    @property
    def truncated(self) -> bool:
        return self.total > self._end or self._budget_hit()


def live(df: DataFrame, now_ms: Column | int | None = None) -> DataFrame:
    """Records that haven't expired: no _expires, 0, or not before now. Numbers are milliseconds, texts and timestamps times."""
    if "_expires" not in df.columns:
        return df
    c, t = F.col("_expires"), df.schema["_expires"].dataType
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    at = c if isinstance(t, T.NumericType) else F.unix_millis(c.try_cast("timestamp"))
    return df.where(c.isNull() | at.isNull() | (at == 0) | (at >= now))


def expired(c: Column) -> Column:
    """Whether an ``_expires`` in milliseconds has passed."""
    return F.coalesce((c != 0) & (c < F.unix_millis(F.current_timestamp())), F.lit(False))


def _variant(df: DataFrame, doc: str) -> VariantFields:
    return VariantFields(doc, {c: k for c, k in BESIDE.items() if c in df.columns})


def resolve(df: DataFrame, where: Mapping | str | None, variant: str | None = None, virtual: Mapping | None = None, tag_field: str = "tags", searchable: Column | None = None, fields: Any = None) -> Column:
    """The predicate of a filter, JSON or compact; ``$text`` (at the top, or a part of a top-level $and) needs ``searchable``."""
    f: Any = parse_compact(where, tag_field) if isinstance(where, str) else where
    compiler = Compiler(fields or (_variant(df, variant) if variant else TypedFields(df)), virtual)
    found: list[Column] = []

    def hoist(x: Any) -> Any:
        if not isinstance(x, Mapping):
            return x
        rest = {}
        for key, v in x.items():
            if key == "$text":
                if searchable is None:
                    raise ValueError("$text requires a text index")
                p = text.and_search(df, searchable, v)
                found.append(F.lit(False) if p is None else p)
            elif key == "$and" and isinstance(v, list):
                rest[key] = [hoist(y) for y in v]
            else:
                rest[key] = v
        return rest

    predicate = compiler.compile(hoist(f) if f else None)
    for p in found:
        predicate = predicate & p
    return predicate


def order_by(df: DataFrame, sort: str, key: str, variant: str | None = None) -> list[Column]:
    """Sort columns of ``field`` or ``-field``: null and missing last either way, then the key. Variant fields: numbers before texts."""
    name = sort.lstrip("-")
    ref = (_variant(df, variant) if variant else TypedFields(df)).ref(name)
    if ref.sort_key is None:
        return [F.col(key)]
    parts = [ref.values["number"], ref.values["string"]] if variant and len(ref.values) > 1 else [ref.sort_key]
    return [(c.desc_nulls_last() if sort.startswith("-") else c.asc_nulls_last()) for c in parts] + [F.col(key)]


def summarize(df: DataFrame) -> DataFrame:
    """Without what is long: objects; texts over 200 units and arrays over 10 elements are null. Of a VARIANT document such fields are left out."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StructType, T.MapType)):
            continue
        if isinstance(f.dataType, T.VariantType):
            c = docs.summary(c)
        elif isinstance(f.dataType, T.StringType):
            c = F.when(docs.units(c) <= 200, c)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.when(F.size(c) <= 10, c)
        out.append(c.alias(f.name))
    return df.select(*out)


def _chars(c: Column, t: T.DataType) -> Column:
    """Estimated characters of a value: null 4, text its length + 2, number or boolean as printed, containers the sum of their parts."""
    if isinstance(t, T.StringType):
        n = F.length(c) + 2
    elif isinstance(t, T.ArrayType):
        n = F.aggregate(F.transform(c, lambda e: _chars(e, t.elementType) + 1), F.lit(2), lambda a, b: a + b)
    elif isinstance(t, T.StructType):
        n = sum((_chars(c[f.name], f.dataType) + len(f.name) + 4 for f in t), F.lit(2))
    elif isinstance(t, T.VariantType):
        n = docs.chars(c)
    elif isinstance(t, (T.DoubleType, T.FloatType)):
        n = F.length(F.regexp_replace(c.cast("string"), r"\.0$", ""))
    else:
        n = F.length(c.cast("string"))
    return F.coalesce(n.cast("int"), F.lit(4))


def tokens(df: DataFrame) -> Column:
    """Estimated tokens of a record: a quarter of its characters, rounded up. The fields of a VARIANT ``doc`` count as the record's own."""
    if dict(df.dtypes).get("doc") == "variant":
        rest = [c for c in df.columns if c != "doc"]
        own = _chars(F.struct(*(F.col(f"`{c}`") for c in rest)), df.select(*rest).schema) if rest else F.lit(2)
        return F.ceil((own + F.coalesce(docs.chars(F.col("doc")), F.lit(2)) - 2) / 4).cast("long")
    return F.ceil(_chars(F.struct(*(F.col(f"`{c}`") for c in df.columns)), df.schema) / 4).cast("long")


def within_budget(page: DataFrame, max_tokens: int, order: list[Column]) -> DataFrame:
    """The first records whose tokens fit, the first one always. The page is bounded by the limit, so one task ranks it."""
    by = Window.partitionBy(F.lit(0)).orderBy(*order)
    rows = page.withColumn("_tok", tokens(page)).withColumn("_sum", F.sum("_tok").over(by)).withColumn("_rn", F.row_number().over(by))
    return rows.where((F.col("_sum") <= max_tokens) | (F.col("_rn") == 1)).drop("_tok", "_sum", "_rn")


def find(df: DataFrame, where: Mapping | str | None = None, sort: str | None = None, limit: int = 50, offset: int = 0, summary: bool = False, max_tokens: int = 0, key: str = "_id", computed: Mapping[str, Column] | None = None, **how: Any) -> FindResult:
    """A page of the live records that match: sorted (else by key), without metadata, with computed fields, summarised, within a token budget."""
    matches = live(df).where(resolve(df, where, **how))
    limit, offset = max(0, min(limit, MAX_LIMIT)), max(0, offset)
    order = order_by(df, sort, key, how.get("variant")) if sort else [F.col(key)]
    page = matches.orderBy(*order)
    page = (page.offset(offset) if offset else page).limit(limit).drop(*META)
    for name, c in (computed or {}).items():
        page = page.withColumn(name, c)
    if summary:
        page = summarize(page)
    if max_tokens <= 0:
        return FindResult(page, matches, offset + limit)
    fits = within_budget(page, max_tokens, order)
    return FindResult(fits, matches, offset + limit, lambda: fits.count() < page.count())


def count(df: DataFrame, where: Mapping | str | None = None, **how: Any) -> DataFrame:
    """One row with ``n``."""
    return live(df).where(resolve(df, where, **how)).agg(F.count("*").alias("n"))


def distinct(df: DataFrame, name: str, variant: str | None = None) -> DataFrame:
    """Distinct values of a field as ``value``; null is one, missing is none. Variant values are told apart by their JSON text."""
    if not variant:
        return live(df).select(F.col(name).alias("value")).distinct()
    ref = VariantFields(variant).ref(name)
    return live(df).where(ref.exists).select(F.to_json(F.try_variant_get(variant, "$." + name, "variant")).alias("value")).distinct()
