"""JSON filters compiled to one Column.

Filters are two-valued: a predicate on a missing or mistyped value is false and its negation true. Where a predicate stands positively it is emitted bare,
so that it reaches the scan's pushed filters; only below a negation is NULL turned into false. Fields are resolved when the filter is compiled: from the
schema of typed tables, or by type guards at run time where records are one VARIANT column.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.documents import number_kind, units

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_MAX_PATTERN = 200


def number_text(c: Column) -> Column:
    """The number that a text spells: outer white space ignored, empty text 0, NULL where it spells none."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(t == "", F.lit(0.0)).when(t.rlike(_NUMBER), t.try_cast("double"))


def spelled(text: str) -> float:
    """As ``number_text`` for a literal; NaN where it spells none."""
    t = text.strip()
    return 0.0 if not t else float(t) if re.match(_NUMBER, t) else math.nan


def kind_of(v: Any) -> str:
    """Kind of a literal."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    return "array" if isinstance(v, (list, tuple)) else "object"


@dataclass
class Ref:
    """A field: for each kind it can have, the value as that kind (NULL if it is of another), and whether it is there and null."""

    values: dict[str, Column]
    exists: Column
    null: Column
    #: For arrays: whether one holds a literal, equals a list.
    holds: Callable[[Any], Column] = field(default=lambda v: F.lit(False))
    same: Callable[[list], Column] = field(default=lambda v: F.lit(False))
    sort_key: Column | None = None


def _typed_kind(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.ArrayType):
        return "array"
    return "time" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "object"


class TypedFields:
    """Fields of a table with a schema. NULL stands for both null and missing, as columns can't tell them apart."""

    def __init__(self, df: DataFrame):
        self.schema = df.schema

    def ref(self, path: str) -> Ref:
        kind: T.DataType = self.schema
        c: Column | None = None
        for part in path.split("."):
            if isinstance(kind, T.StructType) and part in kind.names:
                c, kind = (F.col(f"`{part}`") if c is None else c.getField(part)), kind[part].dataType
            elif isinstance(kind, T.MapType) and c is not None:
                c, kind = c.getItem(part), kind.valueType
            elif isinstance(kind, T.ArrayType) and c is not None and part.isdigit():
                c, kind = F.get(c, int(part)), kind.elementType
            elif isinstance(kind, T.ArrayType) and c is not None and part == "length":
                c, kind = F.when(c.isNotNull(), F.size(c)), T.IntegerType()
            else:
                return Ref({}, F.lit(False), F.lit(False))
        return self._of(c, kind)

    def _of(self, c: Column, t: T.DataType) -> Ref:
        kind = _typed_kind(t)
        value = c
        if isinstance(t, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(c), c)
        ref = Ref({kind: value}, c.isNotNull(), c.isNull(), sort_key=c)
        if kind == "number":
            ref.values = {"number": c} if value is c else {"number": value, "bare": c}
        if kind == "array":
            inner = _typed_kind(t.elementType)
            fits = lambda v: kind_of(v) == inner or (inner == "time" and kind_of(v) == "string")
            ref.holds = lambda v: F.exists(c, lambda e: e.isNull()) if v is None else F.array_contains(c, F.lit(v).cast(t.elementType)) if fits(v) and not (inner == "number" and float(v) != float(v)) else F.lit(False)
            ref.same = lambda vs: (F.size(c) == len(vs)) & reduce(lambda a, b: a & b, [(F.get(c, i).isNull() if v is None else F.coalesce(F.get(c, i) == F.lit(v), F.lit(False)) if fits(v) else F.lit(False)) for i, v in enumerate(vs)], F.lit(True))
        return ref


class VariantFields:
    """Fields of records in one VARIANT column: null, missing and every type are told apart."""

    def __init__(self, doc: str = "doc", columns: Mapping[str, str] | None = None):
        self.doc, self.columns = doc, columns or {}

    def ref(self, path: str) -> Ref:
        """A numeric part is an object's key or else an array's position. Fields kept in columns of their own (name -> kind) are read there."""
        if path in self.columns:
            c = F.col(path)
            return Ref({self.columns[path]: c}, c.isNotNull(), c.isNull(), sort_key=c)
        steps = [""]
        for p in path.split("."):
            name = "['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']"
            steps = [s + o for s in steps for o in ([name, f"[{p}]"] if p.isdigit() else [name])]
        v = F.coalesce(*(F.try_variant_get(self.doc, "$" + s, "variant") for s in steps))
        kind = F.schema_of_variant(v)
        as_ = lambda t: F.try_variant_get(v, "$", t)
        number = number_kind(kind)
        items = as_("array<variant>")
        is_array = kind.startswith("ARRAY")

        def equals(e: Column, lit: Any) -> Column:
            k, s = kind_of(lit), F.schema_of_variant(e)
            if k == "null":
                return F.is_variant_null(e)
            if k == "string":
                return (s == "STRING") & (F.try_variant_get(e, "$", "string") == lit)
            if k == "boolean":
                return (s == "BOOLEAN") & (F.try_variant_get(e, "$", "boolean") == lit)
            if k == "number":
                return number_kind(s) & (F.try_variant_get(e, "$", "double") == float(lit))
            return F.lit(False)

        ref = Ref({"string": F.when(kind == "STRING", as_("string")), "number": F.when(number, as_("double")), "boolean": F.when(kind == "BOOLEAN", as_("boolean"))}, v.isNotNull(), F.coalesce(F.is_variant_null(v), F.lit(False)))
        ref.holds = lambda x: is_array & F.exists(items, lambda e: equals(e, x))
        ref.same = lambda xs: is_array & (F.size(items) == len(xs)) & reduce(lambda a, b: a & b, [equals(F.get(items, i), x) for i, x in enumerate(xs)], F.lit(True))
        ref.sort_key = F.struct(ref.values["number"].alias("n"), ref.values["string"].alias("s"))
        return ref


class ColumnFields(VariantFields):
    """Fields of stored records, of which some are kept in columns beside the document: ``<kind's first three letters>:<field>`` and ``is:<field>`` ("value", "null" or missing)."""

    def __init__(self, doc: str, columns: Mapping[str, str], kept: Mapping[str, str]):
        super().__init__(doc, columns)
        self.kept = kept

    def ref(self, path: str) -> Ref:
        """A kept field has values of one kind only, so predicates on its column are plain and reach the scan."""
        if path not in self.kept:
            return super().ref(path)
        kind, is_ = self.kept[path], F.col(f"`is:{path}`")
        c = F.col(f"`{kind[:3]}:{path}`")
        return Ref({"number" if kind == "double" else kind: c}, is_.isNotNull(), F.coalesce(is_ == "null", F.lit(False)), sort_key=c)


def _check_pattern(p: str) -> str:
    """Reject patterns that can take exponential time: long ones, adjacent quantifiers, quantified groups with a quantifier or alternative inside."""
    if len(p) > _MAX_PATTERN:
        raise ValueError(f"$regex pattern exceeds {_MAX_PATTERN} characters")
    bare = re.sub(r"\[(?:\\.|[^\]\\])*\]", "x", re.sub(r"\\.", "x", p))
    if re.search(r"[*+][*+]|\}[*+{]|\?[*+{]{2}", bare):
        raise ValueError("$regex pattern has adjacent quantifiers")
    risky: list[bool] = []
    for i, ch in enumerate(bare):
        if ch == "(":
            risky.append(False)
        elif ch in "*+|{" and risky:
            risky[-1] = True
        elif ch == ")" and risky:
            bad = risky.pop()
            if bad and i + 1 < len(bare) and bare[i + 1] in "*+{":
                raise ValueError("$regex pattern has a quantified group with a quantifier or alternative")
            if bad and risky:
                risky[-1] = True
    re.compile(p)
    return p


class Compiler:
    """Compiles filters over one set of fields. ``virtual`` maps a name to a function of the fields that gives a predicate."""

    def __init__(self, fields: TypedFields | VariantFields, virtual: Mapping[str, Callable[[Any], Column]] | None = None):
        self.fields, self.virtual = fields, virtual or {}

    def compile(self, f: Mapping | None, negative: bool = False, top: bool = True) -> Column:
        """The predicate; None and {} match everything. ``negative``: the caller negates it, so it must not be NULL."""
        if f is None:
            return F.lit(True)
        if not isinstance(f, Mapping):
            raise ValueError("Filter must be an object")
        parts = []
        for key, want in f.items():
            if key in ("$and", "$or"):
                if not isinstance(want, (list, tuple)):
                    raise ValueError(f"{key} requires an array")
                inner = [self.compile(x, negative, False) for x in want]
                parts.append(reduce(lambda a, b: a & b, inner, F.lit(True)) if key == "$and" else reduce(lambda a, b: a | b, inner, F.lit(False)))
            elif key == "$not":
                if not isinstance(want, Mapping):
                    raise ValueError("$not requires an object")
                parts.append(~self.compile(want, True, False))
            elif key.startswith("+") and top and key[1:] in self.virtual:
                p = F.coalesce(self.virtual[key[1:]](self.fields), F.lit(False))
                parts.append(~p if want is False else p)
            elif key.startswith("$"):
                raise ValueError(f"Unknown operator: {key}")
            else:
                parts.append(self.field(self.fields.ref(key), want, negative))
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def field(self, ref: Ref, want: Any, negative: bool) -> Column:
        """All operators on one field."""
        if isinstance(want, Mapping) and want and all(k.startswith("$") for k in want):
            return reduce(lambda a, b: a & b, [self.operator(ref, op, v, negative) for op, v in want.items()])
        return self._sure(self._equal(ref, want), negative)

    @staticmethod
    def _sure(p: Column, negative: bool) -> Column:
        return F.coalesce(p, F.lit(False)) if negative else p

    def _equal(self, ref: Ref, v: Any) -> Column:
        kind = kind_of(v)
        if kind == "null":
            return ref.null
        if kind == "array":
            return ref.same(list(v))
        if kind == "object" or (kind == "number" and v != v):
            return F.lit(False)
        if kind == "string" and "time" in ref.values:
            return ref.values["time"] == F.lit(v).try_cast("timestamp_ntz")
        value = ref.values.get("bare", ref.values.get(kind)) if kind == "number" else ref.values.get(kind)
        return F.lit(False) if value is None else value == F.lit(v)

    def _compare(self, ref: Ref, op: str, v: Any) -> Column:
        do = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}[op]
        kind, found = kind_of(v), []
        if kind == "string" and "time" in ref.values:
            found.append(do(ref.values["time"], F.lit(v).try_cast("timestamp_ntz")))
        if kind == "string" and "string" in ref.values:
            found.append(do(ref.values["string"], F.lit(v)))
        n = float(v) if kind == "number" else spelled(v) if kind == "string" else math.nan
        if n == n:
            lit = F.lit(v if kind == "number" else n)
            if "number" in ref.values:
                # NaN is the largest number to Spark: only upper bounds keep it out by themselves
                c = ref.values["bare"] if op in ("$lt", "$lte") and "bare" in ref.values else ref.values["number"]
                found.append(do(c, lit))
            if kind == "number" and "string" in ref.values:
                found.append(do(number_text(ref.values["string"]), lit))
        if not found:
            return F.lit(False)
        return found[0] if len(found) == 1 else reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in found])

    def operator(self, ref: Ref, op: str, v: Any, negative: bool) -> Column:
        """One operator on one field."""
        if op == "$eq":
            return self._sure(self._equal(ref, v), negative)
        if op == "$ne":
            kind, value = kind_of(v), None
            if kind in ("string", "number", "boolean") and "time" not in ref.values:
                value = ref.values.get("bare", ref.values.get(kind)) if kind == "number" else ref.values.get(kind)
            return ~value.eqNullSafe(F.lit(v)) if value is not None and v == v else ~F.coalesce(self._equal(ref, v), F.lit(False))
        if op in ("$gt", "$gte", "$lt", "$lte"):
            return self._sure(self._compare(ref, op, v), negative)
        if op in ("$in", "$nin"):
            if not isinstance(v, (list, tuple)):
                raise ValueError(f"{op} requires an array")
            by_kind: dict[str, list] = {}
            for x in v:
                by_kind.setdefault(kind_of(x), []).append(x)
            found = []
            for kind, xs in by_kind.items():
                if kind == "null":
                    found.append(ref.null)
                elif kind in ref.values:
                    found.append((ref.values.get("bare", ref.values[kind]) if kind == "number" else ref.values[kind]).isin([x for x in xs if x == x]))
                elif kind == "string" and "time" in ref.values:
                    found += [self._equal(ref, x) for x in xs]
            p = found[0] if len(found) == 1 else reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in found], F.lit(False))
            return ~F.coalesce(p, F.lit(False)) if op == "$nin" else self._sure(p, negative)
        if op == "$contains":
            parts = [ref.values["string"].contains(v)] if isinstance(v, str) and "string" in ref.values else []
            if "array" in ref.values or "string" not in ref.values or "number" in ref.values:
                parts.append(ref.holds(v))
            return self._sure(parts[0], negative) if len(parts) == 1 else reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in parts], F.lit(False))
        if op in ("$startsWith", "$endsWith", "$regex"):
            if not isinstance(v, str):
                raise ValueError(f"{op} requires a string")
            if op == "$regex":
                _check_pattern(v)
            c = ref.values.get("string")
            return F.lit(False) if c is None else self._sure({"$startsWith": c.startswith, "$endsWith": c.endswith, "$regex": c.rlike}[op](v), negative)
        if op == "$exists":
            if not isinstance(v, bool):
                raise ValueError("$exists requires a boolean")
            return ref.exists if v else ~ref.exists
        if op == "$strLen":
            c = ref.values.get("string")
            if c is None or kind_of(v) not in ("number", "object"):
                return F.lit(False)
            n = units(c)
            return self.field(Ref({"number": n}, n.isNotNull(), n.isNull()), v, negative) if kind_of(v) == "object" else self._sure(n == v, negative)
        if op == "$not":
            if not isinstance(v, Mapping):
                raise ValueError("$not requires an object")
            return ~F.coalesce(self.field(ref, v, True), F.lit(False))
        raise ValueError(f"Unknown operator: {op}")
