import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.compact import parse_compact
from tessera.functions.filters import Compiler, TypedFields, VariantFields
from tessera.operators import find as finder

MISSING = object()
VALUES = [MISSING, None, True, False, 0, 5, 5.5, -1, "", "5", "abc", "ab c", [], [5], ["abc", None], {"k": 1}]


def num(v):
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def same(a, b):
    if num(a) and num(b):
        return a == b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))
    return type(a) is type(b) and not isinstance(a, dict) and a == b


def spelled(s):
    try:
        return float(s) if s.strip() else 0.0
    except ValueError:
        return None


def less(op, a, b):
    f = {"$gt": lambda x, y: x > y, "$gte": lambda x, y: x >= y, "$lt": lambda x, y: x < y, "$lte": lambda x, y: x <= y}[op]
    if isinstance(a, str) and isinstance(b, str):
        return f(a, b)
    x, y = (v if num(v) else spelled(v) if isinstance(v, str) else None for v in (a, b))
    return x is not None and y is not None and f(x, y)


def holds(v, op, want):
    """Plain evaluator of one operator."""
    if op == "$eq":
        return v is not MISSING and same(v, want)
    if op == "$ne":
        return not holds(v, "$eq", want)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return v is not MISSING and less(op, v, want)
    if op == "$in":
        return any(holds(v, "$eq", w) for w in want)
    if op == "$nin":
        return not holds(v, "$in", want)
    if op == "$contains":
        return (isinstance(v, str) and isinstance(want, str) and want in v) or (isinstance(v, list) and any(same(x, want) for x in v))
    if op == "$startsWith":
        return isinstance(v, str) and v.startswith(want)
    if op == "$endsWith":
        return isinstance(v, str) and v.endswith(want)
    if op == "$exists":
        return (v is not MISSING) == want
    if op == "$strLen":
        return isinstance(v, str) and (len(v) == want if num(want) else all(holds(len(v), o, w) for o, w in want.items()))
    if op == "$not":
        return not all(holds(v, o, w) for o, w in want.items())
    raise AssertionError(op)


OPS = [
    *itertools.product(["$eq", "$ne"], [None, 5, 5.5, "5", "abc", True, [5], [], ["abc", None]]),
    *itertools.product(["$gt", "$gte", "$lt", "$lte"], [5, "5", "abc", 0]),
    *itertools.product(["$in", "$nin"], [[5, "abc"], [None], [], [True, "5"]]),
    *itertools.product(["$contains"], ["abc", 5, "b", None]),
    ("$startsWith", "ab"), ("$endsWith", "c"), ("$exists", True), ("$exists", False), ("$strLen", 3), ("$strLen", {"$gt": 1}),
    ("$not", {"$gt": 1}), ("$not", {"$eq": None}), ("$not", {"$in": [5, None]}),
]


def test_variant_operators_against_plain_evaluator(spark):
    import json

    rows = [(i, json.dumps({} if v is MISSING else {"a": {"b": v}})) for i, v in enumerate(VALUES)]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("doc", F.parse_json("t"))
    c = Compiler(VariantFields("doc"))
    tests = [{"a.b": {op: w}} for op, w in OPS] + [{"$not": {"a.b": {op: w}}} for op, w in OPS]
    got = df.select("i", *(F.coalesce(c.compile(t), F.lit(False)).alias(str(n)) for n, t in enumerate(tests))).collect()
    for r in got:
        for n, (op, w) in enumerate(OPS):
            want = holds(VALUES[r["i"]], op, w)
            assert r[str(n)] == want, (VALUES[r["i"]], op, w)
            assert r[str(n + len(OPS))] == (not want), ("not", VALUES[r["i"]], op, w)


@pytest.mark.parametrize("kind,values", [("string", [None, "", "5", "abc", "ab c"]), ("double", [None, 0.0, 5.0, 5.5, -1.0]), ("boolean", [None, True, False])])
def test_typed_operators_against_plain_evaluator(spark, kind, values):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, a {kind}")
    c = Compiler(TypedFields(df))
    ops = [(o, w) for o, w in OPS if o != "$exists" and not (o == "$not" and w == {"$eq": None})]
    got = df.select("i", *(F.coalesce(c.compile({"a": {op: w}}), F.lit(False)).alias(str(n)) for n, (op, w) in enumerate(ops))).collect()
    for r in got:
        for n, (op, w) in enumerate(ops):
            assert r[str(n)] == holds(values[r["i"]], op, w), (values[r["i"]], op, w)


def test_nan_matches_nothing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "i int, a double")
    c = Compiler(TypedFields(df))
    for f, want in (({"a": {"$gt": 1}}, [2]), ({"a": float("nan")}, []), ({"a": {"$ne": 3}}, [1]), ({"a": {"$lte": 5}}, [2])):
        assert [r["i"] for r in df.where(c.compile(f)).collect()] == want


def test_random_trees_agree_in_both_modes(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "a", "b", "7"]), rng.choice([None, 1.0, 7.0, 9.5])) for i in range(60)]
    typed = spark.createDataFrame(rows, "i int, s string, n double")
    both = typed.withColumn("doc", F.parse_json(F.to_json(F.struct("s", "n"))))
    leaf = lambda: rng.choice([{"s": "a"}, {"s": {"$ne": "b"}}, {"n": {"$gt": 5}}, {"n": {"$in": [1, 7]}}, {"s": {"$gte": 7}}, {"n": {"$not": {"$lt": 8}}}])

    def tree(depth):
        if not depth:
            return leaf()
        return rng.choice([lambda: {"$and": [tree(depth - 1), leaf()]}, lambda: {"$or": [tree(depth - 1), leaf()]}, lambda: {"$not": tree(depth - 1)}])()

    trees = [tree(3) for _ in range(12)]
    a, b = Compiler(TypedFields(typed)), Compiler(VariantFields("doc"))
    out = both.select(*(F.coalesce(c.compile(t), F.lit(False)).alias(f"{k}{n}") for n, t in enumerate(trees) for k, c in (("a", a), ("b", b)))).collect()
    for r in out:
        for n, t in enumerate(trees):
            assert r[f"a{n}"] == r[f"b{n}"], t


def test_positive_predicates_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id AS a", "cast(id AS string) AS s").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(finder.resolve(df, {"a": {"$gt": 3}, "s": {"$ne": "4"}}))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,3)" in plan and "Not(EqualNullSafe(s,4))" in plan


def test_errors():
    c = Compiler(VariantFields("doc"))
    for f in ([1], {"$nope": 1}, {"$and": {}}, {"$not": 1}):
        with pytest.raises(ValueError):
            c.compile(f)


def test_compact_language():
    assert parse_compact("") == {}
    assert parse_compact("a:1 b.c:x") == {"$and": [{"a": 1}, {"b.c": "x"}]}
    assert parse_compact("a.gt:5 or b:true and c:null") == {"$or": [{"a": {"$gt": 5}}, {"$and": [{"b": True}, {"c": None}]}]}
    assert parse_compact("+x -y") == {"$and": [{"tags": {"$contains": "x"}}, {"$not": {"tags": {"$contains": "y"}}}]}
    assert parse_compact("quick fix a.in:1,b") == {"$and": [{"$text": "quick fix"}, {"a": {"$in": [1, "b"]}}]}
    assert parse_compact("t.strLen.gt:3") == {"t": {"$strLen": {"$gt": 3}}}
    assert parse_compact("(a:1 or b:2) c.exists:false") == {"$and": [{"$or": [{"a": 1}, {"b": 2}]}, {"c": {"$exists": False}}]}
    for bad in ("(a:1", ")", "a:1 )", "and or"):
        with pytest.raises(ValueError):
            parse_compact(bad)


@pytest.mark.parametrize("p", ["(a+)+", "(a|b)*", "a" * 201, "a**"])
def test_dangerous_patterns(spark, p):
    df = spark.range(1).selectExpr("'x' AS s")
    with pytest.raises(ValueError):
        finder.resolve(df, {"s": {"$regex": p}})
