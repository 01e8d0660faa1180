"""Schemas that drift between versions of a collection: the changes, and one consistent table.

Columns that disappear and columns that appear between two versions are matched by what they hold. Their profiles are value sketches: for each field, of
each of 64 buckets of record ids the value of the record with the lowest hash, so that both versions sample the same records. A sketch is a partial
aggregate and as small for a file with a third of all lines as for any other. Pairs that their sketches rule out beyond doubt are dropped; all others are
counted exactly over all records of both files. Where fields compete, a maximum-weight bipartite matching decides, by shared values first, then equal
type and similar name. Only schemas, never records, are gathered by group.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.joins import lookup
from tessera.functions.matching import assign, name_similarity
from tessera.session import written

BUCKETS = 64
#: A pair is ruled out if records of which half agree would give so few agreeing samples with less than this probability.
HOPELESS = 1e-12
_PAIR = ["coll", "to_version"]


def field_types(defs: Column) -> Column:
    """Map from field name to type, of a JSON object whose values are a type or an object with ``type``; null for text that is no JSON object."""
    return F.transform_values(F.from_json(defs, "map<string,string>"), lambda _, v: F.when(F.ltrim(v).startswith("{"), F.get_json_object(v, "$.type")).otherwise(v))


def versions(defs: DataFrame) -> DataFrame:
    """coll, schema_version, file_name, types: each version as saved last (ties: the higher def_id). Drafts and definitions that can't be read don't count."""
    rows = defs.where(F.col("coll").isNotNull() & F.col("schema_version").isNotNull()).withColumn("types", field_types(F.col("field_defs"))).where("types is not null")
    last = F.max(F.struct("saved_at", "def_id", "field_defs"))
    # file names are the same in all saves; a save without one doesn't hide it
    once = rows.groupBy("coll", "schema_version").agg(last.alias("last"), F.max("file_name").alias("file_name"))
    return once.select("coll", "schema_version", "file_name", field_types(F.col("last.field_defs")).alias("types"))


def version_pairs(vs: DataFrame) -> DataFrame:
    """Each version beside the one before it: coll, to_version, from_file, to_file, old, new (maps of types), gone, come (names)."""
    by = Window.partitionBy("coll").orderBy("schema_version")
    rows = vs.select("coll", F.col("schema_version").alias("to_version"), F.col("file_name").alias("to_file"), F.col("types").alias("new"), F.lag("file_name").over(by).alias("from_file"), F.lag("types").over(by).alias("old"))
    rows = rows.where("old is not null")
    return rows.withColumn("gone", F.array_except(F.map_keys("old"), F.map_keys("new"))).withColumn("come", F.array_except(F.map_keys("new"), F.map_keys("old")))


def records(files: DataFrame, key: str = "_id", *keep: str) -> DataFrame:
    """coll, file_name, rec_id, line_no, row_id, doc (map from name to text: strings as they are, others as JSON). Broken lines and such without id are left out."""
    rows = files.withColumn("doc", F.from_json("raw", "map<string,string>"))
    return rows.select("coll", "file_name", F.col("doc")[key].alias("rec_id"), "line_no", "row_id", "doc", *keep).where("rec_id is not null")


def _values(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Values of fields that went or came: coll, to_version, side, field, rec_id, value; one per record, of its last line that has it."""
    role = lambda side, file, names: F.struct(F.col(file).alias("file_name"), "to_version", F.lit(side).alias("side"), F.col(names).alias("names"))
    both = pairs.where((F.size("gone") > 0) & (F.size("come") > 0))
    roles = both.select("coll", F.explode(F.array(role(0, "from_file", "gone"), role(1, "to_file", "come"))).alias("r")).where("r.file_name is not null")
    roles = roles.groupBy("coll", F.col("r.file_name").alias("file_name")).agg(F.collect_list(F.struct("r.to_version", "r.side", "r.names")).alias("roles"))
    # only lines of the files asked for are parsed
    lines = lookup(files.select("coll", "file_name", "line_no", "row_id", "raw"), roles, ["coll", "file_name"]).where("roles is not null")
    rows = records(lines, "_id", "roles").select("coll", "rec_id", "line_no", "row_id", "doc", F.explode("roles").alias("r"))
    rows = rows.select("coll", "r.to_version", "r.side", "rec_id", "line_no", "row_id", F.explode(F.map_filter("doc", lambda k, v: v.isNotNull() & F.array_contains("r.names", k))).alias("field", "value"))
    return rows.groupBy("coll", "to_version", "side", "field", "rec_id").agg(F.max(F.struct("line_no", "row_id", "value")).alias("v")).select("coll", "to_version", "side", "field", "rec_id", "v.value")


def _sides(rows: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    pick = lambda side, name: rows.where(F.col("side") == side).select(*_PAIR, F.col("field").alias(name), *keep)
    old = pick(0, "gone")
    new = pick(1, "come")
    return old, new.select(*_PAIR, "come", *(F.col(c).alias(f"{c}2") if c == "value" else F.col(c) for c in keep))


def _hopeless() -> list[int]:
    """For 0 to BUCKETS samples: with how few agreeing ones a share of one half is out of the question (-1: with none)."""
    out = []
    for n in range(BUCKETS + 1):
        total, k = 0.0, -1
        while total + math.comb(n, k + 1) * 0.5**n < HOPELESS:
            k += 1
            total += math.comb(n, k) * 0.5**n
        out.append(k)
    return out


def ruled_out(values: DataFrame) -> DataFrame:
    """coll, to_version, gone, come of pairs whose value sketches differ beyond doubt."""
    h = F.xxhash64("rec_id")
    sketch = values.groupBy(*_PAIR, "side", "field", F.pmod(h, F.lit(BUCKETS)).alias("bucket")).agg(F.min(F.struct(h.alias("h"), F.xxhash64("value").alias("v"))).alias("s"))
    old, new = _sides(sketch.select(*_PAIR, "side", "field", F.col("s.h").alias("h"), F.col("s.v").alias("value")), "h", "value")
    agree = old.join(new, [*_PAIR, "h"]).groupBy(*_PAIR, "gone", "come").agg(F.count("*").alias("n"), F.count_if(F.col("value") == F.col("value2")).alias("same"))
    bound = F.element_at(F.array(*map(F.lit, _hopeless())), F.least(F.col("n"), F.lit(BUCKETS)).cast("int") + 1)
    return agree.where(F.col("same") <= bound).select(*_PAIR, "gone", "come")


def _match(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    w = {(r.gone, r.come): 1000 * r.share + r.same_type + 0.5 * name_similarity(r.gone, r.come) for r in pdf.itertuples()}
    return pd.DataFrame([(*key, a, b) for a, b in assign(w)], columns=[*_PAIR, "gone", "come"])


def renames(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """coll, to_version, gone, come: fields renamed from one version to the next.

    Of the records with both values in both files more than half hold the same text; a field is renamed to one other at most.
    """
    values = written(_values(pairs, files), "drift")  # read three times below
    listed = pairs.select(*_PAIR, F.explode("gone").alias("gone"), "come", "old", "new").select(*_PAIR, "gone", F.explode("come").alias("come"), (F.col("old")[F.col("gone")]).alias("t1"), "new")
    listed = listed.select(*_PAIR, "gone", "come", F.coalesce(F.col("t1") == F.col("new")[F.col("come")], F.lit(False)).cast("int").alias("same_type"))
    open_ = listed.join(ruled_out(values), [*_PAIR, "gone", "come"], "left_anti")
    partners = open_.groupBy(*_PAIR, "gone").agg(F.collect_set("come").alias("partners"))
    old, new = _sides(values, "rec_id", "value")
    asked = lookup(old, partners, [*_PAIR, "gone"]).select(*_PAIR, "gone", F.explode("partners").alias("come"), "rec_id", "value")
    counts = asked.join(new, [*_PAIR, "come", "rec_id"]).groupBy(*_PAIR, "gone", "come").agg(F.count("*").alias("n"), F.count_if(F.col("value") == F.col("value2")).alias("same"))
    edges = counts.where("2 * same > n").select(*_PAIR, "gone", "come", (F.col("same") / F.col("n")).alias("share"))
    # competing fields only go through the matching; schemas are small, so these groups are
    rivals = lambda c: F.count("*").over(Window.partitionBy(*_PAIR, c))
    edges = edges.withColumn("_r", F.greatest(rivals("gone"), rivals("come"))).join(listed, [*_PAIR, "gone", "come"])
    crowd = edges.withColumn("_m", F.max("_r").over(Window.partitionBy(*_PAIR)))
    alone = crowd.where("_m = 1").select(*_PAIR, "gone", "come")
    matched = crowd.where("_m > 1").groupBy(*_PAIR).applyInPandas(_match, "coll string, to_version int, gone string, come string")
    return alone.unionByName(matched)


def schema_changes(defs: DataFrame, files: DataFrame) -> DataFrame:
    """Every difference of a version to the one before: coll, to_version, change_kind, field_name, new_field.

    No two versions of a collection: no rows for it. Records are only needed to tell renames; without files, renamed fields are removed and added ones.
    """
    pairs = written(version_pairs(versions(defs)), "versions")  # schemas only; read in every step
    named = renames(pairs, files).groupBy(*_PAIR).agg(F.collect_list(F.struct("gone", "come")).alias("named"))
    rows = pairs.join(named, _PAIR, "left").withColumn("named", F.coalesce("named", F.array().cast("array<struct<gone:string,come:string>>")))
    change = lambda kind, name, new: F.struct(F.lit(kind).alias("change_kind"), name.alias("field_name"), new.alias("new_field"))
    none = F.lit("")
    gone = F.array_except("gone", F.transform("named", lambda x: x["gone"]))
    come = F.array_except("come", F.transform("named", lambda x: x["come"]))
    kept = F.filter(F.array_intersect(F.map_keys("old"), F.map_keys("new")), lambda k: ~F.col("old")[k].eqNullSafe(F.col("new")[k]))
    retyped = F.transform(F.filter("named", lambda x: ~F.col("old")[x["gone"]].eqNullSafe(F.col("new")[x["come"]])), lambda x: x["come"])
    every = F.concat(
        F.transform(gone, lambda k: change("removed", k, none)),
        F.transform(come, lambda k: change("added", k, none)),
        F.transform("named", lambda x: change("renamed", x["gone"], x["come"])),
        F.transform(F.concat(kept, retyped), lambda k: change("type_changed", k, none)),
    )
    return rows.select(*_PAIR, F.explode(every).alias("c")).select(*_PAIR, "c.*")


def _canonical(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Names of the fields of every version in the last one: renames are followed from the last version back."""
    names: dict[str, str] = {}
    out = []
    for r in pdf.sort_values("schema_version", ascending=False).itertuples():
        out += [(key[0], r.schema_version, r.file_name, f, names.get(f, f)) for f in r.fields]
        back = dict(zip(r.come, r.gone))
        known = {f: names.get(f, f) for f in sorted({*r.fields, *names})}
        # a name that is given up here, and used again later, means the renamed field before
        names = {f: n for f, n in known.items() if f not in back} | {back[f]: known[f] for f in sorted(back)}
    return pd.DataFrame(out, columns=["coll", "schema_version", "file_name", "field", "canonical"])


def unify(defs: DataFrame, files: DataFrame) -> DataFrame:
    """One table of all records, each as in the highest version that has it: coll, rec_id, schema_version, fields (map from the last name of a field to text).

    Only fields of the version's schema are kept. Of two fields with one last name, that of the lower name holds.
    """
    vs, recs = written(versions(defs), "versions"), records(files)
    named = renames(written(version_pairs(vs), "versions"), files).groupBy("coll", F.col("to_version").alias("schema_version")).agg(F.sort_array(F.collect_list(F.struct("come", "gone"))).alias("n"))
    empty = F.array().cast("array<string>")
    rows = vs.join(named, ["coll", "schema_version"], "left").select("coll", "schema_version", "file_name", F.map_keys("types").alias("fields"), F.coalesce("n.come", empty).alias("come"), F.coalesce("n.gone", empty).alias("gone"))
    names = rows.groupBy("coll").applyInPandas(_canonical, "coll string, schema_version int, file_name string, field string, canonical string")
    names = names.where("file_name is not null").groupBy("coll", "file_name").agg(F.max("schema_version").alias("schema_version"), F.sort_array(F.collect_set(F.struct("field", "canonical"))).alias("names"))
    known = lookup(recs, names, ["coll", "file_name"]).where("names is not null")
    pairs = F.filter(F.transform("names", lambda n: F.struct(n["canonical"].alias("k"), F.col("doc")[n["field"]].alias("v"))), lambda e: e["v"].isNotNull())
    first = F.filter(pairs, lambda e, i: F.array_position(F.transform(pairs, lambda x: x["k"]), e["k"]) == i + 1)
    whole = known.select("coll", "rec_id", "schema_version", "line_no", "row_id", first.alias("f"))
    last = whole.groupBy("coll", "rec_id").agg(F.max(F.struct("schema_version", "line_no", "row_id", "f")).alias("r"))
    return last.select("coll", "rec_id", "r.schema_version", F.map_from_entries("r.f").alias("fields"))
