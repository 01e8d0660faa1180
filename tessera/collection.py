"""Collections of JSON records on an append-only log of Parquet commits.

A collection is a folder: ``ops/`` holds commits, each the operations of one writer at one sequence number; ``base/`` the state as of some commits, a row
per record, with indexed fields in columns of their own; ``delta/`` what later compactions folded without rewriting the base; ``manifest.json`` names the
current ones and the commits they hold. Readers take base rows whose keys no later part has (an anti-join with few keys) and the last operation of every
later key, so a filter on an indexed field reaches the base files' statistics, and a compaction or another writer never changes a file that is read.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import documents as docs_
from tessera.functions.embedding import EmbeddingProvider, embed_column
from tessera.functions.filters import ColumnFields, VariantFields
from tessera.functions.joins import BROADCAST_ROWS
from tessera.operators import find as finder
from tessera.operators import fusion, knn, oplog, schema as schemas, text, updates
from tessera.session import written
from tessera.sources.files import Files, blobs

_OPS = "seq long, writer string, n long, ts timestamp, op string, _id string, _version long, _agent string, _reason string, _expires long, _embedding struct<data:array<tinyint>,scale:double>, doc string"
_TYPES = {"_version": "long", "_agent": "string", "_reason": "string", "_expires": "long", "_embedding": "struct<data:array<tinyint>,scale:double>", "doc": "string"}
_NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9_-]*$")
_COMMIT = re.compile(r"^c-(\d{12})(?:~([A-Za-z0-9_-]*))?$")
#: A commit folds the log after so many unfolded ones; into a new base after so many deltas (fixed values).
COMPACT_AFTER, FULL_AFTER = 8, 10
#: Ids handed to a listener in one event, at most; a larger commit gives several events.
EVENT_IDS = 1000
_META = ("_version", "_agent", "_reason", "_expires", "_embedding")


def check_name(name: str) -> str:
    if not _NAME.match(name):
        raise ValueError(f"Invalid name: {name}")
    return name


class Group:
    """Records that are committed together: at the latest after ``most`` of them or ``seconds``, and at the end. A crash loses what wasn't committed."""

    def __init__(self, collection: Collection, most: int = 50, seconds: float = 0.1):
        self.collection, self.most, self.seconds = collection, most, seconds
        self.waiting: list[dict] = []
        self.since = time.monotonic()

    def insert(self, doc: Mapping[str, Any]) -> str:
        """The record's id; the record is seen by readers once the group is committed."""
        record = {**doc, "_id": str(doc.get("_id") or uuid.uuid4())}
        if not self.waiting:
            self.since = time.monotonic()
        self.waiting.append(record)
        if len(self.waiting) >= self.most or time.monotonic() - self.since >= self.seconds:
            self.flush()
        return record["_id"]

    def flush(self) -> None:
        some, self.waiting = self.waiting, []
        if some:
            self.collection.insert_many(some)

    def __enter__(self) -> Group:
        return self

    def __exit__(self, kind: Any, *_: Any) -> None:
        if kind is None:
            self.flush()


class Collection:
    """One collection. ``writer`` names this writer's commits; several writers may append at once, and their commits are ordered by number, then writer."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: Mapping[str, Any] | None = None, provider: EmbeddingProvider | None = None, read_only: bool = False, writer: str = ""):
        self.spark, self.name, self.schema_def, self.provider, self.read_only, self.writer = spark, check_name(name), schema, provider, read_only, writer and check_name(writer)
        self.files = Files(spark, f"{root.rstrip('/')}/{name}")
        self.virtual: dict[str, Callable[[Any], Column]] = {}
        self.getters: dict[str, str] = {}
        self.computed: dict[str, Column] = {}
        self.over_all: list[Callable[[DataFrame], DataFrame]] = []
        self.validators: list[Callable[[Column], Column]] = []
        self.views: dict[str, tuple[Any, dict]] = {}
        self._cached: dict[str, tuple[Any, finder.FindResult]] = {}
        self.listeners: list[Callable[[dict], None]] = []
        self.hooks: dict[str, Callable[[DataFrame], None]] = {}
        self.queried: dict[str, int] = {}
        self.tag_field = (schema or {}).get("tagField", "tags")

    # the log

    def _commits(self) -> list[str]:
        """Whole commits in their order."""
        return sorted(n for n in self.files.names("ops") if _COMMIT.match(n) and self.files.exists(f"ops/{n}/_SUCCESS"))

    def manifest(self) -> dict:
        """base, deltas, folded (commits that these hold), columns (indexed field -> kind), rows, cardinality, text (n, total), ts."""
        if not self.files.exists("manifest.json"):
            return {"base": None, "deltas": [], "folded": [], "columns": {}, "rows": 0}
        return json.loads(self.files.read("manifest.json"))

    def seq(self) -> int:
        """Number of the last commit."""
        m = self.manifest()
        return max((int(_COMMIT.match(n)[1]) for n in [*self._commits(), *m["folded"][-1:]]), default=0)

    def _state(self) -> tuple:
        return self.manifest().get("base"), tuple(self._commits())

    def _read(self, paths: list[str], schema: str = _OPS) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.files.root}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], schema)

    def ops(self) -> DataFrame:
        """All operations that the log holds."""
        return self._read([f"ops/{n}" for n in self._commits()])

    def _later(self, m: dict) -> DataFrame:
        """The last operation of every key after the base."""
        folded = set(m["folded"])
        rows = self._read([*m["deltas"], *(f"ops/{n}" for n in self._commits() if n not in folded)])
        return oplog.state(rows.withColumn("at", F.struct("seq", "writer", "n")), seq="at", keep_deleted=True).drop("at")

    def _base(self, m: dict, later: DataFrame) -> DataFrame | None:
        """Base rows that hold, with their indexed columns."""
        if not m["base"]:
            return None
        columns = ", ".join(f"`{kind[:3]}:{f}` {kind}, `is:{f}` string" for f, kind in m["columns"].items())
        rows = self._read([m["base"]], f"{_OPS}, _dl int" + (f", {columns}" if columns else ""))
        keys = later.select("_id")
        raw = m["deltas"] + [f"ops/{n}" for n in self._commits() if n not in set(m["folded"])]
        if not raw:
            return rows
        # a count of rows is read from the footers
        few = self._read(raw).count() <= BROADCAST_ROWS
        return rows.join(F.broadcast(keys) if few else keys, "_id", "left_anti")

    def stored(self) -> DataFrame:
        """Last state of every record, expired ones too, with its metadata."""
        m = self.manifest()
        later = self._later(m)
        base = self._base(m, later)
        new = later.where("op = 'set'")
        return new if base is None else base.select(*new.columns).unionByName(new)

    def _guard(self) -> None:
        if self.read_only:
            raise PermissionError("The database is read-only")

    def _commit(self, rows: DataFrame, kind: str, auto: bool = True) -> str:
        """Append operations (op, _id and fields) as one commit, all or nothing; its name."""
        self._guard()
        number = self.seq() + 1
        have = set(rows.columns)
        name = f"c-{number:012d}" + (f"~{self.writer}" if self.writer else "")
        fields = ((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in _TYPES.items())
        full = rows.select(F.lit(number).cast("long").alias("seq"), F.lit(self.writer).alias("writer"), (F.col("n") if "n" in have else F.lit(0)).cast("long").alias("n"), F.current_timestamp().alias("ts"), "op", "_id", *fields)
        full.write.mode("error").parquet(f"{self.files.root}/ops/{name}")
        self._tell(name, kind, number)
        if auto and self.should_compact():
            self.compact()
        return name

    def _tell(self, name: str, kind: str, number: int) -> None:
        """Events of a commit: EVENT_IDS ids each, until all were handed over."""
        if not self.listeners:
            return
        some: list[str] = []

        def hand() -> None:
            for f in list(self.listeners):
                f({"type": kind, "collection": self.name, "ids": some, "seq": number})

        for r in self._read([f"ops/{name}"]).select("_id").toLocalIterator():
            some.append(r["_id"])
            if len(some) == EVENT_IDS:
                hand()
                some = []
        if some:
            hand()

    # compaction and indexes

    def _settings(self) -> dict:
        have = json.loads(self.files.read("indexes.json")) if self.files.exists("indexes.json") else {}
        s = self.schema_def or {}
        base = {"fields": [[f] for f in s.get("indexes") or []] + [list(x) for x in s.get("compositeIndexes") or []], "arrays": list(s.get("arrayIndexes") or []), "bloom": {}, "text": False}
        return {"fields": [*base["fields"], *(x for x in have.get("fields", []) if x not in base["fields"])], "arrays": sorted({*base["arrays"], *have.get("arrays", [])}), "bloom": have.get("bloom", {}), "text": have.get("text", False)}

    def _set_settings(self, s: dict) -> None:
        self._guard()
        self.files.write("indexes.json", json.dumps(s, sort_keys=True).encode())

    def create_index(self, *fields: str) -> None:
        """From the next full compaction on the base holds the fields in columns of their own and is ordered by them, so that statistics of its files prune."""
        if not fields:
            raise ValueError("an index needs a field")
        s = self._settings()
        if list(fields) not in s["fields"]:
            s["fields"].append(list(fields))
            self._set_settings(s)

    def drop_index(self, *fields: str) -> bool:
        s = self._settings()
        found = list(fields) in s["fields"]
        if found:
            s["fields"].remove(list(fields))
            self._set_settings(s)
        return found

    def list_indexes(self) -> dict:
        """Indexed fields, arrays, bloom filters, and whether texts are."""
        s = self._settings()
        return {"fields": s["fields"], "arrays": s["arrays"], "bloom": sorted(s["bloom"]), "text": s["text"]}

    def create_array_index(self, name: str) -> None:
        """From the next full compaction on a table of (element, id) serves ``$contains`` on the field."""
        s = self._settings()
        self._set_settings(s | {"arrays": sorted({*s["arrays"], name})})

    def create_text_index(self) -> None:
        """From the next full compaction on postings are stored, ordered by term."""
        self._set_settings(self._settings() | {"text": True})

    def suggest_indexes(self, threshold: int = 100) -> list[dict]:
        return [{"field": f, "count": n} for f, n in sorted(self.queried.items(), key=lambda x: (-x[1], x[0])) if n >= threshold]

    def should_compact(self) -> bool:
        folded = set(self.manifest()["folded"])
        return sum(n not in folded for n in self._commits()) >= COMPACT_AFTER

    def compact(self, full: bool | None = None) -> None:
        """Fold the commits: into one delta of their last operations, or, if ``full`` (by default the first time and after FULL_AFTER deltas), into a new base.

        Then what no reader of the last two manifests needs is deleted. Commits stay, as the history; ``vacuum`` deletes them.
        """
        self._guard()
        m, commits = self.manifest(), self._commits()
        new = [n for n in commits if n not in set(m["folded"])]
        if full is None:
            full = not m["base"] or len(m["deltas"]) >= FULL_AFTER
        if not new and not (full and (m["deltas"] or m["base"])):
            return
        stamp = f"{self.seq():012d}-{uuid.uuid4().hex[:8]}"
        if full:
            m = self._fold(m, stamp)
        else:
            rows = oplog.state(self._read([f"ops/{n}" for n in new]).withColumn("at", F.struct("seq", "writer", "n")), seq="at", keep_deleted=True).drop("at")
            rows.write.parquet(f"{self.files.root}/delta/d-{stamp}")
            m["deltas"] = [*m["deltas"], f"delta/d-{stamp}"]
        m |= {"folded": sorted({*m["folded"], *new}), "ts": time.time(), "old": self._live_paths(self.manifest())}
        self.files.write("manifest.json", json.dumps(m).encode())
        keep = {*self._live_paths(m), *m["old"]}
        for folder in ("base", "delta", "postings", "arrays"):
            for n in self.files.names(folder):
                if f"{folder}/{n}" not in keep:
                    self.files.delete(f"{folder}/{n}")

    @staticmethod
    def _live_paths(m: dict) -> list[str]:
        return [p for p in (m["base"], m.get("postings"), m.get("elements"), *m["deltas"]) if p]

    def _fold(self, m: dict, stamp: str) -> dict:
        """Write a new base with its columns, postings and elements; its manifest."""
        s = self._settings()
        wanted = sorted({f for i in s["fields"] for f in i} | set(s["bloom"]))
        rows = written(self.stored().select(*[c.split()[0] for c in re.sub(r"<[^>]*>", "", _OPS).split(", ")]), "fold") if wanted or s["text"] or s["arrays"] else self.stored()
        variant = rows.withColumn("text", F.col("doc")).withColumn("doc", F.parse_json("doc"))
        columns: dict[str, str] = {}
        stats: dict[str, int] = {}
        if wanted:
            refs = {f: VariantFields("doc").ref(f) for f in wanted}
            kinds = {"string": "string", "number": "double", "boolean": "boolean"}
            aggs = [F.count_if(r.values[k].isNotNull()).alias(f"{k}:{i}") for i, r in enumerate(refs.values()) for k in kinds]
            aggs += [F.count_if(r.exists & ~r.null).alias(f"there:{i}") for i, r in enumerate(refs.values())]
            # distinct texts; null and missing are one value
            aggs += [F.count_distinct(F.coalesce(r.values["string"], r.values["number"].cast("string"), r.values["boolean"].cast("string"), F.lit("null"))).alias(f"card:{i}") for i, r in enumerate(refs.values())]
            got = variant.agg(*aggs).collect()[0].asDict()
            for i, f in enumerate(wanted):
                stats[f] = got[f"card:{i}"]
                one = [k for k in kinds if got[f"{k}:{i}"] == got[f"there:{i}"]]
                if one:  # all values of one kind; else the field stays in the document only
                    columns[f] = one[0] if got[f"there:{i}"] else "string"
            for f, k in columns.items():
                r = refs[f]
                variant = variant.withColumn(f"{kinds[k][:3]}:{f}", r.values[k]).withColumn(f"is:{f}", F.when(r.exists, F.when(r.null, F.lit("null")).otherwise(F.lit("value"))))
            columns = {f: kinds[k] for f, k in columns.items()}
        length = F.size(text.terms(self._searchable())) if s["text"] else F.lit(None)
        variant = variant.withColumn("_dl", length.cast("int"))
        out = variant.withColumn("doc", F.col("text")).drop("text")
        order = [F.col(f"`{columns[f][:3]}:{f}`") for i in s["fields"][:1] for f in i if f in columns]
        if order:
            out = out.repartitionByRange(*order).sortWithinPartitions(*order)
        writer = out.write
        for f in s["bloom"]:
            if f in columns:
                writer = writer.option(f"parquet.bloom.filter.enabled#{columns[f][:3]}:{f}", "true")
        writer.parquet(f"{self.files.root}/base/b-{stamp}")
        m = {"base": f"base/b-{stamp}", "deltas": [], "folded": m["folded"], "columns": columns, "cardinality": stats, "rows": self._read([f"base/b-{stamp}"]).count()}
        if s["text"]:
            p = text.postings(variant, self._searchable(), "_id")
            p.repartitionByRange("term").sortWithinPartitions("term", "id").write.parquet(f"{self.files.root}/postings/p-{stamp}")
            total = variant.agg(F.coalesce(F.sum(F.greatest("_dl", F.lit(0))), F.lit(0)).alias("t")).collect()[0]["t"]
            m |= {"postings": f"postings/p-{stamp}", "total": total, "searchable": self._searchable_fields()}
        if s["arrays"]:
            each = None
            for f in s["arrays"]:
                items = F.try_variant_get("doc", f"$.{f}", "array<variant>")
                one = variant.select(F.lit(f).alias("field"), F.explode(F.array_distinct(F.transform(items, lambda e: F.to_json(e)))).alias("element"), "_id")
                each = one if each is None else each.unionByName(one)
            each.repartitionByRange("field", "element").sortWithinPartitions("field", "element").write.parquet(f"{self.files.root}/arrays/a-{stamp}")
            m |= {"elements": f"arrays/a-{stamp}", "arrays": s["arrays"]}
        for f in s["bloom"]:
            self._write_bloom(f, s["bloom"][f], variant)
        return m

    def vacuum(self) -> int:
        """Delete the commits that a base or delta holds, and with them their history; their number."""
        self._guard()
        gone = [n for n in self._commits() if n in set(self.manifest()["folded"])]
        for n in gone:
            self.files.delete(f"ops/{n}")
        return len(gone)

    # reading

    def _parsed(self, rows: DataFrame, live: bool = True) -> DataFrame:
        rows = finder.live(rows) if live else rows
        return rows.withColumn("text", F.col("doc")).withColumn("doc", F.parse_json("doc"))

    def _docs(self, live: bool = True) -> DataFrame:
        return self._parsed(self.stored(), live)

    def find_all(self) -> DataFrame:
        """_id, _version, doc (VARIANT) of all live records."""
        return self._docs().select("_id", "_version", "doc")

    def iterate(self) -> Iterator[dict]:
        """Live records one after another, without gathering them."""
        for r in finder.live(self.stored()).select("_id", "_version", "doc").toLocalIterator():
            yield {"_id": r["_id"], "_version": r["_version"], **json.loads(r["doc"])}

    def find_one(self, record: str) -> dict | None:
        rows = self.by_ids([record]).take(1)
        return {"_id": rows[0]["_id"], "_version": rows[0]["_version"], **json.loads(rows[0]["text"])} if rows else None

    def by_ids(self, ids: DataFrame | Iterable[str]) -> DataFrame:
        """_id, _version, doc, text of the live records with the ids: a list, which reaches the scan, or the column _id of a table of any size."""
        m = self.manifest()
        later = self._later(m)
        base = self._base(m, later)
        pick = (lambda rows: rows.join(ids.select("_id").distinct(), "_id", "left_semi")) if isinstance(ids, DataFrame) else (lambda rows, some=list(ids): rows.where(F.col("_id").isin(some)))
        new = pick(later.where("op = 'set'"))
        rows = new if base is None else pick(base).select(*new.columns).unionByName(new)
        return self._parsed(rows).select("_id", "_version", "doc", "text")

    def _searchable_fields(self) -> list[str]:
        return [n for n, f in ((self.schema_def or {}).get("fields") or {}).items() if f.get("searchable")]

    def _searchable(self) -> Column:
        names = self._searchable_fields()
        if names:
            one = lambda n: F.coalesce(F.array_join(F.try_variant_get("doc", f"$.{n}", "array<string>"), " "), F.try_variant_get("doc", f"$.{n}", "string"), F.lit(""))
            return F.concat_ws(" ", *map(one, names))
        # every text in the record, at any depth; a key is a text before a colon
        texts = F.filter(F.regexp_extract_all("text", F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0)), lambda x: ~x.endswith(":"))
        return F.array_join(F.transform(texts, lambda x: F.try_variant_get(F.parse_json(x), "$", "string")), " ")

    def _how(self) -> dict:
        return {"variant": "doc", "virtual": self.virtual, "tag_field": self.tag_field, "searchable": self._searchable()}

    def _note(self, where: Any) -> None:
        if isinstance(where, Mapping):
            for k in where:
                if not k.startswith(("$", "+")):
                    self.queried[k] = self.queried.get(k, 0) + 1

    def define_virtual(self, name: str, predicate: Callable[[Any], Column], getter: str | None = None) -> None:
        """A filter ``+name``: a predicate over the fields. With ``getter``, a field that holds another record's id, that record is the VARIANT column ``_<name>``."""
        self.virtual[name] = predicate
        if getter:
            self.getters[name] = getter

    def define_computed(self, name: str, value: Column, over_all: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """A field added to pages. ``over_all`` turns all records (_id, _version, doc) into one row whose columns ``value`` may use."""
        self.computed[name] = value
        if over_all:
            self.over_all.append(over_all)

    def _looked_up(self, rows: DataFrame, where: Any) -> DataFrame:
        """With the records that the virtual filters in use look up."""
        for name, field in self.getters.items():
            if isinstance(where, Mapping) and f"+{name}" in where:
                other = self.find_all().select(F.col("_id").alias(f"_key_{name}"), F.col("doc").alias(f"_{name}"))
                rows = rows.withColumn(f"_ref_{name}", F.try_variant_get("doc", f"$.{field}", "string")).join(other, F.col(f"_ref_{name}") == F.col(f"_key_{name}"), "left")
        return rows

    def matching(self, where: Any) -> DataFrame:
        """_id, _version, _embedding, doc (VARIANT), text and metadata of the live records that match; base files are pruned by their indexed columns."""
        self._note(where)
        m = self.manifest()
        later = self._later(m)
        base = self._base(m, later)
        names = [c for c in later.columns if c not in ("seq", "writer", "n", "ts", "op")] + ["text"]

        def hits(rows: DataFrame, fields: VariantFields) -> DataFrame:
            rows = self._looked_up(self._parsed(rows), where)
            return rows.where(finder.resolve(rows, where, fields=fields, **self._how())).select(*names)

        new = hits(later.where("op = 'set'"), VariantFields("doc", finder.BESIDE))
        if base is None:
            return new
        for f, element in self._element_filters(m, where):
            keys = self._elements(m, f, element)
            base = base.join(keys, "_id", "left_semi")
        return hits(base, ColumnFields("doc", finder.BESIDE, m["columns"])).unionByName(new)

    @staticmethod
    def _element_filters(m: dict, where: Any) -> list[tuple[str, Any]]:
        if not isinstance(where, Mapping):
            return []
        return [(f, v["$contains"]) for f, v in where.items() if f in m.get("arrays", []) and isinstance(v, Mapping) and set(v) == {"$contains"} and isinstance(v["$contains"], (int, float, bool))]

    def _elements(self, m: dict, field: str, element: Any) -> DataFrame:
        rows = self._read([m["elements"]], "field string, element string, _id string")
        return rows.where((F.col("field") == field) & (F.col("element") == json.dumps(element))).select("_id")

    def ids_containing(self, field: str, element: Any) -> DataFrame:
        """_id of the live records whose array field holds the element."""
        m = self.manifest()
        p = VariantFields("doc").ref(field).holds(element)
        later = self._later(m)
        new = self._parsed(later.where("op = 'set'")).where(p).select("_id")
        base = self._base(m, later)
        if base is None:
            return new
        if field in m.get("arrays", []):
            return finder.live(base).join(self._elements(m, field, element), "_id", "left_semi").select("_id").unionByName(new)
        return self._parsed(base).where(p).select("_id").unionByName(new)

    def find(self, where: Any = None, **opts: Any) -> finder.FindResult:
        """A page of records (_id, _version, doc); options as of ``operators.find.find``."""
        rows, computed = self.matching(where).select("_id", "_version", "doc"), dict(self.computed)
        for over in self.over_all:
            rows = rows.crossJoin(F.broadcast(over(self.find_all()).limit(1)))  # one row
        r = finder.find(rows, None, computed=computed, variant="doc", **opts)
        r.records = r.records.select("_id", "_version", "doc", *computed)
        return r

    def count(self, where: Any = None) -> int:
        return self.matching(where).count()

    def distinct_values(self, name: str) -> DataFrame:
        """``value``: the distinct values of a field as JSON text."""
        return finder.distinct(self._docs(), name, "doc")

    def distinct(self, name: str) -> dict:
        """The distinct values of a field in memory; ``distinct_values`` has them as a table of any size."""
        values = [json.loads(r["value"]) for r in self.distinct_values(name).orderBy("value").toLocalIterator()]
        return {"field": name, "values": values, "count": len(values)}

    def stats(self) -> dict:
        m = self.manifest()
        return {"activeRecords": self.count(), "opsCount": self.ops().count(), "commits": self.seq(), "textTerms": m.get("total", 0)}

    def schema(self, size: int = 50) -> DataFrame:
        return schemas.sample_fields(self._docs(), "doc", size)

    # writing

    def _frame(self, docs: list[Mapping[str, Any]] | DataFrame) -> DataFrame:
        """_id, doc (JSON text), n of records; a record without _id gets one."""
        if isinstance(docs, DataFrame):
            rest = [c for c in docs.columns if c not in docs_.META_FIELDS]
            return docs.select(F.coalesce(F.col("_id").cast("string"), F.expr("uuid()")).alias("_id"), F.to_json(F.struct(*rest)).alias("doc"), F.lit(0).cast("long").alias("n"))
        rows = [(str(d.get("_id") or uuid.uuid4()), json.dumps({k: v for k, v in d.items() if k not in docs_.META_FIELDS}), i) for i, d in enumerate(docs)]
        return self.spark.createDataFrame(rows, "_id string, doc string, n long")

    def _prepared(self, rows: DataFrame, fill: bool) -> DataFrame:
        """Rows (_id, doc, n) with resolved values, defaults and numbers filled in, after all were validated."""
        s = self.schema_def
        if s is None and not self.validators:
            return rows
        fields = (s or {}).get("fields") or {}
        m = docs_.as_map(F.parse_json("doc"))
        if fill and any("resolve" in f or "default" in f for f in fields.values()):
            rows = rows.withColumn("doc", docs_.from_map(schemas.filled(m, s)))
        for name in (n for n, f in fields.items() if f["type"] == "autoIncrement" and fill):
            rows = self._numbered(rows, name)
        checked = schemas.doc_violations(rows, m, s or {}, tuple(self.validators))
        bad = checked.select(F.explode("violations").alias("v")).distinct().limit(10).collect()
        if bad:
            raise ValueError("; ".join(sorted(r["v"] for r in bad)))
        return rows

    def _numbered(self, rows: DataFrame, name: str) -> DataFrame:
        """Missing numbers of an auto-increment field follow the highest one, in the order of the rows."""
        top = self._docs(False).agg(F.max(F.try_variant_get("doc", f"$.{name}", "long")).alias("m")).collect()[0]["m"] or 0
        rows = written(rows.withColumn("_missing", ~F.map_contains_key(docs_.as_map(F.parse_json("doc")), name)).withColumn("_at", F.monotonically_increasing_id()), "numbered")
        # numbers run on from partition to partition: a row per partition tells where
        part = F.shiftright("_at", 33)
        counts = sorted((r["p"], r["c"]) for r in rows.groupBy(part.alias("p")).agg(F.count_if("_missing").alias("c")).collect())
        begin = self.spark.createDataFrame([(p, top + sum(c for _, c in counts[:i])) for i, (p, _) in enumerate(counts)], "_p long, _begin long")
        nth = F.sum(F.col("_missing").cast("long")).over(Window.partitionBy("_p").orderBy("n", "_at"))
        rows = rows.withColumn("_p", part).join(F.broadcast(begin), "_p").withColumn("_n", F.col("_begin") + nth)
        new = docs_.from_map(docs_.put(docs_.as_map(F.parse_json("doc")), name, F.col("_n").cast("variant")))
        return rows.withColumn("doc", F.when(F.col("_missing"), new).otherwise(F.col("doc"))).select("_id", "doc", "n")

    def _set(self, rows: DataFrame, kind: str, agent: str | None = None, reason: str | None = None, ttl: int | None = None, expected_version: int | None = None) -> DataFrame:
        """Commit rows (_id, doc, n) as sets with the next versions; returns (_id, action) as it was before."""
        self._guard()
        rows = self._prepared(rows, kind in ("insert", "upsert"))
        keep = kind == "update"
        old = self.stored().select("_id", F.col("_version").alias("_old"), *((F.col("_embedding").alias("_vec"), F.col("doc").alias("_doc")) if keep else ()))
        rows = rows.join(old, "_id", "left")
        if expected_version is not None and rows.where(F.col("_old").isNotNull() & (F.col("_old") != expected_version)).limit(1).count():
            raise ValueError(f"Version conflict: expected {expected_version}")
        before = self.hooks.get("beforeInsert") if kind == "insert" else None
        if before:
            before(rows.select("_id", "doc", "n"))
        until = F.lit(int(time.time() * 1000) + ttl).cast("long") if ttl else F.lit(None).cast("long")
        vector = F.lit(None)
        if keep:  # a vector lasts as long as the text it was made from
            words = lambda c: self._text_of(F.col(c))
            vector = F.when(words("doc") == words("_doc"), F.col("_vec"))
        out = rows.select("_id", "n", "doc", F.lit("set").alias("op"), (F.coalesce("_old", F.lit(0)) + 1).alias("_version"), F.lit(agent).alias("_agent"), F.lit(reason).alias("_reason"), until.alias("_expires"), vector.alias("_embedding"))
        name = self._commit(out, kind)
        done = self._read([f"ops/{name}"])
        after = self.hooks.get({"insert": "afterInsert", "upsert": "afterInsert", "update": "afterUpdate"}[kind])
        if after:
            after(done)
        return done.select("_id", F.when(F.col("_version") > 1, "updated").otherwise("inserted").alias("action"))

    def _text_of(self, doc: Column) -> Column:
        """Searchable text of a document that isn't a column of the usual name."""
        names = self._searchable_fields()
        if names:
            return F.concat_ws(" ", *(F.coalesce(F.get_json_object(doc, f"$.{n}"), F.lit("")) for n in names))
        return F.array_join(F.filter(F.regexp_extract_all(doc, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0)), lambda x: ~x.endswith(":")), " ")

    def insert(self, doc: Mapping[str, Any], **mut: Any) -> str:
        return self.insert_many([doc], **mut)[0]

    def insert_many(self, docs: list[Mapping[str, Any]], **mut: Any) -> list[str]:
        """Ids of the records, written in one commit after all were validated; an existing id is replaced."""
        docs = [{**d, "_id": str(d.get("_id") or uuid.uuid4())} for d in docs]
        self._set(self._frame(docs), "insert", **mut)
        return [d["_id"] for d in docs]

    def group(self, most: int = 50, seconds: float = 0.1) -> Group:
        """A writer of single records whose commits are shared."""
        return Group(self, most, seconds)

    def append(self, docs: DataFrame, **mut: Any) -> None:
        """Insert the rows of a DataFrame of any size."""
        self._set(self._frame(docs), "insert", **mut)

    def upsert(self, record: str, doc: Mapping[str, Any], **mut: Any) -> dict:
        return self.upsert_many([{**doc, "_id": record}], **mut)[0]

    def upsert_many(self, docs: list[Mapping[str, Any]] | DataFrame, **mut: Any) -> list[dict]:
        """Replace whole records; the action taken for each (for a DataFrame none are gathered)."""
        if isinstance(docs, DataFrame):
            self._set(self._frame(docs), "upsert", **mut)
            return []
        if any(not d.get("_id") for d in docs):
            raise ValueError("upsert needs _id")
        return [{"id": r["_id"], "action": r["action"]} for r in self._set(self._frame(docs), "upsert", **mut).collect()]

    def update(self, where: Any, ops: Mapping[str, Mapping], expected_version: int | None = None, **mut: Any) -> int:
        """Number of records updated by $set, $unset, $inc, $push."""
        rows = self.matching(where)
        new = rows.select("_id", docs_.from_map(updates.fold_update(docs_.as_map(F.col("doc")), ops)).alias("doc"), F.lit(0).cast("long").alias("n"))
        return self._set(new, "update", expected_version=expected_version, **mut).count()

    def migrate(self, where: Any, ops: list[Mapping[str, Any]], dry_run: bool = False, **mut: Any) -> dict:
        """Ordered operations on the matching records: scanned, updated, unchanged. Fields that no operation names keep their values and types."""
        rows = self.matching(where)
        m = docs_.as_map(F.col("doc"))
        both = written(rows.select("_id", docs_.from_map(m).alias("_old"), docs_.from_map(updates.fold_migrate(m, ops)).alias("doc"), F.lit(0).cast("long").alias("n")), "migrate")
        got = both.agg(F.count("*").alias("scanned"), F.count_if(F.col("_old") != F.col("doc")).alias("updated")).collect()[0].asDict()
        if got["updated"] and not dry_run:
            self._set(both.where("_old <> doc").drop("_old"), "update", **mut)
        return {**got, "unchanged": got["scanned"] - got["updated"]}

    def remove(self, where: Any, kind: str = "delete") -> int:
        """Number of records deleted; their blobs go too."""
        gone = self.matching(where).select("_id", "_version", F.lit("delete").alias("op"))
        return self._gone(self._commit(gone, kind))

    def _gone(self, name: str) -> int:
        done = self._read([f"ops/{name}"])
        have = self.files.names("blobs")
        if have:  # of the deleted records only those with blobs come here
            for r in done.join(self.spark.createDataFrame([(n,) for n in have], "_id string"), "_id", "left_semi").select("_id").toLocalIterator():
                self.files.delete(f"blobs/{r['_id']}")
        if self.hooks.get("afterDelete"):
            self.hooks["afterDelete"](done)
        return done.count()

    def delete_by_id(self, record: str) -> bool:
        return self.remove({"_id": record}) > 0

    def batch(self, inserts: list[Mapping[str, Any]] = (), deletes: list[str] = ()) -> int:
        """Inserts and deletes by id in one commit, after all inserts were validated; its number."""
        self._guard()
        new = self._prepared(self._frame([{**d, "_id": str(d.get("_id") or uuid.uuid4())} for d in inserts]), True).withColumn("op", F.lit("set"))
        old = self.stored().select("_id", F.col("_version").alias("_old"))
        new = new.join(old, "_id", "left").withColumn("_version", F.coalesce("_old", F.lit(0)) + 1).drop("_old")
        gone = self.spark.createDataFrame([(d, len(inserts) + i) for i, d in enumerate(deletes)], "_id string, n long").withColumn("op", F.lit("delete"))
        return int(_COMMIT.match(self._commit(new.unionByName(gone, allowMissingColumns=True), "insert"))[1])

    def undo(self) -> bool:
        """Take the last commit off the log (a folded one can't be)."""
        self._guard()
        commits = self._commits()
        if not commits or commits[-1] in self.manifest()["folded"]:
            return False
        return self.files.delete(f"ops/{commits[-1]}")

    def history(self, record: str) -> DataFrame:
        return oplog.history(self.ops(), record)

    def get_ops(self, since: Column | None = None) -> DataFrame:
        return self.ops() if since is None else oplog.since(self.ops(), since)

    def cleanup(self) -> int:
        """Delete expired records."""
        rows = self.stored().where(finder.expired(F.col("_expires")))
        return self._gone(self._commit(rows.select("_id", "_version", F.lit("delete").alias("op")), "delete"))

    # archive

    def archive(self, where: Any, segment: str | None = None) -> int:
        """Move matches to a cold segment (by default of the quarter)."""
        self._guard()
        now = time.gmtime()
        segment = check_name(segment or f"{now.tm_year}-Q{(now.tm_mon + 2) // 3}")
        hit = self.matching(where).select("_id", "_version", F.col("text").alias("doc"))
        part = f"{self.files.root}/archive/segment={segment}/c-{self.seq() + 1:012d}"
        hit.write.parquet(part)
        moved = self.spark.read.parquet(part)
        self._commit(moved.select("_id", "_version", F.lit("delete").alias("op")), "delete")
        return moved.count()

    def load_archive(self, segment: str) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.files.root}/archive/segment={check_name(segment)}")

    def list_archive_segments(self) -> list[str]:
        return [n.partition("=")[2] for n in self.files.names("archive") if n.startswith("segment=")]

    # search

    def search(self, query: str, limit: int = 50, offset: int = 0, **opts: Any) -> finder.FindResult:
        """Records with every term of the query; none for a blank one."""
        q = text.query_terms(query)
        if not q:
            return finder.find(self.find_all().where("false"), None, limit=limit, offset=offset, variant="doc", **opts)
        found = self.postings(q)
        if found is None:
            rows = self._docs()
            hit = rows.where(text.and_search(rows, self._searchable(), query))
        else:
            ids = found.groupBy("id").agg(F.count("*").alias("k")).where(F.col("k") == len(q)).select(F.col("id").alias("_id"))
            hit = self.by_ids(ids)
        return finder.find(hit.select("_id", "_version", "doc"), None, limit=limit, offset=offset, variant="doc", **opts)

    def postings(self, terms: list[str]) -> DataFrame | None:
        """id, term, tf, dl of the live records with one of the terms, from the stored postings and what came since; None without a text index."""
        m = self.manifest()
        if not m.get("postings") or m.get("searchable") != self._searchable_fields():
            return None
        later = self._later(m)
        rows = self._read([m["postings"]], "id string, dl int, term string, tf long").where(F.col("term").isin(terms))
        gone = later.select(F.col("_id").alias("id")).unionByName(self._read([m["base"]]).where(finder.expired(F.col("_expires"))).select(F.col("_id").alias("id")))
        new = text.postings(self._parsed(later.where("op = 'set'")), self._searchable(), "_id", terms)
        return rows.join(gone, "id", "left_anti").select("id", "term", "tf", "dl").unionByName(new.select("id", "term", "tf", "dl"))

    def _lengths(self, m: dict) -> tuple[int, int]:
        """Number of live records and sum of their lengths: the base's, less what is gone, and what came since."""
        later = self._later(m)
        base = self._read([m["base"]], f"{_OPS}, _dl int")
        dead = base.join(later.select("_id").withColumn("_new", F.lit(True)), "_id", "left").where(F.col("_new").isNotNull() | finder.expired(F.col("_expires")))
        out = dead.agg(F.count("*").alias("n"), F.coalesce(F.sum("_dl"), F.lit(0)).alias("t")).collect()[0]
        new = text.lengths(self._parsed(later.where("op = 'set'")), self._searchable(), "_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).collect()[0]
        return m["rows"] - out["n"] + new["n"], m["total"] - out["t"] + new["t"]

    def bm25_scores(self, query: str) -> DataFrame:
        """id, score of the live records with a term of the query."""
        q = text.query_terms(query)
        found = self.postings(q) if q else None
        if found is None:
            return text.bm25(self._docs(), self._searchable(), "_id", query)
        n, total = self._lengths(self.manifest())
        return text.bm25_of_postings(found, n, total)

    def _scored(self, found: DataFrame, where: Any, limit: int, summary: bool = False) -> DataFrame:
        rows = self.matching(where).select("_id", "_version", "doc")
        out = rows.join(F.broadcast(found.withColumnRenamed("id", "_id")), "_id").orderBy(F.desc("score"), "_id").limit(limit)  # at most the candidate limit
        return finder.summarize(out) if summary else out

    def bm25_search(self, query: str, limit: int = 10, where: Any = None, candidate_limit: int | None = None, summary: bool = False) -> DataFrame:
        """_id, _version, doc, score: candidates by score, then the filter, then the limit."""
        found = self.bm25_scores(query).orderBy(F.desc("score"), "id").limit(candidate_limit or fusion.candidates(limit))
        return self._scored(found, where, limit, summary)

    def _vectors(self) -> DataFrame:
        q = F.col("_embedding")
        return finder.live(self.stored()).where("_embedding is not null").select("_id", knn.dequantize(q).alias("vec"))

    def search_by_vector(self, vector: list[float], limit: int = 10, where: Any = None, candidate_limit: int | None = None, summary: bool = False) -> DataFrame:
        found = knn.nearest(self._vectors(), "vec", "_id", vector, candidate_limit or fusion.candidates(limit))
        return self._scored(found, where, limit, summary)

    def append_vectors(self, rows: DataFrame) -> None:
        """Replace records by rows of a DataFrame of any size: _id, vector, and fields."""
        self._guard()
        new = self._frame(rows.drop("vector")).join(rows.select(F.col("_id").cast("string").alias("_id"), knn.quantize(F.col("vector")).alias("_embedding")), "_id")
        new = new.join(self.stored().select("_id", F.col("_version").alias("_old")), "_id", "left")
        self._commit(new.select("_id", "n", "doc", F.lit("set").alias("op"), (F.coalesce("_old", F.lit(0)) + 1).alias("_version"), "_embedding"), "upsert")

    def insert_vector(self, record: str, vector: list[float], metadata: Mapping[str, Any] | None = None) -> None:
        """Replace the record by its metadata and a quantised vector, of the dimension of those stored."""
        self._guard()
        have = self.stored().where("_embedding is not null").select(F.size("_embedding.data").alias("d")).take(1)
        if have and have[0]["d"] != len(vector):
            raise ValueError(f"Vector dimension mismatch: {len(vector)} instead of {have[0]['d']}")
        rows = self._frame([{**(metadata or {}), "_id": record}]).join(self.stored().select("_id", F.col("_version").alias("_old")), "_id", "left")
        q = knn.quantize(F.array(*(F.lit(float(x)) for x in vector)))
        self._commit(rows.select("_id", "n", "doc", F.lit("set").alias("op"), (F.coalesce("_old", F.lit(0)) + 1).alias("_version"), q.alias("_embedding")), "upsert")

    def _embed(self, rows: DataFrame) -> tuple[int, list[dict]]:
        """Number of vectors stored, and the first ten errors."""
        if self.provider is None:
            raise ValueError("no embedding provider")
        self._guard()
        new = rows.select("_id", F.lit("set").alias("op"), "_version", "_agent", "_reason", "_expires", F.col("text").alias("doc"), embed_column(self._searchable(), self.provider).alias("e"))
        new = written(new.select("*", "e.v", "e.error").drop("e"), "embedded")
        errors = [{"id": r["_id"], "error": r["error"]} for r in new.where("error is not null").orderBy("_id").limit(10).collect()]
        done = new.where("v is not null").withColumn("_embedding", knn.quantize(F.col("v"))).drop("v", "error")
        return self._read([f"ops/{self._commit(done, 'update')}"]).count(), errors

    def embed_unembedded(self) -> int:
        rows = self._docs().where("_embedding is null")
        return self._embed(rows)[0] if not rows.isEmpty() else 0

    def reembed_all(self) -> dict:
        total = self.count()
        done, errors = self._embed(self._docs())
        return {"embedded": done, "failed": total - done, "errors": errors}

    def semantic_search(self, query: str, limit: int = 10, where: Any = None, candidate_limit: int | None = None) -> DataFrame:
        if self.provider is None:
            raise ValueError("no embedding provider")
        if not self.read_only:
            self.embed_unembedded()
        return self.search_by_vector(self.provider.embed([query])[0], limit, where, candidate_limit)

    def hybrid_search(self, query: str, limit: int = 10, where: Any = None, k: float = 60) -> DataFrame:
        """BM25 and vector arms, each filtered, fused by reciprocal ranks."""
        n = fusion.candidates(limit)
        arms = [self.bm25_search(query, n, where, n).select(F.col("_id").alias("id"), "score")]
        if self.provider is not None and query.strip():
            arms.append(self.semantic_search(query, n, where, n).select(F.col("_id").alias("id"), "score"))
        return self._scored(fusion.rrf(arms, k, limit), None, limit)

    # views, bloom filters, blobs, feed

    def define_view(self, name: str, where: Any, **opts: Any) -> None:
        self.views[name] = (where, opts)

    def remove_view(self, name: str) -> bool:
        self._cached.pop(name, None)
        return self.views.pop(name, None) is not None

    def list_views(self) -> list[str]:
        return sorted(self.views)

    def query_view(self, name: str, **overrides: Any) -> finder.FindResult:
        """A view's page, kept until the collection changes; overrides go past the kept one."""
        where, opts = self.views[name]
        if overrides:
            return self.find(where, **{**opts, **overrides})
        now = self._state()
        if name not in self._cached or self._cached[name][0] != now:
            self._cached[name] = (now, self.find(where, **opts))
        return self._cached[name][1]

    def create_bloom_filter(self, name: str, expected: int = 10_000, fpp: float = 0.01) -> None:
        """A stored bloom filter of a field's values, made again at each full compaction."""
        s = self._settings()
        self._set_settings(s | {"bloom": {**s["bloom"], name: [expected, fpp]}})
        self._write_bloom(name, [expected, fpp], self._docs(False))

    def _write_bloom(self, name: str, how: list, rows: DataFrame) -> None:
        col = rows.select(F.to_json(F.try_variant_get("doc", f"$.{name}", "variant")).alias("v")).na.drop()
        sketch = self.spark.sparkContext._jvm.org.apache.spark.util.sketch.BloomFilter
        found = sketch.create(int(how[0]), float(how[1])) if col.isEmpty() else col._jdf.stat().bloomFilter("v", int(how[0]), float(how[1]))
        out = self.spark.sparkContext._jvm.java.io.ByteArrayOutputStream()
        found.writeTo(out)
        self.files.write(f"bloom/{check_name(name)}", bytes(out.toByteArray()))
        self.files.write(f"bloom/{check_name(name)}.json", json.dumps({"commits": self._commits()}).encode())

    def might_have(self, name: str, value: Any) -> bool:
        """False only if no record has the value: by the stored filter and the commits after it; true without a filter."""
        at = f"bloom/{check_name(name)}"
        if not self.files.exists(at):
            return True
        jvm = self.spark.sparkContext._jvm
        data = jvm.java.io.ByteArrayInputStream(bytearray(self.files.read(at)))
        if jvm.org.apache.spark.util.sketch.BloomFilter.readFrom(data).mightContainString(json.dumps(value)):
            return True
        known = set(json.loads(self.files.read(f"{at}.json"))["commits"])
        rows = self._read([f"ops/{n}" for n in self._commits() if n not in known]).where("doc is not null")
        return not rows.where(F.to_json(F.try_variant_get(F.parse_json("doc"), f"$.{name}", "variant")) == json.dumps(value)).isEmpty()

    def write_blob(self, record: str, name: str, content: bytes) -> None:
        self._guard()
        if self.find_one(record) is None:
            raise ValueError(f"Record not found: {record}")
        self.files.write(f"blobs/{check_name(record)}/{name}", content)

    def read_blob(self, record: str, name: str) -> bytes:
        return self.files.read(f"blobs/{check_name(record)}/{name}")

    def list_blobs(self, record: str) -> list[str]:
        return [n for n in self.files.names(f"blobs/{check_name(record)}") if not n.startswith(".")]

    def delete_blob(self, record: str, name: str) -> bool:
        self._guard()
        return self.files.delete(f"blobs/{check_name(record)}/{name}")

    def blobs(self) -> DataFrame:
        return blobs(self.spark, f"{self.files.root}/blobs")

    def on_change(self, f: Callable[[dict], None]) -> Callable[[], None]:
        self.listeners.append(f)
        return lambda: self.listeners.remove(f)
