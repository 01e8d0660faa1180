"""Queries of the general training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import audit, changefeed, drift, incremental, sessions
from tessera.session import scratch
from tessera.sources.tables import table
from tessera.streaming import features as streamed

MINUTE = 60 * 1_000_000


def _agent_entries(spark: SparkSession, d: str) -> DataFrame:
    once = audit.entries_once(table(spark, d, "audit_log").where(audit.usable("entry_ts")), [F.col("entry_ts"), audit.name_of("agent_id").alias("agent")])
    return once.where("agent is not null")


def _forest(spark: SparkSession, d: str) -> DataFrame:
    return sessions.gap_forest(_agent_entries(spark, d), F.col("agent"), F.col("entry_ts"), F.col("entry_id"), 5 * MINUTE)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of every agent at a gap of 30 minutes, cut from the stored trees."""
    out = sessions.cut(_forest(spark, d), 30 * MINUTE)
    return out.select(F.col("entity").alias("agent_id"), F.col("first_id").alias("first_entry_id"), F.col("last_id").alias("last_entry_id"))


def p1_sessions_by_gap(spark: SparkSession, d: str) -> DataFrame:
    """Number of sessions, their entries and longest duration for several gap settings, from trees stored once."""
    forest, out = _forest(spark, d), None
    for gap in (5, 30, 240):
        one = sessions.cut(forest, gap * MINUTE).agg(F.lit(gap).alias("gap_minutes"), F.count("*").alias("n_sessions"), F.sum("n_events").alias("n_entries"), F.max("duration_micros").alias("longest_micros"))
        out = one if out is None else out.unionByName(one)
    return out.where("n_sessions > 0")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Differences of every schema version to the one before."""
    return drift.schema_changes(table(spark, d, "schema_defs"), table(spark, d, "record_files"))


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    """All records in one table under the last names of their fields, a row per field."""
    rows = drift.unify(table(spark, d, "schema_defs"), table(spark, d, "record_files"))
    return rows.select("coll", "rec_id", "schema_version", F.explode("fields").alias("field_name", "value"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that exist after all changes, with version and etag."""
    state = changefeed.current_state(table(spark, d, "change_feed"), F.get_json_object("doc", "$.etag"))
    return state.withColumnRenamed("payload", "etag")


def p3_batches(spark: SparkSession, d: str) -> DataFrame:
    """As p3_found, from a feed that comes in four batches, one of them twice, with a compaction between."""
    feed, store = table(spark, d, "change_feed"), changefeed.new_table(spark)
    etag, part = F.get_json_object("doc", "$.etag"), F.pmod(F.xxhash64("feed_id"), F.lit(4))
    for k in (0, 1, 1, 2, 3):
        store.append(feed.where(part == k), etag)
        if k == 2:
            store.compact()
    return store.read().withColumnRenamed("payload", "etag")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the audit log and versions of stored records as pairs of the feeds of sync_runs."""
    log, records = table(spark, d, "audit_log"), table(spark, d, "stored_records")
    entries = incremental.pairs_of(log, F.concat(F.lit("audit/"), "node"), F.col("entry_id"), F.lit(0), F.col("received_at"))
    return entries.unionByName(incremental.pairs_of(records, F.col("coll"), F.col("rec_id"), F.col("rec_version"), F.col("received_at")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """What the next run of every feed must process: reread from the oldest open attempt, without what the ledger of the runs so far has."""
    ledger, pairs = incremental.new_ledger(spark), _pairs(spark, d)
    ledger.adopt(pairs, table(spark, d, "sync_runs"))
    return ledger.due(pairs)


def p6_runs(spark: SparkSession, d: str) -> DataFrame:
    """Records that three runs process: run 1 after the history, which dies once before its commit; run 2 with nothing new; run 3 with every record one version higher."""
    ledger, pairs, out = incremental.new_ledger(spark), _pairs(spark, d), None
    ledger.adopt(pairs, table(spark, d, "sync_runs"))
    later = pairs.withColumn("rec_version", F.col("rec_version") + 1).withColumn("received_at", F.col("received_at") + F.expr("interval 100 years"))
    ledger.begin(pairs)  # this attempt ends here; the next one has the same pairs
    for rows in (pairs, pairs, pairs.unionByName(later)):
        n, _ = ledger.begin(rows)
        ledger.commit(n)
        done = ledger.run(n).select(F.lit(n).alias("run"), "feed")
        out = done if out is None else out.unionByName(done)
    return out.groupBy("run", "feed").agg(F.count("*").alias("n_records"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    store, log = streamed.new_store(spark), streamed.stream_of(spark, f"{d}/audit_log.parquet")
    store.update(log.where(audit.usable("entry_ts")), audit.name_of("agent_id"), audit.name_of("tool"), F.col("entry_ts"), F.col("entry_id"), F.col("request_bytes"))
    return store.features()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Calls of every tool by every agent and the last one, kept by the stateful stream."""
    return _features(spark, d).select(F.col("entity").alias("agent_id"), F.col("kind").alias("tool"), F.col("last_id").alias("last_entry_id"), F.col("n").alias("n_calls"))


def p7_updates(spark: SparkSession, d: str) -> DataFrame:
    """As p7_found, from a log that comes in two parts, the second with all of the first again, each followed by an update of one store."""
    log, at = table(spark, d, "audit_log"), scratch(spark, "arrivals")
    store, half = streamed.new_store(spark), F.pmod(F.xxhash64("entry_id", "received_at"), F.lit(2)) == 0
    for part in (log.where(half), log):
        part.write.mode("append").parquet(at)
        new = streamed.stream_of(spark, at).where(audit.usable("entry_ts"))
        store.update(new, audit.name_of("agent_id"), audit.name_of("tool"), F.col("entry_ts"), F.col("entry_id"), F.col("request_bytes"))
    rows = store.features()
    return rows.select(F.col("entity").alias("agent_id"), F.col("kind").alias("tool"), F.col("last_id").alias("last_entry_id"), F.col("n").alias("n_calls"))


def p7_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per agent with calls and bytes of each tool as text, ordered by tool."""
    rows = streamed.feature_rows(_features(spark, d))
    each = F.transform(F.map_entries("features"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["n"].cast("string"), F.lit(":"), e["value"]["total"].cast("string")))
    return rows.select(F.col("entity").alias("agent_id"), F.col("n").alias("n_calls"), F.col("total").alias("request_bytes"), F.col("last_id").alias("last_entry_id"), F.array_join(each, ",").alias("by_tool"))


_ENTRIES = """
WITH once AS (
  SELECT DISTINCT ON (entry_id) entry_id, entry_ts, nullif(lower(regexp_replace(agent_id, '^\\s+|\\s+$', '', 'g')), '') AS agent
  FROM audit_log WHERE entry_id IS NOT NULL AND entry_ts >= TIMESTAMP '2000-01-01'
  ORDER BY entry_id, received_at, entry_ts, agent NULLS FIRST),
e AS (SELECT * FROM once WHERE agent IS NOT NULL),
"""

SQL = {
    "p1_found": _ENTRIES
    + """
g AS (SELECT *, CASE WHEN entry_ts - lag(entry_ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY agent ORDER BY entry_ts, entry_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY agent ORDER BY entry_ts, entry_id) AS run FROM g)
SELECT agent AS agent_id, arg_min(entry_id, (entry_ts, entry_id)) AS first_entry_id, arg_max(entry_id, (entry_ts, entry_id)) AS last_entry_id FROM s GROUP BY agent, run
""",
    "p1_sessions_by_gap": _ENTRIES
    + """
t AS (SELECT unnest([5, 30, 240]) AS gap_minutes),
g AS (SELECT *, CASE WHEN entry_ts - lag(entry_ts) OVER w <= gap_minutes * INTERVAL 1 MINUTE THEN 0 ELSE 1 END AS fresh FROM e, t WINDOW w AS (PARTITION BY gap_minutes, agent ORDER BY entry_ts, entry_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY gap_minutes, agent ORDER BY entry_ts, entry_id) AS run FROM g),
r AS (SELECT gap_minutes, count(*) AS n, epoch_us(max(entry_ts)) - epoch_us(min(entry_ts)) AS long FROM s GROUP BY gap_minutes, agent, run)
SELECT gap_minutes, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_entries, max(long) AS longest_micros FROM r GROUP BY gap_minutes
""",
    "p3_found": """
WITH c AS (SELECT coll, unnest(ids) AS rec_id, unnest(versions) AS rec_version, unnest(docs) AS doc, changed_at FROM change_feed WHERE coll IS NOT NULL AND changed_at IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY coll, rec_id ORDER BY changed_at DESC, coalesce(rec_version, 2147483647) DESC, (doc IS NULL) DESC) AS n FROM c WHERE rec_id IS NOT NULL)
SELECT coll, rec_id, rec_version, json_extract_string(doc, '$.etag') AS etag FROM l WHERE n = 1 AND doc IS NOT NULL
""",
    "p6_found": """
WITH m AS (SELECT feed, max(last_timestamp) AS seen_until FROM sync_runs WHERE outcome = 'ok' GROUP BY feed),
r AS (
  SELECT 'audit/' || node AS feed, entry_id AS rec_key, 0 AS rec_version, received_at FROM audit_log
  UNION ALL SELECT coll, rec_id, rec_version, received_at FROM stored_records)
SELECT r.feed, rec_key, CAST(max(rec_version) AS INTEGER) AS rec_version
FROM r LEFT JOIN m ON r.feed = m.feed WHERE r.feed IS NOT NULL AND rec_key IS NOT NULL
GROUP BY r.feed, rec_key
HAVING max(rec_version) > coalesce(max(CASE WHEN received_at <= seen_until THEN rec_version END), -1)
""",
}

SQL["p3_batches"] = SQL["p3_found"]
SQL["p6_runs"] = f"""
WITH due AS ({SQL["p6_found"]}),
k AS (
  SELECT 'audit/' || node AS feed, entry_id AS rec_key FROM audit_log WHERE node IS NOT NULL AND entry_id IS NOT NULL
  UNION SELECT coll, rec_id FROM stored_records WHERE coll IS NOT NULL AND rec_id IS NOT NULL)
SELECT 1 AS run, feed, count(*) AS n_records FROM due GROUP BY feed
UNION ALL SELECT 3, feed, count(*) FROM k GROUP BY feed
"""
_RENAMES = """
WITH RECURSIVE v AS (
  SELECT coll, schema_version, max(file_name) AS file_name, arg_max(field_defs, (saved_at, def_id)) AS defs
  FROM schema_defs WHERE coll IS NOT NULL AND schema_version IS NOT NULL AND json_valid(field_defs) GROUP BY coll, schema_version),
p AS (
  SELECT coll, schema_version AS to_version, file_name AS to_file, defs AS new, lag(file_name) OVER w AS from_file, lag(defs) OVER w AS old
  FROM v WINDOW w AS (PARTITION BY coll ORDER BY schema_version)),
f AS (
  SELECT coll, to_version, to_file, from_file, 0 AS side, unnest(json_keys(old)) AS field, old AS defs FROM p WHERE old IS NOT NULL
  UNION ALL SELECT coll, to_version, to_file, from_file, 1, unnest(json_keys(new)), new FROM p WHERE old IS NOT NULL),
t AS (SELECT *, coalesce(json_extract_string(defs, '$."' || field || '".type'), json_extract_string(defs, '$."' || field || '"')) AS kind FROM f),
o AS (SELECT * FROM t WHERE side = 0), n AS (SELECT * FROM t WHERE side = 1),
gone AS (SELECT o.* FROM o ANTI JOIN n USING (coll, to_version, field)), come AS (SELECT n.* FROM n ANTI JOIN o USING (coll, to_version, field)),
r AS (SELECT coll, file_name, json_extract_string(raw, '$._id') AS rec_id, arg_max(raw, (line_no, row_id)) AS raw FROM record_files WHERE json_valid(raw) GROUP BY ALL),
g AS (SELECT gone.coll, to_version, field, kind, rec_id, raw ->> ('$."' || field || '"') AS val FROM gone JOIN r ON r.coll = gone.coll AND r.file_name = from_file),
c AS (SELECT come.coll, to_version, field, kind, rec_id, raw ->> ('$."' || field || '"') AS val FROM come JOIN r ON r.coll = come.coll AND r.file_name = to_file),
e AS (
  SELECT g.coll, g.to_version, g.field AS a, c.field AS b, any_value(g.kind) AS ka, any_value(c.kind) AS kb, avg((g.val = c.val)::INT) AS share
  FROM g JOIN c ON g.coll = c.coll AND g.to_version = c.to_version AND g.rec_id = c.rec_id AND g.val IS NOT NULL AND c.val IS NOT NULL GROUP BY ALL),
x AS (
  SELECT * FROM e WHERE share > 0.5
  QUALIFY row_number() OVER (PARTITION BY coll, to_version, a ORDER BY share DESC, b) = 1 AND row_number() OVER (PARTITION BY coll, to_version, b ORDER BY share DESC, a) = 1)
"""
SQL["p2_found"] = (
    _RENAMES
    + """
SELECT coll, to_version, 'removed' AS change_kind, field AS field_name, '' AS new_field FROM gone ANTI JOIN x ON gone.coll = x.coll AND gone.to_version = x.to_version AND field = a
UNION ALL SELECT coll, to_version, 'added', field, '' FROM come ANTI JOIN x ON come.coll = x.coll AND come.to_version = x.to_version AND field = b
UNION ALL SELECT coll, to_version, 'renamed', a, b FROM x
UNION ALL SELECT coll, to_version, 'type_changed', b, '' FROM x WHERE ka <> kb
UNION ALL SELECT n.coll, n.to_version, 'type_changed', n.field, '' FROM n JOIN o USING (coll, to_version, field) WHERE n.kind <> o.kind
"""
)
SQL["p2_unified"] = (
    _RENAMES.rstrip()
    + """,
vv AS (SELECT coll, schema_version, file_name, defs, lead(schema_version) OVER (PARTITION BY coll ORDER BY schema_version) AS later FROM v),
n0 AS (SELECT coll, schema_version, file_name, unnest(json_keys(defs)) AS field FROM vv),
walk(coll, schema_version, field, pos, name) AS (
  SELECT coll, schema_version, field, schema_version, field FROM n0
  UNION ALL SELECT w.coll, w.schema_version, w.field, vv.later, coalesce(x.b, w.name)
  FROM walk w JOIN vv ON vv.coll = w.coll AND vv.schema_version = w.pos AND vv.later IS NOT NULL LEFT JOIN x ON x.coll = w.coll AND x.to_version = vv.later AND x.a = w.name),
last AS (SELECT coll, schema_version, field, arg_max(name, pos) AS name FROM walk GROUP BY ALL),
file AS (SELECT coll, file_name, max(schema_version) AS schema_version FROM v WHERE file_name IS NOT NULL GROUP BY ALL),
line AS (
  SELECT coll, json_extract_string(raw, '$._id') AS rec_id, arg_max(raw, (schema_version, line_no, row_id)) AS raw, max(schema_version) AS schema_version
  FROM record_files JOIN file USING (coll, file_name) WHERE json_valid(raw) AND json_extract_string(raw, '$._id') IS NOT NULL GROUP BY ALL),
val AS (SELECT coll, rec_id, schema_version, name AS field_name, field, raw ->> ('$."' || field || '"') AS value FROM line JOIN last USING (coll, schema_version))
SELECT coll, rec_id, schema_version, field_name, arg_min(value, field) AS value FROM val WHERE value IS NOT NULL GROUP BY coll, rec_id, schema_version, field_name
"""
)

_CALLS = """
WITH once AS (
  SELECT DISTINCT ON (entry_id) entry_id, entry_ts, request_bytes, nullif(lower(regexp_replace(agent_id, '^\\s+|\\s+$', '', 'g')), '') AS agent_id, nullif(lower(regexp_replace(tool, '^\\s+|\\s+$', '', 'g')), '') AS tool
  FROM audit_log WHERE entry_ts >= TIMESTAMP '2000-01-01' AND agent_id IS NOT NULL AND tool IS NOT NULL ORDER BY entry_id, received_at),
f AS (
  SELECT agent_id, tool, arg_max(entry_id, (entry_ts, entry_id)) AS last_entry_id, max(entry_ts) AS last_ts, count(*) AS n_calls, CAST(coalesce(sum(request_bytes), 0) AS BIGINT) AS bytes
  FROM once WHERE agent_id IS NOT NULL AND tool IS NOT NULL GROUP BY agent_id, tool)
"""
SQL["p7_found"] = _CALLS + "SELECT agent_id, tool, last_entry_id, n_calls FROM f"
SQL["p7_updates"] = SQL["p7_found"]
SQL["p7_features"] = (
    _CALLS
    + """SELECT agent_id, CAST(sum(n_calls) AS BIGINT) AS n_calls, CAST(sum(bytes) AS BIGINT) AS request_bytes, arg_max(last_entry_id, (last_ts, last_entry_id)) AS last_entry_id,
string_agg(tool || '=' || n_calls || ':' || bytes, ',' ORDER BY tool) AS by_tool FROM f GROUP BY agent_id"""
)

QUERIES = {f.__name__: f for f in (p1_found, p1_sessions_by_gap, p2_found, p2_unified, p3_found, p3_batches, p6_found, p6_runs, p7_found, p7_updates, p7_features)}
