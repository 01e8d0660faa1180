import datetime as dt
import json
import random

from pyspark.sql import functions as F

from tessera.functions.matching import assign
from tessera.operators import audit, changefeed, drift, incremental
from tessera.operators.sessions import APART, Spine, cut, gap_forest, sessions
from tessera.streaming.features import FeatureStore, feature_rows, stream_of

T0 = dt.datetime(2020, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def test_a_growing_tree_holds_the_sessions_of_every_threshold():
    rng = random.Random(2)
    for n in (1, 2, 50, 400):
        gaps = [rng.randrange(20) for _ in range(n)]
        ts = [sum(gaps[:i]) for i in range(n + 1)]
        spine, nodes = Spine(), []
        for i, t in enumerate(ts):
            nodes += spine.add(gaps[i - 1] if i else APART, [-1, t, i, t, i, 1, False])
        nodes += spine.close()
        for threshold in (0, 5, 19, 30):
            got = sorted((x[2], x[4], x[5]) for x, above in nodes if x[0] <= threshold < above)
            starts = [0] + [i + 1 for i, g in enumerate(gaps) if g > threshold]
            assert got == [(a, b - 1, b - a) for a, b in zip(starts, [*starts[1:], n + 1])]


def _brute(rows, gap):
    out, by = set(), {}
    for who, ts, i in rows:
        if None not in (who, ts, i):
            by.setdefault(who, []).append((ts, i))
    for who, xs in by.items():
        run = []
        for x in sorted(xs):
            if run and x[0] - run[-1][0] > gap:
                out.add((who, run[0][1], run[-1][1], len(run)))
                run = []
            run.append(x)
        out.add((who, run[0][1], run[-1][1], len(run)))
    return out


def test_sessions_over_partitions_with_a_hot_entity(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"e{rng.randrange(9)}", at(rng.randrange(4000)), f"{i:05d}") for i in range(3000)]
    rows += [(None, at(1), "x"), ("e1", None, "y"), ("e2", at(5), None)]
    df = spark.createDataFrame(rows, "who string, ts timestamp_ntz, id string").withColumn("entity", F.lit("clash")).withColumn("edge", F.lit(1))
    minute = 60_000_000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = sessions(df, F.col("who"), F.col("ts"), F.col("id"), [minute, 5 * minute]).collect()
        forest = gap_forest(df, F.col("who"), F.col("ts"), F.col("id"))
        for m in (0, 2, 3, 60):
            mine = {(r["entity"], r["first_id"], r["last_id"], r["n_events"]) for r in cut(forest, m * minute).collect()}
            assert mine == _brute(rows, dt.timedelta(minutes=m))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for m in (1, 5):
        mine = {(r["entity"], r["first_id"], r["last_id"], r["n_events"]) for r in got if r["threshold"] == m * minute}
        assert mine == _brute(rows, dt.timedelta(minutes=m))


def test_sessions_empty(spark):
    df = spark.createDataFrame([], "who string, ts timestamp_ntz, id string")
    assert sessions(df, F.col("who"), F.col("ts"), F.col("id"), 1).count() == 0


def test_entries_once_and_names(spark):
    rows = [("1", " A ", at(1), at(5)), ("1", "a", at(1), at(4)), (None, "b", at(1), at(1)), ("2", "  ", None, at(1))]
    df = spark.createDataFrame(rows, "entry_id string, agent string, entry_ts timestamp_ntz, received_at timestamp_ntz")
    got = audit.entries_once(df, [F.col("entry_ts"), audit.name_of("agent").alias("who")]).collect()
    assert {(r["entry_id"], r["who"]) for r in got} == {("1", "a"), ("2", None)}


def _feed(spark, events):
    return spark.createDataFrame(events, "coll string, ids array<string>, versions array<int>, docs array<string>, changed_at timestamp_ntz, doc string")


def test_change_feed_any_order_and_repetition(spark):
    rng = random.Random(4)
    events, state = [], {}
    seq = 0
    for _ in range(400):
        seq += 1
        k = ("c%d" % rng.randrange(2), "hot" if rng.random() < 0.4 else f"r{rng.randrange(20)}")
        gone = rng.random() < 0.3
        v = None if gone else state.get(k, (0,))[0] + 1
        if gone:
            state.pop(k, None)
        else:
            state[k] = (v, json.dumps({"etag": seq}))
        events.append((k[0], [k[1]], [v], [None if gone else state[k][1]], at(seq), "clash"))
    again = events + rng.sample(events, 100)
    rng.shuffle(again)
    again += [("c1", None, None, None, at(1), ""), (None, ["a"], [1], ["{}"], at(1), ""), ("c1", [None], [1], ["{}"], at(1), ""), ("c1", [], [], [], at(9999), "")]
    got = changefeed.current_state(_feed(spark, again)).collect()
    assert {(r["coll"], r["rec_id"]): (r["rec_version"], r["payload"]) for r in got} == state and len(got) == len(state)


def test_change_feed_ties(spark):
    events = [("c", ["a", "b"], [2, 1], ['{"v":2}', '{"v":1}'], at(1), None), ("c", ["a"], [1], ['{"v":1}'], at(1), None), ("c", ["b"], [None], [None], at(1), None)]
    got = {r["rec_id"]: r["rec_version"] for r in changefeed.current_state(_feed(spark, events)).collect()}
    assert got == {"a": 2}
    assert changefeed.current_state(_feed(spark, [])).count() == 0


def test_incremental(spark):
    runs = spark.createDataFrame([("f", "ok", at(10)), ("f", "ok", at(5)), ("f", "failed", at(99)), ("g", "running", None), (None, "ok", at(1))], "feed string, outcome string, last_timestamp timestamp_ntz")
    rows = [("f", "a", 1, at(1)), ("f", "a", 1, at(20)), ("f", "b", 1, at(10)), ("f", "b", 2, at(11)), ("f", "c", 1, at(12)), ("f", "d", 3, at(3)), ("f", "d", 2, at(30)), ("g", "a", 1, at(1)), ("h", "z", None, None), ("f", None, 1, at(50))]
    df = spark.createDataFrame(rows, "feed0 string, k string, v int, r timestamp_ntz").withColumn("seen", F.lit("clash"))
    got = incremental.new_keys(df, runs, F.col("feed0"), F.col("k"), F.col("v"), F.col("r")).collect()
    assert {tuple(r) for r in got} == {("f", "b", 2), ("f", "c", 1), ("g", "a", 1), ("h", "z", 0)} and len(got) == 4
    assert incremental.new_keys(df.limit(0), runs, F.col("feed0"), F.col("k"), F.col("v"), F.col("r")).count() == 0


def test_a_run_that_dies_is_taken_up_with_the_same_records(spark, tmp_path):
    ledger = incremental.Ledger(spark, str(tmp_path / "ledger"))
    schema = "feed string, k string, v int, r timestamp_ntz"
    pairs = lambda rows: incremental.pairs_of(spark.createDataFrame(rows, schema), F.col("feed"), F.col("k"), F.col("v"), F.col("r"))
    keys = lambda df: {(r["rec_key"], r["rec_version"]) for r in df.collect()}
    rows = [("f", "a", 1, at(1)), ("f", "b", 1, at(2)), ("f", "b", 1, at(2)), ("f", "n", 1, None)]
    n, due = ledger.begin(pairs(rows))
    assert n == 0 and keys(due) == {("a", 1), ("b", 1), ("n", 1)}
    # it dies; rows that came since wait for the next run
    rows.append(("f", "c", 1, at(3)))
    n, due = ledger.begin(pairs(rows))
    assert n == 0 and keys(due) == {("a", 1), ("b", 1), ("n", 1)}
    ledger.commit(0)
    ledger.commit(0)
    # a transaction that began at 2 is still open when run 1 reads
    n, due = ledger.begin(pairs(rows), spark.createDataFrame([("f", at(2))], "feed string, oldest timestamp_ntz"))
    assert n == 1 and keys(due) == {("c", 1)}
    ledger.commit(n)
    # it commits late, below what run 1 saw; "a" below the reread bound isn't read again
    rows += [("f", "late", 1, at(2.5)), ("f", "a", 9, at(1)), ("f", "b", 1, at(4)), ("f", "c", 2, at(4))]
    ledger.compact()
    assert ledger.last_run() == 1 and ledger.processed().count() == 4
    n, due = ledger.begin(pairs(rows))
    assert n == 2 and keys(due) == {("late", 1), ("c", 2)}
    ledger.commit(n)
    assert keys(ledger.begin(pairs(rows))[1]) == set()
    try:
        ledger.commit(9)
        raise AssertionError
    except ValueError:
        pass


def test_the_reread_bound_is_the_oldest_open_attempt(spark):
    rows = [
        ("f", 1, 1, at(0), at(1), "ok", at(1)), ("f", 2, 1, at(2), None, "running", None), ("f", 2, 2, at(3), at(9), "failed", None), ("f", 3, 1, at(5), at(6), "ok", at(6)),
        ("f", 4, 1, at(7), None, "running", None), ("g", 5, 1, at(1), None, "running", None), ("h", 6, 1, at(1), at(2), "ok", at(2)), ("h", 7, 1, at(0.5), None, None, None),
    ]
    df = spark.createDataFrame(rows, "feed string, run_id long, attempt int, started_at timestamp_ntz, finished_at timestamp_ntz, outcome string, last_timestamp timestamp_ntz")
    got = {r["feed"]: (r["seen_until"], r["reread_from"]) for r in incremental.watermarks(df).collect()}
    assert got == {"f": (at(6), at(3)), "h": (at(2), at(0.5))}


def test_change_files_in_batches(spark, tmp_path):
    rng = random.Random(14)
    events = []
    for seq in range(300):
        gone = rng.random() < 0.3
        events.append(("c", [f"r{rng.randrange(12)}"], [None if gone else seq], [None if gone else json.dumps({"etag": seq})], at(rng.randrange(60)), "clash"))
    want = {(r["rec_id"], r["rec_version"]) for r in changefeed.current_state(_feed(spark, events)).collect()}
    rng.shuffle(events)
    store = changefeed.ChangeTable(spark, str(tmp_path / "t"))
    assert store.read().count() == 0
    for i in range(0, 300, 100):
        n = store.append(_feed(spark, events[i : i + 120]))  # overlaps come again
        assert store.append(_feed(spark, events[:1]), batch=n) == n
        if i == 100:
            store.compact()
    got = [(r["rec_id"], r["rec_version"]) for r in store.read().collect()]
    assert set(got) == want and len(got) == len(want)
    store.compact()
    assert {(r["rec_id"], r["rec_version"]) for r in store.read().collect()} == want
    # an older change that comes late, after its record was removed and all was compacted
    store.append(_feed(spark, [("c", ["zz"], [None], [None], at(50), "")]))
    store.compact()
    store.append(_feed(spark, [("c", ["zz"], [1], ["{}"], at(40), "")]))
    assert "zz" not in {r["rec_id"] for r in store.read().collect()}


def test_feature_store_over_several_runs(spark, tmp_path):
    schema = "id string, who string, what string, ts timestamp_ntz, n int"
    rows = [(f"{i}", f"w{i % 3}", f"t{i % 2}", at(i), i) for i in range(40)]
    src = str(tmp_path / "in")
    store = FeatureStore(spark, str(tmp_path / "store"))
    store.FOLD = 1
    assert store.features().count() == 0
    for part in (rows[:15], rows[10:30], rows[25:] + [(None, "w", "t", at(1), 1), ("z", None, "t", at(1), 1)]):  # overlaps come again
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        store.update(stream_of(spark, src), F.col("who"), F.col("what"), F.col("ts"), F.col("id"), F.col("n"))
    want = {}
    for i, who, what, ts, n in rows:
        c = want.setdefault((who, what), [0, None, None, 0])
        c[0], c[1], c[2], c[3] = c[0] + 1, ts, i, c[3] + n
    assert {(r["entity"], r["kind"]): [r["n"], r["last_ts"], r["last_id"], r["total"]] for r in store.features().collect()} == want
    wide = {r["entity"]: r for r in feature_rows(store.features()).collect()}
    assert wide["w0"]["n"] == 14 and set(wide["w0"]["features"]) == {"t0", "t1"}


def test_matching_is_maximal():
    w = {("a", "x"): 0.9, ("a", "y"): 0.8, ("b", "x"): 0.85}
    assert assign(w) == [("a", "y"), ("b", "x")]
    assert assign({}) == [] and assign({("a", "x"): 0.1}) == [("a", "x")]


def test_drift(spark):
    d = lambda **f: json.dumps(f)
    defs = [
        (1, "c", 1, "f1", at(1), d(a="string", b={"type": "number"}, flag="boolean", drop="string")),
        (2, "c", 3, "f3", at(2), d(a2={"type": "string"}, b="string", on="boolean", new="string")),
        (3, "c", 3, "f3", at(9), d(new="string", b="string", a2="string", on="boolean")),
        (4, "c", None, None, at(9), d(zzz="string")),
        (5, "e", 1, "g1", at(1), "not json"),
        (6, None, 1, "g1", at(1), d(q="string")),
    ]
    defs = spark.createDataFrame(defs, "def_id long, coll string, schema_version int, file_name string, saved_at timestamp_ntz, field_defs string")
    lines = []
    for i in range(20):
        lines.append((2 * i, "f1", "c", i, json.dumps({"_id": f"r{i}", "a": f"v{i}", "b": i, "flag": i % 2 == 0, "drop": "x"})))
        lines.append((2 * i + 1, "f3", "c", i, json.dumps({"_id": f"r{i}", "a2": f"v{i}" if i % 3 else "other", "b": str(i), "on": i % 2 == 0, "new": f"n{i}"})))
    lines += [lines[0], (99, "f1", "c", 50, "{broken"), (98, "f1", "c", 51, None), (97, "f3", "c", 52, '{"a2": 1}')]
    files = spark.createDataFrame(lines, "row_id long, file_name string, coll string, line_no int, raw string").withColumn("doc", F.lit("clash"))
    got = {tuple(r)[2:] for r in drift.schema_changes(defs, files).collect()}
    assert got == {("renamed", "a", "a2"), ("renamed", "flag", "on"), ("removed", "drop", ""), ("added", "new", ""), ("type_changed", "b", "")}
    rows = drift.unify(defs, files).collect()
    assert len(rows) == 20 and all(set(r["fields"]) == {"a2", "b", "on", "new"} and r["schema_version"] == 3 for r in rows)
    assert drift.schema_changes(defs.limit(0), files).count() == 0
    alone = {tuple(r)[2:4] for r in drift.schema_changes(defs, files.limit(0)).collect()}
    assert ("removed", "a") in alone and ("added", "a2") in alone
