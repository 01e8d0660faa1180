import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import encode, leakage, ranking, truncation, vectors
from tessera.llm.words import words


def brute(rows, k):
    ids = np.array(sorted(rows))
    v = np.array([rows[i] for i in ids], dtype=np.float64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    return {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in np.lexsort((ids, -s[i]))[: min(k, len(ids) - 1)]}


SCHEMA = "vec_id long, vec array<float>, embedding array<tinyint>, sim double"


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 150)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    rows = {i: (centres[i % 40] + 0.2 * rng.normal(size=24)).astype(np.float32) for i in range(900)}
    data = [(i, [float(x) for x in v], None, None) for i, v in rows.items()]
    data += data[:30]
    data += [(10_000, None, None, None), (10_001, [0.0] * 24, None, None), (10_002, [float("nan")] * 24, None, None), (10_003, [1.0] * 5, None, None), (None, [1.0] * 24, None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r["vec_id"], r["near_id"]) for r in vectors.neighbours(vectors.vectors_of(df, 24), 5).collect()}
    want = brute(rows, 5)
    assert len(got & want) >= 0.98 * len(want) and len(got) == len(want)


def test_neighbours_in_groups_of_copies(spark):
    rng = np.random.default_rng(2)
    same = rng.normal(size=8).astype(np.float32)
    rows = {i: same if i % 3 == 0 else rng.normal(size=8).astype(np.float32) for i in range(150)}
    df = spark.createDataFrame([(i, [float(x) for x in v], None, None) for i, v in rows.items()], SCHEMA)
    got = {(r["vec_id"], r["near_id"]) for r in vectors.neighbours(vectors.vectors_of(df, 8), 5).collect()}
    assert got == brute(rows, 5)


@pytest.mark.parametrize("part", [48_000, 300])
def test_neighbours_of_one_direction_in_many_lengths(spark, monkeypatch, part):
    monkeypatch.setattr(vectors, "PART_ROWS", part)
    rng = np.random.default_rng(12)
    same, twin = rng.normal(size=24).astype(np.float32), rng.normal(size=24).astype(np.float32)
    rows = {i: (same * np.float32(rng.uniform(0.01, 100)) if i % 3 else twin * np.float32(2.0 ** rng.integers(-9, 9)) if i % 2 else rng.normal(size=24)).astype(np.float32) for i in range(3000)}
    df = spark.createDataFrame([(i, [float(x) for x in v], None, None) for i, v in rows.items()], SCHEMA)
    found = vectors.neighbours(vectors.vectors_of(df, 24), 5).collect()
    want = brute(rows, 5)
    assert {(r["vec_id"], r["near_id"]) for r in found} == want and len(found) == len(want)


def test_centroids_of_two_levels(spark, monkeypatch):
    for name, n in (("CELL_ROWS", 60), ("MAX_CELLS", 8), ("BLOCK_ROWS", 40)):
        monkeypatch.setattr(vectors, name, n)
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(60, 24))
    rows = {i: (centres[i % 60] + 0.15 * rng.normal(size=24)).astype(np.float32) for i in range(2400)}
    df = vectors.vectors_of(spark.createDataFrame([(i, [float(x) for x in v], None, None) for i, v in rows.items()], SCHEMA), 24).withColumn("asks", F.lit(True))
    index = vectors.members(df, 2400)
    homes = [r["vec_id"] for r in index.where("home").select("vec_id").collect()]
    assert sorted(homes) == list(range(2400)) and index.select("cell").distinct().count() > 8
    got = {(r["vec_id"], r["near_id"]) for r in vectors.neighbours(df, 5).collect()}
    want = brute(rows, 5)
    assert len(got & want) >= 0.95 * len(want)


def test_a_dense_crowd_is_compared_in_parts(monkeypatch):
    monkeypatch.setattr(vectors, "PAIRS", 5000)
    rng = np.random.default_rng(22)
    v = np.ones((900, 24)) + 1e-4 * rng.normal(size=(900, 24))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    a, b, _ = vectors.scan(u, np.arange(900), np.ones(900, bool), 5)
    assert set(zip(a.tolist(), b.tolist())) == brute(dict(enumerate(v)), 5)


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(1, None, [1, 2], None), (2, [2.0, 4.1], None, None), (3, [0.0, 1.0], None, None)], SCHEMA)
    v = vectors.vectors_of(df, 2)
    assert {(r["vec_id"], r["near_id"]) for r in vectors.neighbour_pairs(vectors.neighbours(v, 1)).collect()} == {(1, 2), (2, 3), (1, 3)} - {(1, 3)}
    assert vectors.neighbours(v.limit(1), 5).count() == 0 and vectors.neighbours(v.where("false"), 5).count() == 0


def test_abandoning_loses_little():
    rng = np.random.default_rng(5)
    c = rng.normal(size=(300, 96))
    v = np.concatenate([c + 0.15 * rng.normal(size=c.shape) for _ in range(8)])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    a, b, _ = vectors.scan(u, np.arange(len(u)), np.ones(len(u), bool), 5)
    want = brute(dict(enumerate(v)), 5)
    assert len(set(zip(a.tolist(), b.tolist())) & want) >= 0.99 * len(want)


def test_a_cell_without_near_neighbours_is_not_compared_pair_by_pair(monkeypatch):
    v = np.random.default_rng(6).normal(size=(2400, 96))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    pairs, einsum = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda form, a, b: (pairs.append(len(a)), einsum(form, a, b))[1])
    a, b, _ = vectors.scan(u, np.arange(len(u)), np.ones(len(u), bool), 5)
    monkeypatch.undo()
    assert sum(pairs) < 40 * len(u)
    assert set(zip(a.tolist(), b.tolist())) == brute(dict(enumerate(v)), 5)


def test_few_survivors_go_on_block_by_block(monkeypatch):
    rng = np.random.default_rng(7)
    c = rng.normal(size=(300, 96))
    v = np.concatenate([c + 0.02 * rng.normal(size=c.shape) for _ in range(8)])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    found = [None, None]
    for i, dense in enumerate((1.0, 0.0)):
        monkeypatch.setattr(vectors, "DENSE", dense)
        found[i] = {(x, y) for x, y in zip(*(z.tolist() for z in vectors.scan(u, np.arange(len(u)), np.arange(len(u)) % 3 > 0, 5, np.arange(len(u)) % 7 > 0)[:2]))}
    assert found[0] == found[1] and len(found[0]) == 1600 * 5


def test_ranking(spark):
    rows = []
    for i in range(30):
        rows += [("q", "wide", f"i{i:02d}", float(i * 1000)), ("q", "narrow", f"i{i:02d}", 0.5 + i / 1000), ("q", "distance", f"i{i:02d}", 9.0 - i / 100)]
    rows += [("q", "wide", "loud", 1e12), ("q", "narrow", "loud", 0.4), ("q", "narrow", "i29", 0.1), ("q", "narrow", "i05", None), ("q", "wide", "i05", float("nan")), (None, "wide", "x", 1.0), ("r", "wide", "a", 1.0), ("r", "wide", "b", 1.0), ("s", "wide", "a", None)]
    df = spark.createDataFrame(rows, "query_id string, list_name string, item_id string, score double").withColumn("rank", F.lit("clash"))
    got = {(r["query_id"], r["rank"]): r["item_id"] for r in ranking.top(ranking.fuse(df), 3).collect()}
    assert {got["q", n] for n in (1, 2, 3)} == {"i29", "i28", "i27"}
    assert got["r", 1] == "a" and got["r", 2] == "b" and ("s", 1) not in got
    assert ranking.fuse(df.limit(0)).count() == 0
    heavy = ranking.top(ranking.fuse(df, weights={"wide": 50.0}), 1).where("query_id = 'q'").collect()
    assert heavy[0]["item_id"] in ("loud", "i28", "i29") and ranking.fuse(df, weights={"wide": 50.0}).where("closeness > 1 or closeness < 0").count() == 0


@pytest.fixture(scope="module")
def coder():
    return encode.encoder(encode.vocabulary_path())


def test_ids_equal_the_public_library(coder):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["", " ", "\n\n  x", "it's I'LL", "<|endoftext|>", "a" * 3000, "漢字かな" * 200, "é́​🙂👨‍👩‍👧", " " * 500 + "end", "1234567890" * 30]
    texts += ["".join(rng.choice("abcde fgh\n\t.,!'ÀŁ漢🙂019_-{}") for _ in range(rng.randrange(1, 400))) for _ in range(150)]
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert coder.encode(text) == want.ids, text[:80]


def test_ids_spell_the_text(coder):
    for text in ("Zwölf Boxkämpfer", "x" * 999 + "\0\x7f", "ab\r\ncd"):
        assert b"".join(coder.bytes[i] for i in coder.encode(text)) == text.encode()


def test_encode_corpus(spark):
    df = spark.createDataFrame([(1, "hello world", 0), (2, None, 0), (3, "", 0)], "doc_id int, text string, ids int")
    got = {r["doc_id"]: list(r["ids"]) for r in encode.encode_corpus(df).collect()}
    assert len(got[1]) == 2 and got[2] == [] and got[3] == []


def _sentence(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def test_words_ignore_layout():
    want = "the quick brown fox jumps".split()
    for t in ("The QUICK, brown\n> fox jumps", "// the quick\n// brown fox jumps", "<b>the</b> quick **brown** _fox_ jumps", "the qu​ick brown&nbsp;fox ju­mps", "| the quick\r\n| brown fox\r\n| jumps", "12: the quick\n13: brown fox jumps"):
        assert words(t) == want, t
    assert words(None) == [] and words("") == [] and words("​ \n") == []


def test_leaks(spark):
    rng = random.Random(6)
    passages = [_sentence(rng, 90) for _ in range(30)]
    items = [(i, " ".join(p), f"answer{i}" if i % 2 else None) for i, p in enumerate(passages)] + [(100, None, None), (101, "", "x"), (None, "a b", None)]
    docs, want = [], set()
    noise = lambda n: " ".join(_sentence(rng, n))

    def edited(p, every):
        return [x if i % every != every - 1 else "changed" for i, x in enumerate(p)]

    for i, p in enumerate(passages):
        docs.append((10 * i, noise(60) + " " + " ".join(p[7:19]) + " " + noise(80)))  # 12 in a row
        docs.append((10 * i + 1, noise(60) + " " + " ".join(p[7:18]) + " " + noise(80)))  # 11
        docs.append((10 * i + 2, noise(9) + "\n> " + "\n> ".join(edited(p[20:62], 9)).upper() + "\n" + noise(30)))  # one in 9 edited
        docs.append((10 * i + 3, noise(40) + " " + " ".join(edited(p[20:80], 4)) + noise(30)))  # too many edits
        docs.append((10 * i + 4, noise(40) + " " + " ".join(edited(p[20:45], 9)) + " " + noise(30)))  # too short
        docs.append((10 * i + 5, " ".join(x for k, x in enumerate(p[:70]) if k % 10) + f" answer{i}"))  # words dropped
        want |= {(10 * i, i), (10 * i + 2, i), (10 * i + 5, i)}
    docs += docs[:2] + [(9001, None), (9002, ""), (9003, noise(20_000) + " " + " ".join(passages[3][40:60]) + " " + noise(20_000)), (None, " ".join(passages[0]))]
    want.add((9003, 3))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame(items, "item_id long, passage string, answer string")
    rows = leakage.leaks(d, it).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert got == want and len(rows) == len(want)
    assert {r["doc_id"] for r in rows if r["answer_too"]} == {10 * i + 5 for i in range(30) if i % 2}
    assert leakage.leaks(d.limit(0), it).count() == 0 and leakage.leaks(d, it.limit(0)).count() == 0


@pytest.mark.parametrize("n,words_", [(1500, 20_000), (5000, 6_000)])
def test_leaks_among_many_passages(spark, n, words_):
    rng = random.Random(n)
    word = lambda: f"w{int(rng.paretovariate(0.7)) if rng.random() < 0.3 else rng.randrange(words_)}"
    passages = [[word() for _ in range(40 + rng.randrange(60))] for _ in range(n)]
    docs, want = [], set()
    for i in range(300):
        k = rng.randrange(n)
        at = rng.randrange(len(passages[k]) - 12)
        docs.append((i, " ".join([word() for _ in range(30 + rng.randrange(40))] + passages[k][at : at + 12] + ["zz"] + [word() for _ in range(50)])))
        want.add((i, k))
    it = spark.createDataFrame([(k, " ".join(p), None) for k, p in enumerate(passages)], "item_id long, passage string, answer string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), it).collect()}
    assert not want - got


def test_runs_of_twelve_words_of_every_passage(spark):
    items = spark.read.parquet("/root/testdata/sf0.001/eval_items.parquet")
    rng = random.Random(31)
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 400").collect()]
    planted, want = [], set()
    for r in items.collect():
        w = words(r["passage"])
        at, host = rng.randrange(len(w) - 11), words(rng.choice(docs))
        cut = rng.randrange(len(host))
        planted.append((r["item_id"], " ".join(host[:cut] + w[at : at + 12] + host[cut:])))
        want.add((r["item_id"], r["item_id"]))
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(spark.createDataFrame(planted, "doc_id long, text string"), items).collect()}
    assert len(want) == 400 and not want - got


def test_answers_decide_on_paraphrases(spark):
    rng = random.Random(33)
    p = [f"w{rng.randrange(3000)}" for _ in range(60)]
    kept = [x for i, x in enumerate(p) for x in ([x] if i % 5 else ["other", "words"])]
    docs = spark.createDataFrame([(1, " ".join(kept) + " forty two"), (2, " ".join(kept)), (3, " ".join(p))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(p), "Forty-two")], "item_id long, passage string, answer string")
    assert {(r["doc_id"], r["kind"], r["answer_too"]) for r in leakage.leaks(docs, items).collect()} == {(1, "paraphrase", True), (3, "copy", False)}


def test_leaks_of_the_shortest_cases(spark):
    rng = random.Random(16)
    common = [f"c{i}" for i in range(150)]
    passages = [[rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(4000)}" for _ in range(90)] for _ in range(400)]
    docs, want = [], set()
    other = lambda n: [rng.choice(common) if rng.random() < 0.4 else f"x{rng.randrange(9**6)}" for _ in range(n)]
    for i in range(1200):
        k = rng.randrange(len(passages))
        n = 12 + i % 5
        at = rng.randrange(90 - n)
        docs.append((i, " ".join(other(40 + rng.randrange(30)) + passages[k][at : at + n] + other(60))))
        want.add((i, k))
    for i in range(1200, 1400):  # 30 words, three edits
        k, at = rng.randrange(len(passages)), rng.randrange(60)
        piece: list = passages[k][at : at + 30]
        for j in (7, 15, 23):
            piece[j] = rng.choice((None, "changed", f"{piece[j]} added"))
        docs.append((i, " ".join(other(40 + rng.randrange(30)) + [x for x in piece if x] + other(60))))
        want.add((i, k))
    it = spark.createDataFrame([(k, " ".join(p), None) for k, p in enumerate(passages)], "item_id long, passage string, answer string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), it).collect()}
    assert not want - got


WHOLE = [
    None, "", " \n", "TODO", "👍", "A sentence. And another one!", "It ends so 🙂", "A sentence.\n\n---\n", "Text here is fine.\n-- name-one", "All is well.\n\nOwner: someone",
    "Things:\n- took the red box\n- lost the old key\n- found the new box", '[{"a": "b c"}, {"d": 1}]', "function f() {\n  if (x > 1) y(); // note\n}", "Done here....", "He said “it works, it doesn’t”.",
    "10:00:01 a INFO x=1;\n10:00:02 b INFO x=2;\n10:00:03 c INFO x=3;",
]
CUT = [
    "A sentence. And another o", "A sentence. And another, ", '[{"a": "b c"}, {"d": "e', '[{"a": "b"},', "function f() {\n  if (x > 1) y(); // note", "Done here. And the…", "Done here. But wh...", "終わりです。そして次", "It ends.\nwith a sign�",
    "10:00:01 a INFO x=1;\n10:00:02 b INFO x=2;\n10:00:03 c IN", "Things:\n- took the red box\n- lost the old key\n- found the old box\n- took the",
]


def test_ends(spark):
    filler = [(1000 + i, f"We took the red box again. They lost the old key {i} times.\n- took the red box\n- lost the old key\n- kept one box") for i in range(20)]
    docs = [(i, t) for i, t in enumerate(WHOLE + CUT)] + filler + [(0, None), (None, "x y")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit("clash")).withColumn("source", F.when(F.col("doc_id") < 5, "s"))
    rows = truncation.truncated(df).collect()
    assert len(rows) == len(WHOLE + CUT) + 20
    got = {r["doc_id"]: r["cut"] for r in rows}
    for i, t in enumerate(WHOLE + CUT):
        assert got[i] == (i >= len(WHOLE)), t
    share = {r["source"]: (r["n_docs"], r["n_cut"]) for r in truncation.share_by_source(df, F.col("source")).collect()}
    assert share["s"] == (6, 0) and share[None][1] == len(CUT)
    assert truncation.truncated(df.limit(0)).count() == 0


def test_near_copy_decides(spark):
    rng = random.Random(8)
    items = [f"- moved the w{rng.randrange(50)} thing{rng.randrange(40)}" for _ in range(30)]
    whole = "List:\n" + "\n".join(items)
    cut = whole[: whole.rindex("thing") + 4]
    assert truncation.ends_early(cut, whole) == 1
    assert truncation.ends_early("List:\n" + "\n".join(items[:-1]), whole) == -1
    assert truncation.ends_early("Other words altogether stand here", whole) == 0
    df = spark.createDataFrame([(1, whole), (2, cut), (3, whole), (4, cut)], "doc_id long, text string")
    got = {r["doc_id"]: (r["cut"], r["evidence"]) for r in truncation.truncated(df).collect()}
    assert got[2] == got[4] == (True, "copy") and not got[1][0] and not got[3][0]


def test_the_alignment_decides_despite_edits():
    rng = random.Random(19)
    lines = [" ".join(_sentence(rng, 12)) + "." for _ in range(12)]
    whole = "\n".join(lines)
    cut = whole[: whole.rindex(lines[-1]) + 40]
    edited = cut.split(" ")
    edited[-3] = "Edited,"  # among the last 40 characters
    assert truncation.ends_early(" ".join(edited), whole) == 1 and truncation.ends_early(cut[:-30] + cut[-30:].upper(), whole) == 1
    # of lines with one end, only the right one
    log = [f"step {i} {' '.join(_sentence(rng, 6))} of the long running import job was finished by worker" for i in range(20)]
    whole = "\n".join(x + " 7;" if i == 19 else x for i, x in enumerate(log))
    assert truncation.ends_early("\n".join(log), whole) == 1
    assert truncation.ends_early(whole, whole) == 2


def test_a_copy_overrules_any_end(spark):
    rng = random.Random(20)
    text = lambda: "\n".join(" ".join(_sentence(rng, 12)) + "." for _ in range(6))
    ends = [("\n-- Maria Lopez", 8), ("\n\nOwner: platform", 6), (" See example.com/x.", 6), ("\n- took 1\n- took 2\n- took 345", 2)]
    docs = []
    for i, (end, off) in enumerate(ends):
        whole = text() + end
        docs += [(2 * i, whole), (2 * i + 1, whole[:-off])]
    docs += [(50, "\u5929\u6c17\u306f\u4eca\u65e5\u3082\u3068\u3066\u3082\u3088\u304f\u3066\u6d77\u307e\u3067\u6b69\u3044\u305f\u3002\u5915\u65b9\u306b\u5bb6\u3078\u5e30\u3063\u305f\n-- \u5c71\u7530\u592a\u90ce"), (51, "\u5929\u6c17\u306f\u4eca\u65e5\u3082\u3068\u3066\u3082\u3088\u304f\u3066\u6d77\u307e\u3067\u6b69\u3044\u305f\u3002\u5915\u65b9\u306b\u5bb6\u3078\u5e30\u3063\u305f\n-- \u5c71\u7530")]
    got = {r["doc_id"] for r in truncation.truncated(spark.createDataFrame(docs, "doc_id long, text string")).where("cut").collect()}
    assert got == {1, 3, 5, 7, 51}


@pytest.mark.parametrize("hot", [1000, 2])
def test_every_longer_text_of_a_bucket_is_tried(spark, monkeypatch, hot):
    monkeypatch.setattr(truncation, "HOT", hot)
    rng = random.Random(18)
    line = lambda: " ".join(_sentence(rng, 9)) + " end"
    whole = "\n".join(line() for _ in range(20))
    cut = whole[: whole.rindex(" end") - 7]
    texts = {1: cut, 2: "\n".join([whole, line()]), 3: "\n".join(line() for _ in range(60))}
    # between the cut text and its copy lie others of the same bucket
    texts |= {10 + i: "\n".join(line() for _ in range(20)) for i in range(12)}
    rows = [(d, "cut" if d == 1 else "whole", "", len(t), len(truncation.shingle_hashes(words(t))), 0, [7] * 16) for d, t in texts.items()]
    profiles = spark.createDataFrame(rows, "doc_id long, kind string, key string, size int, shingles int, letters int, bands array<long>")
    got = truncation._copies(profiles, spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["verdict"]) for r in got] == [(1, 1)]


@pytest.mark.parametrize("hot", [1000, 2])
def test_texts_that_end_alike_share_a_verdict(spark, monkeypatch, hot):
    monkeypatch.setattr(truncation, "HOT", hot)
    rng = random.Random(41)
    lines = [" ".join(_sentence(rng, 9)) + "." for _ in range(30)]
    end = " ".join(_sentence(rng, 7)) + " begi"
    longest = "\n".join([*lines, end + "nning of it all."])
    crowd = ["\n".join(x for j, x in enumerate(lines) if j != i) + "\n" + end for i in range(12)]
    docs = [(0, longest), *enumerate(crowd, 1)]
    got = {r["doc_id"]: r["cut"] for r in truncation.truncated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i > 0 for i in range(13)}
    rows = spark.createDataFrame([(1, None, 2), (2, None, 3), (3, None, 4), (4, None, 5), (5, 1, None), (8, None, 9), (6, -1, 2)], "doc_id long, verdict int, link long")
    assert {(r["doc_id"], r["verdict"]) for r in truncation._resolved(rows).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, -1)}


def test_a_crowd_with_ends_of_their_own_costs_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(truncation, "HOT", 50)
    rng = random.Random(43)
    lines = [" ".join(_sentence(rng, 12)) + "." for _ in range(8)]
    docs = [(i, "\n".join(lines) + f" Note {'x' * (i % 40)} for q{i:06d}z." ) for i in range(400)]
    docs.append((1000, "\n".join(lines) + " Note for q000399z. And it goes on with more."))
    docs.append((1001, "\n".join(lines) + " Note for q000399z. And it goes on wi"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    met = []
    monkeypatch.setattr(truncation, "_verdicts", lambda pairs, texts, f=truncation._verdicts: (met.append(pairs.count()), f(pairs, texts))[1])
    got = {r["doc_id"] for r in truncation.truncated(df).where("cut").collect()}
    assert 1001 in got and not got & set(range(399)) and sum(met) < 4 * 400


def test_min_hash_finds_similar_texts():
    rng = random.Random(9)
    found = 0
    for _ in range(40):
        a = _sentence(rng, 200)
        b = a[:175]
        found += bool(set(enumerate(truncation.bands(truncation.shingle_hashes(a)))) & set(enumerate(truncation.bands(truncation.shingle_hashes(b)))))
    assert found >= 39
