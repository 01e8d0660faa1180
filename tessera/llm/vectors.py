"""The k most similar vectors of every vector, by an adaptive dimension scan inside probed cells.

Centroids fitted on a bounded sample divide the space into cells of some thousand vectors. Every vector is at home in its nearest cell and a guest in
the other cells whose centroids are about as near, so that a vector's neighbours are members of its home. In a cell, rotated vectors lie in blocks of
columns and in short lists. A list of queries takes the lists around it whole, which gives each query a good k-th best distance; of all other members it
reads the first block of columns only and abandons those whose distance, estimated from it, is above that one at the confidence of a test; the
survivors go on block by block. Where a few queries of the list show that many would survive the first block, one product of all columns, which abandons
nothing, costs less than going on pair by pair, and takes its place. What remains is compared exactly in double precision. Vectors of one direction, whatever their lengths, are a class: all of it
is equally similar to each of its members, so beyond the first k + 1 they ask for nothing and are given what the first one found. As candidates of others
they stay, but for exact copies beyond k + 1, since rounding may tell them apart there; a cell with a crowd of candidates is searched in parts. Centroids have two levels where one would have more than
``MAX_CELLS``: those of the second level are fitted and searched by the workers, each within a cell of the first, so neither the driver nor a task holds
more than MAX_CELLS of them and work per vector doesn't depend on the number of vectors. The index covers every vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.joins import lookup
from tessera.operators.knn import cosine
from tessera.session import checkpointed, written

#: Vectors at home in a cell, on average; at most so many cells; vectors in the sample that centroids are fitted on, per cell.
CELL_ROWS, MAX_CELLS, SAMPLE_PER_CELL = 4000, 2048, 48
#: A vector is a member of at most so many cells, and only of those whose centroid's cosine is within the margin of its nearest one's.
PROBES, MARGIN = 6, 0.1
#: Rows at home that one task scans at most, on average.
BLOCK_ROWS = 12_000
#: Vectors are of one class if HASHED of their numbers, as shares of the largest of these, agree to one part in GRID, and their cosine with the class's first
#: one is above SAME: then all their cosines round to 1 at 9 decimals.
HASHED, GRID, SAME = 8, 65_536, 1 - 1e-12
#: Candidates that one task holds at most, on average, where classes leave more of them than vectors that ask.
PART_ROWS = 48_000
#: Candidate pairs that a task compares at once, at most (unless one vector has more).
PAIRS = 1_000_000
#: About the bytes of a member, and of the members that a task reads.
MEMBER_BYTES, TASK_BYTES = 450, 48_000_000
#: Columns of a block; significance of the test that abandons a candidate; members of a list; candidates taken whole, at least.
COLUMNS, EPSILON, LIST_ROWS, WHOLE = 24, 2.1, 256, 768
#: Queries of a list that the first block is tried on; the share of members left by it from which on a product of all columns costs less than going on pair by pair.
SAMPLED, DENSE = 16, 0.025


def usable(vec: Column, dims: int) -> Column:
    """Whether an array is a vector of so many numbers, none of them null, NaN or infinite, and not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vec.isNotNull() & (F.size(vec) == dims) & ~F.exists(vec, bad) & F.exists(vec, lambda x: x != 0)


def vectors_of(rows: DataFrame, dims: int = 96, vec_id: str = "vec_id", vec: str = "vec", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (array of float), h (hash of its direction): vec, or embedding where vec is null; unusable vectors and null ids are left out."""
    v = F.coalesce(F.col(vec).cast("array<float>"), F.col(embedding).cast("array<float>"))
    out = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v"), dims))
    # some of the numbers do: what they bring together is compared whole
    some = F.array(*(F.col("v")[i].cast("double") for i in range(0, dims, max(1, dims // HASHED))))
    top = F.array_max(F.transform(some, lambda x: F.abs(x)))
    at = F.transform(some, lambda x: F.round(x / F.col("_top") * GRID).cast("int"))
    return out.withColumn("_top", top).select("vec_id", "v", F.xxhash64(at).alias("h"))


def _unit(v: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _some(vectors: DataFrame, n: int, want: int, seed: int) -> DataFrame:
    """A share of the vectors, chosen by a hash of their id, that has at least about ``want`` of ``n``."""
    share = math.ceil(min(1.0, 1.3 * want / max(n, 1)) * 1_000_000)
    return vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_000)) < share) if n > want else vectors


def _means(u: np.ndarray, cells: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of unit vectors, and the share in each."""
    centroids = u[np.random.default_rng(seed).choice(len(u), min(cells, len(u)), replace=False)]
    for _ in range(10):
        at = (u @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, u)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), centroids)
    return centroids, np.bincount((u @ centroids.T).argmax(axis=1), minlength=len(centroids)) / len(u)


def fit_centroids(vectors: DataFrame, cells: int, n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids (MAX_CELLS at most) and the share of the sample in each, from at most SAMPLE_PER_CELL vectors per cell."""
    want = cells * SAMPLE_PER_CELL
    sample = _some(vectors, n, want, seed).select("v").limit(2 * want + 100).toPandas()["v"]
    if not len(sample):
        return np.zeros((1, 1), np.float32), np.ones(1)
    return _means(_unit(np.stack(sample.to_numpy()).astype(np.float64)).astype(np.float32), cells, seed)


def _near_cells(unit: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, rank, cell) of the cells that rows are members of, the nearest first."""
    near = unit @ centroids.T
    cells = np.argsort(-near, axis=1, kind="stable")[:, : min(PROBES, near.shape[1])]
    inside = np.take_along_axis(near, cells, axis=1)
    row, k = np.nonzero(inside >= inside[:, :1] - MARGIN)
    return row, k, cells[row, k]


def _below(cells: int, seed: int = 13):
    """Rows (top, v) of a top cell's sample -> its own centroids and their shares."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        want = cells * SAMPLE_PER_CELL
        pdf = pdf.iloc[:want]
        raw = np.frombuffer(b"".join(pdf["v"]), np.float32).reshape(len(pdf), -1).astype(np.float64)
        centroids, share = _means(_unit(raw).astype(np.float32), cells, seed)
        return pd.DataFrame({"top": np.int32(key[0]), "sub": np.arange(len(share), dtype=np.int32), "c": [x.tobytes() for x in centroids], "share": share})

    return run


def _sub_members(pdf: pd.DataFrame, subs: pd.DataFrame) -> pd.DataFrame:
    """Rows of one top cell (a salted part of it) and its centroids -> rows of its cells."""
    if pdf.empty or subs.empty:
        return pd.DataFrame({"cell": [], "block": [], "home": [], "cand": [], "vec_id": [], "v": []}).astype({"cell": "int64", "block": "int32", "home": bool, "cand": bool, "vec_id": "int64"})
    subs = subs.sort_values("sub")
    centroids = np.frombuffer(b"".join(subs["c"]), np.float32).reshape(len(subs), -1)
    raw = np.frombuffer(b"".join(pdf["v"]), np.float32).reshape(len(pdf), -1)
    row, k, sub = _near_cells(_unit(raw.astype(np.float64)).astype(np.float32), centroids)
    blocks, ids, home = subs["blocks"].to_numpy(), pdf["vec_id"].to_numpy(), pdf["home"].to_numpy()
    row, k, sub, block = _in_blocks(row, k, sub, blocks)
    mine = home[row] & (k == 0) & (block == ids[row] % blocks[sub])
    data = pdf["v"].to_numpy()
    return pd.DataFrame({"cell": subs["top"].iloc[0] * np.int64(MAX_CELLS) + sub, "block": block.astype(np.int32), "home": mine, "cand": True, "vec_id": ids[row], "v": data[row]})


def _in_blocks(row: np.ndarray, k: np.ndarray, cell: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each member once for every block of its cell."""
    times = blocks[cell]
    block = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(row, times), np.repeat(k, times), np.repeat(cell, times), block


def _members(centroids: np.ndarray, blocks: np.ndarray | None, parts: np.ndarray | None = None):
    """Rows (cell, block, home, vec_id, v): the home row in one block of its cell, and as a candidate in all blocks of its cells. Without blocks: once per cell.

    With parts, blocks are numbered block * parts + part: a candidate is in one part of every block, a home row, as one that asks, in all parts of its block.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            raw = np.stack(batch["v"].to_numpy()).astype(np.float32)
            ids = batch["vec_id"].to_numpy()
            row, k, cell = _near_cells(_unit(raw.astype(np.float64)).astype(np.float32), centroids)
            asks = batch["asks"].to_numpy(dtype=bool)
            if blocks is None:
                block, home, cand = np.zeros(len(row), np.int64), (k == 0) & asks[row], np.ones(len(row), bool)
            elif parts is None:
                row, k, cell, block = _in_blocks(row, k, cell, blocks)
                home, cand = (k == 0) & asks[row] & (block == ids[row] % blocks[cell]), np.ones(len(row), bool)
            else:
                row, k, cell, block = _in_blocks(row, k, cell, blocks * parts)
                home = (k == 0) & asks[row] & (block // parts[cell] == ids[row] % blocks[cell])
                cand = block % parts[cell] == ids[row] // 7 % parts[cell]
                some = home | cand
                row, cell, block, home, cand = row[some], cell[some], block[some], home[some], cand[some]
            data = [x.tobytes() for x in raw]
            yield pd.DataFrame({"cell": cell.astype(np.int64), "block": block.astype(np.int32), "home": home, "cand": cand, "vec_id": ids[row], "v": [data[i] for i in row]})

    return run


_MEMBER = "cell long, block int, home boolean, cand boolean, vec_id long, v binary"


def members(vectors: DataFrame, n: int, others: int = 0) -> DataFrame:
    """The index: cell, block, home, cand, vec_id, v (bytes) of every vector (vec_id, v, asks) in all its cells.

    n of the vectors ask, and each of these is home once (in every part of a block); ``others`` are candidates only.
    """
    cells = max(1, math.ceil(n / CELL_ROWS))
    rows = vectors.select("vec_id", "v", "asks")
    asking = rows.where("asks") if others else rows
    if cells <= MAX_CELLS:
        centroids, share = fit_centroids(asking, cells, n)
        blocks = np.maximum(1, np.ceil(share * n / BLOCK_ROWS)).astype(np.int64)
        parts = None
        if others > n:
            # where the candidates are, from a sample of the same bound
            want = cells * SAMPLE_PER_CELL
            raw = _some(rows.where("not asks"), others, want, 19).select("v").limit(2 * want + 100).toPandas()["v"]
            if len(raw):
                at = (_unit(np.stack(raw.to_numpy()).astype(np.float64)).astype(np.float32) @ centroids.T).argmax(axis=1)
                crowd = np.bincount(at, minlength=len(centroids)) / len(raw) * others
                parts = np.maximum(1, np.ceil(crowd / PART_ROWS)).astype(np.int64)
        return rows.mapInPandas(_members(centroids, blocks, parts), _MEMBER)
    tops = min(MAX_CELLS, math.ceil(math.sqrt(cells)))
    below = min(MAX_CELLS, math.ceil(cells / tops))
    centroids, share = fit_centroids(asking, tops, n)
    near = rows.mapInPandas(_members(centroids, None), _MEMBER)
    # a top cell's sample is bounded by below * SAMPLE_PER_CELL on average, its centroids by MAX_CELLS
    sample = _some(asking, n, tops * below * SAMPLE_PER_CELL, 17).mapInPandas(_members(centroids, None), _MEMBER).where("home")
    subs = sample.select(F.col("cell").cast("int").alias("top"), "v").groupBy("top").applyInPandas(_below(below), "top int, sub int, c binary, share double")
    sizes = near.where("home").groupBy(F.col("cell").cast("int").alias("top")).agg(F.count("*").alias("rows"))
    subs = subs.join(F.broadcast(sizes), "top")  # a row per top cell: MAX_CELLS at most
    subs = written(subs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("rows") / BLOCK_ROWS)).cast("long")), "centroids")
    # a top cell is searched in parts of bounded size
    parts = written(subs.select("top", "rows").distinct().select("top", F.greatest(F.lit(1), F.ceil(F.col("rows") / (8 * BLOCK_ROWS))).cast("int").alias("parts")), "parts")
    left = near.withColumnRenamed("cell", "top").withColumn("top", F.col("top").cast("int")).join(F.broadcast(parts), "top").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    right = subs.join(F.broadcast(parts), "top").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("top", "part", "sub", "c", "blocks")
    return left.groupBy("top", "part").cogroup(right.groupBy("top", "part")).applyInPandas(_sub_members, _MEMBER)


def _rotation(dims: int, seed: int = 11) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))[0].astype(np.float32)


def scan(u: np.ndarray, ids: np.ndarray, home: np.ndarray, k: int, cand: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, near row, similarity) of the k most similar candidates (by default all rows) of every home row; u are unit vectors in double precision, ids increase."""
    n, dims = u.shape
    r = u.astype(np.float32) @ _rotation(dims)
    n_lists = max(1, n // LIST_ROWS)
    heads = r[np.linspace(0, n - 1, n_lists).astype(int)]
    of = np.concatenate([(r[i : i + 4096] @ heads.T).argmax(axis=1) for i in range(0, n, 4096)])
    order = np.argsort(of, kind="stable")
    r, start = np.ascontiguousarray(r[order]), np.searchsorted(of[order], np.arange(n_lists + 1))
    edges = [*range(0, dims, COLUMNS), dims]
    columns = [np.ascontiguousarray(r[:, a:b]) for a, b in zip(edges, edges[1:])]
    left = [1 - np.einsum("ij,ij->i", r[:, :b], r[:, :b]) for b in edges[1:]]  # squared length outside the first columns
    around = heads @ heads.T
    found: list[tuple[np.ndarray, ...]] = []
    sizes, v, own = np.diff(start), u[order], ids[order]
    out_ = np.flatnonzero(~cand[order]) if cand is not None and not cand.all() else None
    for li in range(n_lists):
        q = np.arange(start[li], start[li + 1])
        q = q[home[order[q]]]
        if not len(q):
            continue
        near = np.argsort(-around[li], kind="stable")
        near = np.concatenate(([li], near[near != li]))
        whole = near[: np.searchsorted(np.cumsum(sizes[near]), WHOLE) + 1]
        c = np.concatenate([np.arange(start[x], start[x + 1]) for x in whole])
        todo = [q[i : i + 512] for i in range(0, len(q), 512)]
        while todo:
            some = todo.pop()
            pairs = _scan_list(r, columns, left, edges, some, c, k, out_)
            if pairs is None:  # too many at once
                todo += [some[: len(some) // 2], some[len(some) // 2 :]]
            else:
                found.append(_best(v, own, *pairs, k))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    a, b, sim = (np.concatenate(x) for x in zip(*found))
    return order[a], order[b], sim


def _best(u: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of candidate pairs the k most similar of each row, compared in double precision; equal ones by the smaller id."""
    sim = np.concatenate([np.zeros(0), *(np.round(np.einsum("ij,ij->i", u[a[i : i + 65536]], u[b[i : i + 65536]]), 9) for i in range(0, len(a), 65536))])
    by = np.lexsort((ids[b], -sim, a))
    a, b, sim = a[by], b[by], sim[by]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep], sim[keep]


def _scan_list(r: np.ndarray, columns: list[np.ndarray], left: list[np.ndarray], edges: list[int], q: np.ndarray, c: np.ndarray, k: int, without: np.ndarray | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Candidates (row, near row) that may be among the k best of the queries q: from the members c whole, from all others by column blocks, but those ``without``.

    None if they are more than PAIRS and q can be halved.
    """
    dims = r.shape[1]
    s = r[q] @ r[c].T
    s[q[:, None] == c[None, :]] = -4
    if without is not None:
        s[:, np.isin(c, without)] = -4
    kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(q), -3.0, np.float32)
    slack = 2e-6  # of single precision
    close = (s >= kth[:, None] - slack) & (s > -3)
    many = len(q) > 1 and PAIRS
    if many and np.count_nonzero(close) > many:
        return None
    qi, ci = np.nonzero(close)
    first = (q[qi], c[ci])
    if len(c) == len(r):
        return first
    limit = 2 - 2 * (kth - slack)  # squared distance
    # squared distance on the first columns, as lengths there less twice the product
    d, length = edges[1], 1 - left[0]
    least = length[q] - limit * (1 + EPSILON / math.sqrt(d)) ** 2 * d / dims

    def outside(alive: np.ndarray) -> np.ndarray:
        alive[:, c] = False
        if without is not None:
            alive[:, without] = False
        return alive

    some = slice(None, None, -(-len(q) // SAMPLED))
    tried = outside(2 * (columns[0][q[some]] @ columns[0].T) >= least[some, None] + length)
    if np.count_nonzero(tried) > DENSE * tried.size:
        # so many go on that all columns of all members at once cost less; nothing is abandoned
        alive = outside(r[q] @ r.T >= (kth - slack)[:, None])
        if many and np.count_nonzero(alive) + len(first[0]) > many:
            return None
        qi, ci = np.divmod(np.flatnonzero(alive), len(r))
        return np.concatenate((first[0], q[qi])), np.concatenate((first[1], ci))
    part = columns[0][q] @ columns[0].T
    alive = outside(2 * part >= least[:, None] + length)
    if many and np.count_nonzero(alive) > 4 * many:
        return None
    qi, ci = np.divmod(np.flatnonzero(alive), len(r))
    dot = part[qi, ci]
    for block, rest, d in zip(columns[1:], left[1:], edges[2:]):
        dot = dot + np.einsum("ij,ij->i", block[q[qi]], block[ci])
        bound = limit * ((1 + EPSILON / math.sqrt(d)) ** 2 * d / dims if d < dims else 1)
        ok = (1 - rest)[q[qi]] + (1 - rest)[ci] - 2 * dot <= bound[qi]
        qi, ci, dot = qi[ok], ci[ok], dot[ok]
    if many and len(qi) + len(first[0]) > many:
        return None
    return np.concatenate((first[0], q[qi])), np.concatenate((first[1], ci))


def _search(k: int):
    def run(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "home", "cand"], ascending=[True, False, False], kind="stable")
        if not pdf["home"].any():
            return pd.DataFrame({"vec_id": [], "near_id": [], "sim": []}).astype({"vec_id": "int64", "near_id": "int64", "sim": float})
        pdf = pdf.drop_duplicates(["vec_id", "v"])
        ids, home, cand = pdf["vec_id"].to_numpy(), pdf["home"].to_numpy(), pdf["cand"].to_numpy()
        raw = np.frombuffer(b"".join(pdf["v"]), np.float32).reshape(len(pdf), -1)
        a, b, sim = scan(_unit(raw.astype(np.float64)), ids, home, k, cand)
        other = ids[a] != ids[b]
        return pd.DataFrame({"vec_id": ids[a][other], "near_id": ids[b][other], "sim": sim[other]})

    return run


def neighbours(vectors: DataFrame, k: int = 5) -> DataFrame:
    """vec_id, near_id, sim: for every vector of ``vectors`` (vec_id, v, h) the k most similar others by cosine, rounded to 9 decimals; equal ones by the smaller id.

    Approximate in that a neighbour may be in no probed cell or be abandoned by a test; reported similarities are exact. A vec_id that comes again with
    the same numbers counts once. Fewer than two vectors: no rows. Any number of vectors may share a direction: of each such class k + 1 are searched for,
    and the others are given what its first one found at similarity 1, and that one.
    """
    big = checkpointed(vectors.groupBy("h").agg(F.count("*").alias("copies"), F.min("vec_id").alias("head_id")).where(F.col("copies") > k + 1))
    if big.isEmpty():
        return _searched(vectors.withColumn("asks", F.lit(True)), k, vectors.count())
    heads = lookup(vectors, big.select("h", "head_id"), "h").where(F.col("vec_id") == F.col("head_id")).groupBy("h").agg(F.min("v").alias("head"))
    split = lookup(vectors, checkpointed(heads), "h").withColumn("_in", F.col("head").isNotNull() & F.coalesce(cosine(F.col("v"), F.col("head")) > SAME, F.lit(False)))
    # lengths that differ by a power of two leave all digits as they are
    scale = F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))))
    split = split.withColumn("x", F.when(F.col("_in"), F.xxhash64(F.transform("v", lambda x: x.cast("double") / scale))))

    def first(*by: str) -> DataFrame:
        # this limit of ranks is applied before the shuffle, too
        ranked = split.where("_in").withColumn("n", F.dense_rank().over(Window.partitionBy(*by).orderBy("vec_id")))
        return ranked.where(F.col("n") <= k + 1)

    last = first("h").groupBy("h").agg(F.min("vec_id").alias("head_id"), F.max("vec_id").alias("last_id"), F.count_distinct("vec_id").alias("m"))
    last = checkpointed(last.withColumn("last_id", F.when(F.col("m") > k, F.col("last_id"))).drop("m"))
    crowd = lookup(first("h", "x").select("vec_id", "v", "h").dropDuplicates(["h", "vec_id", "v"]), last, "h")
    crowd = crowd.select("vec_id", "v", F.coalesce(F.col("vec_id") <= F.col("last_id"), F.lit(True)).alias("asks"))
    searched = checkpointed(split.where("not _in").select("vec_id", "v", F.lit(True).alias("asks")).unionByName(crowd))
    n = {r["asks"]: r["count"] for r in searched.groupBy("asks").count().collect()}
    found = written(_searched(searched, k, n.get(True, 0), n.get(False, 0)), "neighbours")
    whole = last.where("last_id is not null")
    ones = found.where("sim >= 1").join(whole.select("head_id", "h"), F.col("vec_id") == F.col("head_id"))
    near = ones.groupBy("h", "head_id").agg(F.collect_set("near_id").alias("near"))  # k ids at most
    near = whole.join(near, ["h", "head_id"], "left").select("h", "last_id", F.slice(F.array_sort(F.array_union(F.array("head_id"), F.coalesce("near", F.array().cast("array<long>")))), 1, k).alias("near"))
    later = lookup(split.where("_in").select("vec_id", "h"), checkpointed(near), "h").where(F.col("vec_id") > F.col("last_id"))
    return found.unionByName(later.select("vec_id", F.explode("near").alias("near_id"), F.lit(1.0).alias("sim")).distinct())


def _searched(vectors: DataFrame, k: int, n: int, others: int = 0) -> DataFrame:
    # partitions by what there is, not by the session's number alone: a vector is in two to three cells on average
    conf = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    index = members(vectors, n, others).repartition(max(conf, math.ceil(3 * (n + others) * MEMBER_BYTES / TASK_BYTES)), "cell", "block")
    found = index.groupBy("cell", "block").applyInPandas(_search(k), "vec_id long, near_id long, sim double")
    if others <= n:
        return found
    # what the parts of a block found, together
    best = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("sim"), "near_id"))
    return found.distinct().withColumn("_n", best).where(F.col("_n") <= k).drop("_n")


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """Distinct pairs (vec_id, near_id) with the smaller id first."""
    return near.select(F.least("vec_id", "near_id").alias("vec_id"), F.greatest("vec_id", "near_id").alias("near_id")).distinct()
