"""Evaluation passages that occur, whole or in part, in a corpus: latent semantic retrieval and alignment.

Passages and documents are cut into overlapping windows of words. The windows of all passages, as TF-IDF vectors over words and word pairs, are taken in
blocks; each block spans a latent space by its SVD, worked out by the workers, of which all directions are kept. Document windows are projected the same way
and compared with all passage windows; a candidate is what reaches the least value that a window with a case can have (the weakest run of 12 words, or piece of
15 with two words lost, of that passage window), so no case is lost, whatever stands around it. A candidate's words are then aligned with the passage's (longest
common subsequence with costs for edits), and the alignment decides; where it finds no case, but most of a stretch in order, the item's answer in the document
makes it a paraphrase. Terms are weighted by their frequency in the corpus, counted over all documents. The passages are a fixed set whose number is checked,
as are the bytes of what is sent to the workers; the documents are read whole, without a shuffle, once for the counts and once for every portion of the passages.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import words

#: Words of a window and between windows: any WINDOW - STRIDE words in a row lie whole in one window.
WINDOW, STRIDE = 32, 16
#: Passage windows that span a latent space; windows whose spaces are sent to the workers together, and the bytes that these may have.
BLOCK, PORTION, BYTES = 128, 4096, 160_000_000
#: Weight of single words beside pairs; a direction whose singular value is below this share of the first is rounding.
SINGLE, TINY = 0.5, 1e-5
#: Words of a piece of a stretch, and of those edited at most: any stretch has such a piece, as more in every 15 words would be over one in 8.
PIECE, LOST = 15, 2
#: Known word pairs that a window with a case has: RUN words in a row have RUN - 1, a piece PIECE - 1, of which each edit takes two.
LEAST_PAIRS = 10
#: What counts: words in a row; or words of a stretch, of which at most one in EDIT_EVERY is edited.
RUN, STRETCH, EDIT_EVERY = 12, 30, 8
#: A paraphrase has STRETCH passage words of which at least this share stand in order in the text, and the item's answer.
ALIKE = 0.6
#: Any case of that size shares so many runs of three words with its passage.
LEAST_TRIPLES = 10
#: The held-out set must not exceed this.
MAX_ITEMS = 50_000


def _terms(w: list, ids: dict[str, int], pairs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of each word's term and of the pair that it begins, -1 where the vocabulary lacks it."""
    one = np.fromiter((ids.get(x, -1) for x in w), np.int64, len(w))
    two = np.full(len(w), -1, np.int64)
    if len(w) > 1:
        code = one[:-1] * n + one[1:]
        code[(one[:-1] < 0) | (one[1:] < 0)] = -1
        at = np.searchsorted(pairs, code)
        at[at == len(pairs)] = 0
        two[:-1] = np.where((len(pairs) > 0) & (pairs[at] == code) & (code >= 0), at + n, -1) if len(pairs) else -1
    return one, two


def _starts(n: int) -> range:
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def _least(w: list[str], ids: dict, pairs: np.ndarray, weight: np.ndarray) -> float:
    """The least product of a window that holds a run, or a piece of a stretch, of this passage window with its row; infinite if it is too short for one."""
    one, two = _terms(w, ids, pairs, len(ids))
    u, v = _row(w, ids, pairs, weight)
    value = lambda t: weight[t] * v[np.searchsorted(u, t)]
    a, b = value(one).astype(np.float64), value(two[:-1]).astype(np.float64)
    least = np.inf
    for i in range(len(w) - RUN + 1):
        least = min(least, a[i : i + RUN].sum() + b[i : i + RUN - 1].sum())
    for i in range(len(w) - PIECE + 1):
        x, y = a[i : i + PIECE], b[i : i + PIECE - 1]
        loss = np.sort(x + np.append(y, 0) + np.append(0, y))
        least = min(least, x.sum() + y.sum() - loss[-LOST:].sum())
    return float(least)


@dataclass
class Block:
    """The latent space of some passage windows: its terms, their directions, the windows' rows in it, what a case reaches at least, what of a row lies outside."""

    terms: np.ndarray
    basis: np.ndarray
    latent: np.ndarray
    least: np.ndarray
    outside: np.ndarray
    owner: np.ndarray


@dataclass
class Space:
    """The latent spaces of a set of passages."""

    items: list[int]
    texts: list[list[str]]
    answers: list[list[str]]
    ids: dict[str, int]
    pairs: np.ndarray
    weight: np.ndarray
    blocks: list[Block]
    triples: dict[int, frozenset]

    def candidates(self, docs: list[list[str]]) -> list[tuple[int, int]]:
        """Sorted (position of the document, position of the item) where a window of the document reaches what a case of one of the passage reaches at least."""
        if not self.ids:
            return []
        # each document begins a new block of STRIDE words
        room = np.array([-(-len(w) // STRIDE) * STRIDE for w in docs], np.int64)
        begin = np.cumsum(room) - room
        flat: list[str | None] = [None] * int(room.sum())
        for s, w in zip(begin.tolist(), docs):
            flat[s : s + len(w)] = w
        one, two = (t.reshape(-1, STRIDE) for t in _terms(flat, self.ids, self.pairs, len(self.ids)))
        of = np.repeat(np.arange(len(docs)), room // STRIDE)
        last = np.append(of[1:] != of[:-1], True)
        # a window is a block and the next one of its document; it needs a few known pairs
        ahead = lambda x: np.where(last, 0, np.append(x[1:], 0))
        found: set[tuple[int, int]] = set()
        here = np.full(len(self.weight) + 1, -1)  # the last is for terms that are not known
        for b in self.blocks:
            here[b.terms] = np.arange(len(b.terms))
            common = (here[two] >= 0).sum(axis=1)
            window = np.flatnonzero(common + ahead(common) >= LEAST_PAIRS)
            for i in range(0, len(window), 4096):
                found.update(self._reached(b, here, one, two, of, last, window[i : i + 4096]))
            here[b.terms] = -1
        return sorted(found)

    def _reached(self, b: Block, here: np.ndarray, one: np.ndarray, two: np.ndarray, of: np.ndarray, last: np.ndarray, window: np.ndarray) -> Iterator[tuple[int, int]]:
        used = np.unique(np.concatenate((window, window[~last[window]] + 1)))
        part = np.zeros((len(used) + 1, b.basis.shape[1]), np.float32)
        heavy = np.zeros(len(used) + 1, np.float32)
        t = here[np.concatenate((one[used], two[used]), axis=1)]
        row, col = np.nonzero(t >= 0)
        t = t[row, col]
        weight = self.weight[b.terms]
        for i in range(0, len(t), 65536):
            some, rows = t[i : i + 65536], row[i : i + 65536]
            k, first = np.unique(rows, return_index=True)
            part[k] += np.add.reduceat(b.basis[some] * weight[some, None], first, axis=0)
            heavy[k] += np.add.reduceat(weight[some], first)
        at = np.searchsorted(used, window)
        after = np.where(last[window], len(used), at + 1)
        q, size = part[at] + part[after], heavy[at] + heavy[after]
        # what of a row lies outside the space could add no more than this
        r, c = np.nonzero(q @ b.latent.T >= b.least - size[:, None] * b.outside)
        return zip(of[window[r]].tolist(), b.owner[c].tolist())


def _vocabulary(texts: list[list[str]]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Ids of the words, sorted codes of the pairs, and the number of passages that each word and pair stands in."""
    ids = {x: i for i, x in enumerate(sorted({x for w in texts for x in w}))}
    n = len(ids)
    codes = [[ids[a] * n + ids[b] for a, b in zip(w, w[1:])] for w in texts]
    pairs = np.array(sorted({c for x in codes for c in x}), dtype=np.int64)
    df = np.zeros(n + len(pairs), np.int64)
    for w, c in zip(texts, codes):
        df[sorted({ids[x] for x in w})] += 1
        if c:
            df[n + np.searchsorted(pairs, sorted(set(c)))] += 1
    return ids, pairs, df


def _counts(vocabulary: Broadcast):
    """Rows (doc_id, text) -> (term, df): how many of the documents hold each word and pair of the vocabulary; (-1, number of documents)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, pairs = vocabulary.value
        size = len(ids) + len(pairs)
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for _, docs in _portions(batch["doc_id"], batch["text"]):
                flat = [x for w in docs for x in (*w, None)]
                of = np.repeat(np.arange(len(docs)), [len(w) + 1 for w in docs])
                for t in _terms(flat, ids, pairs, len(ids)):
                    known = t >= 0
                    total += np.bincount(np.unique(of[known] * size + t[known]) % size, minlength=size)
                n += len(docs)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"term": np.append(found, -1), "df": np.append(total[found], n)})

    return run


def _weights(rows: DataFrame, ids: dict[str, int], pairs: np.ndarray, in_passages: np.ndarray, n_passages: int) -> np.ndarray:
    """Weight of each word and pair: its inverse frequency over all documents and passages."""
    sent = rows.sparkSession.sparkContext.broadcast((ids, pairs))  # of a portion of the checked set
    df = in_passages.astype(np.float64)
    n = n_passages
    for r in rows.mapInPandas(_counts(sent), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row per term of the portion
        if r["term"] < 0:
            n += r["df"]
        else:
            df[r["term"]] += r["df"]
    weight = np.log(1 + n / df).astype(np.float32)
    weight[: len(ids)] *= SINGLE
    return weight


def _row(w: list[str], ids: dict, pairs: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two = _terms(w, ids, pairs, len(ids))
    t = np.concatenate((one[one >= 0], two[two >= 0]))
    u, k = np.unique(t, return_counts=True)
    v = weight[u] * k
    return u, (v / max(np.linalg.norm(v), 1e-9)).astype(np.float32)


def _spans(ids: dict, pairs: np.ndarray, weight: np.ndarray):
    """Rows (block, windows of words, owners) -> the pickled Block of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for windows, owner in zip(batch["w"], batch["owner"]):
                windows = [list(w) for w in windows]
                rows = [_row(w, ids, pairs, weight) for w in windows]
                terms = np.unique(np.concatenate([t for t, _ in rows]))
                a = np.zeros((len(rows), len(terms)))
                for x, (t, v) in zip(a, rows):
                    x[np.searchsorted(terms, t)] = v
                _, size, turn = np.linalg.svd(a, full_matrices=False)
                basis = turn[size > TINY * size[0]].T.astype(np.float32)
                latent = (a @ basis).astype(np.float32)
                outside = np.linalg.norm(a - latent @ basis.T, axis=1)
                least = np.array([_least(w, ids, pairs, weight) for w in windows])
                block = Block(terms, basis, latent, 0.999 * least.astype(np.float32), outside.astype(np.float32), np.asarray(owner, np.int64))
                yield pd.DataFrame({"block": [pickle.dumps(block)]})

    return run


def _portion(rows: list, first: int) -> int:
    """Where a portion that begins at an item ends: at PORTION windows, but it has one item at least."""
    windows, i = 0, first
    while i < len(rows) and (i == first or windows + len(_starts(len(rows[i][1]))) <= PORTION):
        windows += len(_starts(len(rows[i][1])))
        i += 1
    return i


def fit(items: DataFrame, docs: DataFrame, item_id: str = "item_id", passage: str = "passage", answer: str | None = "answer") -> Iterator[Space]:
    """The latent spaces of the passages, by portions; ``docs`` (doc_id, text) weigh the terms. Items with a null id or without RUN words in their passage can't leak and are left out."""
    spark = items.sparkSession
    rows = items.select(item_id, passage, F.col(answer) if answer else F.lit(None)).where(F.col(item_id).isNotNull()).dropDuplicates([item_id]).orderBy(item_id).limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} held-out items")
    rows = [(r[0], words(r[1]), words(r[2])) for r in rows]
    rows = [r for r in rows if len(r[1]) >= RUN]
    first = 0
    while first < len(rows):
        end = _portion(rows, first)
        some, first = rows[first:end], end
        texts = [r[1] for r in some]
        ids, pairs, df = _vocabulary(texts)
        weight = _weights(docs, ids, pairs, df, len(texts))
        windows = [(k, w[s : s + WINDOW]) for k, w in enumerate(texts) for s in _starts(len(w))]
        parts = [(([w for _, w in windows[i : i + BLOCK]]), [k for k, _ in windows[i : i + BLOCK]]) for i in range(0, len(windows), BLOCK)]
        found = spark.createDataFrame(parts, "w array<array<string>>, owner array<long>").repartition(len(parts)).mapInPandas(_spans(ids, pairs, weight), "block binary").collect()
        if sum(len(r["block"]) for r in found) > BYTES:
            raise ValueError("the spaces of a portion of passages are too large to be sent")
        triples = {k: frozenset(zip(w, w[1:], w[2:])) for k, w in enumerate(texts)}
        yield Space([r[0] for r in some], texts, [r[2] for r in some], ids, pairs, weight, [pickle.loads(r["block"]) for r in found], triples)


def align(p: list[str], w: list[str], edit: float = 2.0) -> list[int]:
    """The best local alignment of passage and text, as steps: 1 same word, 0 replaced, -1 dropped, -2 added."""
    known: dict[str, int] = {}
    a = np.array([known.setdefault(x, len(known)) for x in p])
    b = np.array([known.get(x, -1) for x in w])
    n, m = len(a), len(b)
    h = np.zeros((n + 1, m + 1), np.float32)
    slope = edit * np.arange(m + 1, dtype=np.float32)
    for i in range(1, n + 1):
        t = np.zeros(m + 1, np.float32)
        t[1:] = np.maximum(h[i - 1, :-1] + np.where(b == a[i - 1], 1.0, -edit), h[i - 1, 1:] - edit)
        h[i] = np.maximum.accumulate(np.maximum(t, 0) + slope) - slope
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    steps = []
    while i > 0 and j > 0 and h[i, j] > 0:
        same = b[j - 1] == a[i - 1]
        if h[i, j] == h[i - 1, j - 1] + (1.0 if same else -edit):
            steps.append(1 if same else 0)
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - edit:
            steps.append(-1)
            i -= 1
        else:
            steps.append(-2)
            j -= 1
    return steps[::-1]


def long_stretch(steps: list[int]) -> bool:
    """Whether some part of an alignment has STRETCH passage words with at most one in EDIT_EVERY edited."""
    length = np.concatenate(([0], np.cumsum([s != -2 for s in steps])))
    edits = np.concatenate(([0], np.cumsum([s != 1 for s in steps])))
    span = length[None, :] - length[:, None]
    return bool(((span >= STRETCH) & (EDIT_EVERY * (edits[None, :] - edits[:, None]) <= span)).any())


def paraphrased(p: list[str], w: list[str]) -> bool:
    """Whether the text has, in order, ALIKE of the words of some STRETCH passage words; to be asked only where the answer is there too."""
    known = set(zip(p, p[1:]))
    at = [i for i, x in enumerate(zip(w, w[1:])) if x in known]
    reach, first = STRETCH, 0
    for k in range(1, len(at) + 1):
        if k == len(at) or at[k] - at[k - 1] > reach:
            if k - first >= LEAST_PAIRS:
                steps = align(p, w[max(0, at[first] - STRETCH) : at[k - 1] + 2 + STRETCH], 0.5)
                span = np.concatenate(([0], np.cumsum([s != -2 for s in steps])))
                same = np.concatenate(([0], np.cumsum([s == 1 for s in steps])))
                length = span[None, :] - span[:, None]
                if ((length >= STRETCH) & (same[None, :] - same[:, None] >= ALIKE * length)).any():
                    return True
            first = k
    return False


def holds(p: list[str], triples: frozenset, w: list[str]) -> bool:
    """Whether the words hold RUN words of the passage in a row or an edited stretch."""
    at = [i for i, t in enumerate(zip(w, w[1:], w[2:])) if t in triples]
    if len(at) < LEAST_TRIPLES:
        return False
    places = defaultdict(list)
    for i, x in enumerate(p):
        places[x].append(i)
    run: dict[int, int] = {}
    for x in w:
        run = {i: run.get(i - 1, 0) + 1 for i in places.get(x, ())}
        if run and max(run.values()) >= RUN:
            return True
    # parts of the text around shared runs; what lies further apart is no stretch
    reach, first = 2 * STRETCH, 0
    for k in range(1, len(at) + 1):
        if k == len(at) or at[k] - at[k - 1] > reach:
            if k - first >= LEAST_TRIPLES and long_stretch(align(p, w[max(0, at[first] - STRETCH) : at[k - 1] + 3 + STRETCH])):
                return True
            first = k
    return False


def _portions(ids: pd.Series, texts: pd.Series, most: int = 200_000) -> Iterator[tuple[list, list[list[str]]]]:
    """Documents with enough words, in portions of about so many words."""
    some, docs, size = [], [], 0
    for d, x in zip(ids, texts):
        w = words(x)
        if len(w) >= RUN:
            some.append(d)
            docs.append(w)
            size += len(w)
        if size >= most:
            yield some, docs
            some, docs, size = [], [], 0
    if docs:
        yield some, docs


def _leaks(space: Broadcast):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = space.value
        for batch in batches:
            out = []
            for some, docs in _portions(batch["doc_id"], batch["text"]):
                joined: dict[int, str] = {}
                for i, k in s.candidates(docs):
                    a, w = s.answers[k], docs[i]
                    if i not in joined and a:
                        joined[i] = f" {' '.join(w)} "
                    there = bool(a) and f" {' '.join(a)} " in joined[i]
                    if holds(s.texts[k], s.triples[k], w):
                        out.append((some[i], s.items[k], "copy", there))
                    elif there and paraphrased(s.texts[k], w):
                        out.append((some[i], s.items[k], "paraphrase", True))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "kind", "answer_too"])

    return run


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, kind, answer_too: documents that hold 12 words in a row of an item's passage, or an edited stretch of 30 (kind copy), and whether its answer is there too.

    Kind paraphrase: no such words, but most of a stretch in order, and the answer. Null and empty texts hold nothing; answer_too is false for an item
    without answer. Repeated rows of a document give one row per item and kind.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    schema = "doc_id long, item_id long, kind string, answer_too boolean"
    found = items.sparkSession.createDataFrame([], schema)
    for k, space in enumerate(fit(items, rows)):
        part = rows.mapInPandas(_leaks(items.sparkSession.sparkContext.broadcast(space)), schema)  # of a portion of the checked set, its bytes are checked
        found = found.unionByName(part) if k else part
    return found.distinct()
