"""Texts that lost their end: near-copies that go on, and ends that no whole text has.

Texts are reduced to what their end, their likeness and the statistics of words need, in one pass without a shuffle of texts. Copies with one text are one class. Near-copies are
found by banded min-hashes over shingles of five words, for texts of few words also of five letters; each text, however it ends, meets the next longer ones of its buckets, some in each round, until a
longer copy gives a verdict, or ends as it does and so stands for it, or none is left; in large buckets these are the ones that hold its last word. A pair is verified on its shingles (0.8 or more), its texts are aligned, and the one whose alignment ends
inside a sentence or line of the other is cut. Texts without such a copy are judged by their last line: its form (prose, list, log, JSON, code, sign-off)
and the terminality of its closing words: the share of all their occurrences in the corpus that end a sentence or line.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.joins import lookup
from tessera.llm.words import words
from tessera.session import written

#: Words of a shingle, least similarity of near-copies, bands and rows of a band (a pair at 0.8 is missed once in 500).
SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 16, 5
#: Texts with fewer words than this are compared by letters too.
FEW = 8 * SHINGLE
#: Longer texts of a bucket that a text meets in the first round; each later round takes four times as many, up to the last.
NEXT, NEXT_MOST = 4, 256
#: Words and tokens remembered by a worker, at most.
MEMORY = 400_000
#: In a bucket of more texts a text meets only those that hold its last word, or its first letters where it may go on: so many at most.
HOT, LETTERS = 1000, 4
#: Last words of the short text that are aligned with the long one.
TAIL = 400
#: Below this share of closing occurrences in list items a word doesn't end one.
CLOSES = 0.05
#: Words before a mark like "..." are a phrase of its own if of the texts with a sentence that begins so most end with the mark there: the lower bound of
#: that share, at this many deviations, is one half.
SURE = 1.645
#: A number's shape, or any word, after a certain word closes nothing if it does so in less than this share of at least so many cases.
NEVER, SEEN = 0.004, 100

_END = ".!?。！？｡"
_CLOSERS = "\"'”’»)]}】」』*_`"
_MARK = re.compile(r"[ \t]*(?:\.{3,}|…+|[\[(](?:\.{3}|…|truncated|cut|more|continued|cont\.?)[\])]|<(?:truncated|cut|more)>)$", re.I)
_BULLET = re.compile(r"^[ \t]*(?:[-*+•‣]|\d{1,4}[.)])(?:[ \t]+|$)")
_SIGN = re.compile(r"^(?:--|—|–)[ \t]*\S.{0,60}$")
_FIELD = re.compile(r"^[^\W\d_][\w -]{0,24}:[ \t]+\S+(?:[ \t]*,?[ \t]*\S+){0,3}$")
_RULE = re.compile(r"^[ \t]*([-=*_~#.·])\1{2,}[ \t]*$")
_LOG = re.compile(r"^[ \t]*\[?(?:\d{4}-\d\d-\d\d[T ])?\d\d:\d\d")
_JSON = re.compile(r"^\s*(?:\[\s*[\[{\"\]]|\{\s*[\"}])")
_RUN = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_NUMBER = re.compile(r"^[(\[“\"']?\d[\d.,:/-]*$")
_STRING = re.compile(r'"(?:[^"\\]|\\.)*("|$)', re.S)


class _Memo(dict):
    """A function's values, kept for at most MEMORY arguments."""

    def __init__(self, f):
        super().__init__()
        self.f = f

    def __missing__(self, x):
        if len(self) >= MEMORY:
            self.clear()
        v = self[x] = self.f(x)
        return v


def _bare(text: str) -> list[str]:
    """Lines of the text without white space, rules, emoji and other symbols after its end."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    while lines:
        line = lines[-1]
        while line and (line[-1].isspace() or unicodedata.category(line[-1]) in ("So", "Sk", "Cf", "Mn", "Cc")) and line[-1] != "\ufffd":
            line = line[:-1]
        if line and not _RULE.match(line):
            lines[-1] = line
            return lines
        lines.pop()
    return []


def _open_brackets(text: str, code: bool) -> bool:
    """Whether a text ends inside a string or bracket."""
    if code:
        text = re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.S)
    open_string = False

    def drop(m: re.Match) -> str:
        nonlocal open_string
        open_string = not m[1]
        return ""

    rest = _STRING.sub(drop, text)
    return open_string or sum(rest.count(c) for c in "[{(") > sum(rest.count(c) for c in "]})")


def _last_word(line: str) -> str:
    found = _LETTERS.findall(line[-200:])
    return found[-1].lower() if found and line.endswith(found[-1]) else ""


def _fragment(line: str) -> str:
    """What stands after the last sentence of a line, in lower case."""
    return " ".join(re.split(r"(?<=[.!?。！？])[\"'”’»)\]]*\s+", line)[-1].lower().split())


def _shape(token: str) -> str:
    return re.sub(r"\d+", "d", token.rstrip(_END + _CLOSERS + ",;").lstrip("([“\"'"))


def judge(text: str | None) -> tuple[str, str]:
    """How a text ends: ("whole", ""), ("cut", ""), or a question to the corpus: a kind and a key whose terminality decides.

    Null, empty and blank texts, placeholders and such of symbols only are whole.
    """
    if not text:
        return "whole", ""
    lines = _bare(text)
    if not lines:
        return "whole", ""
    line, body = lines[-1], "\n".join(lines)
    if line.endswith("\ufffd"):
        return "cut", ""
    if _JSON.match(body) and body.count('"') > 1:
        return ("cut" if _open_brackets(body, False) else "whole"), ""
    first = next(x for x in lines if x.strip()).rstrip()
    if first.endswith("{") or (first.startswith("```") and body.count("```") % 2):
        return ("cut" if first.startswith("```") or _open_brackets(body, True) else "whole"), ""
    others = [x.rstrip() for x in lines[:-1] if x.strip()]
    if _SIGN.match(line) or (others and not lines[-2].strip() and _FIELD.match(line) and line[0].isupper() and line[-1] not in ",;:("):
        return "whole", ""
    if _BULLET.match(line) and any(_BULLET.match(x) for x in others[-3:]):
        return _listed(line, others)
    if not others and len(line.split()) <= 3 and len(line) <= 30 and not any(c in _END for c in line[:-1]):
        return "whole", ""
    if _LOG.match(line) and others:
        ends = Counter(x[-1] for x in others if _LOG.match(x))
        if ends:
            usual, n = ends.most_common(1)[0]
            if not usual.isalnum() and n >= 0.6 * ends.total():
                return ("whole" if line.endswith(usual) else "cut"), ""
    mark = _MARK.search(line)
    if mark:
        # of four dots the first ends the sentence
        line = line[: mark.start()] + (mark[0].strip()[:-3] if set(mark[0].strip()) == {"."} else "")
        line = line.rstrip()
        if not line:
            return "whole", ""
        if line.rstrip(_CLOSERS)[-1:] not in tuple(_END):
            phrase = _fragment(line)
            return ("mark", phrase) if phrase.count(" ") > 1 else ("cut", "")
    core = line.rstrip(_CLOSERS)
    if core and core[-1] in _END:
        tokens = core.split()
        before = _last_word(tokens[-2]) if len(tokens) > 1 else ""
        if before and _NUMBER.match(core.split()[-1].rstrip(_END)):
            return "number", f"{before} {_shape(tokens[-1])}"
        return ("after", before) if before else ("whole", "")
    if line[-1] in "}]" and line.count("{") + line.count("[") > 0 and not _open_brackets(line, False):
        return "whole", ""
    return "cut", ""


def _listed(line: str, others: list[str]) -> tuple[str, str]:
    """The end of a list whose items are no sentences."""
    items = [x for x in others if _BULLET.match(x)]
    if line[-1] in _END:
        return "whole", ""
    if sum(x[-1] in _END for x in items) > 0.6 * len(items):
        return "cut", ""
    rest = _BULLET.sub("", line)
    if not rest:
        return "cut", ""
    word = _last_word(rest)
    if not word:
        return ("whole", "") if rest[-1] in _CLOSERS or rest[-1].isdigit() else ("cut", "")
    if len(items) > 2 and len(rest.split()) < min(len(_BULLET.sub("", x).split()) for x in items):
        return "cut", ""
    return "list", word


def _token(t: str) -> tuple[bool, bool, bool, str, str, bool]:
    """Of a token: whether it ends with a stop, whether its core does, whether that is a number, its shape, the last word it holds, whether a word ends it."""
    core = t.rstrip(_CLOSERS)
    ends = core[-1:] in _END if core else False
    number = bool(_NUMBER.match(core.rstrip(_END + ",;") or "-"))
    found = _LETTERS.findall(core)
    whole = bool(found) and core.rstrip(_END + ",;:").endswith(found[-1]) and not ends and core[-1:] not in ",;:"
    return t[-1] in _END, ends, number, _shape(core) if number else "", found[-1].lower() if found else "", whole


_TOKENS = _Memo(_token)


def closings(text: str, into: dict) -> list[str]:
    """Count every word, number after a word, and word after a word of a text but its last token: (kind, key) -> [all, closing].

    Gives the first two words of the text's sentences, but of one that ends it before a mark.
    """
    lines = _bare(text)
    if not lines or _JSON.match(lines[0]):
        return []
    starts, marked = [], bool(_MARK.search(lines[-1]))
    for i, line in enumerate(lines):
        final = i == len(lines) - 1
        if _BULLET.match(line):
            ws = [t.lower() for t in _LETTERS.findall(line)]
            for j, w in enumerate(ws[:-1] if final else ws):
                n = into["list", w]
                n[0] += 1
                n[1] += j == len(ws) - 1
            continue
        tokens = line.split()
        before, begins, first = "", True, len(starts)
        for j, t in enumerate(tokens[:-1] if final else tokens):
            if begins and j + 2 < len(tokens):
                starts.append(f"{t} {tokens[j + 1]}".lower())
            begins, ends, number, shape, w, whole = _TOKENS[t]
            if number:
                if before:
                    n = into["number", f"{before} {shape}"]
                    n[0] += 1
                    n[1] += ends
                    n = into["after", before]
                    n[0] += 1
                    n[1] += ends
                before = ""
                continue
            if before and w:
                n = into["after", before]
                n[0] += 1
                n[1] += ends
            before = w if whole else ""
        if final and marked and len(starts) > first:
            starts.pop()
    return starts


_MULTIPLY = np.random.default_rng(3).integers(1, 2**63, size=(2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def _hash(word: str) -> int:
    b = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(b) | zlib.adler32(b) << 32


_HASHES = _Memo(_hash)


def shingle_hashes(w: list[str]) -> np.ndarray:
    """Distinct hashes of the shingles of five words; of fewer words, one of them all."""
    h = np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w))
    total = np.zeros(max(1, len(h) - SHINGLE + 1), np.uint64)
    for i in range(min(SHINGLE, len(h))):
        total = (total ^ h[i : i + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return np.unique(total)


def bands(s: np.ndarray) -> list[int]:
    """One hash per band of the min-hashes of a text's shingle hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        x = s[i : i + 4096, None] * _MULTIPLY[0] + _MULTIPLY[1]
        low = np.minimum(low, (x ^ (x >> np.uint64(31))).min(axis=0))
    rows = low.reshape(BANDS, ROWS)
    total = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        total = (total ^ rows[:, i]) * np.uint64(0xD6E8FEB86659FD93)
        total ^= total >> np.uint64(32)
    return total.view(np.int64).tolist()


def _alike(a: list[str], b: list[str]) -> bool:
    x, y = shingle_hashes(a), shingle_hashes(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILAR * (len(x) + len(y) - both)


def ends_early(short: str, long: str) -> int:
    """1 if the short text is a near-copy that stops inside a sentence or line of the long one, -1 if it stops at the end of one, 2 if both end there, 0 if it is none."""
    a, b = words(short), words(long)
    few = len(a) < FEW and len(b) < FEW
    if not (_alike(a, b) or few and _alike(list("".join(a)), list("".join(b)))):
        return 0
    bare = _cleared(short)
    rest = _beyond(bare, long.replace("\r\n", "\n").replace("\r", "\n"))
    if rest is None:
        return 0
    if not rest.strip():
        return 2
    if _JSON.match(bare) or bare.lstrip().split("\n")[0].rstrip().endswith("{") or bare.lstrip().startswith("```"):
        return 1 if judge(short)[0] == "cut" else -1  # a line's end closes no value or block
    if bare.rstrip(_CLOSERS)[-1:] in tuple(_END):
        return 1 if _word(rest[0]) else -1
    return -1 if rest.lstrip(" \t" + _CLOSERS + ",;").startswith("\n") else 1


def _cleared(text: str) -> str:
    """A text without what stands after its end, nor a mark."""
    return _MARK.sub("", "\n".join(_bare(text))).rstrip()


def _word(c: str) -> bool:
    return c.isalnum()


def _beyond(short: str, long: str) -> str | None:
    """What the long text has after the place where the alignment of the short text's last words ends, None if its last word stands at no such place."""
    a, b = list(_RUN.finditer(short)), list(_RUN.finditer(long))
    if not a or not b:
        return None
    n = len(a)
    # similar texts are displaced by no more words than they may differ in
    low = max(0, int((n - min(TAIL, n)) * SIMILAR) - 2 * SHINGLE)
    high = min(len(b), int(n / SIMILAR) + 2 * SHINGLE)
    a, b = a[-TAIL:], b[low:high]
    if not b:
        return None
    known: dict[str, int] = {}
    x = [known.setdefault(m[0].lower(), len(known)) for m in a]
    y = np.array([known.get(m[0].lower(), -1) for m in b])
    last = a[-1][0].lower()
    open_end = a[-1].end() == len(short)
    begins = np.array([m[0].lower().startswith(last) if open_end else m[0].lower() == last for m in b])
    # free begin in the long text unless both begin together; each edit costs 1
    at = np.arange(len(b) + 1, dtype=np.float32)
    h = -at if low == 0 and n <= TAIL else np.zeros_like(at)
    for i, w in enumerate(x):
        same = begins if i == len(x) - 1 else y == w
        t = np.full(len(b) + 1, h[0] - 1, np.float32)
        step = h[:-1] + np.where(same, 1, -1)
        t[1:] = np.maximum(step, h[1:] - 1)
        h = np.maximum.accumulate(t + at) - at
    end = np.flatnonzero(begins & (step >= h[1:]))
    if not len(end):
        return None
    best = end[np.argmax(step[end])]
    if step[best] < max(h.max() - 1, 0):
        return None
    m = b[best]
    if m[0].lower() != last:
        return long[m.start() + len(a[-1][0]) :]
    after, rest = short[a[-1].end() :], long[m.end() :]
    # the signs after the last word, whatever the white space among them
    i = 0
    for c in after:
        while not c.isspace() and rest[i : i + 1].isspace() and rest[i] != c:
            i += 1
        if not c.isspace() and rest[i : i + 1] == c:
            i += 1
        elif c in _END and _word(rest[i : i + 1] or " "):
            return None
    return rest[i:]


def _start(phrase: str) -> int:
    """Hash of the first two words of a sentence."""
    return int(np.uint64(_hash(" ".join(phrase.split(" ")[:2]))).view(np.int64))


_PROFILE = "doc_id long, kind string, key string, size int, shingles int, letters int, bands array<long>, start long, starts array<long>, n long, closing long"


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (doc_id, text) -> a row per text, and rows without doc_id: how often closing words (kind, key) occur, and how often they close a sentence or line."""
    columns = [c.split()[0] for c in _PROFILE.split(", ")]
    seen: defaultdict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])

    def counts() -> pd.DataFrame:
        rows = [(None, k, w, 0, 0, 0, None, None, None, *n) for (k, w), n in seen.items()]
        seen.clear()
        return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64", "start": "Int64"})

    for batch in batches:
        out = []
        for d, t in zip(batch["doc_id"], batch["text"]):
            kind, key = judge(t)
            w = words(t)
            by_word, by_letter = shingle_hashes(w), shingle_hashes(list("".join(w))) if len(w) < FEW else ()
            # the bands of letters follow those of words
            found = bands(by_word) if len(w) >= 2 * SHINGLE else [None] * BANDS
            found = found + (bands(by_letter) if len(w) < FEW and sum(map(len, w)) >= 2 * SHINGLE else [None] * BANDS)
            starts = {_start(x) for x in closings(t, seen)} if t else ()
            out.append((d, kind, key, len(t or ""), len(by_word), len(by_letter), found, _start(key) if kind == "mark" else None, list(starts), 0, 0))
        yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64", "start": "Int64"})
        if len(seen) > 500_000:
            yield counts()
    if seen:
        yield counts()


def phrase_of_its_own(n: Column, others: Column) -> Column:
    """Whether n of n + others is surely most (Wilson's lower bound)."""
    m, z = n + others, SURE
    p = n / m
    low = (p + z * z / (2 * m) - z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    return F.coalesce(low >= 0.5, F.lit(False))


def _answers(own: DataFrame, stats: DataFrame) -> DataFrame:
    """kind, key, open: whether the ends of the representatives that ask so are open, by all texts."""
    asked = own.where("key <> '' and kind <> 'mark'").select("kind", "key").distinct()
    # numbers of any shape after a word, to compare one shape with
    shapes = stats.where("kind = 'number'").groupBy(F.substring_index("key", " ", 1).alias("before")).agg(F.sum("closing").alias("others"))
    counts = stats.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("closing").alias("closing"))
    answers = asked.join(counts, ["kind", "key"], "left").withColumn("before", F.when(F.col("kind") == "number", F.substring_index("key", " ", 1))).join(shapes, "before", "left")
    answers = answers.select("kind", "key", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "closing", "others")))
    open_end = (
        F.when(F.col("kind") == "list", F.col("closing") < CLOSES * F.greatest("n", F.lit(1)))
        .when(F.col("kind") == "number", (F.col("others") >= SEEN) & (F.col("closing") < NEVER * F.col("others")))
        .otherwise((F.col("n") >= SEEN) & (F.col("closing") < NEVER * F.col("n")))
    )
    # a phrase before a mark: classes of copies that end so, against those with another sentence that begins so
    marks = own.where("kind = 'mark'").groupBy("kind", "key", "start").agg(F.count("*").alias("n"))
    begun = own.select(F.explode("starts").alias("start")).join(marks.select("start").distinct(), "start", "left_semi").groupBy("start").agg(F.count("*").alias("others"))
    marks = marks.join(begun, "start", "left").select("kind", "key", (~phrase_of_its_own(F.col("n"), F.coalesce("others", F.lit(0)))).alias("open"))
    return answers.select("kind", "key", open_end.alias("open")).unionByName(marks)


def _copies(profiles: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, verdict (1 cut, -1 whole) of class representatives that have a verified longer near-copy that goes on, or one that ends alike and has such a copy."""
    spark = profiles.sparkSession
    rows = profiles.select("doc_id", "size", "shingles", "letters", F.posexplode("bands").alias("band", "h")).where("h is not null")
    rows = rows.withColumn("shingles", F.when(F.col("band") < BANDS, F.col("shingles")).otherwise(F.col("letters"))).drop("letters")
    # buckets of one text fall away before any text is read
    buckets = rows.groupBy("band", "h").agg(F.count("*").alias("n")).where("n > 1")
    rows = _keyed(written(rows.join(buckets, ["band", "h"]), "shared"), texts)
    order = ["band", "h", "key", "size", "doc_id"]  # a large bucket spreads over partitions
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id()), "buckets")
    counts = sorted(tuple(r) for r in rows.groupBy(F.shiftright("_at", 33).alias("part")).count().collect())  # a row per partition
    begin = [(p, sum(n for _, n in counts[:i])) for i, (p, _) in enumerate(counts)]
    begin = spark.createDataFrame(begin, "part long, begin long")
    rows = rows.withColumn("part", F.shiftright("_at", 33)).join(F.broadcast(begin), "part").withColumn("place", F.col("begin") + F.col("_at").bitwiseAND(F.lit(2**33 - 1)))
    rows = written(rows.select("doc_id", "size", "shingles", "band", "h", "key", "asks", "place"), "places")
    longer = rows.select("band", "h", "key", F.col("place").alias("at"), F.col("doc_id").alias("long_id"), F.col("size").alias("long_size"), F.col("shingles").alias("long_shingles"))
    asking, found, step, wide = rows.where("asks"), None, 1, NEXT
    while True:
        asked = asking.withColumn("at", F.explode(F.sequence(F.col("place") + step, F.col("place") + step + wide - 1)))
        met = written(asked.join(longer, ["band", "h", "key", "at"]), "met")
        able = F.least("shingles", "long_shingles") >= SIMILAR * F.greatest("shingles", "long_shingles")
        pairs = met.where(able & (F.col("long_size") > F.col("size"))).select("doc_id", "long_id").distinct()
        judged = written(_verdicts(written(pairs, "pairs"), texts), "verdicts")
        found = judged if found is None else found.unionByName(judged)
        more = met.where(F.col("at") == F.col("place") + step + wide - 1).select("place")
        asking = written(asking.join(more, "place", "left_semi").join(judged, "doc_id", "left_anti"), "asking")
        if asking.isEmpty():
            return _resolved(found)
        step, wide = step + wide, min(4 * wide, NEXT_MOST)


def _last(text: str) -> str:
    """What a longer copy must hold for an alignment to end there: the last word, "=" before it, or, where it may go on, its first letters; "" without words."""
    bare = _cleared(text)
    found = _RUN.findall(bare)
    return "" if not found else found[-1].lower()[:LETTERS] if bare.endswith(found[-1]) else f"={found[-1].lower()}"


def _keyed(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (doc_id, band, h, n and others) with ``key`` and ``asks``: texts meet in a bucket under one key. In a large one a text stands under the beginnings of its
    words and asks under that of its last word, without which no alignment can end there; in others all stand and ask under one key."""
    small = rows.where(F.col("n") <= HOT).drop("n").select("*", F.lit(0).alias("key"), F.lit(True).alias("asks"))
    hot = rows.where(F.col("n") > HOT)
    if hot.isEmpty():
        return small

    @F.pandas_udf("own int, all array<int>")
    def keys(some: pd.Series) -> pd.DataFrame:
        own, every = [], []
        for t in some:
            key = _last(t)
            own.append(_hash(key) & 0x7FFFFFFF if key else None)
            w = {x.lower() for x in _RUN.findall(t)}
            every.append(sorted({_hash(k) & 0x7FFFFFFF for k in {f"={x}" for x in w} | {x[:j] for x in w for j in range(1, min(len(x), LETTERS) + 1)}}))
        return pd.DataFrame({"own": pd.array(own, dtype="Int32"), "all": every})

    asked = lookup(texts, hot.select("doc_id").distinct().withColumn("hot", F.lit(True)), "doc_id").where("hot and text is not null")
    known = written(asked.dropDuplicates(["doc_id"]).select("doc_id", keys("text").alias("k")), "words")
    large = hot.drop("n").join(known, "doc_id").select(*(c for c in rows.columns if c != "n"), F.explode("k.all").alias("key"), F.col("k.own").alias("_own"))
    return small.unionByName(large.withColumn("asks", F.coalesce(F.col("key") == F.col("_own"), F.lit(False))).drop("_own"))


def _resolved(found: DataFrame) -> DataFrame:
    """doc_id, verdict of rows (doc_id, verdict, link): without a verdict a text has that of the longer text it is linked to. Links are doubled in length in each round."""
    known = found.where("verdict is not null").groupBy("doc_id").agg(F.max("verdict").alias("verdict"))
    links = found.where("verdict is null").groupBy("doc_id").agg(F.min("link").alias("link")).join(known.select("doc_id"), "doc_id", "left_anti")
    links = written(links, "links")
    while not links.isEmpty():
        known = written(known, "known")
        new = links.join(known.select(F.col("doc_id").alias("link"), "verdict"), "link").select("doc_id", "verdict")
        rest = links.join(new.select("doc_id"), "doc_id", "left_anti")
        links = written(rest.join(links.select(F.col("doc_id").alias("link"), F.col("link").alias("next")), "link").select("doc_id", F.col("next").alias("link")), "links")
        known = known.unionByName(new)
    return known


def _verdicts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, verdict, link (the longer text where both end alike) of the pairs (doc_id, long_id) that are verified."""
    longs = pairs.groupBy("long_id").agg(F.collect_set("doc_id").alias("shorts"))  # of the texts just below it, ids only
    with_long = lookup(texts.select(F.col("doc_id").alias("long_id"), F.col("text").alias("long")), longs, "long_id").where("shorts is not null")
    with_long = with_long.select("long_id", F.explode("shorts").alias("doc_id"), "long")
    shorts = lookup(texts, pairs.select("doc_id").distinct().withColumn("asked", F.lit(True)), "doc_id").where("asked").select("doc_id", "text")

    @F.pandas_udf("int")
    def verdict(short: pd.Series, long: pd.Series) -> pd.Series:
        return pd.Series([ends_early(a, b) for a, b in zip(short, long)], dtype="int32")

    judged = with_long.join(shorts, "doc_id").select("doc_id", "long_id", verdict("text", "long").alias("v")).where("v <> 0")
    return judged.groupBy("doc_id").agg(F.max(F.when(F.col("v") < 2, F.col("v"))).alias("verdict"), F.min(F.when(F.col("v") == 2, F.col("long_id"))).alias("link"))


def truncated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, cut (boolean), evidence (copy, end or words) of every document with an id; repeated ids give one row.

    Null, empty and blank texts are whole. Copies of one text share its verdict.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    keyed = rows.withColumn("h", F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b"), F.length("text").alias("c")))
    classes = keyed.groupBy("doc_id").agg(F.max("h").alias("h"))
    heads = classes.groupBy("h").agg(F.min("doc_id").alias("head"))
    heads = written(heads, "classes")
    profiles = written(rows.mapInPandas(_profile, _PROFILE), "profiles")
    # representatives only: a row's own id is its class's
    own = profiles.where("doc_id is not null").join(heads.select(F.col("head").alias("doc_id"), "h"), "doc_id").dropDuplicates(["doc_id"])
    own = written(own.drop("n", "closing"), "own")
    answers = written(_answers(own, profiles.where("doc_id is null").select("kind", "key", "n", "closing")), "answers")
    judged = lookup(own, answers, ["kind", "key"]).join(_copies(own, rows), "doc_id", "left")
    by_end = (F.col("kind") == "cut") | F.coalesce("open", F.lit(False))
    cut = F.when(F.col("verdict") == 1, True).when(F.col("verdict") == -1, False).otherwise(by_end)
    evidence = F.when(F.col("verdict").isNotNull(), "copy").when(F.col("key") != "", "words").otherwise("end")
    heads_judged = judged.select("h", cut.alias("cut"), evidence.alias("evidence"))
    null_h = F.xxhash64("h")
    return classes.withColumn("_k", null_h).join(heads_judged.withColumn("_k", null_h).withColumnRenamed("h", "h2"), "_k").where(F.col("h").eqNullSafe(F.col("h2"))).select("doc_id", "cut", "evidence")


def share_by_source(docs: DataFrame, source: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """source, n_docs, n_cut, share (of all its documents, rounded to 6) of every source; a null source is one too."""
    flags = truncated(docs, doc_id, text).where("cut").select(F.col("doc_id").alias("_id"))
    named = docs.select(F.col(doc_id).cast("long").alias("_doc"), source.alias("source"))
    rows = named.join(flags, F.col("_doc") == F.col("_id"), "left").groupBy("source").agg(F.count("*").alias("n_docs"), F.count("_id").alias("n_cut"))
    return rows.withColumn("share", F.round(F.col("n_cut") / F.col("n_docs"), 6))
