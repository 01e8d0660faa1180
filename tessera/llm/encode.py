"""Token ids of whole texts by a public byte-level BPE vocabulary.

A pre-token is encoded left to right. For every prefix of its bytes exactly one token can be the last of the prefix's encoding: the one among the tokens
that end there which is compatible with the last token of the prefix before it. Tokens that end at a position come from an automaton over the
vocabulary (an Aho-Corasick automaton: it reports all tokens that are suffixes of the prefix, as the suffix automaton would); two tokens are compatible if the merges of the vocabulary, applied to their joined bytes, give back the two. The last tokens are stored for
all prefixes, and the back-pointers from the end spell the ids. Time is linear in the text, also for pre-tokens without any break.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How byte-level vocabularies of this kind split text before encoding (fixed value).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens and token pairs remembered by a worker, at most.
MEMORY = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a public vocabulary lies: the installed package, else /opt/tokenizers."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except (ImportError, AttributeError):
        return os.path.join("/opt/tokenizers", name)


class Encoder:
    """Encodes with the vocabulary of a file of base64 tokens and ranks."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.split = regex.compile(SPLIT)
        self.bytes = {r: t for t, r in self.rank.items()}
        self.known: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.ends = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            # a token that its own merges don't rebuild is never a result
            if len(token) == 1 or self._merge(token) == [rank]:
                self.ends.add_word(token.decode("latin-1"), (len(token), rank))
        self.ends.make_automaton()

    def _merge(self, data: bytes) -> list[int]:
        """The defining encoding: merge the neighbours of lowest rank, leftmost first, until none can be merged."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            options = [(self.rank[m], i) for i in range(len(parts) - 1) if (m := parts[i] + parts[i + 1]) in self.rank]
            if not options:
                break
            i = min(options)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether b can follow a in an encoding."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            found = self.pairs[a, b] = self._merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return found

    def piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        n = len(data)
        whole = self.rank.get(data)
        if whole is not None and n > 0:
            return [whole]
        last = [(0, -1)] * (n + 1)  # (length, id) of the last token of each prefix
        at, options = -1, []

        def settle() -> None:
            options.sort(reverse=True)
            for length, rank in options:
                before = at + 1 - length
                if before == 0 or self.compatible(last[before][1], rank):
                    last[at + 1] = (length, rank)
                    return
            raise ValueError("the vocabulary lacks single bytes")

        for end, option in self.ends.iter(data.decode("latin-1")):
            if end != at:
                if options:
                    settle()
                at, options = end, []
            options.append(option)
        if options:
            settle()
        ids, i = [], n
        while i > 0:
            length, rank = last[i]
            ids.append(rank)
            i -= length
        ids.reverse()
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text; the text is taken as it is, whatever it contains."""
        known, ids = self.known, []
        for word in self.split.findall(text):
            found = known.get(word)
            if found is None:
                found = self.piece(word.encode("utf-8"))
                if len(word) <= 64:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[word] = found
            ids += found
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary, built once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_ids(text: Column, path: str | None = None) -> Column:
    """Column of the ids of a text column; null and empty texts both give an empty list. The vocabulary file is sent to the executors with the application's files."""
    from pyspark import SparkFiles
    from pyspark.sql import SparkSession

    where = path or vocabulary_path()
    sc = SparkSession.active().sparkContext
    name = os.path.basename(where)
    if name not in {os.path.basename(x) for x in sc.listFiles}:
        sc.addFile(where)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(SparkFiles.get(name))
        for texts in batches:
            yield pd.Series([own.encode(t) if t else [] for t in texts], dtype=object)

    return ids(text.cast("string"))


def encode_corpus(docs: DataFrame, text: str = "text", path: str | None = None, out: str = "ids") -> DataFrame:
    """The rows with their ids in ``out``: no shuffle, one pass, texts whole. A column named ``out`` is replaced."""
    return docs.withColumn(out, token_ids(F.col(text), path))
