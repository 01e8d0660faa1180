"""Embedding providers."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class EmbeddingProvider(Protocol):
    """Turns texts into vectors of one length. It is sent to the executors."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashProvider:
    """Vectors of hashed words: the same everywhere, no model and no network."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dims
            for w in re.findall(r"[^\W_]+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dims] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


class HttpProvider:
    """Vectors from a service that takes {"input": [...]} and gives {"data": [{"embedding": [...]}]}."""

    def __init__(self, url: str, headers: dict[str, str] | None = None, model: str | None = None, batch: int = 100):
        self.url, self.headers, self.model, self.batch = url, headers or {}, model, batch

    def embed(self, texts: list[str]) -> list[list[float]]:
        import json
        import urllib.request

        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            body = self.body(texts[i : i + self.batch])
            req = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", **self.headers})
            with urllib.request.urlopen(req, timeout=60) as r:
                out += self.parse(json.load(r))
        return out

    def body(self, texts: list[str]) -> dict:
        return {"input": texts, **({"model": self.model} if self.model else {})}

    def parse(self, answer: dict) -> list[list[float]]:
        return [d["embedding"] for d in answer["data"]]


class OllamaProvider(HttpProvider):
    """A service that takes {"model", "input": [...]} and gives {"embeddings": [[...]]}."""

    def parse(self, answer: dict) -> list[list[float]]:
        return answer["embeddings"]


class CohereProvider(HttpProvider):
    """A service that takes {"model", "texts": [...], "input_type"} and gives {"embeddings": [[...]]} or {"embeddings": {"float": [[...]]}}."""

    def body(self, texts: list[str]) -> dict:
        return {"texts": texts, "input_type": "search_document", **({"model": self.model} if self.model else {})}

    def parse(self, answer: dict) -> list[list[float]]:
        found = answer["embeddings"]
        return found["float"] if isinstance(found, dict) else found


class GeminiProvider(HttpProvider):
    """A service that takes {"requests": [{"model", "content": {"parts": [{"text"}]}}]} and gives {"embeddings": [{"values": [...]}]}."""

    def body(self, texts: list[str]) -> dict:
        return {"requests": [{"model": self.model, "content": {"parts": [{"text": t}]}} for t in texts]}

    def parse(self, answer: dict) -> list[list[float]]:
        return [e["values"] for e in answer["embeddings"]]


def embed_column(text: Column, provider: EmbeddingProvider, batch: int = 256) -> Column:
    """(v, error) of texts: where a batch fails its texts have no vector and the error, so that they can be tried again."""

    @F.pandas_udf("v array<double>, error string")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out: list = []
            for i in range(0, len(texts), batch):
                some = texts.iloc[i : i + batch].fillna("").tolist()
                try:
                    out += [(v, None) for v in provider.embed(some)]
                except Exception as e:  # noqa: BLE001
                    out += [(None, str(e))] * len(some)
            yield pd.DataFrame({"v": pd.Series([v for v, _ in out], dtype=object), "error": pd.Series([e for _, e in out], dtype=object)})

    return vectors(text)
