"""What embeds texts and writes answers, behind small interfaces, with stand-ins that need no model."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class HashingEmbedder:
    """Unit vectors of hashed character pairs: alike texts get alike vectors, the same on every machine."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed_query(self, text: str) -> list[float]:
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
        mixed = (codes[:-1] * np.uint64(1_000_003) + codes[1:]) * np.uint64(0x9E3779B97F4A7C15)
        sign = np.where((mixed >> np.uint64(20)) & np.uint64(1), 1.0, -1.0)
        v = np.bincount((mixed >> np.uint64(40)).astype(np.int64) % self.size, weights=sign, minlength=self.size)
        length = np.sqrt(v @ v)
        return (v / length if length else v).tolist()

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return [self.embed_query(t) for t in texts]


def embedded(text: Column, make: Callable[[], Embedder] = HashingEmbedder, batch: int = 16) -> Column:
    """The vectors of a column of texts; the embedder is made once for each worker and gets `batch` texts at once. Null gives null."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            known = texts.dropna()
            vectors = [v for at in range(0, len(known), batch) for v in model.embed_documents(list(known[at : at + batch]))]
            yield pd.Series(vectors, index=known.index, dtype=object).reindex(texts.index).where(lambda x: x.notna(), None)

    return run(text)


@dataclass
class Reply:
    content: str


class Llm(Protocol):
    def invoke(self, messages: list[tuple[str, str]]) -> Reply: ...


class OfflineLlm:
    """Stands in for a model: rewrites a question as itself, and answers with the extracts it was given."""

    def invoke(self, messages: list[tuple[str, str]]) -> Reply:
        system, user = messages[0][1], messages[-1][1]
        if "JSON" in system:
            question = user.rsplit("\n", 1)[-1].strip()
            return Reply(json.dumps({"task_type": "fact", "rewritten_query": question, "sub_queries": [question], "filters": {}, "use_history": False}, ensure_ascii=False))
        return Reply(user[-400:].strip())


#: Ways to make a model by name.
PROVIDERS: dict[str, Callable[[], Llm]] = {"offline": OfflineLlm}


def llm(provider: str = "offline") -> Llm:
    if provider not in PROVIDERS:
        raise NotImplementedError(f"no model {provider!r} here; add it to PROVIDERS")
    return PROVIDERS[provider]()
