"""Exact vector search: blocks of queries against every vector, scanned once for each pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.similarity import ROOT_2
from siltstone.operators.bm25 import top_k

#: Bytes of query vectors that go to the tasks in one pass over the vectors; more queries take more passes.
PASS_BYTES = 64 << 20
#: Scores held at once in a task.
SCORES = 4_000_000


def search(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int = 10, threshold: float | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k most relevant vectors for each (query_id, vector).

    Vectors are taken as of length one. Each task keeps its own best k for each
    query over all its batches, so the shuffle holds k rows for each query and
    task. The threshold applies after the k best are chosen. Null vectors are left out.
    """
    stated = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null").orderBy("query_id")
    schema = "query_id bigint, key bigint, score double"
    source = vectors.filter(vectors[vector].isNotNull()).select(vectors[key].cast("bigint").alias("key"), vectors[vector].cast("array<double>").alias("vector"))
    out = source.sparkSession.createDataFrame([], schema)
    ids, rows, size = [], [], 0
    for r in stated.toLocalIterator():
        ids.append(r[0])
        rows.append(np.asarray(r[1], np.float64))
        size += 8 * len(r[1])
        if size >= PASS_BYTES:
            out = out.unionByName(source.mapInPandas(_best(np.array(ids), np.stack(rows), k), schema))
            ids, rows, size = [], [], 0
    if ids:
        out = out.unionByName(source.mapInPandas(_best(np.array(ids), np.stack(rows), k), schema))
    best = top_k(out, k)
    return best if threshold is None else best.filter(F.col("score") >= threshold)


def _first(k: int, query: np.ndarray, key: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, ties by key."""
    order = np.lexsort((key, -score, query))
    query, key, score = query[order], key[order], score[order]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(query)), bool), query[1:] != query[:-1])))
    place = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
    keep = place < k
    return query[keep], key[keep], score[keep]


def _best(ids: np.ndarray, q: np.ndarray, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            if batch.empty:
                continue
            keys, x = batch["key"].to_numpy(), np.stack(batch["vector"].to_numpy()).astype(np.float64)
            found = [best]
            step = max(1, SCORES // len(keys))
            for at in range(0, len(ids), step):
                score = np.round(1.0 - (2.0 - 2.0 * (q[at : at + step] @ x.T)) / ROOT_2, 6)
                # All that reach the kth score of the batch, ties included.
                least = np.partition(score, -k, axis=1)[:, -k] if len(keys) > k else np.full(len(score), -np.inf)
                row, column = np.nonzero(score >= least[:, None])
                found.append((row + at, keys[column], score[row, column]))
            best = _first(k, *(np.concatenate(side) for side in zip(*found, strict=True)))
        yield pd.DataFrame({"query_id": ids[best[0]], "key": best[1], "score": best[2]})

    return run
