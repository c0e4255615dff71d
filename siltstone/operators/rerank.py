"""Second ranking of hits by a scorer of (query, segment) pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.chunking import pair_segments
from siltstone.functions.text import is_noise, tokens
from siltstone.operators.bm25 import top_k

Scorer = Callable[[Column, Column], Column]


def overlap_score(query: Column, segment: Column) -> Column:
    """Share of the query's distinct tokens that the segment has: a scorer without a model."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(segment))).cast("double") / F.size(q)).otherwise(F.lit(0.0))


def rerank(hits: DataFrame, n: int = 10, scorer: Scorer = overlap_score, keep_noise: bool = False) -> DataFrame:
    """(query_id, key, score, rank): the n best hits by their best segment.

    hits: query_id, query, key, text. Noise is left out. A model goes in as a
    scorer that returns a pandas UDF column, loaded once for each worker.
    """
    kept = hits if keep_noise else hits.filter(~is_noise(F.col("text")))
    pairs = kept.select("query_id", "query", "key", F.explode(pair_segments(F.col("text"))).alias("segment"))
    scored = pairs.withColumn("s", scorer(F.col("query"), F.col("segment"))).groupBy("query_id", "key").agg(F.round(F.max("s"), 6).alias("score"))
    return top_k(scored, n)
