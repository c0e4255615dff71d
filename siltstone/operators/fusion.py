"""Hits of several searches put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.bm25 import top_k

CONSTANT = 60


def fuse(lists: list[tuple[DataFrame, float]], k: int | None = None, constant: int = CONSTANT) -> DataFrame:
    """(query_id, identity, score, rank): weighted reciprocal-rank fusion.

    lists: (hits with query_id, identity, rank; weight). Hits of one identity
    count once in a list, at their best rank.
    """
    union = None
    for i, (hits, weight) in enumerate(lists):
        best = hits.groupBy("query_id", "identity").agg(F.min("rank").alias("rank")).withColumn("part", F.lit(float(weight)) / (F.col("rank") + constant)).withColumn("list", F.lit(i))
        union = best if union is None else union.unionByName(best)
    fused = union.groupBy("query_id", "identity").agg(F.round(F.sum("part"), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("identity"))
    return top_k(fused, k, key="identity") if k else fused.withColumn("rank", F.row_number().over(w))


def deduplicate(hits: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first hit, in the given order, of each query and key (null keys are equal)."""
    w = Window.partitionBy("query_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]).orderBy(*order)
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def balance(hits: DataFrame, k: int) -> DataFrame:
    """Round robin over the sub-queries of each query: one hit of each in turn, until k.

    hits: query_id, sub_query (its place), rank; `position` is the place in the result.
    """
    turn = Window.partitionBy("query_id", "sub_query").orderBy("rank")
    order = Window.partitionBy("query_id").orderBy("_turn", "sub_query")
    turned = hits.withColumn("_turn", F.row_number().over(turn))
    return turned.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k).drop("_turn")
