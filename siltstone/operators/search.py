"""Search as a whole: one job for a table of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import bm25, filters, fusion, rerank, vector

#: Weights of vector and lexical lists in the fusion, and hits at most.
WEIGHTS, FINAL = (0.8, 0.2), 30


def search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, mode: str = "hybrid", k: int = 10, threshold: float | None = 0.1, use_reranker: bool = False) -> DataFrame:
    """(query_id, key, score, rank).

    queries: query_id, query and, for vector search, vector; chunks: key, text;
    vectors: key, vector. Equal texts fuse into the chunk of the least key.
    """
    if mode not in ("vector", "bm25", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    lists = []
    if mode != "bm25":
        lists.append((vector.search(queries, vectors, "key", "vector", k, threshold), WEIGHTS[0]))
    if mode != "vector":
        lists.append((bm25.search(queries, chunks, "key", "text", k), WEIGHTS[1]))
    if mode == "hybrid":
        first = chunks.groupBy(F.md5("text").alias("h")).agg(F.min("key").alias("identity"))
        named = chunks.select("key", F.md5("text").alias("h")).join(first, "h").select("key", "identity")
        hits = fusion.fuse([(h.join(named, "key").select("query_id", "identity", "rank"), w) for h, w in lists], FINAL).withColumnRenamed("identity", "key")
    else:
        hits = lists[0][0]
    if use_reranker:
        full = hits.join(queries.select("query_id", "query"), "query_id").join(chunks.select("key", "text"), "key")
        hits = rerank.rerank(full)
    return hits.filter(F.col("rank") <= FINAL).select("query_id", "key", "score", "rank")


def structured(questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, mode: str = "bm25", k: int = 10) -> DataFrame:
    """(query_id, position, sub_query, key, rank): the sub-queries of every question in one job.

    questions: query_id, sub_queries array, filter_values array, exclude_terms
    array, required_terms array, top_k. Filters run in this order on the hits of
    each sub-query; then hits are merged, made unique by file, page and chunk
    where the chunks have these columns, and balanced.
    """
    parts = questions.select("*", F.posexplode("sub_queries").alias("sub_query", "query"))
    asked = parts.withColumn("qid", F.xxhash64("query_id", "sub_query"))
    hits = search(asked.select(F.col("qid").alias("query_id"), "query"), chunks, vectors, mode, k)
    # Hits meet their chunks first: where they are few enough, they are broadcast and no text of another chunk is shuffled.
    joined = hits.withColumnRenamed("query_id", "qid").join(chunks, "key").join(asked.select("qid", "query_id", "sub_query", "filter_values", "exclude_terms", "required_terms", "top_k"), "qid")
    meta = [F.col(c) for c in chunks.columns if c not in ("key", "text")]
    found = filters.soft(joined, filters.all_values(F.col("filter_values"), filters.searchable(F.col("text"), *meta)))
    found = filters.exclude(found, F.col("exclude_terms"), F.col("text"))
    found = filters.soft(found, filters.all_values(F.col("required_terms"), F.lower("text")))
    place = [c for c in ("file_name", "page_num", "chunk_id") if c in chunks.columns]
    single = fusion.deduplicate(found, place if len(place) == 3 else ["key"], [F.col("sub_query"), F.col("rank"), F.col("key")])
    return fusion.balance(single, FINAL).filter(F.col("position") <= F.coalesce("top_k", F.lit(5))).select("query_id", "position", "sub_query", "key", "rank")


def report_search(questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, mode: str = "bm25", k: int = 10) -> DataFrame:
    """(query_id, search_kind, position, key): plain search for questions of the kind `fact`, structured search for all others.

    questions: as for `structured`, with task_type, query and rewritten_query. A
    fact is looked for by its query, else its rewritten query, and neither filters
    nor terms nor sub-queries apply; a question without a task type is a fact.
    A structured question without sub-queries has its rewritten query as the only one.
    """
    fact = F.coalesce("task_type", F.lit("fact")) == "fact"
    words = F.coalesce(F.nullif("query", F.lit("")), F.nullif("rewritten_query", F.lit("")))
    simple = search(questions.filter(fact).select("query_id", words.alias("query")).filter("query is not null"), chunks, vectors, mode, k)
    subs = F.when(F.size(F.coalesce("sub_queries", F.array().cast("array<string>"))) > 0, F.col("sub_queries")).otherwise(F.array("rewritten_query"))
    rest = structured(questions.filter(~fact).withColumn("sub_queries", subs).drop("query", "rewritten_query", "task_type"), chunks, vectors, mode, k)
    plain = simple.select("query_id", F.lit("simple").alias("search_kind"), F.col("rank").alias("position"), "key")
    return plain.unionByName(rest.select("query_id", F.lit("structured").alias("search_kind"), "position", "key"))
