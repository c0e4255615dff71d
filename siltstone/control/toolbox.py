"""The tools of single questions, each a Spark query over the chunk store."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import metrics
from siltstone.operators import bm25, filters, fusion, rerank, tools, vector
from siltstone.operators.search import FINAL, WEIGHTS

#: Columns of a hit that a tool returns.
SHOWN = ("doc_id", "chunk_id", "file_name", "page_num", "content")


class Toolbox:
    """Search, neighbours, catalog and metrics over chunks with the columns row_id, content and metadata.

    The lexical index is built once and serves all questions. vectors: row_id and
    a unit vector; embed turns a question into one.
    """

    def __init__(self, chunks: DataFrame, vectors: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None, order: tuple[str, ...] = ("page_num", "row_id")) -> None:
        self.chunks, self.vectors, self.embed, self.order = chunks, vectors, embed, list(order)
        self.spark = chunks.sparkSession
        self.index = bm25.index(chunks, "row_id", "content")

    def handlers(self) -> dict[str, Callable[..., dict[str, Any]]]:
        return {"report_search": self.report_search, "rag_search": self.rag_search, "structured_rag_search": self.structured_rag_search, "context_expand": self.context_expand, "report_catalog": self.report_catalog, "metric_calculate": self.metric_calculate}

    def _hits(self, queries: list[str], mode: str, use_reranker: bool, k: int = 10) -> DataFrame:
        """(query_id, key, score, rank) for a few queries, numbered from 0."""
        if mode not in ("vector", "bm25", "hybrid"):
            raise ValueError(f"unknown mode {mode!r}")
        asked = self.spark.createDataFrame(list(enumerate(queries)), "query_id bigint, query string")
        lists = []
        if mode != "bm25" and self.vectors is not None and self.embed is not None:
            own = self.spark.createDataFrame([(i, self.embed(q)) for i, q in enumerate(queries)], "query_id bigint, vector array<double>")
            lists.append((vector.search(own, self.vectors, "row_id", "vector", k, 0.1), WEIGHTS[0]))
        if mode != "vector" or not lists:
            lists.append((bm25.search_index(asked, self.index, k), WEIGHTS[1]))
        hits = lists[0][0]
        if len(lists) > 1:
            same = self.chunks.select(F.col("row_id").alias("key"), F.min("row_id").over(_equal_texts()).alias("identity"))
            hits = fusion.fuse([(h.join(same, "key"), w) for h, w in lists], FINAL).withColumnRenamed("identity", "key")
        if use_reranker:
            full = hits.join(asked, "query_id").join(self.chunks.select(F.col("row_id").alias("key"), F.col("content").alias("text")), "key")
            hits = rerank.rerank(full)
        return hits.select("query_id", "key", "score", "rank")

    def _full(self, hits: DataFrame) -> DataFrame:
        return hits.join(self.chunks.withColumnRenamed("row_id", "key"), "key")

    def rag_search(self, query: str, mode: str = "hybrid", use_reranker: bool = True) -> dict[str, Any]:
        rows = self._full(self._hits([query], mode, use_reranker)).orderBy("rank").select(*SHOWN, "score").collect()  # FINAL rows at most
        return {"query": query, "docs": [r.asDict() for r in rows]}

    def structured_rag_search(self, structured_query: dict[str, Any], mode: str = "hybrid", use_reranker: bool = True) -> dict[str, Any]:
        """Each sub-query by itself, its hits filtered; then all hits once, in turns over the sub-queries."""
        subs = structured_query.get("sub_queries") or [structured_query.get("rewritten_query")]
        if not subs[0]:
            raise ValueError("a structured query needs sub_queries or rewritten_query")
        names = F.create_map(*[F.lit(x) for i, q in enumerate(subs) for x in (i, q)])
        words = lambda key: F.array(*[F.lit(str(v)) for v in key]).cast("array<string>")
        hits = self._full(self._hits(subs, mode, use_reranker)).withColumnRenamed("query_id", "sub_query").withColumn("query_id", F.lit(0))
        meta = [F.col(c).cast("string") for c in self.chunks.columns if c not in ("row_id", "content")]
        wanted = [v for v in (structured_query.get("filters") or {}).values() if v not in ("", None, [], {})]
        found = filters.soft(hits, filters.all_values(words(wanted), filters.searchable(F.col("content"), *meta)))
        found = filters.exclude(found, words(structured_query.get("exclude_terms") or []), F.col("content"))
        found = filters.soft(found, filters.all_values(words(structured_query.get("required_terms") or []), F.lower("content")))
        single = fusion.deduplicate(found, ["file_name", "page_num", "chunk_id"], [F.col("sub_query"), F.col("rank")])
        rows = fusion.balance(single, structured_query.get("top_k") or 5).orderBy("position").select(*SHOWN, "score", names[F.col("sub_query")].alias("retrieved_by")).collect()
        return {"query": structured_query, "docs": [r.asDict() for r in rows]}

    def report_search(self, query: str | None = None, structured_query: dict[str, Any] | None = None, mode: str = "hybrid", use_reranker: bool = True) -> dict[str, Any]:
        """Structured search for all tasks but facts, for which neither filters nor sub-queries apply."""
        parts = structured_query or {}
        plain = not parts or parts.get("task_type") == "fact"
        found = self.rag_search(query or parts.get("rewritten_query") or "", mode, use_reranker) if plain else self.structured_rag_search(parts, mode, use_reranker)
        return found | {"meta": found.get("meta", {}) | {"search_kind": "simple" if plain else "structured"}}

    def context_expand(self, doc_id: str, chunk_id: str, before: int = 1, after: int = 1) -> dict[str, Any]:
        out = {"doc_id": doc_id, "chunk_id": chunk_id, "docs": []}
        own = self.chunks.filter(F.col("doc_id") == doc_id)
        target = own.filter(F.col("chunk_id") == chunk_id).orderBy(*self.order).limit(1)
        near = tools.expand(own, target, "row_id", "doc_id", self.order, before, after).withColumnRenamed("key", "row_id")
        rows = near.join(own, "row_id").orderBy("distance").select(*SHOWN, "relation", "distance").collect()  # before + after + 1 rows
        if not rows:
            return out | {"reason": "not_found"}
        return out | {"docs": [r.asDict() for r in rows], "meta": {"before": -rows[0]["distance"], "after": rows[-1]["distance"]}}

    def report_catalog(self, company: str | None = None, year: str | None = None, limit: int = 20) -> dict[str, Any]:
        columns = [c for c in ("file_name", "title", "company", "broker", "report_date") if c in self.chunks.columns]
        rows = tools.catalog(self.chunks, "doc_id", columns, ["row_id"], (company or "").strip() or None, year, limit).collect()  # `limit` rows
        return {"reports": [r.asDict() for r in rows], "count": len(rows), "filters": {"company": company, "year": year}}

    def metric_calculate(self, operation: str, values: list[float], precision: int = 4) -> dict[str, Any]:
        metrics.checked(operation, len(values), precision)
        a = [str(Decimal(str(v))) for v in values]
        shape = {"difference": "{0} - {1}", "ratio": "{0} / {1}", "growth_rate": "({0} - {1}) / abs({1}) * 100", "gross_margin": "({0} - {1}) / {0} * 100"}.get(operation, " + ".join(a))
        return {"operation": operation, "values": values, "formula": shape.format(*a), "result": metrics.calculate(operation, a, precision), "unit": metrics.OPERATIONS[operation][1], "precision": precision}


def _equal_texts():
    from pyspark.sql import Window

    return Window.partitionBy(F.md5("content"))
