"""Neighbours of a chunk, catalog of documents, and texts put together for answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expand(chunks: DataFrame, targets: DataFrame, key: str, doc: str, order: list[str], before: int = 1, after: int = 1) -> DataFrame:
    """(target, key, distance, relation): the chunks around each target in its document's order.

    Two equi-joins on document and position; the ends of a document clamp.
    """
    w = Window.partitionBy(doc).orderBy(*order)
    placed = chunks.select(F.col(key).alias("key"), F.col(doc).alias("doc"), F.row_number().over(w).alias("at"))
    wanted = placed.join(targets.select(F.col(key).alias("key")).distinct(), "key", "left_semi")
    near = wanted.select(F.col("key").alias("target"), "doc", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("distance"), "at").withColumn("at", F.col("at") + F.col("distance"))
    relation = F.when(F.col("distance") == 0, "target").otherwise("neighbor")
    return near.join(placed, ["doc", "at"]).select("target", "key", "distance", relation.alias("relation"))


def catalog(chunks: DataFrame, doc: str, columns: list[str], order: list[str], company: str | None = None, year: str | None = None, limit: int | None = None) -> DataFrame:
    """One row for each document, from its first chunk in the given order; filtered by company and year."""
    first = chunks.filter(F.coalesce(F.col(doc), F.lit("")) != "").groupBy(F.col(doc).alias("doc_id")).agg(F.min(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], *columns)).alias("f"))
    rows = first.select("doc_id", *[F.col("f")[c].alias(c) for c in columns], F.col("f")["_0"].alias("_at"))
    text = F.lower(F.concat_ws(" ", *[c for c in ("company", "title", "file_name", "broker") if c in columns]))
    if company:
        rows = rows.filter(F.contains(text, F.lit(company.lower())))
    if year:
        rows = rows.filter(F.coalesce(F.startswith(F.col("report_date"), F.lit(year)), F.lit(False)) | F.contains(text, F.lit(year)))
    if limit:
        rows = rows.orderBy("_at", "doc_id").limit(limit)
    return rows.drop("_at")


def ordered_text(value: Column, order: Column, separator: str) -> Column:
    """Aggregate: the values of a group, joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), separator)


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def context(hits: DataFrame, text: str = "text", most: int = 500) -> DataFrame:
    """(query_id, context): the hits of each query as numbered extracts with file name and page."""
    t = _text(text)
    shown = F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)
    block = F.concat(F.lit("[片段"), F.col("rank").cast("string"), F.lit("]\n文件名: "), _text("file_name"), F.lit("\n页码: "), _text("page_num"), F.lit("\n内容: "), shown, F.lit("\n"))
    return hits.groupBy("query_id").agg(ordered_text(block, F.col("rank"), "\n").alias("context"))


def fragments(hits: DataFrame, text: str = "text", sub_query: str | None = None) -> DataFrame:
    """(query_id, fragments): the whole hits of each query as one text, with the sub-query of each if named."""
    own = (F.lit("\n子查询: "), _text(sub_query)) if sub_query else ()
    block = F.concat(F.lit("[片段"), F.col("rank").cast("string"), F.lit("]\n文件名: "), _text("file_name"), F.lit("\n页码: "), _text("page_num"), *own, F.lit("\n内容: "), _text(text), F.lit("\n"))
    return hits.groupBy("query_id").agg(ordered_text(block, F.col("rank"), "\n").alias("fragments"))


def sources(hits: DataFrame) -> DataFrame:
    """(query_id, sources): each file and page of a query's hits once, in the order in which they come first."""
    first = hits.groupBy("query_id", _text("file_name").alias("f"), _text("page_num").alias("p")).agg(F.min("rank").alias("rank"))
    line = F.concat(F.lit("- "), F.col("f"), F.lit("，第"), F.col("p"), F.lit("页"))
    return first.groupBy("query_id").agg(ordered_text(line, F.col("rank"), "\n").alias("sources"))


def evidences(hits: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, id, page, pdf, content, score): hits as evidence, counted from 0."""
    page, pdf = F.coalesce(F.nullif(_text("page_num"), F.lit("")), F.lit("未知")), F.coalesce(F.nullif(_text("file_name"), F.lit("")), F.lit("文档"))
    return hits.select("query_id", (F.col("rank") - 1).alias("id"), page.alias("page"), pdf.alias("pdf"), F.col(text).alias("content"), F.coalesce("score", F.lit(0.0)).alias("score"))


def normalised(results: DataFrame, order: list[str], metadata: str | None = None) -> DataFrame:
    """Results of any retriever with the columns doc_id, chunk_id, file_name, page_num, content and score.

    What a row lacks is taken from its metadata (a struct column), then from its
    place among the results of its query: doc_{n}, chunk_{n}, counted from 0.
    """
    have = set(results.columns)
    inner = {f.name for f in results.schema[metadata].dataType.fields} if metadata else set()
    place = (F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1).cast("string")
    found = lambda *names: [F.col(n) for n in names if n in have] + [F.col(metadata)[n] for n in names if n in inner]
    pick = lambda names, last: F.coalesce(*[x.cast("string") for x in found(*names)], last)
    score = F.coalesce(*[x.cast("double") for x in found("score")], F.lit(None).cast("double"))
    return results.select(
        "query_id",
        place.cast("int").alias("place"),
        pick(("doc_id",), F.concat(F.lit("doc_"), place)).alias("doc_id"),
        pick(("chunk_id",), F.concat(F.lit("chunk_"), place)).alias("chunk_id"),
        pick(("file_name",), F.lit("")).alias("file_name"),
        pick(("page_num",), F.lit("")).alias("page_num"),
        pick(("content", "page_content"), F.lit("")).alias("content"),
        score.alias("score"),
    )


def contributions(hits: DataFrame, by: str) -> DataFrame:
    """(query_id, value, n): how many hits of each query share a value, such as the sub-query or the file."""
    return hits.groupBy("query_id", F.col(by).cast("string").alias("value")).agg(F.count("*").alias("n"))


def citations(hits: DataFrame, length: int = 180) -> DataFrame:
    return hits.select("query_id", "rank", "file_name", "page_num", "chunk_id", F.substring("text", 1, length).alias("snippet"))


def relevant_enough(hits: DataFrame, least: float = 0.3) -> DataFrame:
    """(query_id, passed): whether the first hit reaches the least score; a missing score passes."""
    first = hits.filter("rank = 1")
    return first.select("query_id", F.coalesce(F.col("score") >= least, F.lit(True)).alias("passed"))
