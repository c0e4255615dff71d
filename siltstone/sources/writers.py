"""Writers: tables to document stores, indexes, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.chunking import chunks
from siltstone.operators import bm25

META = ("doc_id", "file_name", "file_stem", "file_path", "source", "parse_engine", "broker", "title", "report_date", "company", "page_num", "chunk_id")


def json_store(chunk_table: DataFrame, path: str) -> None:
    """JSON lines of {page_content, metadata}, written anew."""
    meta = [c for c in META if c in chunk_table.columns]
    chunk_table.select(F.col("content").alias("page_content"), F.struct(*meta).alias("metadata")).write.mode("overwrite").json(path)


def jsonl(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def vector_store(vectors: DataFrame, path: str, key: str = "chunk_id", vector: str = "embedding") -> None:
    vectors.select(key, vector).write.mode("overwrite").parquet(path)


def report(metrics: DataFrame, path: str) -> None:
    """Rows as CSV and JSON lines, and the means of the numeric columns."""
    metrics.write.mode("overwrite").option("header", True).csv(f"{path}/rows_csv")
    metrics.write.mode("overwrite").json(f"{path}/rows_json")
    numeric = [c for c, t in metrics.dtypes if t in ("int", "bigint", "float", "double")]
    metrics.agg(*[F.avg(c).alias(c) for c in numeric]).write.mode("overwrite").json(f"{path}/means")


def build(page_table: DataFrame, path: str, size: int = 256, overlap: int = 50) -> DataFrame:
    """Pages to chunks, stored with their lexical index; returns the stored chunks.

    A chunk keeps its page's columns and gets chunk_id = doc_id_p{page}_c{place}.
    """
    parts = page_table.filter(F.trim("content") != "").select("*", F.posexplode(chunks(F.col("content"), size, overlap)).alias("_i", "_chunk"))
    named = F.concat("doc_id", F.lit("_p"), F.col("page_num").cast("string"), F.lit("_c"), (F.col("_i") + 1).cast("string"))
    parts.withColumn("chunk_id", named).withColumn("content", F.col("_chunk")).drop("_i", "_chunk").write.mode("overwrite").parquet(f"{path}/chunks")
    stored = page_table.sparkSession.read.parquet(f"{path}/chunks")
    bm25.save(stored, "chunk_id", "content", f"{path}/bm25")
    return stored
