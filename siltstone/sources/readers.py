"""Readers: files and document stores to tables. All lazy; schemas are given, not inferred, where they are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

META = ("doc_id", "file_name", "file_stem", "file_path", "source", "parse_engine", "broker", "title", "report_date", "company")
STORE = T.StructType(
    [
        T.StructField("page_content", T.StringType()),
        T.StructField("metadata", T.StructType([*[T.StructField(c, T.StringType()) for c in META], T.StructField("page_num", T.IntegerType()), T.StructField("chunk_id", T.StringType())])),
    ]
)


def pdf_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of the PDF files, upper-case extensions included; none gives an empty table."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]")
    return reader.option("recursiveFileLookup", str(recursive).lower()).load(folder)


def pages(files: DataFrame, extract: Column) -> DataFrame:
    """(file_name, file_stem, file_path, page_num, content): one row for each page with text.

    extract: a column over `content`, an array of page texts (a pandas UDF around
    any PDF library).
    """
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select(F.col("path").alias("file_path"), name.alias("file_name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("file_stem"), F.posexplode(extract).alias("page_num", "content"))
    return out.withColumn("page_num", F.col("page_num") + 1).filter(F.trim("content") != "")


def document_id(stem: Column, page_count: Column) -> Column:
    return F.concat(stem, F.lit("_"), page_count.cast("string"), F.lit("pages"))


def json_store(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a JSON array of {page_content, metadata}; missing metadata gives nulls."""
    rows = spark.read.schema(STORE).option("multiLine", True).json(path)
    return rows.select(F.col("page_content").alias("content"), "metadata.*")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(query, gt) of a JSON array; rows without both are malformed and fail."""
    rows = spark.read.schema("query string, gt array<string>").option("multiLine", True).json(path)
    bad = F.col("query").isNull() | F.col("gt").isNull()
    checked = F.when(bad, F.raise_error(F.lit("each row needs query and gt"))).otherwise(F.col("query"))
    return rows.select(checked.alias("query"), "gt")


def test_set(spark: SparkSession, path: str) -> DataFrame:
    """(query, reference, positive_doc) of JSON lines; other names of the columns are accepted."""
    names = "query string, question string, user_input string, reference string, answer string, gt string, positive_doc string"
    rows = spark.read.schema(names).json(path)
    first = lambda *cs: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])
    return rows.select(first("query", "question", "user_input").alias("query"), first("reference", "answer", "gt").alias("reference"), "positive_doc").filter("query is not null")


def triplets(spark: SparkSession, path: str) -> DataFrame:
    """(query, positive_doc, negative_doc) of JSON lines in either shape, without rows that lack one."""
    rows = spark.read.schema("query string, positive_doc string, negative_doc string, pos array<string>, neg array<string>").json(path)
    out = rows.select("query", F.coalesce(F.get("pos", F.lit(0)), "positive_doc").alias("positive_doc"), F.coalesce(F.get("neg", F.lit(0)), "negative_doc").alias("negative_doc"))
    return out.filter(" and ".join(f"trim(coalesce({c}, '')) <> ''" for c in out.columns))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(place, sign): one sign on each line of a text file, empty lines left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: x != "")).alias("place", "sign"))
    return lines


def front_text(pages_table: DataFrame, doc: str = "doc_id", most: int = 3) -> DataFrame:
    """(doc_id, text): the first pages of each document, joined by line breaks."""
    front = pages_table.filter((F.col("page_num") <= most) & (F.trim("content") != ""))
    texts = F.array_sort(F.collect_list(F.struct("page_num", "content")))
    return front.groupBy(F.col(doc).alias("doc_id")).agg(F.array_join(F.transform(texts, lambda x: x["content"]), "\n").alias("text"))


def some_pdf_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """As pdf_files, but fails at once where there is none."""
    found = pdf_files(spark, folder, recursive)
    if found.select("path").limit(1).count() == 0:
        raise ValueError(f"no PDF files in {folder}")
    return found


def vector_store(spark: SparkSession, path: str) -> DataFrame:
    """The vectors that writers.vector_store wrote."""
    return spark.read.parquet(path)
