"""The queries of the training-data operators, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import answer_defects, leakage, markup, near_duplicates, packing, repeated_lines, scanned_pages, subject_areas, textform
from siltstone.runtime import spread, table


def _texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose texts take long to work on, over all cores."""
    return spread(table(spark, sf, name))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_lines.repeated_lines(_texts(spark, sf, "all_documents"), "row_id", "file_name", "content")


def p1_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk without the lines repeated in its file."""
    return repeated_lines.without_repeated_lines(_texts(spark, sf, "all_documents"), "row_id", "file_name", "content").select("row_id", "clean_text")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [("all_documents", "row_id", "content"), ("text_blocks", "block_id", "text")]
    found = [textform.changed(_texts(spark, sf, t), k, c).select(F.lit(t).alias("table_name"), "row_key") for t, k, c in parts]
    return found[0].unionByName(found[1])


def p2_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk and block in the consistent form."""
    parts = [("all_documents", "row_id", "content"), ("text_blocks", "block_id", "text")]
    forms = [textform.normalise(_texts(spark, sf, t), c).select(F.lit(t).alias("table_name"), F.col(k).alias("row_key"), "canonical") for t, k, c in parts]
    return forms[0].unionByName(forms[1])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return scanned_pages.page_defects(_texts(spark, sf, "text_blocks"))


def p3_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return scanned_pages.paragraphs(_texts(spark, sf, "text_blocks"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    texts = near_duplicates.lean_texts(_texts(spark, sf, "all_documents"), "row_id", "file_name", "content")
    return near_duplicates.group_pairs(near_duplicates.near_duplicates(texts, threshold=0.5))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return answer_defects.answer_defects(_texts(spark, sf, "testset"), "item_id", "query", "reference")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return markup.markup_languages(_texts(spark, sf, "all_documents"), "row_id", "content")


def p6_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk without markup, its structure in one plain notation."""
    t = _texts(spark, sf, "all_documents")
    return t.select("row_id", markup.without_markup(t["content"], markup.fitted_odds(t, "row_id", "content")).alias("clean_text"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return packing.cut_texts(packing.packing(table(spark, sf, "documents"), table(spark, sf, "pack_specs")))


def p7_unused_room(spark: SparkSession, sf: str) -> DataFrame:
    specs = table(spark, sf, "pack_specs")
    return packing.unused_room(packing.packing(table(spark, sf, "documents"), specs), specs)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    found = leakage.leaked_items(_texts(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "heldout_items"))
    return found.select("doc_id", "item_id")


def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The places of the leaked passages in the consistent form of each document, for removal."""
    found = leakage.leaked_items(_texts(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "heldout_items"))
    return found.select("doc_id", "item_id", F.round("covered", 6).alias("covered"), F.explode("spans").alias("span")).select("doc_id", "item_id", "covered", "span.start", "span.end")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return subject_areas.subject_areas(_texts(spark, sf, "documents"), table(spark, sf, "doc_labels"), table(spark, sf, "subjects"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_canonical, p3_found, p3_paragraphs, p4_found, p5_found, p6_found, p6_clean, p7_found, p7_unused_room, p8_found, p8_spans, p9_found)
}
ORACLES: dict[str, str] = {
    "p7_found": """
        SELECT s.spec_id, d.doc_id FROM documents d, pack_specs s
        WHERE strlen(d.text) > s.capacity_tokens AND regexp_matches(d.text, '\\S')
    """,
}
