"""Filters on hits, within each query and sub-query, after the best k were chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import stripped

GROUP = ("query_id", "sub_query")


def searchable(text: Column, *metadata: Column) -> Column:
    """Text and metadata values, lower case, as one string."""
    return F.lower(F.concat_ws(" ", text, *metadata))


def soft(hits: DataFrame, matches: Column, group: tuple[str, ...] = GROUP) -> DataFrame:
    """Only the matching hits; where none of a group matches, all of the group."""
    found = F.coalesce(matches, F.lit(False))
    any_found = F.max(found).over(Window.partitionBy(*[c for c in group if c in hits.columns]))
    return hits.withColumn("_m", found).withColumn("_any", any_found).filter("_m or not _any").drop("_m", "_any")


def all_values(values: Column, text: Column) -> Column:
    """Every value (an array; null and empty values are ignored, blanks around the others too) stands in the text."""
    kept = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
    return F.forall(kept, lambda v: F.contains(text, F.lower(stripped(v))))


def exclude(hits: DataFrame, terms: Column, text: Column) -> DataFrame:
    """Without the hits that hold any of the terms; may leave none."""
    kept = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
    return hits.filter(~F.exists(kept, lambda v: F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(v))))
