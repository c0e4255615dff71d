"""Similarity and geometry expressions."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT_2 = 1.4142135623730951


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def unit(v: Column) -> Column:
    """v scaled to length one; a null vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def relevance(cosine: Column) -> Column:
    """Relevance of unit vectors from their squared distance."""
    return 1.0 - (2.0 - 2.0 * cosine) / F.lit(ROOT_2)


def signs(text: Column) -> Column:
    """Distinct letters and digits of a text, lower case."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", ""), ""), lambda c: c != ""))


def char_jaccard(a: Column, b: Column) -> Column:
    x, y = signs(a), signs(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)).cast("double") / union).otherwise(F.lit(0.0))


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes in the columns a.x0 .. a.y1 and b.x0 .. b.y1."""
    c = lambda t, n: F.col(f"{t}.{n}")
    w = F.greatest(F.lit(0.0), F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0")))
    area = lambda t: (c(t, "x1") - c(t, "x0")) * (c(t, "y1") - c(t, "y0"))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Matching-block ratio of two texts; 0 if either is empty."""
    for a, b in batches:
        yield pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(50.0)), F.lit(-50.0))))
