"""Exact decimal metrics over one or more amounts, rounded half up."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits that a quotient keeps before it is rounded.
DIGITS = Context(prec=28)
_PERCENT = Decimal(100)
_C = DIGITS
#: Operation: (number of amounts or None, unit, place of the amount that may not be zero, formula over decimals).
OPERATIONS: dict[str, tuple[int | None, str | None, int | None, Callable[..., Decimal]]] = {
    "sum": (None, None, None, lambda *a: sum(a, Decimal(0))),
    "difference": (2, None, None, lambda a, b: _C.subtract(a, b)),
    "ratio": (2, None, 1, lambda a, b: _C.divide(a, b)),
    "growth_rate": (2, "%", 1, lambda a, b: _C.multiply(_C.divide(_C.subtract(a, b), abs(b)), _PERCENT)),
    "gross_margin": (2, "%", 0, lambda a, b: _C.multiply(_C.divide(_C.subtract(a, b), a), _PERCENT)),
}


def checked(operation: str, amounts: int, precision: int) -> None:
    """Raises where the operation, the number of amounts or the precision is none that there is."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}")
    wanted = OPERATIONS[operation][0]
    if not 0 <= precision <= 8:
        raise ValueError("precision is 0 to 8")
    if wanted and amounts != wanted or not 1 <= amounts <= 20:
        raise ValueError(f"{operation} takes {wanted or '1 to 20'} amounts")


def calculate(operation: str, amounts: list[str | None], precision: int = 2) -> float | None:
    """The metric of one row of amounts in decimal notation; None where one is missing, no finite number, or a zero base."""
    _, _, base, formula = OPERATIONS[operation]
    try:
        a = [Decimal(x) for x in amounts if x is not None]
    except InvalidOperation:
        return None
    if len(a) < len(amounts) or not all(x.is_finite() for x in a) or base is not None and not a[base]:
        return None
    return float(formula(*a).quantize(Decimal(1).scaleb(-precision), rounding=ROUND_HALF_UP, context=Context(prec=400)))


def metric(operation: str, amounts: list[Column], precision: int = 2) -> Column:
    """The metric as a double; null where an amount is missing or the base is zero.

    Fixed-scale decimals lose digits in a quotient of very small or very large
    amounts, so the division runs in batches with a floating decimal of 28 digits.
    """
    checked(operation, len(amounts), precision)

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([calculate(operation, list(row), precision) for row in zip(*columns, strict=True)], dtype="float64")

    return run(*[x.cast("string") for x in amounts])


def formula(operation: str, amounts: list[Column]) -> Column:
    """The calculation in words of one line."""
    a = [x.cast("string") for x in amounts]
    if operation == "sum":
        return F.concat_ws(" + ", *a)
    shape = {"difference": "%s - %s", "ratio": "%s / %s", "growth_rate": "(%s - %s) / abs(%s) * 100", "gross_margin": "(%s - %s) / %s * 100"}[operation]
    last = {"growth_rate": [a[1]], "gross_margin": [a[0]]}.get(operation, []) if len(a) > 1 else []
    return F.format_string(shape, *a, *last)
