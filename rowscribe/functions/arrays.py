"""Small vector helpers over ARRAY<DOUBLE> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def computed_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value, bound as the one element of an array. An expression inside a
    lambda is computed again at each call, a variable is not."""
    return F.transform(F.array(value), use)[0]


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return array_total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """NULL where a vector has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def normalised(values: Column) -> Column:
    """Divide by the sum; NULL where the sum is zero."""

    def shares(own: Column) -> Column:
        return computed_once(
            array_total(own), lambda total: F.transform(own, lambda x: x / F.nullif(total, F.lit(0.0)))
        )

    return computed_once(values, shares)


def argmax(values: Column) -> Column:
    """Zero-based position of the largest value, the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def ordered_join(entries: Column, separator: str) -> Column:
    """Join collected (position, text) structs by position."""
    return F.array_join(
        F.transform(F.sort_array(entries), lambda e: e["text"]), separator
    )
