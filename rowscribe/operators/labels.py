"""Label rules. Each returns a function from the table to an INT label column."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscribe.operators.ranking import median_of

LabelRule = Callable[[DataFrame], Column]


def equals(column: str, value) -> LabelRule:
    """1 where the column has the value, 0 elsewhere, also for NULL."""
    return lambda df: F.coalesce((F.col(column) == F.lit(value)).cast("int"), F.lit(0))


def one_of(column: str, values: Sequence) -> LabelRule:
    return lambda df: F.coalesce(F.col(column).isin(list(values)).cast("int"), F.lit(0))


def coded(column: str, codes: Mapping[str, int]) -> LabelRule:
    """The number of each code; an unknown code fails the query."""

    def rule(df: DataFrame) -> Column:
        value = F.col(column).cast("string")
        chain = F
        for code, number in codes.items():
            chain = chain.when(value == F.lit(code), F.lit(number))
        return chain.when(value.isNull(), F.lit(None)).otherwise(
            F.raise_error(F.concat(F.lit(f"no label for {column} = "), value)).cast("int")
        )

    return rule


def above_median(column: str) -> LabelRule:
    """1 above the exact median of the column. The median is a scalar subquery."""
    return lambda df: (F.col(column) > median_of(df, column)).cast("int")


def binned(column: str, edges: Sequence[float]) -> LabelRule:
    """The number of the right-closed interval; a value outside all fails the query."""

    def rule(df: DataFrame) -> Column:
        value = F.col(column)
        chain = F
        for number, (low, high) in enumerate(zip(edges, edges[1:])):
            chain = chain.when((value > low) & (value <= high), F.lit(number))
        return chain.otherwise(
            F.raise_error(
                F.concat(F.lit(f"{column} outside the bins: "), F.coalesce(value.cast("string"), F.lit("NULL")))
            ).cast("int")
        )

    return rule


def as_int(column: str) -> LabelRule:
    return lambda df: F.col(column).cast("int")


def shifted(column: str, by: int = -1) -> LabelRule:
    """A number stored as text, moved by a constant."""
    return lambda df: F.col(column).cast("int") + F.lit(by)
