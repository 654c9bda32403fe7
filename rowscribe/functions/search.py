"""Position of a key among sorted bounds, as a column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Up to this many bounds a decision tree of comparisons stays inside generated code.
TREE_SIZE = 63


def key_struct(columns: Sequence[Column]) -> Column:
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)])


def _key(columns: Sequence[Column]) -> Column:
    return columns[0] if len(columns) == 1 else key_struct(columns)


def range_of(
    columns: Sequence[Column], bounds: Sequence[tuple], types: Sequence[T.DataType]
) -> Column:
    """How many of the sorted bounds are <= the key: the number of the key's range.
    A key that is NULL lies in range 0. About log2(bounds) comparisons a row, no join."""
    if not bounds:
        return F.lit(0)
    literals = [_key([F.lit(v).cast(t) for v, t in zip(row, types)]) for row in bounds]
    if len(bounds) <= TREE_SIZE:
        return _tree(_key(columns), literals, 0, len(literals))
    return _halving(_key(columns), F.array(*literals), len(literals))


def _tree(key: Column, bounds: Sequence[Column], low: int, high: int) -> Column:
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(key >= bounds[middle], _tree(key, bounds, middle + 1, high)).otherwise(
        _tree(key, bounds, low, middle)
    )


def _halving(key: Column, bounds: Column, size: int) -> Column:
    def halve(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["lo"] + state["hi"], 1)
        right = F.coalesce(
            F.element_at(bounds, F.least(middle + 1, F.lit(size))) <= key, F.lit(False)
        )
        done = state["lo"] >= state["hi"]
        return F.struct(
            F.when(done | ~right, state["lo"]).otherwise(middle + 1).alias("lo"),
            F.when(done | right, state["hi"]).otherwise(middle).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(size).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(size.bit_length()))
    return F.aggregate(steps, start, halve, lambda state: state["lo"])
