"""Splits of a table into train, validation, test and folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscribe.functions.hashing import seeded_hash
from rowscribe.operators.ranking import (
    at_most,
    hash_range,
    nth_key,
    number_by_hash,
    sampled_range,
)


def holdout_size(n: Column, share: float) -> Column:
    """Rows held out of n: rounded up."""
    # the small term keeps products such as 0.2 * 15 from rounding up by one
    return F.ceil(n.cast("double") * share - 1e-9)


def _edge(df: DataFrame, order: Sequence[str], range_: Column, keep: Column) -> Column:
    return nth_key(df, order, range_, keep).scalar()


def split_ordered(df: DataFrame, key: str, out: str = "split") -> DataFrame:
    """First 80 % train, next 10 % validation, last 10 % test, along a unique ``key``.

    Ranges of the key are counted to find the last training and the last validation
    row; the rows themselves are compared with these two and not moved.
    """
    range_ = sampled_range(df, [F.col(key)])
    n = F.col("n")
    held = holdout_size(n, 0.2)
    return df.withColumn(
        out,
        F.when(at_most([key], _edge(df, [key], range_, n - held)), "train")
        .when(at_most([key], _edge(df, [key], range_, n - holdout_size(held, 0.5))), "validation")
        .otherwise("test"),
    )


def split_seeded(
    df: DataFrame,
    key: str,
    seed: int,
    share: float = 0.2,
    out: str = "split",
    names: tuple[str, str] = ("train", "validation"),
) -> DataFrame:
    """Hold out an exact share, chosen by hash. One split of the rest is empty: the
    held-out rows are validation and test at once.

    The rows are not sorted: a first pass counts hash ranges and finds the hash of the
    last training row, the second compares with it.
    """
    hashed = df.withColumn("_h", seeded_hash(seed, "split", F.col(key)))
    order = ["_h", key]
    train = F.col("n") - holdout_size(F.col("n"), share)
    edge = _edge(hashed, order, hash_range(hashed, "_h"), train)
    return hashed.withColumn(
        out, F.when(at_most(order, edge), F.lit(names[0])).otherwise(F.lit(names[1]))
    ).drop("_h")


def split_seeds(
    df: DataFrame, key: str, seeds: Sequence[int], share: float = 0.2, out: str = "split"
) -> DataFrame:
    """The seeded split for several seeds at once: every row once per seed."""
    per_seed = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    hashed = per_seed.withColumn("_h", seeded_hash(F.col("seed"), "split", F.col(key)))
    order = ["_h", key]
    train = F.col("n") - holdout_size(F.col("n"), share)
    last = nth_key(hashed, order, hash_range(hashed, "_h"), train, ["seed"])
    return (
        hashed.join(last, "seed", "left")
        .withColumn(
            out, F.when(at_most(order, F.col("_edge")), "train").otherwise("validation")
        )
        .drop("_h", "_edge")
    )


# Splits that a benchmark names differently.
STORY_ROUTES = {"train": "validation", "validation": "test"}
ROUND_ROUTES = {"validation": "test"}


def route_split(split: Column, routes: Mapping[str, str], suffix: str = "") -> Column:
    """The name under which a split is stored."""
    named = split
    for asked, stored in routes.items():
        named = F.when(split == asked, F.lit(stored)).otherwise(named)
    return F.concat(named, F.lit(suffix)) if suffix else named


def hold_out_range(
    df: DataFrame, position: str, start: int, size: int = 10, out: str = "split"
) -> DataFrame:
    """Cross-validation slice: ``size`` zero-based positions from ``start`` are held out."""
    return df.withColumn(
        out,
        F.when(F.col(position).between(start, start + size - 1), "validation").otherwise("train"),
    )


def fold_count(df: DataFrame, label: str, most: int = 4) -> int:
    """Folds the smallest class allows, at most ``most``. One aggregate, one number."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    return int(sizes.agg(F.least(F.min("c"), F.lit(most))).first()[0] or 0)


def stratified_folds(
    df: DataFrame, key: str, label: str, seed: int, most: int = 4, out: str = "fold"
) -> DataFrame:
    """Shuffled folds with equal label shares. Where a label has a single row, two plain
    folds over the whole table."""
    folds = fold_count(df, label, most)
    hashed = df.withColumn("_h", seeded_hash(seed, "fold", F.col(key)))
    if folds > 1:
        numbered = number_by_hash(hashed, "_h", "_rn", [key], [label])
    else:
        folds = 2
        numbered = number_by_hash(hashed, "_h", "_rn", [key])
    return numbered.withColumn(out, F.pmod(F.col("_rn") - 1, F.lit(folds)).cast("int")).drop(
        "_h", "_rn"
    )
