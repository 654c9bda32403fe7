"""Result tables over datasets, shots and seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def experiment_grid(
    df: DataFrame, shots: Sequence[int], seeds: Sequence[int]
) -> DataFrame:
    """Every row once per (num_shot, seed), so that one job covers all cells."""
    return df.withColumn("num_shot", F.explode(F.array(*[F.lit(s) for s in shots]))).withColumn(
        "seed", F.explode(F.array(*[F.lit(s) for s in seeds]))
    )


def mean_std(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Mean, population deviation and count of a score per group."""
    return df.groupBy(*by).agg(
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"),
        F.count(F.lit(1)).alias("n"),
    )


def rounded(cells: DataFrame, digits: int = 2) -> DataFrame:
    return cells.withColumn("mean", F.round("mean", digits)).withColumn(
        "std", F.round("std", digits)
    )


def result_grid(cells: DataFrame, row: str, column: str, columns: Sequence, value: str) -> DataFrame:
    """One line per ``row``, one column per entry of ``columns``."""
    return cells.groupBy(row).pivot(column, list(columns)).agg(F.first(value))


def column_averages(cells: DataFrame, column: str) -> DataFrame:
    """Mean and deviation of the rounded cells of each column."""
    return cells.groupBy(column).agg(
        F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("std")
    )


def result_text(mean: Column, std: Column, n: Column, scale: float = 1.0) -> Column:
    """'m (s)' with two decimals; a single score stands alone, in percent."""
    several = F.format_string("%.2f (%.2f)", mean * F.lit(scale), std * F.lit(scale))
    return F.when(n > 1, several).otherwise(F.format_string("%.2f", mean * F.lit(100.0)))


def latex_cell(mean: Column, std: Column) -> Column:
    """'& $m_{.sd}$' with the leading digit of the deviation cut off."""
    sd = F.substring(F.format_string("%.2f", std), 2, 2147483647)
    return F.concat(F.lit("& $"), F.format_string("%.2f", mean), F.lit("_{"), sd, F.lit("}$"))


def best_step(df: DataFrame, by: Sequence[str], step: str, metric: str) -> DataFrame:
    """The earliest step with the highest metric."""
    order = F.struct(F.col(metric), -F.col(step))
    return df.groupBy(*by).agg(
        F.max_by(F.col(step), order).alias("best_step"), F.max(metric).alias("best_metric")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key along ``order``. An aggregate with map-side combining,
    so a key with very many rows costs no more than any other."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


# Fixed value: the parts of an experiment folder, model_dataset_numshotN_seedN_rest. A
# partition column may stand in front of it.
EXPERIMENT = r"^(?:[^=]*=)?([^_]+)_(.+)_numshot([^_]+)_seed(\d+)(?:_(.*))?$"


def experiment_key(path: Column) -> dict[str, Column]:
    """model, dataset, num_shot, seed and spec of the folder that holds a score file."""
    folder = F.element_at(F.split(path, "/"), -2)
    names = ("model", "dataset", "num_shot", "seed", "spec")
    return {n: F.regexp_extract(folder, EXPERIMENT, i) for i, n in enumerate(names, 1)}
