"""Features for linear models and trees: encodings, scaling, column selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowscribe.operators.ranking import number_by_order

RESERVED = ("idx", "label")


def column_roles(df: DataFrame, reserved: Sequence[str] = RESERVED) -> tuple[list[str], list[str]]:
    """Numeric and other columns, key and label aside."""
    numeric = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in reserved
    ]
    other = [c for c in df.columns if c not in numeric and c not in reserved]
    return numeric, other


def column_facts(df: DataFrame, columns: Sequence[str], fact, name: str) -> DataFrame:
    """One aggregate over all columns, turned into (column, <name>) rows."""
    row = df.agg(*[fact(F.col(c)).alias(c) for c in columns])
    return row.unpivot([], list(columns), "column", name)


def varying_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, kept): kept where a column has more than one value, NULL aside."""
    return column_facts(
        df, columns, lambda c: F.coalesce(F.min(c) < F.max(c), F.lit(False)), "kept"
    )


def drop_constants(df: DataFrame, reserved: Sequence[str] = RESERVED) -> DataFrame:
    """Drop columns with one value, key and label aside. One aggregate job."""
    columns = [c for c in df.columns if c not in reserved]
    kept = {r["column"] for r in varying_columns(df, columns).where("kept").collect()}
    return df.select([c for c in df.columns if c in kept or c in reserved])


def nonzero_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, nonzero) for every column."""
    return column_facts(
        df, columns, lambda c: F.sum(F.when(c != 0, 1).otherwise(0)).cast("bigint"), "nonzero"
    )


def densest_columns(df: DataFrame, columns: Sequence[str], keep: int = 100) -> DataFrame:
    """(column, nonzero, kept): the ``keep`` columns with most non-zero values. The table
    has one row per column."""
    counts = nonzero_counts(df, columns)
    top = counts.orderBy(F.desc("nonzero"), "column").limit(keep).select("column")
    return counts.join(top.withColumn("kept", F.lit(True)), "column", "left").withColumn(
        "kept", F.coalesce("kept", F.lit(False))
    )


def drop_sparsest(
    df: DataFrame, keep: int = 100, reserved: Sequence[str] = RESERVED
) -> DataFrame:
    columns = [c for c in df.columns if c not in reserved]
    if len(columns) <= keep:
        return df
    kept = {r["column"] for r in densest_columns(df, columns, keep).where("kept").collect()}
    return df.select([c for c in df.columns if c in kept or c in reserved])


def dummy_name(column: str, value: Column) -> Column:
    """'column_value'; a missing value is 'column_nan'."""
    return F.concat(F.lit(f"{column}_"), F.coalesce(value.cast("string"), F.lit("nan")))


def one_hot_long(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, feature, 1.0) per categorical value: the sparse form, without a shuffle and
    for any number of categories."""
    return df.select(
        key, F.explode(F.array(*[dummy_name(c, F.col(c)) for c in columns])).alias("feature")
    ).withColumn("value", F.lit(1.0))


def drop_constant_features(long: DataFrame, rows: Column) -> DataFrame:
    """Of the sparse form, keep the features that are not present in every row.

    A column has at most one feature that every row has, so the list of those to drop is
    no longer than the list of columns and is compared in place, without a join.
    """
    counts = long.groupBy("feature").agg(F.count(F.lit(1)).alias("_c"))
    constant = counts.withColumn("_n", rows).where(F.col("_c") == F.col("_n"))
    names = constant.agg(F.collect_list("feature").alias("names")).scalar()
    return long.withColumn("_drop", names).where(
        ~F.array_contains("_drop", F.col("feature"))
    ).drop("_drop")


def align_features(long: DataFrame, train: DataFrame) -> DataFrame:
    """Of the sparse form, the features that the training rows have too. One that is absent
    here needs no row, as absent means 0; any number of categories will do."""
    return long.join(train.select("feature").distinct(), "feature", "left_semi")


def one_hot(df: DataFrame, vocabulary: Mapping[str, Sequence]) -> DataFrame:
    """Replace categorical columns by 0/1 columns 'column_value' and 'column_nan', one for
    each value that the vocabulary names. For values that are not known beforehand there is
    ``one_hot_long``."""
    plain = [F.col(c) for c in df.columns if c not in vocabulary]
    dummies = []
    for column, values in vocabulary.items():
        text = F.col(column).cast("string")
        for value in values:
            hit = text.isNull() if value is None else text.eqNullSafe(F.lit(value))
            shown = "nan" if value is None else value
            dummies.append(hit.cast("double").alias(f"{column}_{shown}"))
    return df.select(*plain, *dummies)


def fit_ordinal(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): zero-based rank of each value in sorted order."""
    pairs = train.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                    for c in columns
                ]
            )
        ).alias("p")
    ).select("p.*")
    values = pairs.where(F.col("value").isNotNull()).distinct()
    return number_by_order(values, ["value"], "_rn", ["column"]).select(
        "column", "value", (F.col("_rn") - 1).alias("code")
    )


def apply_ordinal(df: DataFrame, codes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace values by their code; a value unseen in training is -1."""
    for column in columns:
        table = codes.where(F.col("column") == column).select(
            F.col("value").alias("_value"), F.col("code").alias("_code")
        )
        df = df.join(table, F.col(column).cast("string") == F.col("_value"), "left").select(
            *[
                F.coalesce("_code", F.lit(-1)).cast("double").alias(c) if c == column else F.col(c)
                for c in df.columns
            ]
        )
    return df


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the mean and population deviation of every column."""
    return train.agg(
        *[
            F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c)
            for c in columns
        ]
    )


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores from fitted statistics, read as one scalar subquery; a deviation of zero
    counts as one."""
    facts = scaler.select(F.struct(*columns)).scalar()
    with_facts = df.withColumn("_facts", facts)
    return with_facts.withColumns(
        {
            c: (F.col(c) - F.col(f"_facts.{c}.mean"))
            / F.when(F.col(f"_facts.{c}.std") == 0, 1.0).otherwise(F.col(f"_facts.{c}.std"))
            for c in columns
        }
    ).drop("_facts")


def scale_by_constants(
    df: DataFrame, constants: Mapping[str, tuple[float, float]]
) -> DataFrame:
    """z-scores from given (mean, deviation) pairs."""
    return df.withColumns(
        {c: (F.col(c) - F.lit(mean)) / F.lit(std) for c, (mean, std) in constants.items()}
    )


def align_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of the training table in its order; those missing here are 0."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns])


def missing_flag(df: DataFrame, column: str, fill=0) -> DataFrame:
    """Add '<column>_nan' and fill the gaps."""
    return df.withColumn(f"{column}_nan", F.col(column).isNull().cast("double")).fillna(
        {column: fill}
    )


def explanation_features(
    df: DataFrame, key: str, constants: Mapping[str, tuple[float, float]],
    reserved: Sequence[str] = RESERVED,
) -> DataFrame:
    """(key, feature, value): dummies of the other columns and the numeric columns, those
    with given constants scaled. What is the same in every row is left out."""
    numeric, other = column_roles(df, (key, *reserved))
    parts = []
    if numeric:
        varying = varying_columns(df, numeric).where("kept")
        kept = varying.agg(F.collect_list("column").alias("names")).scalar()
        scaled = scale_by_constants(df, {c: v for c, v in constants.items() if c in numeric})
        pairs = [
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
            for c in numeric
        ]
        numbers = scaled.select(key, F.explode(F.array(*pairs)).alias("f")).select(key, "f.*")
        parts.append(
            numbers.withColumn("_kept", kept)
            .where(F.array_contains("_kept", F.col("feature")))
            .drop("_kept")
        )
    if other:
        rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
        parts.append(drop_constant_features(one_hot_long(df, key, other), rows))
    if not parts:
        return df.select(key, F.lit("").alias("feature"), F.lit(0.0).alias("value")).limit(0)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """The columns as one vector column."""
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)
