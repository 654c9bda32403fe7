"""Perturbed copies of rows and their similarity to the original."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscribe.functions.arrays import cosine_similarity
from rowscribe.functions.hashing import pick, uniform

# Copies per row and the share of features that change (two of twelve).
COPIES = 20
SHARE = 2.0 / 12.0


def perturb_rows(
    df: DataFrame,
    key: str,
    domains: Mapping[str, object],
    seed: int,
    copies: int = COPIES,
    share: float = SHARE,
) -> DataFrame:
    """Every row ``copies`` times, each feature replaced with probability ``share``.

    A domain is the largest value of a whole-number feature, or the list of values of a
    category. ``copy_no`` numbers the copies from 1. One pass, no shuffle.
    """
    copied = df.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    changed = {}
    for column, domain in domains.items():
        draw = (seed, column, F.col(key), F.col("copy_no"))
        kind = df.schema[column].dataType
        if isinstance(domain, (int, float)):
            value = F.floor(uniform("value", *draw) * F.lit(float(domain))).cast(kind)
        else:
            values = F.array(*[F.lit(v) for v in domain])
            value = F.element_at(values, pick(len(domain), "value", *draw).cast("int") + 1)
            value = value.cast(kind)
        changed[column] = F.when(uniform("hit", *draw) < share, value).otherwise(F.col(column))
    return copied.withColumns(changed)


def locality_weights(original: Column, perturbed: Column) -> Column:
    """Weight of a perturbed row for a local linear model: its cosine similarity."""
    return cosine_similarity(original, perturbed)


def paired_weights(
    original: DataFrame, perturbed: DataFrame, key: str, vector: str, out: str = "weight"
) -> DataFrame:
    """Join perturbed copies to the original row and weigh them."""
    pairs = perturbed.join(original.select(key, F.col(vector).alias("_original")), key)
    return pairs.withColumn(out, locality_weights(F.col("_original"), F.col(vector))).drop(
        "_original"
    )
