"""Batches of rows padded to one length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowscribe.operators.ranking import number_by_order


def assign_batches(
    df: DataFrame,
    key: str,
    size: int,
    shard: Sequence[str] = (),
    drop_last: bool = False,
    out: str = "batch",
) -> DataFrame:
    """Number batches of ``size`` rows along ``key``, whole table or per shard."""
    numbered = number_by_order(df, [key], "_rn", shard).withColumn(
        out, F.floor((F.col("_rn") - 1) / size).cast("bigint")
    )
    if drop_last:
        within = Window.partitionBy(*shard, out)
        numbered = numbered.withColumn("_c", F.count(F.lit(1)).over(within))
        numbered = numbered.where(F.col("_c") == size).drop("_c")
    return numbered.drop("_rn")


def pad_batches(
    df: DataFrame, ids: str, batch: Sequence[str], pad_id: int = 0, out: str = "input_ids"
) -> DataFrame:
    """Pad every row to the longest of its batch and add ``attention_mask``. A batch is
    as many rows as a batch has."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(*batch))
    fill = F.array_repeat(F.lit(pad_id).cast("int"), (longest - F.size(ids)).cast("int"))
    return df.withColumn(out, F.concat(F.col(ids), fill)).withColumn(
        "attention_mask", attention_mask(F.col(out), pad_id)
    )


def attention_mask(ids: Column, pad_id: int = 0) -> Column:
    return F.transform(ids, lambda i: (i != pad_id).cast("int"))


def check_choice_counts(df: DataFrame, choices: str, batch: Sequence[str]) -> DataFrame:
    """Fail the query where a batch mixes different numbers of choices."""
    within = Window.partitionBy(*batch)
    same = F.min(F.size(choices)).over(within) == F.max(F.size(choices)).over(within)
    return (
        df.withColumn("_same", same)
        .where(
            F.when(F.col("_same"), F.lit(True)).otherwise(
                F.raise_error(F.lit("different numbers of choices in a batch")).cast("boolean")
            )
        )
        .drop("_same")
    )


def joined_fields(parts: Sequence[Column], last_special: Column | None = None) -> Column:
    """Token ids of several fields as one list; special ids follow the last field only."""
    pieces = list(parts) + ([last_special] if last_special is not None else [])
    return F.flatten(F.array(*pieces))
