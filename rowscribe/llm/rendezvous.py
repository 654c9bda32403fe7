"""Rendezvous hashing of record keys over weighted shards, in built-in functions only.

Every shard draws a number from (key, shard); the shard with the smallest
``-ln(draw) / weight`` takes the record. A shard's draw does not depend on the other
shards, so one more shard only takes records for itself. A weight of 2 takes twice as
many records as a weight of 1.

Numbers inside a shard follow the md5 of the key. A shard's rows are cut into ranges of
leading hex digits, the ranges are counted first (map-side, keys only), and each range
is numbered on its own from the count before it, so no task sees a whole shard.

Defined cases: a null key hashes as the empty string, a null text has size 1 and a null
checksum, repeated rows go to one shard and get numbers of their own, an empty table
gives no rows. Columns of the input other than the key and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowscribe.llm.registry import query, read

ROWS_PER_RANGE = 1024


def _draw(key: Column, shard: int) -> Column:
    digest = F.md5(F.concat(key, F.lit(f"-{shard}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(2.0**52)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among shards 0 .. len(weights) - 1."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    text = F.coalesce(key.cast("string"), F.lit(""))
    bids = [
        F.struct((-F.log(_draw(text, i)) / F.lit(float(w))).alias("bid"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights)
    ]
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def place(
    rows: DataFrame, key: str, text: str, weights: Sequence[float], grown: Sequence[float]
) -> DataFrame:
    """key, size, text_crc32, law, shard, slot and the shard under the ``grown`` weights."""
    digits = max(0, math.ceil(math.log(max(1, rows.count()) / len(weights) / ROWS_PER_RANGE, 16)))
    spot = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    keys = rows.select(shard_of(F.col(key), weights).alias("shard"), F.substring(spot, 1, digits).alias("_range"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keys.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
        .select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    placed = rows.select(
        F.col(key),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(F.col(text), "utf-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), weights).alias("shard"),
        shard_of(F.col(key), grown).alias("grown_shard"),
        spot.alias("_spot"),
        F.substring(spot, 1, digits).alias("_range"),
    )
    inside = Window.partitionBy("shard", "_range").orderBy("_spot", key, "text_crc32", "size")
    return (
        placed.withColumn("_row", F.row_number().over(inside))
        .join(starts, ["shard", "_range"])
        .withColumn("slot", (F.col("_before") + F.col("_row") - 1).cast("bigint"))
        .select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    )


SHARDS = 16


@query("op6_rendezvous_sharding")
def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(read(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * SHARDS, [1.0] * (SHARDS + 1))
