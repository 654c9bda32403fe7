"""Ranks, running sums and quantiles over the whole table or over very large groups.

A window without a partition column moves every row to one task, and a window over
a hot group does the same with that group. The operators here cut each group into
ranges first, sum every range with a map-side combined aggregate, and start the
window of each range at the sum of the ranges before it. The result is the exact
rank; only the work is spread.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowscribe.functions.search import key_struct, range_of
from rowscribe.session import bucket_count

_BUCKET = "_range"
_BEFORE = "_before"

DRAWS = 1 << 40  # steps of a share of sampled keys


def hash_digits(spark: SparkSession) -> int:
    """Leading hex digits of a digest that name its range: 4096 ranges, or 65536 where
    the session shuffles into thousands of partitions."""
    return 3 if bucket_count(spark) <= 1024 else 4


def hash_range(df: DataFrame, digest: str) -> Column:
    """The range of a hash order."""
    return F.substring(digest, 1, hash_digits(df.sparkSession))


def sampled_range(
    df: DataFrame, order: Sequence[Column], ranges: int | None = None
) -> Column:
    """The range of each row when the order is cut into ranges of similar size.

    Keys whose hash falls below a threshold, about 64 per range by the counted rows, are
    sorted on the driver. The choice steers only the balance of the ranges. In an order
    of several columns NULLs count as keys, so that later columns split them.
    """
    ranges = ranges or bucket_count(df.sparkSession)
    keys = df.select(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    names = keys.columns
    keys = keys.na.drop() if len(names) == 1 else keys
    share = min(1.0, 64.0 * ranges / max(1, keys.count()))
    drawn = F.pmod(F.xxhash64(*names), F.lit(DRAWS)) < F.lit(int(share * DRAWS))
    chosen = keys.where(drawn).distinct().collect()
    sample = sorted({tuple(row) for row in chosen}, key=lambda row: [(v is not None, v) for v in row])
    step = max(1, len(sample) // ranges)
    bounds = sample[step::step][: ranges - 1]
    return range_of(order, bounds, [f.dataType for f in keys.schema.fields])


def running_sums(
    df: DataFrame,
    range_: Column,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Add an inclusive running sum per entry of ``sums`` along ``order``.

    ``range_`` must not decrease along ``order``. ``order`` should be a total order
    within a group; partition columns must not be NULL.
    """
    keys = list(partition_by)
    cut = df.withColumn(_BUCKET, range_)
    totals = cut.groupBy(*keys, _BUCKET).agg(
        *[F.sum(expr).alias(f"_total_{name}") for name, expr in sums.items()]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per range: at most `ranges` rows meet in a group's window.
    starts = totals.select(
        *keys,
        _BUCKET,
        *[
            F.coalesce(F.sum(f"_total_{name}").over(earlier), F.lit(0)).alias(f"{_BEFORE}_{name}")
            for name in sums
        ],
    )
    if not keys:
        starts = F.broadcast(starts)  # bounded by the number of ranges
    within = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = cut.join(starts, [*keys, _BUCKET])
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            (F.col(f"{_BEFORE}_{name}") + F.sum(expr).over(within)).alias(name)
            for name, expr in sums.items()
        ],
    )


def number_by_hash(
    df: DataFrame,
    digest: str,
    out: str,
    tie: Sequence[str] = (),
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Number rows 1..n along a digest column, whole table or per group."""
    return running_sums(
        df,
        hash_range(df, digest),
        [F.col(digest), *[F.col(c) for c in tie]],
        {out: F.lit(1).cast("bigint")},
        partition_by,
    )


def number_by_order(
    df: DataFrame,
    order: Sequence[str],
    out: str,
    partition_by: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Number rows 1..n along ascending columns, whole table or per group.

    The last order column should be unique, so that a value that fills a third of
    the table is still cut into many ranges.
    """
    columns = [F.col(c) for c in order]
    range_ = sampled_range(df, columns, ranges)
    return running_sums(df, range_, columns, {out: F.lit(1).cast("bigint")}, partition_by)


def accumulate_by_order(
    df: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, Column],
    partition_by: Sequence[str] = (),
    range_: Column | None = None,
) -> DataFrame:
    """Running sums along ascending columns. ``range_`` spares a sample of ``df``."""
    columns = [F.col(c) for c in order]
    if range_ is None:
        range_ = sampled_range(df, columns)
    return running_sums(df, range_, columns, sums, partition_by)


def quantile_bounds(df: DataFrame, column: str, most: int = 1024) -> list[tuple]:
    """Bounds that cut a numeric column into ranges of similar row counts, from one
    pass with a sketch; rows are not shuffled."""
    ranges = min(most, bucket_count(df.sparkSession))
    marks = df.stat.approxQuantile(
        column, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)
    )
    return [(m,) for m in sorted(set(marks))]


def nth_key(
    df: DataFrame,
    order: Sequence[str],
    range_: Column,
    keep: Column,
    partition_by: Sequence[str] = (),
    limits: DataFrame | None = None,
) -> DataFrame:
    """The order key of row number ``keep`` per group, one row a group, as ``_edge``.

    ``keep`` is an expression of the group's row count ``n`` and of the columns of
    ``limits``, a table with one row per group. Only the range that holds the row is
    sorted; all other rows are merely counted, so the table itself is not shuffled.
    A group without such a row has no result.
    """
    keys = list(partition_by)
    cut = df.select(*keys, *order, range_.alias(_BUCKET))
    counts = cut.groupBy(*keys, _BUCKET).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*keys).orderBy(_BUCKET)
    whole = Window.partitionBy(*keys)
    ranges = counts.withColumn("_end", F.sum("_c").over(upto)).withColumn(
        "n", F.sum("_c").over(whole)
    )
    if limits is not None:
        ranges = ranges.join(limits, keys)
    ranges = ranges.withColumn("_keep", keep.cast("bigint"))
    hit = ranges.where(
        (F.col("_keep") > F.col("_end") - F.col("_c")) & (F.col("_keep") <= F.col("_end"))
    ).select(*keys, _BUCKET, (F.col("_keep") - F.col("_end") + F.col("_c")).alias("_nth"))
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    if not keys:
        hit = F.broadcast(hit)  # one row
    return (
        cut.join(hit, [*keys, _BUCKET])
        .withColumn("_rn", F.row_number().over(inside))
        .where(F.col("_rn") == F.col("_nth"))
        .select(*keys, key_struct([F.col(c) for c in order]).alias("_edge"))
    )


def at_most(order: Sequence[str], edge: Column) -> Column:
    """Whether a row stands at or before an edge; false where there is no edge."""
    return F.coalesce(key_struct([F.col(c) for c in order]) <= edge, F.lit(False))


def exact_quantiles(df: DataFrame, column: str, at: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of a numeric column with linear interpolation, as one row.

    An approximate sketch brackets each quantile; rows outside the brackets are
    only counted. What is sorted is the few values inside a bracket, not the column.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    n = values.count()
    if n == 0:
        return df.sparkSession.range(1).select(
            *[F.lit(None).cast("double").alias(name) for name in at]
        )
    slack = 0.002 + 2.0 / n  # room for the two neighbours of an interpolated position
    probes = sorted({min(1.0, max(0.0, q + d)) for q in at.values() for d in (-slack, slack)})
    marks = values.stat.approxQuantile("v", probes, slack / 4)
    mark = dict(zip(probes, marks))
    brackets = []
    for q in at.values():
        low = float("-inf") if q <= slack else mark[q - slack]
        high = float("inf") if q >= 1 - slack else mark[q + slack]
        brackets.append((low, high))
    inside = F.lit(False)
    for low, high in brackets:
        inside = inside | F.col("v").between(low, high)
    # Rows between brackets collapse onto the next bracket's lower edge.
    edge = F.lit(float("inf"))
    for low, _ in sorted(brackets, reverse=True):
        edge = F.when(F.col("v") < low, F.lit(low)).otherwise(edge)
    counts = (
        values.select(F.when(inside, F.col("v")).otherwise(edge).alias("v"), inside.alias("real"))
        .groupBy("v", "real")
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumn("real_rank", F.col("real").cast("int"))
    )
    steps = accumulate_by_order(counts, ["v", "real_rank"], {"upto": F.col("c")})
    picks, shares = [], {}
    for name, q in at.items():
        position = (n - 1) * q  # zero-based, fractional
        shares[name] = position - math.floor(position)
        for suffix, index in (("lo", math.floor(position)), ("hi", math.ceil(position))):
            here = (F.col("upto") > index) & (F.col("upto") - F.col("c") <= index)
            picks.append(F.max(F.when(here, F.col("v"))).alias(f"{name}_{suffix}"))
    low = {name: F.col(f"{name}_lo") for name in at}
    gap = {name: F.col(f"{name}_hi") - low[name] for name in at}
    return steps.agg(*picks).select(
        *[(low[name] + gap[name] * F.lit(shares[name])).alias(name) for name in at]
    )


def median_of(df: DataFrame, column: str) -> Column:
    """The exact median as a scalar subquery."""
    return exact_quantiles(df, column, {"median": 0.5}).scalar()
