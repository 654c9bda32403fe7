"""Connected components of a table of links.

Large-star and small-star steps in turn: a node hands its larger neighbours to the
smallest node it knows, then a node and its smaller neighbours go to the smallest of
them. Both are an aggregate with map-side combining and a join, which Spark splits where
a node has very many links. The links are written to the shared folder after every
round, so a lost executor costs one round at most, and the loop ends when a round
changes nothing; the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscribe.session import cut_lineage


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links``: columns ``a`` and ``b`` of one type,
    in any order, repeated or not. The component is its smallest node. Rows with a null
    end or equal ends are no links."""
    one = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut_lineage(one, "links")
    mark = _mark(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = cut_lineage(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        handed = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = cut_lineage(handed.union(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("id", F.col("id").alias("component")))
