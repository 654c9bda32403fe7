"""Exact nearest vectors by a vector-approximation file.

Vectors are turned into whole numbers, ``floor(SCALE * x)``, and the file keeps one
byte per dimension: the cell, of ``CELLS`` of equal width, that holds the number. The
scan meets queries and cells block by block; from the cells alone follow a lower and an
upper bound of every inner product, and a vector whose upper bound is below the kth
best lower bound of a query is out. Exact vectors are then read in the order of their
bound: first the best few of every query, then of the others those whose bound can
still reach the kth best score found. What is left out is provably no result, so the
answer is exact.

Equal vectors are one class in the scan, with as many of their smallest ids as a
result can need. Blocks follow from the number of rows; a block of queries meets a
block of cells in a task of its own, and passes on only candidates.

Defined cases: vectors that are null, empty or hold null or non-finite numbers are
neither queries nor candidates; vectors of other lengths than the query's are no
candidates; a query with fewer candidates than k gets them all; ties go to the smaller
id; a zero vector takes part; rows that repeat an id and its vector are one row, and no
row with the query's id is a candidate. Numbers are exact while an inner product is below
2 to the 53rd.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowscribe.llm.registry import query, read
from rowscribe.session import cut_lineage

K = 5
SCALE = 256
CELLS = 256
QUERY_BLOCK = 512
CELL_BLOCK = 4096
FIRST = 12  # exact vectors read per query before the bound is checked again


def whole_numbers(rows: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, same, v): usable vectors in whole numbers; ``same`` is equal for equal ones."""
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = rows.filter(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad))
    whole = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    return fine.select(F.col(key).alias("id"), whole.alias("v")).withColumn("same", F.md5(F.col("v").cast("string").cast("binary")))


def _bounds(low: int, width: int, k: int):
    """Candidates of one block of queries in one block of cells."""

    def run(_, queries: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        names = ["query", "same", "low", "high"]
        out = [pd.DataFrame({"query": [], "same": [], "low": [], "high": []}).astype({"query": str, "same": str})]
        if not len(queries) or not len(cells):
            return out[0][names]
        sizes = cells["cell"].map(len)
        for size in sorted(set(queries["v"].map(len)) & set(sizes)):
            asked = queries[queries["v"].map(len) == size]
            held = cells[sizes == size]
            q = np.stack(asked["v"].to_numpy()).astype(float)
            corner = np.frombuffer(b"".join(held["cell"]), np.uint8).reshape(len(held), size) * float(width) + low
            score = q @ corner.T
            worst = score + (width - 1) * np.minimum(q, 0).sum(1, keepdims=True)
            best = score + (width - 1) * np.maximum(q, 0).sum(1, keepdims=True)
            n = worst.shape[1]
            kth = np.partition(worst, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), -np.inf)
            i, j = np.nonzero(best >= kth[:, None])
            out.append(
                pd.DataFrame({"query": asked["same"].to_numpy()[i], "same": held["same"].to_numpy()[j], "low": worst[i, j], "high": best[i, j]})
            )
        return pd.concat(out)[names]

    return run


def _score(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("bigint"), lambda s, x: s + x)


def _kth(rows: DataFrame, value: str, k: int, name: str) -> DataFrame:
    """The kth largest value of each query; the least one where there are fewer."""
    order = Window.partitionBy("query").orderBy(F.col(value).desc(), "same")
    top = rows.select("query", "same", value).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)
    full = F.when(F.max("at") == k, F.min(value)).otherwise(F.lit(float("-inf")))
    return top.groupBy("query").agg(full.alias(name))


def top_k(rows: DataFrame, key: str, vector: str, asked, k: int = K) -> DataFrame:
    """(query_id, rank, key, score): the ``k`` best rows for every row for which the
    column ``asked``, over ``id``, holds."""
    whole = cut_lineage(whole_numbers(rows, key, vector), "va-whole")
    spread = Window.partitionBy("same").orderBy("id")
    members = whole.select("same", "id").distinct().withColumn("at", F.row_number().over(spread)).filter(F.col("at") <= k + 1)
    members = cut_lineage(members.select("same", "id"), "va-members")
    classes = cut_lineage(whole.groupBy("same").agg(F.first("v").alias("v")), "va-classes")
    asking = whole.filter(asked).select("same").distinct()
    asking = cut_lineage(asking.join(classes, "same"), "va-queries")
    ends = classes.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    schema = "query_id bigint, rank int, id bigint, score bigint"
    if ends[0] is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", key)
    low, width = ends[0], max(1, -(-(ends[1] - ends[0] + 1) // CELLS))
    cell = F.transform("v", lambda x: F.floor((x - low) / width).cast("int"))
    as_bytes = F.unhex(F.array_join(F.transform(cell, lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    blocks = max(1, math.ceil(classes.count() / CELL_BLOCK))
    groups = max(1, math.ceil(asking.count() / QUERY_BLOCK))
    place = lambda n: F.pmod(F.xxhash64("same"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = classes.select("same", as_bytes.alias("cell"), place(blocks).alias("block"), every(groups).alias("group"))
    queries = asking.select("same", "v", place(groups).alias("group"), every(blocks).alias("block"))
    found = (
        queries.groupBy("group", "block").cogroup(cells.groupBy("group", "block"))
        .applyInPandas(_bounds(low, width, k + 1), "query string, same string, low double, high double")
    )
    found = cut_lineage(found, "va-bounds")
    able = found.join(_kth(found, "low", k + 1, "least"), "query").filter("high >= least").drop("least", "low")
    order = Window.partitionBy("query").orderBy(F.col("high").desc(), "same")
    able = cut_lineage(able.withColumn("place", F.row_number().over(order)), "va-candidates")

    def exact(pairs: DataFrame) -> DataFrame:
        read = pairs.join(classes, "same").join(asking.select(F.col("same").alias("query"), F.col("v").alias("q")), "query")
        return read.select("query", "same", _score("v", "q").alias("score"))

    first = cut_lineage(exact(able.filter(F.col("place") <= FIRST)), "va-first")
    rest = able.filter(F.col("place") > FIRST).join(_kth(first, "score", k + 1, "least"), "query").filter("high >= least")
    scored = first.union(exact(rest))
    best = Window.partitionBy("query").orderBy(F.col("score").desc())
    kept = scored.withColumn("place", F.rank().over(best)).filter(F.col("place") <= k + 1).drop("place")
    # Of the equal vectors of a class the k + 1 smallest ids can be results, and of all
    # a query's hits the k + 1 best, as one of them may be the query itself.
    short = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    hits = kept.join(members, "same").select("query", "id", "score")
    hits = hits.withColumn("near", F.row_number().over(short)).filter(F.col("near") <= k + 1)
    ids = whole.filter(asked).select(F.col("id").alias("query_id"), F.col("same").alias("query")).distinct()
    ranked = Window.partitionBy("query_id", "query").orderBy("near")
    joined = ids.join(hits, "query").filter("id <> query_id")
    return (
        joined.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
    )


@query("op3_va_file")
def op3_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 50 == 0)
