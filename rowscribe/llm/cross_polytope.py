"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by pseudo-random rotations, each three rounds of random signs and a
fast Hadamard transform; its hash is the signed coordinate of the largest size. A table
joins ``depth`` rotations to one bucket, and a vector is also put into the buckets of
the second-best coordinate of each rotation in turn (multiprobe). Vectors that share a
bucket are compared by cosine in double precision.

Equal vectors are one class and are hashed once, with their number. Buckets are counted
before vectors travel; a bucket of one is not sent. A large bucket is cut into chunks by
hash and every pair of chunks is compared in a task of its own, by a matrix product; what
leaves the task per vector is its number of links and the smallest vector it reaches
there, never the pairs. A pair that shares several buckets counts in the smallest of
them only. ``depth`` follows from the number of classes, so buckets stay small as the
table grows, and the number of tables from the depth.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers link
with nothing; vectors of different lengths do not link; equal vectors link at once;
rows that repeat an id are rows of their own for the links; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscribe.llm.components import connected_components
from rowscribe.llm.registry import query, read
from rowscribe.session import cut_lineage

COSINE = 0.9
CHUNK = 512  # vectors of a bucket that are compared at once
SEED = 11
MISSED = 1e-3  # most links at the threshold that may share no bucket
HIT = 0.72  # chance that one rotation, with probing, joins vectors at the threshold


def usable(vector: str):
    """Whether a vector has numbers only, and not all zero."""
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)


def identity(vector: str):
    """Equal for vectors of the same numbers."""
    return F.md5(F.col(vector).cast("string").cast("binary"))


class Hasher:
    """Buckets of vectors of one length."""

    def __init__(self, size: int, depth: int, tables: int):
        self.size, self.depth, self.tables = size, depth, tables
        self.width = 1 << max(1, math.ceil(math.log2(max(2, size))))
        random = np.random.default_rng([SEED, size, depth, tables])
        self.signs = random.choice([-1.0, 1.0], (3, tables * depth, self.width))

    def _rotate(self, vectors: np.ndarray) -> np.ndarray:
        n = len(vectors)
        out = np.zeros((n, self.tables * self.depth, self.width))
        out[:, :, : self.size] = vectors[:, None, :]
        for signs in self.signs:
            out = out * signs
            step = 1
            while step < self.width:
                pairs = out.reshape(n, -1, self.width // (2 * step), 2, step)
                low, high = pairs[:, :, :, 0], pairs[:, :, :, 1]
                out = np.stack([low + high, low - high], 3).reshape(n, -1, self.width)
                step *= 2
        return out

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """The buckets of each row: one per table and probe."""
        parts = [self._buckets(vectors[i : i + 256]) for i in range(0, len(vectors), 256)]
        return np.concatenate(parts) if parts else np.empty((0, self.tables * (1 + self.depth)), np.int64)

    def _buckets(self, vectors: np.ndarray) -> np.ndarray:
        n = len(vectors)
        turned = self._rotate(vectors)
        size = np.abs(turned)
        rows = np.arange(n)[:, None], np.arange(turned.shape[1])[None, :]
        best = size.argmax(2)
        size[rows[0], rows[1], best] = -1
        second = size.argmax(2)
        code = [2 * at + (turned[rows[0], rows[1], at] < 0) for at in (best, second)]
        first, other = (c.reshape(n, self.tables, self.depth) for c in code)
        probes = [first]
        for d in range(self.depth):
            probe = first.copy()
            probe[:, :, d] = other[:, :, d]
            probes.append(probe)
        place = np.arange(self.tables, dtype=np.int64)
        out = []
        for probe in probes:
            key = np.broadcast_to(place, probe.shape[:2]).copy()
            for d in range(self.depth):
                key = key * (2 * self.width) + probe[:, :, d]
            out.append(key)
        return np.concatenate(out, 1)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def shape_of(classes: int) -> tuple[int, int]:
    """Depth and number of tables for a number of classes."""
    depth = max(2, math.ceil(math.log(max(2, classes) / 64, 128)))
    return depth, math.ceil(math.log(MISSED) / math.log(1 - HIT**depth))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)


def _bucket_rows(classes: DataFrame, depth: int, tables: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(at))
                hasher = hashers.setdefault(size, Hasher(size, depth, tables))
                found = hasher.buckets(unit(_matrix(part.column("vector"), size)))
                n, m = found.shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n * m, size, np.int32)), pa.array(found.ravel()), part.column("rep").take(pa.array(np.repeat(np.arange(n), m)))],
                    ["size", "bucket", "rep"],
                )

    return classes.select("rep", "size", "vector").mapInArrow(run, "size int, bucket bigint, rep bigint").distinct()


def _compare(vectors, reps, counts, left, right, bucket, hasher) -> tuple[list, list, list] | None:
    """Links of one pair of chunks: ids, numbers of links, smallest id reached."""
    hits = vectors @ vectors.T >= COSINE - 1e-9
    hits &= left[:, None] & right[None, :] & (reps[:, None] < reps[None, :]) | left[None, :] & right[:, None] & (reps[:, None] < reps[None, :])
    a, b = np.nonzero(hits)
    if not len(a):
        return None
    for i in range(0, len(a), 65536):  # the cosine itself, summed the same way everywhere
        x, y = a[i : i + 65536], b[i : i + 65536]
        hits[x, y] = np.einsum("ij,ij->i", vectors[x], vectors[y]) >= COSINE
    some = np.flatnonzero(hits.any(0) | hits.any(1))
    if not len(some):
        return None
    hits = hits[np.ix_(some, some)]
    earlier = hasher.buckets(vectors[some])
    keys, at = np.unique(earlier, return_inverse=True)
    at = at.reshape(earlier.shape)
    of = np.zeros((len(some), len(keys)), np.float32)
    of[np.arange(len(some))[:, None], at] = keys[at] < bucket
    of = of[:, of.sum(0) > 1]
    hits &= of @ of.T == 0
    both = hits | hits.T
    linked = np.flatnonzero(both.any(1))
    if not len(linked):
        return None
    both = both[np.ix_(linked, linked)]
    some = some[linked]
    ids = reps[some]
    root = ids.copy()
    while True:
        new = np.minimum(root, np.where(both, root[None, :], np.iinfo(np.int64).max).min(1))
        if (new == root).all():
            break
        root = new
    return ids.tolist(), (both @ counts[some]).tolist(), root.tolist()


def _links(pairs: DataFrame, depth: int, tables: int) -> DataFrame:
    """(id, n, root) per vector and chunk pair; rows of a chunk pair lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        held: list[pa.RecordBatch] = []

        def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            sizes, buckets, low, high, own = (rows.column(c).to_numpy() for c in ("size", "bucket", "low", "high", "chunk"))
            reps, counts = rows.column("rep").to_numpy(), rows.column("n").to_numpy()
            change = np.flatnonzero((np.diff(sizes) != 0) | (np.diff(buckets) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1
            out: tuple[list, list, list] = ([], [], [])
            for start, stop in zip([0, *change], [*change, len(sizes)]):
                if stop - start < 2:
                    continue
                size = int(sizes[start])
                hasher = hashers.setdefault(size, Hasher(size, depth, tables))
                vectors = unit(_matrix(rows.column("vector").slice(start, stop - start).combine_chunks(), size))
                part = own[start:stop]
                found = _compare(vectors, reps[start:stop], counts[start:stop], part == low[start], part == high[start], buckets[start], hasher)
                if found:
                    for column, new in zip(out, found):
                        column.extend(new)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["id", "n", "root"])

        def group_of(batch: pa.RecordBatch, i: int) -> tuple:
            return tuple(batch.column(c)[i].as_py() for c in ("size", "bucket", "low", "high"))

        for batch in batches:
            if not batch.num_rows:
                continue
            # The last group of a batch may go on in the next one.
            last = group_of(batch, batch.num_rows - 1)
            if held and group_of(batch, 0) == last == group_of(held[-1], held[-1].num_rows - 1):
                held.append(batch)
                continue
            start, stop = 0, batch.num_rows
            while start < stop:  # first row of the last group
                middle = (start + stop) // 2
                if group_of(batch, middle) >= last:
                    stop = middle
                else:
                    start = middle + 1
            yield from work(pa.Table.from_batches([*held, batch.slice(0, start)]))
            held = [batch.slice(start)]
        if held:
            yield from work(pa.Table.from_batches(held))

    return pairs.mapInArrow(run, "id bigint, n bigint, root bigint")


def near_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    members = rows.filter(usable("vector")).select("id", identity("vector").alias("same"), "vector")
    classes = members.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    classes = cut_lineage(classes.withColumn("size", F.size("vector")), "classes")
    depth, tables = shape_of(classes.count())
    placed = cut_lineage(_bucket_rows(classes, depth, tables), "buckets")
    full = placed.groupBy("size", "bucket").agg(F.count("*").alias("rows")).filter("rows > 1")
    chunks = F.ceil(F.col("rows") / CHUNK).cast("int")
    spread = placed.join(full, ["size", "bucket"]).select(
        "size", "bucket", "rep", chunks.alias("chunks"), F.pmod(F.xxhash64("rep"), chunks.cast("bigint")).cast("int").alias("chunk")
    )
    spread = spread.join(classes.select("rep", "n", "vector"), "rep")
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    spread = spread.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})
    spread = spread.select("size", "bucket", "low", "high", "chunk", "rep", "n", "vector")
    dealt = spread.repartition("size", "bucket", "low", "high").sortWithinPartitions("size", "bucket", "low", "high")
    found = cut_lineage(_links(dealt, depth, tables), "vector-links")
    linked = found.groupBy("id").agg(F.sum("n").alias("linked"))
    grouped = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_class = (
        classes.select("same", "rep", "n").join(linked.withColumnRenamed("id", "rep"), "rep", "left")
        .join(grouped.withColumnRenamed("id", "rep"), "rep", "left")
        .select("same", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    keys = rows.select("id", F.when(usable("vector"), identity("vector")).alias("same"))
    return (
        keys.join(per_class, "same", "left")
        .select(
            F.col("id").alias(key),
            F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
        .withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
    )


@query("op2_cross_polytope")
def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
