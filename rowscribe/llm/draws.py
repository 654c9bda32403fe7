"""Samples of different texts by the smallest of their hashes.

Rows have a text ``_text`` and its hash ``_place``, and with a group also ``_lang``.
Copies of a text count once, so a sample follows neither the number of copies nor the
partitions, and never comes out empty where there are rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 40
SPARE = 2.0  # drawn by threshold for each one wanted


def by_place(place: int) -> tuple[int, int]:
    """The order of hashes: by their last bits, then whole."""
    return place & ((1 << BITS) - 1), place


def bounds(rows: DataFrame, size: int, group: str) -> dict:
    """For each group the order of its last hash of the ``size`` smallest, or None where it
    has at most as many.

    Thresholds follow from approximate counts of different hashes, without a shuffle of
    rows. A group of which too few hashes fall below its threshold is drawn again with a
    wider one, so the result is exact.
    """
    counts = rows.groupBy(group).agg(F.approx_count_distinct("_place").alias("_n")).collect()
    share = {r[group]: SPARE * size / max(1, r["_n"]) for r in counts}
    out: dict = {}
    while share:
        limits = {g: (1 << BITS) if s >= 1 else int(s * (1 << BITS)) for g, s in share.items()}
        found: dict = {g: [] for g in limits}
        below = rows.filter(_last_bits() < _by_group(limits, group)).select(group, "_place").distinct()
        for r in below.collect():
            found[r[group]].append(r["_place"])
        for g, places in found.items():
            if len(places) >= size:
                out[g] = by_place(sorted(places, key=by_place)[size - 1])
            elif share[g] >= 1:
                out[g] = None
        share = {g: 2 * s for g, s in share.items() if g not in out}
    return out


def smallest_places(rows: DataFrame, size: int, group: str | None = None) -> DataFrame:
    """One row of each of the ``size`` smallest hashes, per group."""
    own = group or "_all"
    if not group:
        rows = rows.withColumn(own, F.lit(0))
    last = bounds(rows, size, own)
    if not last:
        return (rows if group else rows.drop(own)).limit(0)
    bits = _by_group({g: (1 << BITS) if b is None else b[0] for g, b in last.items()}, own)
    whole = _by_group({g: 0 if b is None else b[1] for g, b in last.items()}, own)
    kept = rows.filter((_last_bits() < bits) | (_last_bits() == bits) & (F.col("_place") <= whole))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # bounded by the sample
        for batch in batches:
            keys = list(zip(batch.column("_place").to_pylist(), batch.column(own).to_pylist()))
            first = []
            for i, key in enumerate(keys):
                if key not in seen:
                    seen.add(key)
                    first.append(i)
            yield batch.take(pa.array(first, pa.int64()))

    single = kept.mapInArrow(once, kept.schema).dropDuplicates([own, "_place"])
    return single if group else single.drop(own)


def _last_bits() -> Column:
    return F.pmod("_place", F.lit(1 << BITS))


def _by_group(values: dict, group: str) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])[F.col(group)].cast("bigint")
