"""Seeded randomness by hash.

Every draw in the library is a function of (seed, tag, key), never of the
partitioning or of task order, so a recomputed task returns the same rows and the
same rule can be written in any SQL engine.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPACE = 1 << 60  # values of the first fifteen hex digits


def _col(part) -> Column:
    if isinstance(part, Column):
        return part.cast("string")
    return F.lit(str(part))


def seeded_hash(*parts) -> Column:
    """md5 hex digest of the parts joined by '-'. Columns and plain values mix freely."""
    return F.md5(F.concat_ws("-", *[_col(p) for p in parts]))


def hash_int(digest: Column) -> Column:
    """The first fifteen hex digits of a digest as a BIGINT in [0, 2^60)."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """A number in [0, 1) that depends only on the parts."""
    return hash_int(seeded_hash(*parts)) / F.lit(float(HASH_SPACE))


def pick(n, *parts) -> Column:
    """A position in [0, n) that depends only on the parts."""
    size = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(hash_int(seeded_hash(*parts)), size.cast("bigint"))


def digest_of(*parts) -> str:
    """The digest of plain values, for choices that are made once per plan."""
    return hashlib.md5("-".join(str(p) for p in parts).encode()).hexdigest()


def cyclic_derangement(n: int, *parts) -> list[int]:
    """A permutation of range(n) without a fixed point: positions are ordered by
    digest and every position moves to its successor. n = 1 has none and is an error."""
    if n < 2:
        raise ValueError("a derangement needs at least two positions")
    order = sorted(range(n), key=lambda i: (digest_of(*parts, i), i))
    target = [0] * n
    for here, there in zip(order, order[1:] + order[:1]):
        target[here] = there
    return target
