"""Exact duplicates by recipes of content-defined chunks.

A text is normalised, every run of blanks, tabs, line and page breaks becoming one
space, and cut where a rolling hash of its last ``WINDOW`` bytes has its top ``CUT_BITS``
bits at zero, so equal passages are cut alike wherever they stand. A chunk's identifier
is a short key. The key is verified: all chunks of a key are compared by their SHA-256
and length, and where different chunks meet in one key each gets an ordinal beside it.
A text's recipe is the ordered list of its identifiers, and texts are equal when their
recipes are; the SHA-256 of the whole normalised text, which the result carries anyway,
is compared as well.

Texts are read once and never shuffled. Only digests travel, about 50 bytes for a chunk
of some 2,500, first combined per task: keys and digests to verify them, and recipes to
compare them. A hot group is counted per task first, and rows go back to their group by a
join that adaptive execution splits.

Defined cases: null texts count as empty, and empty texts are one group; rows that
repeat an id are rows of their own, and exactly one row of a group stays, of equal ids
the first that was read; a null id stands behind all others and stays only where the
group has no id, with a null ``keep_id``; an empty table gives no rows; other columns are
left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscribe.llm.registry import query, read
from rowscribe.session import cut_lineage

WINDOW = 32  # bytes that decide a cut
CUT_BITS = 11
SHORTEST, LONGEST = 512, 16_384  # bytes of a chunk; the last one of a text may be shorter
KEY_BITS = 64
BLOCK = 1 << 20  # bytes hashed at once, whatever the length of the text
GEAR = np.random.default_rng(13).integers(0, 1 << 32, 256, dtype=np.uint32)


def normalise(text: bytes) -> bytes:
    """Runs of the bytes 9 to 13 and 32 become one space each."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return (b" " if text[:1].isspace() else b"") + b" ".join(words) + (b" " if text[-1:].isspace() else b"")


def cut_places(text: bytes) -> np.ndarray:
    """Places after which the content allows a cut, ascending."""
    data = np.frombuffer(text, np.uint8)
    found = []
    for start in range(0, len(data), BLOCK):
        before = min(start, WINDOW - 1)
        rolled = GEAR[data[start - before : start + BLOCK]]
        width = 1
        while width < WINDOW:
            rolled[width:] += rolled[:-width] << np.uint32(width)
            width *= 2
        found.append(np.flatnonzero(rolled[before:] >> np.uint32(32 - CUT_BITS) == 0) + start + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunks(text: bytes) -> list[bytes]:
    """The chunks of a text; joined they are the text."""
    if len(text) <= SHORTEST:
        return [text] if text else []
    places = cut_places(text)
    out, start = [], 0
    while start < len(text):
        at = int(np.searchsorted(places, start + SHORTEST))
        stop = min(int(places[at]) if at < len(places) else len(text), start + LONGEST, len(text))
        out.append(text[start:stop])
        start = stop
    return out


def recipes(docs: DataFrame, key_bits: int = KEY_BITS) -> DataFrame:
    """(row, id, sha, keys, proofs) of (id, text): a number per row, the digest of the
    normalised text, and the keys and digests of its chunks in order."""
    shift = 64 - key_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, keys, proofs = [], [], []
            for value in batch.column("text"):
                text = normalise(value.as_py() or b"")
                parts = chunks(text)
                whole = hashlib.sha256(text)
                # One chunk is the whole text; the length makes chunks of unlike size differ in any case.
                found = [whole.digest()] if len(parts) == 1 else [hashlib.sha256(p).digest() for p in parts]
                shas.append(whole.hexdigest())
                keys.append([int.from_bytes(d[:8], "little", signed=True) >> shift for d in found])
                proofs.append([d + len(p).to_bytes(8, "little") for d, p in zip(found, parts)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("id"), pa.array(shas, pa.string()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(proofs, pa.list_(pa.binary())),
                ],
                ["row", "id", "sha", "keys", "proofs"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "row bigint, id bigint, sha string, keys array<bigint>, proofs array<binary>")


def shared_keys(made: DataFrame) -> DataFrame:
    """(key, proof, ordinal) of every chunk whose key also belongs to another chunk; the
    ordinal counts from 0 in the order of the proofs."""
    seen = made.select(F.explode(F.arrays_zip("keys", "proofs")).alias("c")).select("c.keys", "c.proofs").distinct()
    twice = seen.groupBy("keys").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("proofs")).alias("all")).filter("n > 1")
    return twice.select(F.col("keys").alias("key"), F.posexplode("all").alias("ordinal", "proof"))


def identified(made: DataFrame) -> DataFrame:
    """(row, id, sha, keys, twist): with ``twist``, the places and ordinals of the chunks
    whose key alone does not tell them apart, the list of keys is the verified recipe."""
    shared = cut_lineage(shared_keys(made), "recipe-shared-keys")
    plain = made.select("row", "id", "sha", "keys")
    none = F.lit(None).cast("array<struct<place:int,ordinal:int>>")
    if shared.isEmpty():
        return plain.withColumn("twist", none)
    parts = made.select("row", F.posexplode(F.arrays_zip("keys", "proofs")).alias("place", "c"))
    parts = parts.select("row", "place", F.col("c.keys").alias("key"), F.col("c.proofs").alias("proof"))
    unlike = parts.join(shared, ["key", "proof"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "ordinal"))).alias("twist"))
    return plain.join(unlike, "row", "left")


def equal_texts(docs: DataFrame, key: str, text: str, key_bits: int = KEY_BITS) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row."""
    docs = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    made = cut_lineage(recipes(docs, key_bits), "recipes")
    rows = identified(made)
    # Grouping keys may not be null in the join below.
    rows = rows.withColumn("twist", F.coalesce("twist", F.array().cast("array<struct<place:int,ordinal:int>>")))
    same = ["keys", "twist", "sha"]
    first = F.min(F.struct(F.col("id").isNull().alias("late"), "id", "row"))
    groups = rows.groupBy(*same).agg(F.count("*").alias("group_size"), first.alias("first")).filter("group_size > 1")
    found = rows.join(groups, same, "left")
    alone = F.col("group_size").isNull()
    return found.select(
        F.col("id").alias(key),
        F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


SQL = r"""
WITH plain AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept,
       sha256(t) AS text_sha256
FROM plain
WINDOW same AS (PARTITION BY t)
"""


@query("op13_chunk_recipes", SQL)
def op13_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equal_texts(read(spark, sf_dir, "documents"), "doc_id", "text")
