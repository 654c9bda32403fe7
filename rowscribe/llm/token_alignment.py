"""Alignment of the tokens of two tokenizers over the same texts.

Both token lists of a text get the byte places where their tokens end, kept as
dictionaries from end to index. The ends that stand in both, found by a set
intersection and sorted, slice the two lists into groups, and within a group every two
tokens whose byte ranges overlap are linked. Over all texts a pair of ids counts the
texts that hold it linked; a link is a best one if no other pair of its first id counts
more.

Texts are cut at single spaces between printed characters, where neither tokenizer joins
what stands before and after (checked on the vocabulary of pieces), so that a task
encodes and aligns every stretch once and remembers up to ``MEMORY`` short ones. Pairs
are counted per task before they are shuffled. The counts go to the tasks as one table
where it has at most ``SENT`` pairs, which is measured; a larger one is joined by pair
with the texts' own pairs, both spread by the shuffle.

Defined cases: null and empty texts, and texts that either tokenizer does not give back
byte for byte, have no tokens, zeros, and an empty string for the groups; strings of
special tokens are plain text; rows that repeat an id are texts of their own; an empty
table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowscribe.llm.batches import runs_of
from rowscribe.llm.registry import query, read
from rowscribe.session import cut_lineage

MEMORY = 300_000  # stretches kept per task
SHORT = 80  # characters of a stretch that is kept
RUN_BYTES = 2 << 20  # of texts aligned at once
HELD = 1 << 19  # pairs counted in a task before they are passed on
SENT = 4_000_000  # pairs whose counts go to every task: 12 bytes each
CUT = re.compile(r"(?<=[\w!-/:-@\[-`{-~]) (?=[\w!-/:-@\[-`{-~])")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
SPACE = "▁"


def byte_level_bytes(tokens: dict[str, int]) -> list[bytes]:
    """The bytes of every entry of a byte-level vocabulary, by id. Printed Latin-1
    characters stand for themselves, the other bytes for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    out = [b""] * (max(tokens.values()) + 1)
    for token, i in tokens.items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return out


def piece_bytes(pieces: list[str]) -> list[bytes]:
    found = [BYTE_PIECE.fullmatch(p) for p in pieces]
    return [bytes([int(m[1], 16)]) if m else p.replace(SPACE, " ").encode() for m, p in zip(found, pieces)]


class Aligner:
    """Groups and links of texts; ``first`` is a byte-level tokenizer file and ``second`` a
    piece model, both as bytes."""

    def __init__(self, first: bytes, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(first.decode())
        self.first.encode_special_tokens = True
        self.second = SentencePieceProcessor(model_proto=second)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.first_bytes = byte_level_bytes(self.first.get_vocab(with_added_tokens=True))
        self.second_bytes = piece_bytes(pieces)
        self.sizes = [len(b) for b in self.first_bytes]
        self.second_sizes = [len(b) for b in self.second_bytes]
        self.names = [str(i) for i in range(max(len(self.sizes), len(pieces)))]
        self.width = len(pieces)
        self.whole = any(SPACE in p.lstrip(SPACE) for p in pieces)  # pieces reach over spaces: no cuts
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def align(self, ids: list[int], others: list[int]) -> tuple[str, int, list[int]]:
        """The groups as text, their number, and the linked pairs as ``id * width + other``."""
        sizes, other_sizes, width, name = self.sizes, self.second_sizes, self.width, self.names.__getitem__
        index = dict(zip(accumulate(map(sizes.__getitem__, ids)), count(1)))
        other_index = dict(zip(accumulate(map(other_sizes.__getitem__, others)), count(1)))
        groups, links, i, j = [], [], 0, 0
        for place in sorted(index.keys() & other_index.keys()):
            to, other_to = index[place], other_index[place]
            if to - i == 1 and other_to - j == 1:
                x, y = ids[i], others[j]
                groups.append(f"{x}|{y}")
                links.append(x * width + y)
                i, j = to, other_to
                continue
            left, right = ids[i:to], others[j:other_to]
            groups.append(f"{','.join(map(name, left))}|{','.join(map(name, right))}")
            if to - i == 1:
                x = left[0] * width
                links += [x + y for y in right]
            elif other_to - j == 1:
                y = right[0]
                links += [x * width + y for x in left]
            else:
                a = b = 0
                ahead = sizes[left[0]] - other_sizes[right[0]]  # no inner end is common: one is always ahead
                links.append(left[0] * width + right[0])
                while a + b < len(left) + len(right) - 2:
                    if ahead < 0:
                        a += 1
                        ahead += sizes[left[a]]
                    else:
                        b += 1
                        ahead -= other_sizes[right[b]]
                    links.append(left[a] * width + right[b])
            i, j = to, other_to
        return ";".join(groups), len(groups), links

    def _new(self, parts: list[str]) -> list[tuple | None]:
        """(groups, tokens of the first, of the second, groups, packed links) of stretches,
        each read after a space; None where the bytes do not come back."""
        if not parts:
            return []
        encoded = [e.ids for e in self.first.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        others = self.second.encode(parts, num_threads=1)
        data = [b" " + p.encode() for p in parts]
        same = self._come_back(encoded, self.first_bytes, data)
        same &= self._come_back(others, self.second_bytes, data)
        out: list[tuple | None] = []
        for ok, one, two in zip(same.tolist(), encoded, others):
            if ok:
                groups, n, links = self.align(one, two)
                out.append((groups, len(one), len(two), n, array("q", links).tobytes()))
            else:
                out.append(None)
        return out

    @staticmethod
    def _come_back(ids: list[list[int]], table: list[bytes], data: list[bytes]) -> np.ndarray:
        """Of which stretches the tokens give the bytes: all at once, else one by one."""
        made = [b"".join(map(table.__getitem__, x)) for x in ids]
        return np.ones(len(data), bool) if made == data else np.array([a == b for a, b in zip(made, data)])

    def align_all(self, texts: list[str | None]) -> list[list[tuple | None]]:
        """The stretches of each text."""
        cut = [([t] if self.whole else CUT.split(t)) if t else [] for t in texts]
        found, new, known, older = {}, [], self.known, self.older
        for part in set().union(*cut):
            made = known.get(part, 0) or older.get(part, 0)
            if made:
                found[part] = made
            else:
                new.append(part)
        found.update(zip(new, self._new(new)))
        known.update((p, made) for p, made in found.items() if made and len(p) <= SHORT)
        if len(known) > MEMORY // 2:  # what was met since the last time stays
            self.known, self.older = {}, known
        take = found.__getitem__
        return [list(map(take, parts)) for parts in cut]


@lru_cache(1)
def _aligner(first: bytes, second: bytes) -> Aligner:
    """One for all tasks of a worker, with what it remembers."""
    return Aligner(first, second)


SCHEMA = "kind int, id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, pairs array<{0}>, times array<bigint>"
TEXTS, COUNTS = 0, 1


def _counted(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the counts of equal pairs."""
    order = np.argsort(pairs, kind="stable")
    pairs, counts = pairs[order], counts[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], np.add.reduceat(counts, first) if len(first) else counts


def aligned(docs: DataFrame, first: bytes, second: bytes, digest: bool = False) -> DataFrame:
    """The alignment of every (id, text), and rows with the counts of pairs so far.

    Rows of kind 0 have the groups as text, or its SHA-256 where ``digest``, and the linked
    pairs with how often each occurs. Rows of kind 1 have pairs and in how many texts of
    the task they occur.
    """
    sent = docs.sparkSession.sparkContext.broadcast((first, second))  # two files, whatever the table
    aligner = Aligner(first, second)
    kind = "int" if len(aligner.first_bytes) * aligner.width < 1 << 31 else "bigint"
    number = pa.int32() if kind == "int" else pa.int64()
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def lists(values: np.ndarray, bounds: np.ndarray, of: pa.DataType) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values).cast(of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _aligner(*sent.value)
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def passed_on() -> pa.RecordBatch:
            nothing = [pa.nulls(1, t) for t in (*[pa.int64()] * 4, pa.string())]
            ends = np.array([0, len(pairs)])
            return pa.RecordBatch.from_arrays(
                [pa.array([COUNTS], pa.int32()), *nothing, lists(pairs, ends, number), lists(counts, ends, pa.int64())], names
            )

        for batch in batches:
            for part in runs_of(batch, "text", RUN_BYTES):
                texts = made.align_all(part.column("text").to_pylist())
                held, links, numbers = [], [], []
                for stretches in texts:
                    if not stretches or None in stretches:
                        stretches = []
                    groups = ";".join([s[0] for s in stretches])
                    held.append(hashlib.sha256(groups.encode()).hexdigest() if digest and groups else groups)
                    links.append(np.frombuffer(b"".join([s[4] for s in stretches]), np.int64))
                    numbers.append([sum([s[k] for s in stretches]) for k in (1, 2, 3)])
                size = np.array([len(x) for x in links])
                span = len(made.first_bytes) * made.width
                places = np.repeat(np.arange(len(links)), size) * span + np.concatenate(links)
                places, times = np.unique(places, return_counts=True)
                own = places % span
                bounds = np.searchsorted(places, np.arange(len(links) + 1) * span)
                columns = [pa.array(c, pa.int64()) for c in zip(*numbers)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(links), TEXTS, np.int32)), part.column("id"), *columns, pa.array(held, pa.string()),
                        lists(own, bounds, number), lists(times, bounds, pa.int64()),
                    ],
                    names,
                )
                pairs, counts = _counted(np.concatenate([pairs, own]), np.concatenate([counts, np.ones(len(own), np.int64)]))
                if len(pairs) > HELD:
                    yield passed_on()
                    pairs, counts = pairs[:0], counts[:0]
        if len(pairs):
            yield passed_on()

    return docs.select("id", "text").mapInArrow(run, SCHEMA.format(kind))


def pair_counts(made: DataFrame, width: int) -> DataFrame:
    """(pair, n, best) of all texts."""
    seen = made.filter(F.col("kind") == COUNTS).select(F.explode(F.arrays_zip("pairs", "times")).alias("c"))
    counts = seen.groupBy(F.col("c.pairs").alias("pair")).agg(F.sum("c.times").alias("n"))
    # A group is the pairs of one id of the first vocabulary, at most as many as the second has ids.
    own = Window.partitionBy(F.floor(F.col("pair") / width))
    return counts.withColumn("best", F.col("n") == F.max("n").over(own))


def scored(made: DataFrame, counts: DataFrame, sent: int = SENT) -> DataFrame:
    """Kind 0 rows with ``n_best`` and ``count_sum`` instead of the pairs."""
    texts = made.filter(F.col("kind") == TEXTS).drop("kind")
    plain = texts.drop("pairs", "times").withColumn("n_links", F.lit(0).cast("bigint"))
    if counts.count() > sent:
        return _scored_by_join(texts, counts)
    table = counts.orderBy("pair").toPandas()
    shared = made.sparkSession.sparkContext.broadcast(
        (table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64), table["best"].to_numpy(bool))
    )
    schema = plain.schema.add("n_best", "long").add("count_sum", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            own = batch.column("pairs")
            bounds = np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False)
            at = np.searchsorted(known, own.flatten().to_numpy(zero_copy_only=False))
            sums = []
            for values in (times, times * best[at], times * n[at]):
                total = np.concatenate([[0], np.cumsum(values)])
                sums.append(pa.array(np.diff(total[bounds]), pa.int64()))
            kept = [batch.column(name) for name in schema.names[:-3]]
            yield pa.RecordBatch.from_arrays([*kept, *sums], schema.names)

    return texts.mapInArrow(run, schema)


def _scored_by_join(texts: DataFrame, counts: DataFrame) -> DataFrame:
    rows = texts.withColumn("row", F.monotonically_increasing_id())
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("c")).select("row", F.col("c.pairs").alias("pair"), "c.times")
    # A pair that most texts hold is split by adaptive execution.
    sums = links.join(counts.hint("merge"), "pair").groupBy("row").agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    found = rows.drop("pairs", "times").join(sums, "row", "left").drop("row")
    return found.fillna(0, ["n_links", "n_best", "count_sum"])


def align_texts(docs: DataFrame, key: str, text: str, first: bytes, second: bytes, digest: bool = False, sent: int = SENT) -> DataFrame:
    """(key, n_a, n_b, n_groups, groups, n_links, n_best, count_sum) of every row."""
    docs = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    made = cut_lineage(aligned(docs, first, second, digest), "token-alignment")
    width = Aligner(first, second).width
    counts = cut_lineage(pair_counts(made, width), "token-pairs")
    return scored(made, counts, sent).withColumnRenamed("id", key)


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = []
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(public_tokenizers.path(name), "rb") as file:
            files.append(file.read())
    found = align_texts(read(spark, sf_dir, "documents"), "doc_id", "text", *files, digest=True)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
