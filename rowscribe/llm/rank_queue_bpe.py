"""Byte-level BPE over a rank queue of hierarchical bitmaps.

The merges of a pre-token wait in buckets, one per merge rank. A bitmap over the ranks
says which buckets hold anything; above it stand a bitmap of its words and a bitmap of
those, so the next rank is three find-first-set steps away whatever the pre-token's
length. A bucket holds positions of a linked list of parts, smallest first; an entry is
stale when its part is gone or pairs to another rank by now, and is skipped. A
pre-token of n bytes costs O(n log n), which also holds for one of millions of bytes.

Text is first cut at places where matches of the pattern are known to end, and each cut
is split by the pattern and encoded once per task: a bounded memory of cuts keeps the
ids of those seen. The memory only saves time; it is emptied when full.

Defined cases: a null text encodes as an empty text, to no ids; ids travel as packed
little-endian unsigned 32-bit integers; characters of any script and lone control
characters round-trip; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from rowscribe.llm.batches import in_small_batches, runs_of
from rowscribe.llm.registry import query, read

# White space as Unicode defines it, where no match of the pattern spans,
# and plain letters. A run of plain letters that no other letter follows is one match;
# what follows it is matched as if it stood alone, as the pattern never looks back.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LATIN = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
CUTS = re.compile(f" ?[{LATIN}]+(?![^\\W\\d_])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

MEMORY = 200_000  # cuts kept per task, besides those of the run at hand
RUN_BYTES = 1_500_000  # text worked on at a time
MERGE_BYTES = 300_000  # of pre-tokens merged side by side; a merge takes about a hundred times that


class RankQueue:
    """Positions by rank. ``top`` is 0 when nothing waits."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
            self.top |= 1 << (rank >> 12)
        else:
            heapq.heappush(bucket, position)

    def first(self) -> int:
        """The smallest rank that waits: three find-first-set steps."""
        high = (self.top & -self.top).bit_length() - 1
        word = (high << 6) + (self.mid[high] & -self.mid[high]).bit_length() - 1
        return (word << 6) + (self.low[word] & -self.low[word]).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """All positions of the smallest rank, which no longer waits."""
        word, high = rank >> 6, rank >> 12
        self.low[word] &= self.low[word] - 1
        if not self.low[word]:
            self.mid[high] &= self.mid[high] - 1
            if not self.mid[high]:
                self.top &= self.top - 1
        return self.buckets.pop(rank)

    def pop(self) -> tuple[int, int]:
        """The smallest rank and its smallest position."""
        rank = self.first()
        position = heapq.heappop(self.buckets[rank])
        if not self.buckets[rank]:
            self.take(rank)
        return rank, position


LONG = 256  # bytes from which a pre-token has a queue of its own


class _Numbers(dict):
    """Numbers cuts in the order in which they are met."""

    def __missing__(self, cut: str) -> int:
        self[cut] = number = len(self)
        return number


class Encoder:
    """Encodes texts by ranks: bytes of a token -> its id and merge priority.

    Pre-tokens share one queue, so that a bucket holds a rank's positions in all of
    them; of each pre-token only the first position is merged at a time. A long
    pre-token is merged alone, position by position.
    """

    def __init__(self, ranks: dict[bytes, int], pairs: tuple[np.ndarray, np.ndarray], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.cuts = _Numbers()
        self.packed: list[bytes] = []  # ids of each cut, by its number
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pair_keys, self.pair_ranks = pairs

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 where they do not merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1).astype(np.int32)

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks, queue = self.ranks, self.queue
        n = len(data)
        end = list(range(1, n + 1))  # end of the part that starts here, 0 when merged away
        before = list(range(-1, n - 1))
        pair = [-1] * n  # rank of the part and its successor
        for i in range(n - 1):
            rank = ranks.get(data[i : i + 2], -1)
            pair[i] = rank
            if rank >= 0:
                queue.push(rank, i)
        while queue.top:
            rank, i = queue.pop()
            if pair[i] != rank or not end[i]:
                continue  # stale
            gone = end[i]
            stop = end[gone]
            end[i], end[gone] = stop, 0
            if stop < n:
                before[stop] = i
                pair[i] = new = ranks.get(data[i : end[stop]], -1)
                if new >= 0:
                    queue.push(new, i)
            else:
                pair[i] = -1
            left = before[i]
            if left >= 0:
                pair[left] = new = ranks.get(data[left:stop], -1)
                if new >= 0:
                    queue.push(new, left)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[data[i : end[i]]])
            i = end[i]
        return ids

    def _push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        queue = self.queue
        for rank, position in zip(ranks.tolist(), positions.tolist()):
            bucket = queue.buckets.get(rank)
            if bucket is None:
                queue.push(rank, position)
            else:
                bucket.append(position)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of many pre-tokens, ``MERGE_BYTES`` of them at a time."""
        ends = np.cumsum([len(p) for p in pieces])
        bounds = np.unique(np.searchsorted(ends, np.arange(MERGE_BYTES, ends[-1], MERGE_BYTES))).tolist() if pieces else []
        return [ids for a, b in zip([0, *bounds], [*bounds, len(pieces)]) for ids in self._merge_together(pieces[a:b])]

    def _merge_together(self, pieces: list[bytes]) -> list[bytes]:
        lengths = np.array([len(p) for p in pieces], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(ids)
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        after[starts[1:] - 1] = -1
        before[starts[:-1]] = -1
        pair = np.full(n, -1, np.int32)
        inner = np.flatnonzero(after >= 0)
        pair[inner] = self._rank_of(ids[inner], ids[inner + 1])
        alive = np.ones(n, bool)
        waiting = np.flatnonzero(pair >= 0)
        self._push_all(pair[waiting], waiting)
        queue = self.queue
        while queue.top:
            rank = queue.first()
            at = np.array(queue.take(rank))
            at = at[pair[at] == rank]  # the others are stale
            if len(at) > 1:
                at = np.unique(at)
                owner = piece[at]
                first = np.concatenate([[True], owner[1:] != owner[:-1]])
                if not first.all():
                    for later in at[~first].tolist():
                        queue.push(rank, later)
                    at = at[first]
            if not len(at):
                continue
            gone = after[at]
            stop = after[gone]
            ids[at] = rank
            alive[gone] = False
            pair[gone] = -1
            after[at] = stop
            pair[at] = -1
            inside = stop >= 0
            left, right = at[inside], stop[inside]
            before[right] = left
            prior = before[at]
            has = prior >= 0
            left = np.concatenate([left, prior[has]])
            right = np.concatenate([right, at[has]])
            new = self._rank_of(ids[left], ids[right])
            pair[left] = new
            merges = new >= 0
            self._push_all(new[merges], left[merges])
        packed = ids[alive].astype("<u4")
        ends = np.concatenate([[0], np.cumsum(alive)])[starts] * 4
        data, bounds = packed.tobytes(), ends.tolist()
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]

    def _packed(self, cuts: list[str]) -> list[bytes]:
        """Packed ids of different cuts."""
        split = [[c] if c.removeprefix(" ").isalpha() else self.split(c) for c in cuts]
        new = {p: p.encode() for pieces in split for p in pieces}
        short = [p for p, b in new.items() if len(b) < LONG]
        ids = dict(zip(short, self.merge_all([new[p] for p in short])))
        for p in new.keys() - ids.keys():
            ids[p] = np.array(self.merge(new[p]), "<u4").tobytes()
        return [b"".join([ids[p] for p in pieces]) for pieces in split]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.cuts) > MEMORY:
            self.cuts, self.packed = _Numbers(), []
        number = self.cuts.__getitem__
        # a text is held as the numbers of its cuts: each cut is kept once
        found = [np.array([number(c) for c in CUTS.findall(t or "")], np.int32) for t in texts]
        self.packed += self._packed(list(islice(self.cuts, len(self.packed), None)))
        ids = self.packed.__getitem__
        return [b"".join(map(ids, numbers.tolist())) for numbers in found]


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ids that merge, packed and sorted, and the rank of each."""
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    keys = np.array(sorted(pairs), np.int64)
    return keys, np.array([pairs[k] for k in keys.tolist()], np.int64)


class Decoder:
    """Bytes of packed ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token_of = {i: t for t, i in ranks.items()}

    def decode_all(self, packed: list[bytes | None]) -> list[bytes]:
        token_of = self.token_of.__getitem__
        return [b"".join(map(token_of, np.frombuffer(v or b"", "<u4").tolist())) for v in packed]


def _add_binaries(df: DataFrame, source: str, names: list[str], start) -> DataFrame:
    """``df`` with binary columns made from ``source``; ``start()`` gives, once per task,
    the function from values to a list of values per column."""
    plain = df.drop(*names)
    schema = StructType(plain.schema.fields[:])
    for name in names:
        schema = schema.add(name, BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = start()
        for batch in batches:
            for part in runs_of(batch, source, RUN_BYTES):
                made = convert(part.column(source).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(m, pa.binary()) for m in made)], schema.names)

    return in_small_batches(plain).mapInArrow(run, schema)


def _sent(df: DataFrame, ranks: dict[bytes, int]):
    """The ranks and their pairs on the executors: as large as the vocabulary, whatever
    the table."""
    return df.sparkSession.sparkContext.broadcast((ranks, pair_table(ranks)))


def encode(df: DataFrame, text: str, ranks: dict[bytes, int], pattern: str, into: str = "ids_le") -> DataFrame:
    """Adds the packed ids of ``text``."""
    sent = _sent(df, ranks)

    def start():
        encoder = Encoder(*sent.value, pattern)
        return lambda texts: [encoder.encode_all(texts)]

    return _add_binaries(df, text, [into], start)


def decode(df: DataFrame, ids: str, ranks: dict[bytes, int], into: str = "decoded") -> DataFrame:
    """Adds the bytes that packed ids stand for; null ids decode to no bytes."""
    sent = _sent(df, ranks)

    def start():
        decoder = Decoder(sent.value[0])
        return lambda packed: [decoder.decode_all(packed)]

    return _add_binaries(df, ids, [into], start)


def encode_and_decode(
    df: DataFrame, text: str, ranks: dict[bytes, int], pattern: str, into: str = "ids_le", back: str = "decoded"
) -> DataFrame:
    """Adds the packed ids of ``text`` and the bytes decoded from them, in one pass."""
    sent = _sent(df, ranks)

    def start():
        encoder, decoder = Encoder(*sent.value, pattern), Decoder(sent.value[0])

        def both(texts):
            packed = encoder.encode_all(texts)
            return [packed, decoder.decode_all(packed)]

        return both

    return _add_binaries(df, text, [into, back], start)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id with the digests of the ids and of the text decoded from them."""
    made = encode_and_decode(docs.select("doc_id", "text"), "text", load_ranks(path), pattern)
    return made.select(
        "doc_id",
        (F.octet_length("ids_le") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op7_rank_queue_bpe")
def op7_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
