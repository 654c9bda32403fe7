"""The prefix trie of conversations, a balanced-parentheses sequence per shard.

A conversation is a path of turns, each known by a 128-bit digest of role and text, so
texts stay where they are. Paths are sorted and cut into shards of about ``TURNS`` turns;
equal paths are ordered by conversation, so a path that very many share is cut as well.
A task writes its shard's trie as parentheses, one pair per node in the order of the
paths. Blocks of the running excess keep its least and greatest value, and a tree over
the blocks finds the closing parenthesis that ends a subtree (``Parens.findclose``). What
a subtree holds is then a difference of two places: of the rank of "()" pairs for
childless nodes, and of cumulative arrays for members and savings.

Only the first and the last path of a shard, its spines, can also occur in other shards.
All other nodes are finished in their shard; what hangs off a spine goes on as one row
of sums per spine. These rows are paths again and are put through the same step, where
nodes of equal paths merge, until one shard is left; every step leaves two paths of a
shard and at most a quarter of the shards. Finished nodes below a spine learn the
spine's number by their own shard, so a parent with very many children is no hot key.

The digest of the conversations that end at a node is taken in its shard, or, for a
spine, by one task that streams the shards' pieces in order, as SHA-256 demands; a piece
holds the numbers of up to ``PIECE`` conversations.

Defined cases: rows without a conversation number belong to none and are left out; null
roles and texts are empty; a null turn stands first, and turns of equal number stand in
the order of their digests; a turn that is repeated counts again; an empty table gives no
rows, not even a root; other columns are left out. One conversation's digests, 24 bytes a
turn, make one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscribe.llm.registry import query, read
from rowscribe.session import bucket_count, cut_lineage

TURNS = 200_000  # of a shard
BLOCK = 64  # parentheses per block
PIECE = 10_000
FAMILY = 100  # neighbouring numbers whose conversations begin alike
HEADS = 6  # beginnings of 0 to 5 turns
NOTHING = hashlib.sha256(b"").hexdigest()
SUMS = ("ends", "members", "saved", "leaves", "children")  # what a spine's node carries on, beside the least conversation


class Parens:
    """A balanced-parentheses sequence with range min-max excess blocks."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        blocks = -(-len(bits) // BLOCK)
        padded = np.full(blocks * BLOCK, self.excess[-1] if len(bits) else 0)
        padded[: len(bits)] = self.excess
        self.padded = padded
        low = padded.reshape(blocks, BLOCK).min(axis=1)
        high = padded.reshape(blocks, BLOCK).max(axis=1)
        self.levels = [(low, high)]
        while len(low) > 1:
            if len(low) % 2:
                low, high = np.append(low, low[-1]), np.append(high, high[-1])
            low, high = low.reshape(-1, 2).min(axis=1), high.reshape(-1, 2).max(axis=1)
            self.levels.append((low, high))

    def _holds(self, level: int, node: np.ndarray, value: np.ndarray) -> np.ndarray:
        low, high = self.levels[level]
        inside = node < len(low)
        node = np.minimum(node, len(low) - 1)
        return inside & (low[node] <= value) & (value <= high[node])

    def _scan(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The first place from ``at`` to the end of its block with that excess, or -1."""
        out, at = np.full(len(at), -1), at.copy()
        left = np.arange(len(at))
        stop = (at // BLOCK + 1) * BLOCK
        while len(left):
            hit = self.padded[at[left]] == value[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return out

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one."""
        value = self.excess[opens] - 1
        out = np.full(len(opens), -1)
        inner = np.flatnonzero((opens + 1) % BLOCK)
        out[inner] = self._scan(opens[inner] + 1, value[inner])
        far = np.flatnonzero(out < 0)
        node, found, at_level = opens[far] // BLOCK + 1, np.full(len(far), -1), np.zeros(len(far), np.int64)
        left = np.arange(len(far))
        for level in range(len(self.levels)):
            for right in (False, True):  # the node itself, then its right neighbour of the same parent
                here = left[node[left] % 2 == 0] if right else left
                asked = node[here] + right
                hit = self._holds(level, asked, value[far[here]])
                found[here[hit]], at_level[here[hit]] = asked[hit], level
                left = left[found[left] < 0]
            node[left] = node[left] // 2 + 1
        for level in range(len(self.levels) - 1, 0, -1):
            down = np.flatnonzero(at_level == level)
            first = found[down] * 2
            found[down] = np.where(self._holds(level - 1, first, value[far[down]]), first, first + 1)
            at_level[down] = level - 1
        out[far] = self._scan(found * BLOCK, value[far])
        return out


def _range_min(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The least of ``values[start:stop]`` of each range, none of them empty."""
    out = np.empty(len(start), np.int64)
    power = np.log2(stop - start).astype(np.int64)
    table, width = values, 1
    for k in range(int(power.max()) + 1):
        mine = power == k
        out[mine] = np.minimum(table[start[mine]], table[stop[mine] - width])
        table, width = np.minimum(table[:-width], table[width:]) if len(table) > width else table, width * 2
    return out


def _before(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


class Trie:
    """The trie of sorted paths. ``halves`` are the turns' digests as two numbers each,
    ``lens`` their code points, ``bounds`` the ends of the paths in both."""

    def __init__(self, halves: np.ndarray, lens: np.ndarray, bounds: np.ndarray):
        size = np.diff(bounds)
        n = len(size)
        depth_of = np.arange(len(lens)) - np.repeat(bounds[:-1], size)
        prior = np.concatenate([[0], size[:-1]])
        same = depth_of < np.repeat(prior, size)
        partner = np.repeat(np.concatenate([[0], bounds[:-2]]), size) + depth_of
        partner[~same] = 0
        same &= (halves[partner] == halves).all(axis=1)
        unlike = np.where(same, np.iinfo(np.int64).max, depth_of)
        shared = size.copy()
        full = np.flatnonzero(size)
        if len(full):
            shared[full] = np.minimum(size[full], np.minimum.reduceat(unlike, bounds[:-1][full]))
        new = size - shared
        fresh = depth_of >= np.repeat(shared, size)
        self.ends = np.cumsum(new)  # the node at which each path ends
        self.depth = np.concatenate([[0], depth_of[fresh] + 1])
        self.lens = np.concatenate([[0], lens[fresh]])
        self.turn = np.concatenate([[-1], np.flatnonzero(fresh)])
        runs = np.empty(2 * n, np.int64)
        runs[0::2], runs[1::2] = prior - shared, new  # closed before, then opened
        inner = np.repeat(np.tile(np.array([False, True]), n), runs)
        bits = np.concatenate([[True], inner, np.zeros(size[-1] + 1, bool)])
        self.parens = Parens(bits)
        self.opens = np.flatnonzero(bits)
        self.closes = self.parens.findclose(self.opens)
        self.stop = _before(bits)[self.closes + 1]  # by rank; a subtree is the nodes up to here
        self.order = np.argsort(self.depth, kind="stable")
        self.place = self.depth[self.order] * len(bits) + self.order
        self.parent = self.on_path(np.arange(len(self.depth)), self.depth - 1)
        self.parent[0] = -1

    def on_path(self, node: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The ancestor of each node, or itself, at a depth."""
        return self.order[np.searchsorted(self.place, depth * len(self.parens.bits) + node, "right") - 1]

    def sum_below(self, values: np.ndarray) -> np.ndarray:
        total = _before(values)
        return total[self.stop] - total[: len(values)]

    def least_below(self, values: np.ndarray) -> np.ndarray:
        return _range_min(values, np.arange(len(values)), self.stop)

    def leaves_below(self, childless: np.ndarray) -> np.ndarray:
        """By rank over the "()" pairs whose node has no children elsewhere."""
        bits = self.parens.bits
        pair = np.zeros(len(bits), bool)
        pair[:-1] = bits[:-1] & ~bits[1:]
        pair[self.opens] &= childless
        rank = _before(pair)
        return rank[self.closes] - rank[self.opens]


NODE = (
    "kind int, shard bigint, key binary, conv_id bigint, depth bigint, parent_conv_id bigint, parent_key binary, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, mark bigint, piece string, "
    "path array<binary>, lens array<bigint>, at array<bigint>, keys array<binary>, least array<bigint>, "
    + ", ".join(f"{name} array<bigint>" for name in SUMS)
)
FINISHED, SPINE, PIECES = 0, 1, 2
LISTS = {"path": pa.binary(), "keys": pa.binary(), **dict.fromkeys(("lens", "at", "least", *SUMS), pa.int64())}
TYPES = {"kind": pa.int32(), "key": pa.binary(), "parent_key": pa.binary(), "ends_sha256": pa.string(), "piece": pa.string()}
NAMES = [field.split()[0] for field in NODE.split(", ")]


def _table(rows: int, **columns) -> pa.RecordBatch:
    arrays = []
    for name in NAMES:
        kind = pa.list_(LISTS[name]) if name in LISTS else TYPES.get(name, pa.int64())
        arrays.append(pa.array(columns[name], kind) if name in columns else pa.nulls(rows, kind))
    return pa.RecordBatch.from_arrays(arrays, NAMES)


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _nodes_of(batches: list[pa.RecordBatch], shard: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Finished nodes of one shard, its two spines, and pieces of the numbers that end on them."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    column = lambda name: rows.column(name).combine_chunks()
    path = column("path")
    digests = path.flatten().to_pylist()
    halves = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2)
    size = path.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = _before(size)
    lens = column("lens").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    mark = column("mark").to_numpy(zero_copy_only=False)
    trie = Trie(halves, lens, bounds)
    n = len(trie.depth)
    sums = {name: np.zeros(n, np.int64) for name in SUMS}
    least = np.full(n, np.iinfo(np.int64).max)
    conversations = column("at").null_count == len(rows)
    if conversations:
        np.add.at(sums["ends"], trie.ends, 1)
        np.minimum.at(least, trie.ends, mark)
    else:
        counts = column("at").value_lengths().to_numpy(zero_copy_only=False)
        up = trie.on_path(np.repeat(trie.ends, counts), column("at").flatten().to_numpy(zero_copy_only=False))
        for name, into in sums.items():
            np.add.at(into, up, column(name).flatten().to_numpy(zero_copy_only=False))
        np.minimum.at(least, up, column("least").flatten().to_numpy(zero_copy_only=False))

    members = trie.sum_below(sums["ends"] + sums["members"])
    children = np.bincount(trie.parent[1:], minlength=n) + sums["children"]
    leaves = trie.leaves_below(sums["children"] == 0) + trie.sum_below(sums["leaves"])
    saved = trie.sum_below((members - 1) * trie.lens + sums["saved"])
    smallest = trie.least_below(least)

    spine = np.zeros(n, bool)
    chains = []
    if not last:
        chain, v = [], int(trie.ends[-1])
        while v > size[0]:  # the first path made the nodes up to its length
            chain.append(v)
            v = int(trie.parent[v])
        chains = [(0, list(range(size[0] + 1))), (len(size) - 1, chain[::-1])]
        for _, nodes in chains:
            spine[nodes] = True
    keys: dict[int, bytes] = {-1: b""}
    for v in np.flatnonzero(spine).tolist() if conversations else range(n):
        turn = digests[trie.turn[v]] if v else b""
        keys[v] = hashlib.sha256(keys[int(trie.parent[v])] + turn).digest()[:16]

    shas = None
    if conversations:
        shas = np.full(n, NOTHING, object)
        cuts = np.flatnonzero(np.diff(trie.ends, prepend=-1, append=-1)).tolist()
        found: dict[str, list] = {"key": [], "mark": [], "piece": []}
        for a, b in zip(cuts, cuts[1:]):
            v = int(trie.ends[a])
            if not spine[v]:
                shas[v] = hashlib.sha256(_joined(mark[a:b]).encode()).hexdigest()
                continue
            for at in range(a, b, PIECE):
                found["key"].append(keys[v])
                found["mark"].append(int(mark[at]))
                found["piece"].append(_joined(mark[at : min(b, at + PIECE)]))
        yield _table(len(found["key"]), kind=[PIECES] * len(found["key"]), **found)

    done = np.flatnonzero(~spine)
    above = trie.parent[done]
    below = (above >= 0) & spine[above]
    for start in range(0, len(done), 100_000):
        part = slice(start, start + 100_000)
        v, up, on_spine = done[part], above[part], below[part]
        named = {"ends_sha256": shas[v].tolist()} if conversations else {"key": [keys[x] for x in v.tolist()]}
        yield _table(
            len(v), kind=np.full(len(v), FINISHED), shard=np.full(len(v), shard), conv_id=smallest[v], depth=trie.depth[v],
            parent_conv_id=pa.array(smallest[up], pa.int64(), mask=on_spine | (up < 0)),
            parent_key=[keys[x] if s else None for x, s in zip(up.tolist(), on_spine.tolist())],
            n_convs=members[v], n_children=children[v], n_leaves=leaves[v], saved_tokens=saved[v], **named,
        )
    if last:
        return
    hanging = done[below]
    top = trie.parent[hanging]
    own = {name: sums[name].copy() for name in SUMS}
    np.add.at(own["members"], top, members[hanging])
    np.add.at(own["saved"], top, saved[hanging])
    np.add.at(own["leaves"], top, leaves[hanging])
    np.add.at(own["children"], top, 1)
    np.minimum.at(least, top, smallest[hanging])
    for i, (row, nodes) in enumerate(chains):
        if nodes:
            a, b = bounds[row], bounds[row + 1]
            yield _table(
                1, kind=[SPINE], shard=[shard], mark=[2 * shard + i], path=[digests[a:b]], lens=[lens[a:b].tolist()],
                at=[trie.depth[nodes].tolist()], keys=[[keys[v] for v in nodes]], least=[least[nodes].tolist()],
                **{name: [own[name][nodes].tolist()] for name in SUMS},
            )


def _shards(rows: DataFrame, count: int) -> DataFrame:
    """The nodes, spines and pieces of ``rows``, in shards of neighbouring paths."""
    last = count == 1
    dealt = rows.repartition(1) if last else rows.repartitionByRange(count, "path", "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _nodes_of(held, TaskContext.get().partitionId(), last)

    return cut_lineage(dealt.sortWithinPartitions("path", "mark").mapInArrow(run, NODE), "trie-shards")


RESULT = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
INPUT = ["path", "lens", "mark", "at", "least", *SUMS]


def _merged(made: DataFrame, count: int, turns: int) -> DataFrame:
    """All nodes of the shards; those that were on a spine carry their key."""
    done = made.filter(F.col("kind") == FINISHED)
    spines = made.filter(F.col("kind") == SPINE)
    held = spines.agg(F.sum(F.size("path"))).first()[0]
    if held is None:  # a single shard, or no rows
        return done.select(RESULT)
    fewer = max(1, min(ceil(held / turns), count // 4))
    upper = _merged(_shards(spines.select(INPUT), fewer), fewer, turns)
    if fewer > 1:
        upper = cut_lineage(upper, "trie-spines")
    numbers = upper.select("key", F.col("conv_id").alias("number"))
    local = spines.select("shard", F.explode("keys").alias("key")).join(numbers, "key")
    local = local.select("shard", F.col("key").alias("parent_key"), "number")
    below = done.filter("parent_key is not null").drop("parent_conv_id").join(local, ["shard", "parent_key"])
    below = below.withColumnRenamed("number", "parent_conv_id")
    return done.filter("parent_key is null").select(RESULT).union(below.select(RESULT)).union(upper.select(RESULT))


def _pieces_hashed(pieces: DataFrame) -> DataFrame:
    """(key, sha) of the numbers of each key, streamed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], ["key", "sha"])
        for batch in batches:
            for k, piece in zip(batch.column("key"), batch.column("piece")):
                if k.as_py() != key:
                    if key is not None:
                        yield out()
                    key, sha = k.as_py(), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(piece.as_py().encode())
        if key is not None:
            yield out()

    return pieces.repartition("key").sortWithinPartitions("key", "mark").select("key", "piece").mapInArrow(run, "key binary, sha string")


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turn, digest and code points of each turn, in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = F.struct(
        F.col("turn").cast("bigint").alias("turn"), F.unhex(F.substring(digest, 1, 32)).alias("digest"),
        F.char_length(text).cast("bigint").alias("length"),
    )
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) of conversations that take their first turns, up to five by the
    checksum of their number, from the first conversation of their hundred."""
    lists = cut_lineage(turn_lists(conversations), "trie-turns")
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = lists.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return lists.withColumn("first", first).join(heads, "first", "left").select("conv_id", F.concat(head, own).alias("turns"))


def trie_nodes(lists: DataFrame, turns: int = TURNS) -> DataFrame:
    """One row per node of the trie of (conv_id, turns), in shards of about ``turns`` turns."""
    empty = [F.lit(None).cast("array<bigint>").alias(name) for name in ("at", "least", *SUMS)]
    path, lens = F.transform("turns", lambda t: t["digest"]), F.transform("turns", lambda t: t["length"])
    rows = cut_lineage(lists.select(path.alias("path"), lens.alias("lens"), F.col("conv_id").alias("mark")), "trie-paths")
    held = rows.agg(F.sum(F.size("path"))).first()[0] or 0
    count = max(bucket_count(rows.sparkSession), ceil(held / turns))
    made = _shards(rows.select("*", *empty), count)
    hashed = _pieces_hashed(made.filter(F.col("kind") == PIECES))
    nodes = _merged(made, count, turns)
    inner = nodes.filter("key is null")
    spines = nodes.filter("key is not null").drop("ends_sha256").join(hashed, "key", "left")
    spines = spines.withColumn("ends_sha256", F.coalesce("sha", F.lit(NOTHING)))
    return inner.select(RESULT[1:]).union(spines.select(RESULT[1:]))


SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (
           PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))
         ) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT conv_id, xor(4294967295::BIGINT, list_reduce(
           list_concat([4294967295::BIGINT], flatten(list_transform(
             string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, e: CASE WHEN e >= 0 THEN xor(a, e)
                             ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END) END)) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), taken AS (
  SELECT h.conv_id, 0 AS part, k, role, text FROM heads h JOIN turns t ON t.conv_id = h.conv_id - h.conv_id % 100 AND k <= h
  UNION ALL
  SELECT h.conv_id, 1, k, role, text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND k > h
), paths AS (
  SELECT conv_id, coalesce(path, []) AS path
  FROM heads LEFT JOIN (
    SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY part, k) AS path FROM taken GROUP BY conv_id
  ) USING (conv_id)
), steps AS (
  SELECT conv_id AS member, len(path) AS total, path, unnest(range(0, len(path) + 1)) AS depth FROM paths
), prefixes AS (
  SELECT member, total, depth, path[1:depth] AS prefix FROM steps
), found AS (
  SELECT prefix, depth, min(member) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(member::VARCHAR, ',' ORDER BY member) FILTER (total = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY prefix, depth
), nodes AS (
  SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(prefix[depth].text) END AS own FROM found
), lines AS (
  SELECT p.member, p.depth, n.conv_id FROM prefixes p JOIN nodes n USING (prefix, depth)
), parents AS (
  SELECT n.conv_id, n.depth, l.conv_id AS parent FROM nodes n LEFT JOIN lines l ON l.member = n.conv_id AND l.depth = n.depth - 1
), counted AS (
  SELECT n.*, p.parent, (SELECT count(*) FROM parents c WHERE c.parent = n.conv_id AND c.depth = n.depth + 1) AS n_children
  FROM nodes n JOIN parents p ON p.conv_id = n.conv_id AND p.depth = n.depth
), below AS (
  SELECT l.conv_id, l.depth, sum(c.own) AS saved, count(*) FILTER (c.n_children = 0) AS leaves
  FROM counted c JOIN lines l ON l.member = c.conv_id AND l.depth <= c.depth GROUP BY l.conv_id, l.depth
)
SELECT c.conv_id, c.depth, parent AS parent_conv_id, n_convs, n_children, leaves AS n_leaves,
       saved::BIGINT AS saved_tokens, ends_sha256
FROM counted c JOIN below b ON b.conv_id = c.conv_id AND b.depth = c.depth
"""


@query("op11_conversation_trie", SQL)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(rebuilt(read(spark, sf_dir, "conversations")))
