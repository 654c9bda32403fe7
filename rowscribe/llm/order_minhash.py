"""Near-duplicate texts by Order MinHash with banded alignment.

A text is the sequence of its shingles of five words; a shingle that occurs again carries
its occurrence number. Each of ``SKETCHES`` hash functions takes the ``TOGETHER`` labelled
shingles with the smallest hashes and keeps them in the order of the text, so a sketch
is equal only where the same shingles stand in the same order, which follows the edit
similarity rather than the overlap of sets. Texts with an equal sketch are candidates.

Candidates are verified by banded alignment of their shingle sequences: with M shingles
matched in order, the similarity is 2 M / (length + length), the edit similarity with
insertions and deletions, and pairs of at least ``SIMILAR`` are linked. More insertions
or deletions than the band's width already rule a pair out, so nothing is lost by it.

Texts of the same words are one class, known by a digest of their words, and stand once in
the candidate search. Within a bucket of up to ``SMALL`` classes all pairs are candidates.
In a larger bucket every class is a candidate with the bucket's shortest. Once these pairs
are verified and joined to groups, the classes that are not in the group of their bucket's
first are cut at random into parts of about ``PART``, and all pairs of a part are candidates.
What is left, pairs of a large bucket that are still in different groups, is searched
exactly: texts over the threshold share at least a proportion ``LEAST`` of the longer one's
shingles, hence one among the rarest of both, and meet there. Shingles of a single group
come first in that order and never travel as pairs.
All linked texts form one group, named by its smallest id.

Defined cases: null and empty texts and texts without a word stand alone and are kept; a
text of fewer than five words is one shingle; texts equal but for case, punctuation and
white space are equal; rows that repeat an id with another text are documents of their
own; rows that repeat both are one document and are kept or not together; a null id takes
part and names a group only where all its ids are null; an empty table gives no rows;
other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowscribe.llm.batches import runs_of
from rowscribe.llm.components import connected_components
from rowscribe.llm.registry import query, read
from rowscribe.session import cut_lineage

WORDS = 5  # per shingle
SIMILAR = 0.8
LEAST = SIMILAR / (2 - SIMILAR)  # of a text's shingles are matched in one as similar; of lengths, the smallest ratio
SKETCHES = 12
TOGETHER = 2  # shingles per sketch
SMALL = 24
PART = 8  # classes of a part of a large bucket
MEMORY = 150_000  # words kept per task
RUN = 4 << 20  # bytes of word numbers whose shingles are made at once

WORD = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)
SEEDS = np.random.default_rng(5).integers(1, 2**63, SKETCHES).astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX2
    x = (x ^ (x >> np.uint64(27))) * MIX
    return x ^ (x >> np.uint64(30))


class _Words(dict):
    """64-bit numbers of words; emptied when full, which changes no number."""

    def __missing__(self, word: str) -> int:
        number = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) >= MEMORY:
            self.clear()
        if len(word) <= 64:
            self[word] = number
        return number


def word_numbers(text: str | None, numbers: _Words) -> np.ndarray:
    words = WORD.findall(text.lower()) if text else []
    return np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray) -> np.ndarray:
    """A number per run of five words; one for all words where there are fewer."""
    width = min(WORDS, len(words))
    out = np.zeros(len(words) - width + 1 if width else 0, np.uint64)
    for j in range(width):
        out = (out + words[j : len(words) - width + 1 + j]) * MIX
        out ^= out >> np.uint64(29)
    return out


def labelled(kmers: np.ndarray) -> np.ndarray:
    """The shingles, told apart by how often each stood before."""
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    again = np.concatenate([[False], ranked[1:] == ranked[:-1]])
    if not again.any():
        return kmers
    place = np.arange(len(kmers))
    start = np.maximum.accumulate(np.where(again, 0, place))
    out = kmers.copy()
    out[order] += (place - start).astype(np.uint64) * MIX2
    return out


def sketch(words: np.ndarray) -> np.ndarray:
    """The order sketches of a text with at least one word."""
    kmers = labelled(shingles(words))
    n = len(kmers)
    out = np.empty(SKETCHES, np.uint64)
    step = SKETCHES if n < 50_000 else 1
    for at in range(0, SKETCHES, step):
        hashes = _mixed(kmers[None, :] ^ SEEDS[at : at + step, None])
        taken = np.argpartition(hashes, TOGETHER - 1, axis=1)[:, :TOGETHER] if n > TOGETHER else np.tile(np.arange(n), (step, 1))
        value = SEEDS[at : at + step].copy()
        for column in np.sort(taken, axis=1).T:
            value = _mixed(value + kmers[column])
        out[at : at + step] = value
    return out.astype(np.int64)


def alignment(a: np.ndarray, b: np.ndarray) -> int:
    """How many shingles match in order within the band; 0 where too few can."""
    need = SIMILAR * (len(a) + len(b)) / 2 - 1e-9
    band = int((len(a) + len(b)) * (1 - SIMILAR) + 1e-9)
    if abs(len(a) - len(b)) > band:
        return 0
    short = min(len(a), len(b))
    same = a[:short] == b[:short]
    head = short if same.all() else int(same.argmin())
    tail = 0
    if head < short:
        same = a[len(a) - short + head :][::-1] == b[len(b) - short + head :][::-1]
        tail = len(same) if same.all() else int(same.argmin())
    left = a[head : len(a) - tail].tolist()
    places: dict[int, list[int]] = {}
    for i, x in enumerate(left):
        places.setdefault(x, []).append(i)
    hits = [(j, places[x]) for j, x in enumerate(b[head : len(b) - tail].tolist()) if x in places]
    if head + tail + len(hits) < need:
        return 0
    full = (1 << len(left)) - 1
    free = full  # bit i is cleared where the longest match grows at place i
    for j, found in hits:
        match = 0
        for i in found:
            if -band <= i - j <= band:
                match |= 1 << i
        taken = free & match
        free = ((free + taken) | (free - taken)) & full
    return head + tail + len(left) - free.bit_count()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two word sequences, by their shingles."""
    x, y = shingles(a), shingles(b)
    return 2 * alignment(x, y) / (len(x) + len(y)) if len(x) and len(y) else 0.0


def document_mark(key: Column, text: Column) -> Column:
    """A digest that tells documents apart, by id and text."""
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in (key, text)]
    return F.md5(F.concat(parts[0], F.lit(" "), parts[1]))


def _sketched(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Words()
        for batch in batches:
            same, sizes, found = [], [], []
            for text in batch.column("text"):
                words = word_numbers(text.as_py(), numbers)
                same.append(hashlib.md5(words.tobytes()).hexdigest() if len(words) else None)
                sizes.append(len(words))
                found.append(sketch(words) if len(words) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("mark"), pa.array(same, pa.string()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                ["id", "mark", "same", "size", "sketches"],
            )

    return docs.mapInArrow(run, "id bigint, mark string, same string, size bigint, sketches array<bigint>")


def _all_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs of the members of small buckets."""
    members = buckets.groupBy("bucket").agg(F.sort_array(F.collect_list("rep")).alias("m"))
    pairs = F.flatten(
        F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    )
    return members.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def buckets_of(classes: DataFrame) -> DataFrame:
    """(rep, size, bucket) of (rep, size, sketches)."""
    return classes.select("rep", "size", F.explode("sketches").alias("bucket")).distinct()


def with_leads(rows: DataFrame) -> DataFrame:
    """(rep, size, bucket, n, lead) of the buckets with two classes or more: their number and
    the class of fewest words. Where texts have a passage in common, each is as similar to
    the shortest of them as to any other of at least its length."""
    least = F.min(F.struct("size", "rep"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), least.alias("least")).filter("n > 1")
    return rows.join(sizes.select("bucket", "n", F.col("least.rep").alias("lead")), "bucket")


def candidates(sized: DataFrame) -> DataFrame:
    """Pairs (a < b) to compare: all of a small bucket, of a large one each with its lead."""
    star = sized.filter((F.col("n") > SMALL) & (F.col("rep") != F.col("lead")))
    star = star.select(F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b"))
    return _all_pairs(sized.filter(F.col("n") <= SMALL)).union(star).distinct()


def unsettled(sized: DataFrame, groups: DataFrame) -> DataFrame:
    """(rep, size, bucket) of the classes of large buckets that are not in their lead's group."""
    named = lambda name: groups.select(F.col("id").alias(name), F.col("component").alias(f"g_{name}"))
    rows = sized.filter(F.col("n") > SMALL).join(named("rep"), "rep", "left").join(named("lead"), "lead", "left")
    return rows.filter(F.coalesce("g_rep", "rep") != F.coalesce("g_lead", "lead")).select("rep", "size", "bucket")


def scattered(sized: DataFrame) -> DataFrame:
    """Pairs (a < b) of buckets cut at random into parts of about ``PART`` classes, of each
    part all pairs: where many pairs of a bucket are links, these hold most of it together."""
    part = F.pmod(F.xxhash64("bucket", "rep"), F.ceil(F.col("n") / PART))
    return _all_pairs(sized.select("rep", F.xxhash64("bucket", part).alias("bucket"))).distinct()


def _shingled(texts: DataFrame) -> DataFrame:
    """The labelled shingles of (rep, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs_of(batch, "words", RUN):
                kmers = [labelled(shingles(np.frombuffer(w.as_py(), np.uint64))).astype(np.int64) for w in part.column("words")]
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(kmers, pa.list_(pa.int64()))], ["rep", "kmers"])

    return texts.select("rep", "words").mapInArrow(run, "rep bigint, kmers array<bigint>")


def _grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows with the group ``g`` of their class."""
    return rows.join(groups.withColumnRenamed("id", "rep"), "rep", "left").withColumn("g", F.coalesce("component", "rep")).drop("component")


def crossing_shingles(crowded: DataFrame, groups: DataFrame, words: DataFrame) -> DataFrame:
    """(rep, n, kmer) of the classes in large buckets of more than one group. ``groups`` has
    (id, component) of linked classes, ``words`` (id, words) of all classes of large buckets."""
    placed = _grouped(crowded.select("rep", "bucket"), groups)
    mixed = placed.groupBy("bucket").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo < hi").select("bucket")
    members = placed.join(mixed, "bucket", "left_semi").select("rep").distinct()
    texts = _shingled(words.withColumnRenamed("id", "rep").join(members.hint("merge"), "rep"))
    return texts.select("rep", F.size("kmers").alias("n"), F.explode("kmers").alias("kmer"))


def rare_shingles(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(kmer, g, rep, n, rest): of the shingles that occur in several groups those that a
    text over the threshold with another one must have one of, and how many shingles the
    text has from there on in the order of rarity."""
    rows = _grouped(rows, groups)
    kinds = rows.groupBy("kmer").agg(F.count("*").alias("often"), (F.min("g") < F.max("g")).alias("crosses"))
    rarest = Window.partitionBy("rep").orderBy("crosses", "often", "kmer")
    # Shingles a pair has in common stand at or after the first of them in that order, so
    # both have at least as many from there on as must be matched.
    ranked = rows.join(kinds, "kmer").withColumn("rest", F.col("n") - F.row_number().over(rarest) + 1)
    reach = F.col("rest") >= F.col("n") * LEAST - 1e-9
    return ranked.filter(reach & F.col("crosses")).select("kmer", "g", "rep", "n", "rest")


def _enough() -> Column:
    return F.least("rest_a", "rest_b") >= (F.col("n_a") + F.col("n_b")) * (SIMILAR / 2) - 1e-9


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def pairs_apart(early: DataFrame) -> DataFrame:
    """Pairs (a < b) of texts in different groups that can reach the threshold: every such
    pair over it is among them."""
    held = early.groupBy("kmer", "g").agg(F.min("n").alias("n"), F.max("rest").alias("rest"))
    side = lambda of, name: of.select("kmer", *(F.col(c).alias(f"{c}_{name}") for c in of.columns if c != "kmer"))
    meet = side(held, "a").join(side(held, "b"), "kmer").filter((F.col("g_a") < F.col("g_b")) & _enough()).drop("n_a", "rest_a")
    meet = meet.join(side(early, "a"), ["kmer", "g_a"]).filter(_enough()).drop("n_b", "rest_b")
    return _ordered(meet.join(side(early, "b"), ["kmer", "g_b"]).filter(_enough()))


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("words_a"), batch.column("words_b")):
                kept.append(similarity(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= SIMILAR - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.select("a", "b", "words_a", "words_b").mapInArrow(run, "a bigint, b bigint")


def _numbered(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Words()
        for batch in batches:
            words = [word_numbers(t.as_py(), numbers).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words, pa.binary())], ["id", "words"])

    return docs.select("id", "text").mapInArrow(run, "id bigint, words binary")


def near_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id, kept, mark, wordless) of every row; ``kept`` marks the document that
    stays of its group, and ``mark`` is its ``document_mark``."""
    docs = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    docs = docs.withColumn("mark", document_mark(F.col("id"), F.col("text")))
    sketched = cut_lineage(_sketched(docs), "omh-sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("late"), "id", "mark"))
    classes = sketched.filter("same is not null").groupBy("same").agg(first.alias("first"), F.first("size").alias("size"), F.first("sketches").alias("sketches"))
    classes = cut_lineage(classes.withColumn("rep", F.monotonically_increasing_id()), "omh-classes")
    sized = cut_lineage(with_leads(buckets_of(classes)), "omh-sized")
    # Sort-merge joins at every size: texts meet classes, whose number grows with the table.
    wanted = classes.select("rep", F.col("first.mark").alias("mark")).join(sized.select("rep").distinct().hint("merge"), "rep", "left_semi")
    chosen = docs.select("mark", "text").join(wanted.hint("merge"), "mark").dropDuplicates(["rep"])
    words = cut_lineage(_numbered(chosen.withColumnRenamed("rep", "id")), "omh-words")
    side = lambda name: words.select(F.col("id").alias(name), F.col("words").alias(f"words_{name}")).hint("merge")
    verified = lambda pairs: cut_lineage(_verified(pairs.join(side("b"), "b").join(side("a"), "a")), "omh-links")

    links = verified(candidates(sized))
    groups = connected_components(links)
    again = cut_lineage(with_leads(unsettled(sized, groups)), "omh-unsettled")
    links = links.union(verified(scattered(again)))
    groups = connected_components(links)
    rows = cut_lineage(crossing_shingles(sized.filter(F.col("n") > SMALL), groups, words), "omh-shingles")
    early = cut_lineage(rare_shingles(rows, groups), "omh-rarest")
    links = links.union(verified(cut_lineage(pairs_apart(early), "omh-apart")))
    groups = connected_components(links)

    placed = classes.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("same", "first", F.coalesce("component", "rep").alias("g"))
    lead = placed.groupBy("g").agg(F.min("first").alias("lead"))
    named = placed.join(lead, "g").select("same", "lead")
    found = sketched.select("id", "mark", "same").join(named, "same", "left")
    alone = F.col("same").isNull()
    return found.select(
        F.col("id").alias(key), F.when(alone, F.col("id")).otherwise(F.col("lead.id")).alias("class_id"),
        (alone | (F.col("mark") == F.col("lead.mark"))).alias("kept"), "mark", alone.alias("wordless"),
    )


@query("op1_order_minhash")
def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "class_id", "kept")
