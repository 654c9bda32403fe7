"""Language of words and documents by a linear-chain conditional random field.

Every word of a text is labelled with a language. A word's features are its affixes
of one to three letters, its letter pairs and triples with word borders, and itself
where it is in the lexicon, the frequent words of the sample. Transitions between the
labels of neighbouring words are learned with the feature weights by gradient ascent on
the conditional likelihood; the training sequence strings stretches of documents in
hash order, so that the borders between them are the language switches. Texts are
labelled by exact forward-backward over whole texts. A document's language is the one
with the highest mean probability over its words, and that mean is its score.

Learning reads only text and language, of at most ``PER_LANGUAGE`` different texts per
language, those with the smallest hashes, ``WORDS_EACH`` words of each from a place that
follows from its hash.

Defined cases: a text that is null or has no letter is ``und`` with score 0; where no row
is labelled every text is ``und``; ties go to the language first in alphabetical
order; repeated rows give repeated results; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowscribe.llm.batches import in_small_batches, runs_of
from rowscribe.llm.chain import Adam, pair_counts, posteriors, scaled, sum_rows
from rowscribe.llm.draws import smallest_places
from rowscribe.llm.registry import query, read

PER_LANGUAGE = 200
WORDS_EACH = 100
LEXICON = 300  # words per language
ROUNDS = 40
PENALTY = 0.05
MEMORY = 100_000  # words kept per task
RUN_BYTES = 1_000_000  # text worked on at a time
UNKNOWN = "und"

LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def features(word: str, lexicon: frozenset[str] | set[str]) -> list[str]:
    out = ["*"]
    for n in (1, 2, 3):
        if len(word) >= n:
            out.append("<" + word[:n])
            out.append(">" + word[-n:])
    edged = f"^{word}$"
    for n in (2, 3):
        out += [edged[i : i + n] for i in range(len(edged) - n + 1)]
    if word in lexicon:
        out.append("=" + word)
    return out


def train(stretches: list[tuple[str, list[str]]]) -> dict | None:
    """Fit the field to (language, words), in the order in which they are strung."""
    stretches = [(lang, words) for lang, words in stretches if words]
    if not stretches:
        return None
    langs = sorted({lang for lang, _ in stretches})
    k = len(langs)
    number = {lang: i for i, lang in enumerate(langs)}
    common = {lang: Counter() for lang in langs}
    for lang, words in stretches:
        common[lang].update(words)
    lexicon = {w for c in common.values() for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]}
    types = sorted({w for _, words in stretches for w in words})
    place = {w: i for i, w in enumerate(types)}
    found = [features(w, lexicon) for w in types]
    kept = sorted(f for f, n in Counter(f for fs in found for f in set(fs)).items() if n > 1 or f[0] in "*=")
    rank = {f: i for i, f in enumerate(kept)}
    rows = [[rank[f] for f in fs if f in rank] for fs in found]
    lengths = np.array([len(r) for r in rows])
    flat = np.array([i for r in rows for i in r])
    sequence = np.array([place[w] for _, words in stretches for w in words])
    labels = np.array([number[lang] for lang, words in stretches for _ in words])
    index = np.ones(len(sequence), np.int64)
    index[0] = 0
    weights = Adam(np.zeros((len(kept), k)), 0.1)
    moves = Adam(np.zeros((k, k)), 0.1)
    seen = np.zeros((len(types), k))
    np.add.at(seen, (sequence, labels), 1)
    moved = np.zeros((k, k))
    np.add.at(moved, (labels[:-1], labels[1:]), 1)
    start = np.full((k, k), 1.0 / k)
    owner = np.repeat(np.arange(len(types)), lengths)
    scale = 1.0 / len(sequence)
    for _ in range(ROUNDS):
        emission = scaled(sum_rows(weights.weights, flat, lengths))[sequence]
        stack = np.stack([start, np.exp(moves.weights)])
        label, forward, backward = posteriors(emission, index, stack)
        expected = np.stack([np.bincount(sequence, label[:, j], len(types)) for j in range(k)], 1)
        gap = (seen - expected)[owner]
        gradient = np.stack([np.bincount(flat, gap[:, j], len(kept)) for j in range(k)], 1)
        pairs = pair_counts(emission, index, stack, forward, backward)[1]
        weights.ascend(scale * (gradient - PENALTY * weights.weights))
        moves.ascend(scale * (moved - pairs - PENALTY * moves.weights))
    return {"langs": langs, "lexicon": sorted(lexicon), "features": kept, "weights": weights.weights, "moves": moves.weights}


class Tagger:
    """Labels texts with a trained field."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        k = len(self.langs)
        self.lexicon = set(model["lexicon"])
        self.rank = {f: i for i, f in enumerate(model["features"])}
        self.weights = model["weights"]
        self.stack = np.stack([np.full((k, k), 1.0 / k), np.exp(model["moves"])])
        self.known: dict[str, int] = {}
        self.scores = np.empty((0, k))

    def _emissions(self, words: list[str]) -> np.ndarray:
        if len(self.known) > MEMORY:
            self.known, self.scores = {}, self.scores[:0]
        known, rank = self.known, self.rank
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            rows = [[rank[f] for f in features(w, self.lexicon) if f in rank] for w in new]
            scores = sum_rows(self.weights, np.array([i for r in rows for i in r]), np.array([len(r) for r in rows]))
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.scores = np.concatenate([self.scores, scaled(scores)])
        return self.scores[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def label(self, texts: list[str | None]) -> list[tuple[str, float, np.ndarray | None]]:
        """(language, score, probabilities per word) of each text."""
        found = [words_of(t) for t in texts]
        found = [w if any(c.isalpha() for x in w for c in x) else [] for w in found]
        out: list[tuple[str, float, np.ndarray | None]] = [(UNKNOWN, 0.0, None)] * len(texts)
        some = [i for i, w in enumerate(found) if w]
        if not some:
            return out
        lengths = np.array([len(found[i]) for i in some])
        starts = np.concatenate([[0], np.cumsum(lengths)])
        index = np.ones(starts[-1], np.int64)
        index[starts[:-1]] = 0
        labels, _, _ = posteriors(self._emissions([w for i in some for w in found[i]]), index, self.stack)
        means = np.add.reduceat(labels, starts[:-1], axis=0) / lengths[:, None]
        best = means.argmax(1)
        for at, i in enumerate(some):
            score = min(1.0, float(means[at, best[at]]))
            out[i] = (self.langs[best[at]], score, labels[starts[at] : starts[at + 1]])
        return out


def training_rows(rows: DataFrame, text: str, lang: str) -> DataFrame:
    """``_lang``, ``_words``, ``_place`` of the bounded sample of labelled rows."""
    place = F.xxhash64(F.col(text), F.col(lang))
    labelled = rows.filter(F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}")).select(
        F.col(text).alias("_text"), F.col(lang).alias("_lang"), place.alias("_place")
    )
    # One threshold per language, for each of which the model will hold weights. Texts are
    # compared with the thresholds in place and are not shuffled.
    drawn = smallest_places(in_small_batches(labelled), PER_LANGUAGE, "_lang")

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, places = [], batch.column("_place").to_pylist()
            for text, place in zip(batch.column("_text").to_pylist(), places):
                found = words_of(text)
                at = place % max(1, len(found) - WORDS_EACH + 1)
                words.append(found[at : at + WORDS_EACH])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_lang"), pa.array(words, pa.list_(pa.string())), batch.column("_place")], ["_lang", "_words", "_place"]
            )

    cut = drawn.select("_lang", "_text", "_place").mapInArrow(stretch, "_lang string, _words array<string>, _place bigint")
    return cut.filter(F.size("_words") > 0)


def fit(rows: DataFrame, text: str, lang: str) -> dict | None:
    """A model from the labelled ones of ``rows``; None where there are none."""
    sample = training_rows(rows, text, lang).collect()
    sample.sort(key=lambda r: (r["_place"], r["_lang"], r["_words"]))
    return train([(r["_lang"], r["_words"]) for r in sample])


def label_documents(docs: DataFrame, text: str, model: dict | None) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and the number of words whose label differs from the
    word before, ``n_switches``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    made = ("lang_pred", "score", "n_switches")
    plain = docs.drop(*made)
    schema = StructType(plain.schema.fields[:]).add("lang_pred", "string").add("score", "double").add("n_switches", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(sent.value) if sent.value else None
        for batch in batches:
            for part in runs_of(batch, text, RUN_BYTES):
                texts = part.column(text).to_pylist()
                found = tagger.label(texts) if tagger else [(UNKNOWN, 0.0, None)] * len(texts)
                turns = [0 if p is None else int(np.count_nonzero(np.diff(p.argmax(1)))) for _, _, p in found]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(turns, pa.int64())],
                    schema.names,
                )

    return in_small_batches(plain).mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning, by its id."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit_documents(docs: DataFrame) -> dict | None:
    return fit(docs.filter(~held_out(F.col("doc_id"))), "text", "lang")


@query("op5_language_crf")
def op5_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit_documents(docs.select("doc_id", "text", "lang"))
    labelled = label_documents(docs.select("doc_id", "text"), "text", model)
    return labelled.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_switches")
