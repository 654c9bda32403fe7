"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give the base spans: e-mail addresses, IP addresses, card numbers and phone
numbers. The field adds spans that the patterns miss. Its nodes are a document's marks,
the stretches between white space that hold a digit or an at sign; every mark is
labelled with a kind or with none. Chain edges join neighbouring marks, with transition
weights by the number of words between them. Skip edges join a mark to the last one
before it that is equal or similar (the same token, local part or digits), however far
apart, with a potential for equal labels. Repeats are nodes too: stretches that are no
marks themselves but equal the local part of one, such as a handle or a name without a
digit. A skip edge joins each to the last such mark before it, or else to the first one
after it; a repeat is in no chain and has no scores of its own. The label of a mark
with repeats is known where a base span overlaps it. Beliefs are found by loopy message passing:
exact forward-backward along the chains and messages over the skip edges in turn, until
they settle or for ``SWEEPS`` rounds. So a handle or a number that stands once in a
clear form is found in its other places too.

Learning needs no labels but the base spans: of at most ``SAMPLE`` different texts with a
mark, those with the smallest hashes, ``MARKS_EACH`` marks each, the chain weights are fitted by gradient ascent on the
conditional likelihood, and the skip potential from how often skip edges join equal
labels (piecewise training). Repeats take no part in it, since the patterns never label
one. Prediction takes all marks and repeats of whole texts.

Defined cases: a null or empty text has no spans; equal marks in one document are linked
one after the other, so a mark that occurs n times has n - 1 edges; stretches are
compared in lower case and without punctuation at their ends; added spans never
overlap base spans; repeated rows give repeated results; an empty table gives no
rows; other columns pass through.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowscribe.llm.batches import in_small_batches, runs_of
from rowscribe.llm.chain import Adam, pair_counts, posteriors, scaled, sum_rows
from rowscribe.llm.draws import by_place, smallest_places
from rowscribe.llm.registry import query, read

SAMPLE = 1500
MARKS_EACH = 100
ROUNDS = 60
PENALTY = 0.05
SWEEPS = 20
SETTLED = 1e-4
RUN_BYTES = 2_000_000  # text worked on at a time

# The base patterns, in the order of their kinds.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

HIT = re.compile(r"[0-9@]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
SPACES = re.compile(r"\s")
TOKEN = re.compile(r"\S+")
EDGE = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, by kind and start."""
    out = []
    at = text.find("@")
    last = 0
    while at >= 0:  # the leftmost match with this at sign starts where its local part does
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            last = match.end()
            out.append(("email", start, last))
        at = text.find("@", max(at + 1, last))
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def marks(text: str) -> list[tuple[int, int, int]]:
    """(start, end, words since the mark before) of the stretches with a digit or an at sign."""
    out = []
    end = 0
    hit = HIT.search(text)
    while hit:
        start = hit.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        stop = SPACES.search(text, hit.end())
        stop = stop.start() if stop else len(text)
        out.append((start, stop, len(text[end:start].split()) if out else 0))
        end = stop
        hit = HIT.search(text, end)
    return out


def keys_of(token: str) -> set[str]:
    """What equal or similar tokens share."""
    bare = token.strip(EDGE).lower()
    out = {"=" + bare} if len(bare) > 2 else set()
    local, at, _ = bare.partition("@")
    if at and len(local) > 2:
        out.add("=" + local)
    digits = NOT_DIGIT.sub("", bare)
    if len(digits) >= 6:
        out.add("#" + digits)
    return out


def repeats(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the stretches without a digit or an at sign that equal a key of a mark."""
    names = {k[1:] for a, b, _ in found for k in keys_of(text[a:b]) if k[0] == "=" and not HIT.search(k)}
    if not names:
        return []
    return [m.span() for m in TOKEN.finditer(text) if m[0].strip(EDGE).lower() in names]


def _shape(token: str) -> str:
    shape = re.sub(r"[0-9]+", "9", token)
    shape = re.sub(r"[^\W\d_]+", "a", shape)
    return shape[:16]


def features(token: str, before: str, after: str) -> list[str]:
    digits = len(NOT_DIGIT.sub("", token))
    bucket = digits if digits < 4 else 4 + digits // 4 if digits < 24 else 10
    return [
        "*",
        "shape " + _shape(token),
        "first " + token[0] if not token[0].isalnum() else "first a",
        f"digits {bucket}",
        f"dots {min(4, token.count('.'))}",
        f"at {'@' in token}",
        f"size {min(12, len(token) // 3)} {_shape(token)}",
        "before " + before,
        "after " + after,
    ]


def gap_class(words: int) -> int:
    return 1 if words == 0 else 2 if words < 4 else 3


class Document:
    """The marks of a text, and after them its repeats, as nodes of the field."""

    __slots__ = ("spans", "features", "index", "edges", "known")

    def __init__(self, text: str, found: list[tuple[int, int, int]], again: list[tuple[int, int]] = ()):
        tokens = [text[a:b] for a, b, _ in found]
        shapes = [_shape(t) for t in tokens]
        self.spans = [(a, b) for a, b, _ in found]
        self.index = [0] + [gap_class(g) for _, _, g in found[1:]]
        n = len(found)
        self.features = [
            features(
                tokens[i],
                shapes[i - 1] if i and self.index[i] == 1 else "-",
                shapes[i + 1] if i + 1 < n and self.index[i + 1] == 1 else "-",
            )
            for i in range(n)
        ]
        having: dict[str, list[int]] = {}  # the marks with a key
        edges = set()
        for i, token in enumerate(tokens):
            for key in keys_of(token):
                of = having.setdefault(key, [])
                if of:
                    edges.add((of[-1], i))
                of.append(i)
        for i, (start, end) in enumerate(again, n):
            of = having["=" + text[start:end].strip(EDGE).lower()]
            edges.add((of[max(0, bisect.bisect(of, start, key=lambda j: self.spans[j][0]) - 1)], i))
        self.known = [0] * (n + len(again))  # labels of marks with repeats, where base spans give them
        self.spans += again
        self.index += [0] * len(again)
        self.features += [[]] * len(again)
        self.edges = sorted(edges)


def labels_of(spans: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[int]:
    """The kind of the base span that each mark (by start) overlaps, as a number; 0 for none."""
    out = [0] * len(spans)
    for kind, start, end in base:
        i = bisect.bisect_right(spans, start, key=lambda s: s[1])
        while i < len(spans) and spans[i][0] < end:
            out[i] = out[i] or 1 + KINDS.index(kind)
            i += 1
    return out


def train(sample: list[tuple[list[list[str]], list[int], list[tuple[int, int]], list[int]]]) -> dict | None:
    """Fit the field to (features, transition classes, skip edges, labels) of documents."""
    sample = [s for s in sample if s[0]]
    if not sample:
        return None
    k = 1 + len(KINDS)
    counts = Counter(f for fs, *_ in sample for node in fs for f in set(node))
    kept = sorted(f for f, n in counts.items() if n > 2) or sorted(counts)
    rank = {f: i for i, f in enumerate(kept)}
    rows = [[rank[f] for f in node if f in rank] or [rank["*"]] if "*" in rank else [0] for fs, *_ in sample for node in fs]
    lengths = np.array([len(r) for r in rows])
    flat = np.array([i for r in rows for i in r])
    owner = np.repeat(np.arange(len(rows)), lengths)
    index = np.array([g for _, gs, _, _ in sample for g in gs])
    labels = np.array([y for *_, ys in sample for y in ys])
    truth = np.zeros((len(labels), k))
    truth[np.arange(len(labels)), labels] = 1
    moved = np.zeros((4, k, k))
    inner = np.flatnonzero(index > 0)
    np.add.at(moved, (index[inner], labels[inner - 1], labels[inner]), 1)
    weights, moves = Adam(np.zeros((len(kept), k)), 0.2), Adam(np.zeros((4, k, k)), 0.2)
    scale = 1.0 / len(labels)
    for _ in range(ROUNDS):
        stack = np.exp(moves.weights)
        stack[0] = 1.0 / k
        emission = scaled(sum_rows(weights.weights, flat, lengths))
        belief, forward, backward = posteriors(emission, index, stack)
        gap = (truth - belief)[owner]
        gradient = np.stack([np.bincount(flat, gap[:, j], len(kept)) for j in range(k)], 1)
        pairs = pair_counts(emission, index, stack, forward, backward)
        pairs[0] = moved[0] = 0
        weights.ascend(scale * (gradient - PENALTY * weights.weights))
        moves.ascend(scale * (moved - pairs - PENALTY * moves.weights))
    joined = [ys[i] == ys[j] for _, _, edges, ys in sample for i, j in edges]
    same = (9 + sum(joined)) / (10 + len(joined))  # as if nine in ten were known to agree
    stack = np.exp(moves.weights)
    stack[0] = 1.0 / k
    return {"features": kept, "weights": weights.weights, "stack": stack, "agree": same * (k - 1) / (1 - same)}


class Finder:
    """Finds the spans of texts with a trained field, or with the patterns alone."""

    def __init__(self, model: dict | None):
        self.model = model
        if model:
            self.rank = {f: i for i, f in enumerate(model["features"])}
            self.default = self.rank.get("*", 0)

    def beliefs(self, documents: list[Document]) -> np.ndarray:
        """Label probabilities of the documents' marks, one after the other."""
        model, rank = self.model, self.rank
        rows = [[rank[f] for f in node if f in rank] or [self.default] for d in documents for node in d.features]
        unary = scaled(sum_rows(model["weights"], np.array([i for r in rows for i in r]), np.array([len(r) for r in rows])))
        unary[[not node for d in documents for node in d.features]] = 1.0
        known = np.array([y for d in documents for y in d.known])
        unary[known > 0] = 1e-12
        unary[np.flatnonzero(known), known[known > 0]] = 1.0
        index = np.array([g for d in documents for g in d.index])
        starts = np.cumsum([0] + [len(d.index) for d in documents])
        edges = np.array([(s + i, s + j) for d, s in zip(documents, starts) for i, j in d.edges], np.int64).reshape(-1, 2)
        belief, _, _ = posteriors(unary, index, model["stack"])
        if not len(edges):
            return belief
        k = unary.shape[1]
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        half = len(edges)
        reverse = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        message = np.full((2 * half, k), 1.0 / k)
        for _ in range(SWEEPS):
            sent = np.maximum(belief[source] / message[reverse], 1e-12)
            new = sent.sum(1, keepdims=True) + (model["agree"] - 1) * sent
            new /= new.sum(1, keepdims=True)
            new = (new + message) / 2  # damped
            change = np.abs(new - message).max()
            message = new
            logs = np.zeros_like(unary)
            np.add.at(logs, target, np.log(message))
            belief, _, _ = posteriors(scaled(np.log(unary) + logs), index, model["stack"])
            if change < SETTLED:
                break
        return belief

    def find(self, texts: list[str | None]) -> list[list[tuple[str, int, int, bool]]]:
        """(kind, start, end, by a pattern) of each text's spans, by kind and start."""
        out = [[(*s, True) for s in base_spans(t)] if t else [] for t in texts]
        if not self.model:
            return out
        found = [marks(t) if t else [] for t in texts]
        some = [i for i, m in enumerate(found) if m]
        if not some:
            return out
        documents = [Document(texts[i], found[i], repeats(texts[i], found[i])) for i in some]
        for i, document in zip(some, documents):
            n = len(found[i])
            if n < len(document.spans):
                labels = labels_of(document.spans[:n], [s[:3] for s in out[i]])
                for a, b in document.edges:
                    if b >= n:
                        document.known[a] = labels[a]
        belief = self.beliefs(documents)
        label, sure = belief.argmax(1), belief.max(1) >= 0.5
        at = 0
        for i, document in zip(some, documents):
            n = len(document.spans)
            added = self._added(texts[i], document, label[at : at + n].tolist(), sure[at : at + n].tolist(), out[i])
            at += n
            if added:
                out[i] = sorted(out[i] + added, key=lambda s: (KINDS.index(s[0]), s[1]))
        return out

    @staticmethod
    def _added(text, document, label, sure, base) -> list[tuple[str, int, int, bool]]:
        covered = np.array(sorted((a, b) for _, a, b, _ in base)).reshape(-1, 2)
        out: list[list] = []
        joined = False
        for i, (start, end) in enumerate(document.spans):
            if label[i] and sure[i]:
                while end > start and text[end - 1] in EDGE:
                    end -= 1
                while start < end and text[start] in EDGE:
                    start += 1
                near = np.searchsorted(covered[:, 0], end) if len(covered) else 0
                free = start < end and not (near and (covered[:near, 1] > start).any())
                kind = KINDS[label[i] - 1]
                if free and joined and out and out[-1][0] == kind and document.index[i] == 1:
                    out[-1][2] = end
                elif free:
                    out.append([kind, start, end, False])
                joined = free
            else:
                joined = False
        return [tuple(s) for s in out]


def fit(docs: DataFrame, text: str) -> dict | None:
    """A field from a bounded sample of the different texts that hold a mark."""
    marked = docs.filter(F.col(text).rlike("[0-9@]")).select(F.col(text).alias("_text"), F.xxhash64(text).alias("_place"))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"_place": batch.column("_place").to_pylist(), "_features": [], "_index": [], "_edges": [], "_labels": []}
            for text in batch.column("_text").to_pylist():
                document = Document(text, marks(text)[:MARKS_EACH])
                rows["_features"].append(document.features)
                rows["_index"].append(document.index)
                rows["_edges"].append([list(e) for e in document.edges])
                rows["_labels"].append(labels_of(document.spans, base_spans(text)))
            kinds = (pa.int64(), pa.list_(pa.list_(pa.string())), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], list(rows))

    schema = "_place bigint, _features array<array<string>>, _index array<bigint>, _edges array<array<bigint>>, _labels array<bigint>"
    drawn = smallest_places(in_small_batches(marked), SAMPLE)
    sample = drawn.mapInArrow(nodes, schema).collect()
    sample.sort(key=lambda r: (by_place(r["_place"]), r["_features"]))
    return train([(r["_features"], r["_index"], r["_edges"], r["_labels"]) for r in sample])


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def find_spans(docs: DataFrame, text: str, model: dict | None, into: str = "spans") -> DataFrame:
    """Adds the spans of ``text``: kind, start, end (code points) and whether a pattern
    found it."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    plain = docs.drop(into)
    names = plain.columns
    schema = StructType(plain.schema.fields[:]).add(
        docs.sparkSession.createDataFrame([], f"{into} array<struct<kind:string,start:bigint,end:bigint,base:boolean>>").schema[into]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(sent.value)
        for batch in batches:
            for part in runs_of(batch, text, RUN_BYTES):
                spans = finder.find(part.column(text).to_pylist())
                found = [[dict(zip(("kind", "start", "end", "base"), s)) for s in of] for of in spans]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(SPAN))], [*names, into])

    return in_small_batches(plain).mapInArrow(run, schema)


def redact(docs: DataFrame, text: str, model: dict | None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets. Where
    spans of different kinds overlap, the stretch they cover is replaced once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(sent.value)
        for batch in batches:
            for part in runs_of(batch, text, RUN_BYTES):
                texts = part.column(text).to_pylist()
                made = [_replace(t, s) for t, s in zip(texts, finder.find(texts))]
                columns = [pa.array(made, pa.string()) if n == text else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    return in_small_batches(docs).mapInArrow(run, docs.schema)


def _replace(text: str | None, spans: list[tuple[str, int, int, bool]]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join(out) + text[at:]


@query("op8_skip_chain_pii")
def op8_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, "text", fit(docs, "text"), "found")
    base = F.filter("found", lambda s: s["base"])
    place = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(kind) for kind in KINDS), F.sha2(place(base).cast("binary"), 256).alias("base_sha256"), place("found").alias("spans")
    )
