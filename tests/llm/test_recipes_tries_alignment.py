"""Chunk recipes, the conversation trie and token alignment against brute force, with edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from rowscribe.llm.chunk_recipes import LONGEST, SHORTEST, chunks, equal_texts, normalise
from rowscribe.llm.conversation_trie import Parens, Trie, rebuilt, trie_nodes, turn_lists
from rowscribe.llm.token_alignment import Aligner, align_texts

BLANKS = re.compile(rb"[\x20\x09-\x0D]+")


def test_chunks_follow_the_content():
    random = np.random.default_rng(1)
    for _ in range(300):
        text = bytes(random.choice(list(b"ab \t\n\r\x0b\x0c\x1c\xc2\xa0"), random.integers(0, 40)).tolist())
        assert normalise(text) == BLANKS.sub(b" ", text)
    body = random.integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    for text in (b"", b"a", body, b"z" * 100_000, body[: 1 << 18] * 9):
        parts = chunks(text)
        assert b"".join(parts) == text and all(SHORTEST <= len(p) <= LONGEST for p in parts[:-1])
    moved = set(chunks(b"some words before " + body))
    assert len(moved & set(chunks(body))) > 0.9 * len(chunks(body))  # all but the first few


@pytest.mark.parametrize("key_bits", [64, 3])  # with 3, unlike chunks share their keys
def test_equal_texts_against_brute_force(spark, key_bits):
    random = np.random.default_rng(2)
    passage = " ".join(f"w{x}" for x in random.integers(0, 999, 2000))
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a\x0cb", " a b", "a b", passage, passage + ".", passage.replace(" ", "\n"), passage[:-1]]
    texts += [passage[i : i + 600] for i in (0, 0, 1)] + ["copy"] * 40 + ["z" * 50_000, "z" * 50_000, "z" * 50_001]
    ids = list(range(100, 100 + len(texts)))
    ids[20] = ids[21] = 7  # of equal ids one row stays
    ids[22] = ids[4] = None
    rows = [(i, t, "x", "y", 1, [2]) for i, t in zip(ids, texts)] + [(None, "no id", "x", "y", 1, [2])] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id string, row string, group_size int, keys array<int>")
    found = equal_texts(docs, "doc_id", "text", key_bits).collect()
    plain = [BLANKS.sub(b" ", (r[1] or "").encode()) for r in rows]
    groups = defaultdict(list)
    for text, row in zip(plain, rows):
        groups[text].append(row[0])
    want = Counter()
    for text, row in zip(plain, rows):
        known = [i for i in groups[text] if i is not None]
        want[row[0], min(known, default=None), len(groups[text]), hashlib.sha256(text).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == want
    stay = Counter(r["text_sha256"] for r in found if r["kept"])
    assert set(stay.values()) == {1} and len(stay) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])
    assert equal_texts(docs.limit(0), "doc_id", "text").count() == 0


def test_find_close():
    random = np.random.default_rng(3)
    for _ in range(60):
        paths = sorted(tuple(random.integers(0, random.integers(1, 4), random.choice([0, 2, 9, 200]))) for _ in range(random.integers(1, 50)))
        flat = np.array([x for p in paths for x in p], np.uint64)
        trie = Trie(np.stack([flat, flat], 1), np.ones(len(flat), np.int64), np.cumsum([0, *map(len, paths)]))
        nodes = sorted({p[:d] for p in paths for d in range(len(p) + 1)})
        assert trie.depth.tolist() == list(map(len, nodes))
        assert trie.stop.tolist() == [i + sum(q[: len(p)] == p for q in nodes) for i, p in enumerate(nodes)]
        assert trie.parent.tolist() == [nodes.index(p[:-1]) if p else -1 for p in nodes]
    deep = Parens(np.array([True] * 5000 + [False] * 5000))
    assert deep.findclose(np.arange(5000)).tolist() == list(range(9999, 4999, -1))


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            order = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            turns[conv].append(((turn is not None, turn or 0), order, role, text))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        paths[c] = tuple(turns.get(base, [])[:h]) + tuple(own[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    out = set()
    for node, ms in members.items():
        below = [q for q in members if q[: len(node)] == node]
        childless = lambda q: not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)
        ends = sorted(c for c in ms if len(paths[c]) == len(node))
        out.add((
            min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms),
            sum(len(q) == len(node) + 1 for q in below), sum(map(childless, below)),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("turns", [200_000, 40, 4])  # of a shard; with 4, spines merge in several steps
def test_trie_against_brute_force(spark, turns):
    random = np.random.default_rng(4)
    rows = []
    for c in [*range(60), *range(95, 130), 300, -7, -100, -203]:
        if c == 100:
            continue  # a family without its first conversation
        hot = c % 3 == 0  # a third of all conversations are the same
        for t in range(4 if hot else random.integers(1, 9)):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", f"same {t}" if hot else "é" * int(random.integers(0, 3))))
    rows += [(1, None, "user", "first"), (1, 2, "user", "tie"), (1, 2, "user", "tie"), (2, 1, None, None), (200, None, None, ""), (201, 0, "a", "b")]
    rows += [(301, t, "u", "deep") for t in range(300)] + [(302, t, "u", "deep") for t in range(250)]
    rows += [(None, 0, "user", "lost")]
    schema = "conv_id bigint, turn bigint, role string, text string, path string, mark string, turns string"
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema).repartition(3)
    nodes = trie_nodes(rebuilt(table), turns)
    assert nodes.columns == TRIE
    found = [tuple(r) for r in nodes.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_trie(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert trie_nodes(rebuilt(empty)).count() == 0
    one = spark.createDataFrame([(100, 0, "u", "x")], empty.schema)
    assert trie_nodes(turn_lists(one)).count() == 2


@pytest.fixture(scope="module")
def files():
    out = []
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(public_tokenizers.path(name), "rb") as file:
            out.append(file.read())
    return out


ODD = [
    None, "", " ", "\n", " lead", "trail ", "a  b", "x▁y", "<|endoftext|> <s> </s> hi", "<0x41>", "tab\tx \n y", "\x00 a \x01", "é" * 50,
    "漢字 仮名 \U0001f600 \U0001f469‍\U0001f469‍\U0001f467", "z" * 3000, "a ᠎ b", "a\u0085 b \x1c c", "don't we'll 's", "…", "ﬁ ½", "İ ǅ",
]


def spans(ids, data):
    ends = np.cumsum([len(data[i]) for i in ids]).tolist()
    return list(zip([0, *ends], ends))


def brute_alignment(text, first, second, aligner):
    """Groups and pairs of a text, from whole encodings and all pairs of ranges."""
    left, right = first.encode(" " + (text or ""), add_special_tokens=False).ids, second.encode(text or "")
    whole = (" " + (text or "")).encode()
    sides = [(left, aligner.first_bytes), (right, aligner.second_bytes)]
    if not text or any(b"".join(data[i] for i in ids) != whole for ids, data in sides):
        return [], [], [], Counter()
    at, other = spans(*sides[0]), spans(*sides[1])
    common = sorted({e for _, e in at} & {e for _, e in other})
    groups = [
        ",".join(str(x) for x, (a, b) in zip(left, at) if s <= a and b <= e) + "|" + ",".join(str(x) for x, (a, b) in zip(right, other) if s <= a and b <= e)
        for s, e in zip([0, *common], common)
    ]
    return left, right, groups, Counter((x, y) for x, (a, b) in zip(left, at) for y, (c, d) in zip(right, other) if a < d and c < b)


@pytest.mark.parametrize("sent", [4_000_000, 0])  # counts to every task, then by a join
def test_alignment_against_brute_force(spark, sf_dir, files, sent):
    first = tokenizers.Tokenizer.from_str(files[0].decode())
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    aligner = Aligner(*files)
    docs = [r["text"][:1500] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    texts = [*ODD, *docs, docs[0], docs[0]]
    rows = [(i if i else None, t, "x", "y", "z") for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, id string, pairs string, row string")
    whole = [brute_alignment(t, first, second, aligner) for t in texts]
    counts = Counter(p for *_, links in whole for p in links)
    highest = Counter()
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    found = {r["doc_id"]: r for r in align_texts(table, "doc_id", "text", *files, sent=sent).collect()}
    assert len(found) == len(texts)
    for (i, *_), (left, right, groups, links) in zip(rows, whole):
        r = found[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["groups"]) == (len(left), len(right), len(groups), ";".join(groups))
        assert r["n_links"] == sum(links.values()) and r["count_sum"] == sum(n * counts[p] for p, n in links.items())
        assert r["n_best"] == sum(n for p, n in links.items() if counts[p] == highest[p[0]])
    digests = {r["doc_id"]: r["groups"] for r in align_texts(table, "doc_id", "text", *files, digest=True, sent=sent).collect()}
    for (i, *_), (*_, groups, _) in zip(rows, whole):
        assert digests[i] == (hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
    assert align_texts(table.limit(0), "doc_id", "text", *files).count() == 0
